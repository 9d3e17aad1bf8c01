"""Line dedup through sharded minimal perfect hashes.

Pass 1 counts, for each distinct line key, the documents that hold it (128-bit hashes, counted in each task before the
shuffle, so a line of every document travels once a task). Keys that reach ``min_docs`` are dealt by hash into shards of
bounded size; each shard becomes a minimal perfect hash over its keys, which indexes an array of 64-bit fingerprints and
an array of counts. Pass 2 streams the documents and probes these arrays: no line is joined and no text is shuffled.

Arrays of at most ``most_bytes`` are broadcast. Larger ones never meet the driver: each executor lays them out in one file,
which its workers map and probe, so that one pass over the documents does however many frequent lines there are. Keys
that decide nothing (below ``min_docs``) are left out of the arrays.

Defined results: a null text is one empty line; keys shorter than ``min_chars`` code points never go; repeated rows are
documents of their own; texts and lines of any length are taken whole; an empty table gives an empty table; clashing column names are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.common import columns_of, in_batches, laid_out, map_rows, named, shared_folder, small_batches, stored, stored_rows, without

BLANK = b" \t\n\x0b\x0c\r"
#: Keys of one shard, at most about this many.
SHARD_KEYS = 200_000


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes.lower() changes A-Z alone


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode()) >= least)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over unsigned keys."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: at each level keys that fall alone on a bit keep it, the rest go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bits of each level, as 64-bit words
        self.ranks, before = [], 0
        for words in levels:
            n = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(before + np.cumsum(n) - n)
            before += int(n.sum())
        self.size = before

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        levels, left = [], np.asarray(keys, np.uint64)
        while len(left):
            m = (int(len(left) * gamma) // 64 + 1) * 64
            at = mix(left, len(levels)) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at.astype(np.int64)]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key from 0 on, -1 if it can't be one of the keys; other keys may get any place."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = mix(keys[left], k) % np.uint64(len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit], bit[hit]
            out[left[hit]] = ranks[w] + np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
            left = left[~hit]
        return out


def build_shard(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[list[bytes], bytes, bytes]:
    """The levels of the hash over hi, the fingerprints lo and the counts, each in the order of the hash."""
    mph = PerfectHash.build(hi)
    at = mph.index(hi)
    prints, counts = np.zeros(len(hi), np.uint64), np.zeros(len(hi), np.uint64)
    prints[at], counts[at] = lo, n
    return [w.tobytes() for w in mph.levels], prints.tobytes(), counts.tobytes()


class Shards:
    """Shards as they are probed: (hash, fingerprints, counts) by number, some numbers with several of them."""

    def __init__(self, shards: dict[int, list[tuple[PerfectHash, np.ndarray, np.ndarray]]], total: int):
        self.shards, self.total = shards, total

    @classmethod
    def of(cls, rows: Iterable[tuple[int, list[bytes], bytes, bytes]], total: int) -> Shards:
        out: dict = {}
        for k, levels, p, c in rows:
            out.setdefault(k, []).append((PerfectHash([np.frombuffer(x, np.uint64) for x in levels]), np.frombuffer(p, np.uint64), np.frombuffer(c, np.uint64)))
        return cls(out, total)

    def counts(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The documents of each key, 0 where it isn't in these shards."""
        out = np.zeros(len(hi), np.int64)
        of = ((hi >> np.uint64(40)) % np.uint64(self.total)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(self.total + 1)) if self.total < len(hi) else None
        for k in range(self.total) if first is not None else np.unique(of).tolist():
            mine = order[first[k] : first[k + 1]] if first is not None else np.flatnonzero(of == k)
            for mph, prints, n in self.shards.get(k, ()) if len(mine) else ():
                at = mph.index(hi[mine])
                known = (at >= 0) & (prints[at] == lo[mine])
                out[mine[known]] = n[at[known]]
        return out


class Laid:
    """Arrays in one file of an executor; index: for each shard its number, and the bytes of each level, the fingerprints and the counts."""

    def __init__(self, index: list[tuple[int, int, list[int], int]], files: list[str], total: int):
        self.files, self.total, self.name = files, total, f"driftloom-lines-{uuid.uuid4().hex}"
        self.index, at = {}, 0
        for k, nth, levels, size in index:
            self.index[k, nth] = (at, levels, size)
            at += sum(levels) + 2 * size
        self.size = at

    def mapped(self) -> Shards:
        def write(f) -> None:
            for k, nth, levels, p, c in stored_rows(self.files, ["shard", "nth", "levels", "prints", "counts"]):
                f.seek(self.index[k, nth][0])
                f.write(b"".join([*levels, p, c]))

        data, out = np.memmap(laid_out(self.name, self.size, write), np.uint64, "r"), {}
        for (k, _), (at, levels, size) in self.index.items():
            parts = np.split(data[at // 8 : (at + sum(levels) + 2 * size) // 8], np.cumsum([*levels, size]) // 8)
            out.setdefault(k, []).append((PerfectHash(parts[: len(levels)]), parts[-2], parts[-1]))
        return Shards(out, self.total)


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def line_counts(df: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """(hi, lo, n): the documents that hold each line key."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            raw = np.frombuffer(b"".join(seen), ">i8").astype(np.int64).reshape(-1, 2)
            return [raw[:, 0], raw[:, 1], list(seen.values())]

        for (texts,) in batches:
            for t in texts:
                if t:
                    keys = {k for x in t.encode().split(b"\n") if long_enough(k := key_of(x), min_chars)}
                    seen.update([xxhash.xxh3_128_digest(k) for k in keys])
                if len(seen) > 500_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return map_rows(df, [named(text)], run, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def build_arrays(frequent: DataFrame, total: int) -> DataFrame:
    """(shard, nth, levels, prints, counts) of the frequent keys; keys equal in hi go to hashes of their own, one after another."""

    def one(t: pa.Table) -> pa.Table:
        hi, lo, n = (t.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("hi", "lo", "n"))
        made = []
        while len(hi):
            first = np.unique(hi, return_index=True)[1]
            made.append(build_shard(hi[first], lo[first], n[first]))
            hi, lo, n = (np.delete(x, first) for x in (hi, lo, n))
        levels, prints, counts = zip(*made, strict=True)
        return pa.table({
            "shard": pa.array(t.column("shard")[:1].to_pylist() * len(made), pa.int32()), "nth": pa.array(range(len(made)), pa.int32()), "levels": pa.array(levels, pa.list_(pa.binary())),
            "prints": pa.array(prints, pa.binary()), "counts": pa.array(counts, pa.binary()),
        })

    shard = F.pmod(F.shiftrightunsigned("hi", 40), F.lit(total)).cast("int")
    return frequent.withColumn("shard", shard).groupBy("shard").applyInArrow(one, "shard int, nth int, levels array<binary>, prints binary, counts binary")


def drop_lines(df: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, most_bytes: int = 64 << 20) -> DataFrame:
    """df with the text of the lines that stay, n_lines (before) and n_dropped."""
    spark = df.sparkSession
    shared_folder(spark)
    small_batches(spark)
    df = without(df, "n_lines", "n_dropped")
    frequent = stored(line_counts(df, text, min_chars).filter(F.col("n") >= min_docs))
    keys = frequent.count()
    total = max(1, -(-keys // SHARD_KEYS))
    sent = None
    if keys:
        arrays = stored(build_arrays(frequent, total))
        index = arrays.select("shard", "nth", F.transform("levels", F.octet_length).alias("l"), F.octet_length("prints").alias("p")).collect()  # a row for SHARD_KEYS keys
        if sum(sum(r.l) + 2 * r.p for r in index) <= most_bytes:
            rows = arrays.select("shard", "levels", "prints", "counts").collect()  # at most most_bytes
            sent = spark.sparkContext.broadcast(Shards.of([(r[0], [bytes(x) for x in r[1]], bytes(r[2]), bytes(r[3])) for r in rows], total))
        else:
            sent = spark.sparkContext.broadcast(Laid([tuple(r) for r in index], arrays.inputFiles(), total))
    place = df.columns.index(text)

    def run(batches):
        shards = sent and (sent.value if isinstance(sent.value, Shards) else sent.value.mapped())
        for b in batches:
            texts = b.column(place).to_pylist()
            lines = [(t or "").encode().split(b"\n") for t in texts]
            keys = [[key_of(x) for x in own] for own in lines]
            flat = [k for own in keys for k in own]
            gone = shards.counts(*hashes(flat)) >= min_docs if shards else np.zeros(len(flat), bool)
            gone &= np.array([long_enough(k, min_chars) for k in flat])
            marked = np.split(gone, np.cumsum([len(own) for own in lines])[:-1])
            cols = list(b.columns)
            cols[place] = pa.array([None if t is None else b"\n".join([x for x, g in zip(own, m, strict=True) if not g]).decode() if m.any() else t for t, own, m in zip(texts, lines, marked, strict=True)], pa.string())
            cols += [pa.array([len(m) for m in marked], pa.int64()), pa.array([int(m.sum()) for m in marked], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "n_lines", "n_dropped"])

    return in_batches(df, run, T.StructType([*df.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


def digest(df: DataFrame) -> DataFrame:
    """The columns of op5."""
    out = drop_lines(df.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def clean(df: DataFrame) -> DataFrame:
    """documents without the lines that many of them share; columns as they came."""
    out = drop_lines(df)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns_of(df))
