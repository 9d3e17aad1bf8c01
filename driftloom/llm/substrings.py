"""Substring dedup: words under a window of ``width`` words that also starts earlier are removed.

1. Anchors. Each window is led by the smallest of its runs of ``width // 2`` words. Equal windows have equal leaders, so
   only windows whose leader occurs twice can repeat. Leaders are counted (one row for about six words, summed in each
   task before the shuffle) and the repeated ones set in a bitmap of BITS_EACH bits each. One of at most ``most_bytes`` is
   broadcast; a larger one is laid out in a file of each executor, which its workers map. A false hit in it costs work,
   never the result.
2. Shards. Each Arrow batch is made of shards of at most about SYMBOLS words: over each a suffix automaton is built online,
   over its candidate stretches, in document order. After each word the suffix link tells the longest stretch that ended there and occurred before; from ``width``
   on, that window is removed without leaving the task. Windows new to the shard go on as hashes.
3. Between shards, windows meet by hash in (document, start) order; all but the first are removed. A window of a third of
   all documents arrives once a shard, and rows are streamed, never gathered.

Broadcasting the automata of all reference shards, as the method was first named, streams every document past every
shard: work that grows with the square of the corpus, over a reference without a size bound. Hence step 3.

Windows are compared by 95 bits of hash. Defined results: a null text has no words; rows of one doc_id are one document, and
what they hold at the same place is one occurrence; a null doc_id comes last; an empty table gives an empty table;
clashing column names are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.common import WORD, columns_of, in_batches, laid_out, map_rows, shared_folder, small_batches, stored, stored_rows, without
from driftloom.llm.wordhash import blocks, grams, mix

#: Bits of the anchor bitmap for each repeated leader (and up to twice as many), and of each part of it that one group fills.
BITS_EACH, PART = 128, 1 << 19
#: Words of a shard, and windows of a stretch that goes into it at a time.
SYMBOLS, STRETCH = 200_000, 50_000
LAST = (1 << 63) - 1


class SuffixAutomaton:
    """Over integers, built online."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, symbol: int) -> int:
        """Appends symbol; the length of the longest suffix that also ended somewhere before."""
        nexts, link, length = self.next, self.link, self.length
        p, cur = self.last, len(nexts)
        nexts.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in nexts[p]:
            nexts[p][symbol] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][symbol]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(symbol) == q:
                    nexts[p][symbol] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        return length[link[cur]]


def leaders(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of one text: the hash of its leading run and that run's place."""
    half = width // 2
    g = grams(words, half)
    n = len(words) - width + 1
    best, at = g[:n].copy(), np.arange(n)
    for o in range(1, width - half + 1):
        x = g[o : o + n]
        less = x < best
        best[less] = x[less]
        at[less] = np.flatnonzero(less) + o
    return best, at


def anchor_counts(df: DataFrame, text: str, width: int) -> DataFrame:
    def run(batches):
        for (texts,) in batches:
            own = []
            for places, off, words in blocks(texts):
                for k in range(len(places)):
                    if off[k + 1] - off[k] >= width:
                        best, at = leaders(words[off[k] : off[k + 1]], width)
                        own.append(best[np.concatenate([[True], at[1:] != at[:-1]])])
            if own:
                h, n = np.unique(np.concatenate(own), return_counts=True)
                yield [h.astype(np.int64), n]

    return map_rows(df, [F.col(text)], run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Bitmap:
    """Of leaders: parts of PART bits, in memory or in a file of the executor."""

    def __init__(self, parts: int, files: list[str], bits: np.ndarray | None = None):
        self.parts, self.files, self.bits, self.name = parts, files, bits, f"driftloom-anchors-{uuid.uuid4().hex}"

    def opened(self) -> np.ndarray:
        def write(f) -> None:
            for part, bits in stored_rows(self.files, ["part", "bits"]):
                f.seek(part * PART // 8)
                f.write(bits)

        if self.bits is None:
            return np.memmap(laid_out(self.name, self.parts * PART // 8, write), np.uint8, "r")
        return self.bits

    def has(self, bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(self.parts * PART - 1)).astype(np.int64)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def repeated_anchors(df: DataFrame, text: str, width: int, most_bytes: int) -> Bitmap:
    """Of the leaders that occur twice."""
    twice = stored(anchor_counts(df, text, width).filter("n > 1").select("h"))
    parts = 1
    while parts * PART < BITS_EACH * twice.count():
        parts *= 2
    part = F.shiftright(F.col("h").bitwiseAND(F.lit(parts * PART - 1)), PART.bit_length() - 1)

    def one(t: pa.Table) -> pa.Table:
        bits = np.zeros(PART, bool)
        bits[t.column("h").to_numpy().astype(np.int64) & (PART - 1)] = True
        return pa.table({"part": pa.array(t.column("part")[:1].to_pylist(), pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    made = stored(twice.withColumn("part", part).groupBy("part").applyInArrow(one, "part long, bits binary"))
    if parts * PART // 8 > most_bytes:
        return Bitmap(parts, made.inputFiles())
    out = np.zeros(parts * PART // 8, np.uint8)
    for r in made.toLocalIterator():
        out[r.part * PART // 8 : (r.part + 1) * PART // 8] = np.frombuffer(r.bits, np.uint8)
    return Bitmap(parts, [], out)


def runs_of(flags: np.ndarray) -> np.ndarray:
    """(start, length) of the stretches of True."""
    f = np.concatenate([[False], flags, [False]])
    turn = np.flatnonzero(f[1:] != f[:-1])
    return np.stack([turn[::2], turn[1::2] - turn[::2]], 1)


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """runs_of() in pieces of STRETCH at most."""
    return [(a + o, min(STRETCH, n - o)) for a, n in runs_of(flags).tolist() for o in range(0, n, STRETCH)]


def text_key(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode()) >> 1


def windows(df: DataFrame, text: str, key: str, width: int, bitmap) -> DataFrame:
    """(h, h2, doc, text_key, start, size): windows new to their shard (size 0), or removed stretches of window starts."""

    def shard(ids: list[int], keys: list[int], texts: list[str | None], out: list[list[np.ndarray]]) -> None:
        bits = bitmap.value.opened()
        automaton, separator = SuffixAutomaton(), 0
        for places, off, words in blocks(texts):
            g, other = grams(words, width), (grams(mix(words, 3), width) >> np.uint64(33)).astype(np.int64)
            number = None
            for k, place in enumerate(places):
                a, b = int(off[k]), int(off[k + 1])
                if b - a < width:
                    continue
                best, _ = leaders(words[a:b], width)
                may = bitmap.value.has(bits, best)
                if not may.any():
                    continue
                gone = np.zeros(len(may), bool)
                if ids[place] is not None and not doubtful[place]:
                    if number is None:
                        number = (words & np.uint64(LAST)).tolist()
                    for start, n in stretches(may):
                        if len(automaton.next) > SYMBOLS:
                            automaton = SuffixAutomaton()
                        separator -= 1
                        automaton.extend(separator)
                        for i in range(n + width - 1):
                            if automaton.extend(number[a + start + i]) >= width:
                                gone[start + i - width + 1] = True
                doc, tk = LAST if ids[place] is None else ids[place], keys[place]
                new = np.flatnonzero(may & ~gone)
                full = lambda n, x: np.full(n, x, np.int64)
                out.append([g[a + new].astype(np.int64), other[a + new], full(len(new), doc), full(len(new), tk), new, full(len(new), 0)])
                if gone.any():
                    r = runs_of(gone)
                    out.append([g[a + r[:, 0]].astype(np.int64), other[a + r[:, 0]], full(len(r), doc), full(len(r), tk), r[:, 0], r[:, 1]])

    doubtful: list[bool] = []

    def run(batches):
        for ids, texts in batches:
            seen: dict = {}
            for i, t in zip(ids, texts, strict=True):
                seen.setdefault((i is None, i or 0, text_key(t)), (i, t))
            order = sorted(seen)
            per: dict = {}
            for null, i, _ in order:
                per[null, i] = per.get((null, i), 0) + 1
            doubtful[:] = [per[k[:2]] > 1 for k in order]  # one id with several texts: left to the exchange
            out: list[list[np.ndarray]] = []
            shard([seen[k][0] for k in order], [k[2] for k in order], [seen[k][1] for k in order], out)
            if out:
                yield [np.concatenate(c) for c in zip(*out, strict=True)]

    return map_rows(df, [F.col(key), F.col(text)], run, "h long, h2 int, doc long, text_key long, start int, size int")


def removed(rows: DataFrame) -> DataFrame:
    """(doc, text_key, start, size): the windows that also start earlier, from rows that come sorted."""

    def run(batches):
        last = (None, None, None, None)
        for b in batches:
            h, h2, doc, tk, start, size = (c.to_numpy() for c in b.columns)
            w = size == 0
            hw, gw, dw, sw = h[w], h2[w], doc[w], start[w]
            gone = np.zeros(len(hw), bool)
            if len(hw):
                new = np.concatenate([[(hw[0], gw[0]) != last[:2]], (hw[1:] != hw[:-1]) | (gw[1:] != gw[:-1])])
                first = np.maximum.accumulate(np.where(new, np.arange(len(hw)), -1))
                inside = first >= 0
                d0 = np.where(inside, dw[first], last[2] if last[2] is not None else 0)
                s0 = np.where(inside, sw[first], last[3] if last[3] is not None else 0)
                gone = (dw != d0) | (sw != s0)
                last = (hw[-1], gw[-1], d0[-1], s0[-1])
            keep = ~w
            keep[np.flatnonzero(w)[gone]] = True
            size = np.maximum(size, 1)
            yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[keep]), "text_key": pa.array(tk[keep], pa.int64()), "start": pa.array(start[keep], pa.int32()), "size": pa.array(size[keep], pa.int32())})

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(n, "h").sortWithinPartitions("h", "h2", "doc", "start")
    return sorted_.mapInArrow(run, "doc long, text_key long, start int, size int")


def drop_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 20, most_bytes: int = 64 << 20) -> DataFrame:
    """df with the kept words joined by one space as text (null stays null), n_words (before) and n_removed."""
    import re

    spark = df.sparkSession
    shared_folder(spark)
    small_batches(spark)
    df = without(df, "n_words", "n_removed", "__doc", "__tk", "__runs")
    bitmap = spark.sparkContext.broadcast(repeated_anchors(df, text, width, most_bytes))
    gone = removed(windows(df, text, key, width, bitmap)).groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "size")).alias("__runs"))  # as long as the one text
    place, id_place = df.columns.index(text), df.columns.index(key)
    keyed = T.StructType([*df.schema.fields, T.StructField("__doc", T.LongType()), T.StructField("__tk", T.LongType())])

    def with_key(batches):
        for b in batches:
            ids = [LAST if i is None else i for i in b.column(id_place).to_pylist()]
            tk = [text_key(t) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64()), pa.array(tk, pa.int64())], names=[*b.schema.names, "__doc", "__tk"])

    joined = in_batches(df, with_key, keyed).join(gone.toDF("__doc", "__tk", "__runs"), ["__doc", "__tk"], "left").select(*columns_of(df), "__runs")
    word = re.compile(WORD)

    def run(batches):
        for b in batches:
            texts, n, m = [], [], []
            for t, runs in zip(b.column(place).to_pylist(), b.column(len(b.columns) - 1).to_pylist(), strict=True):
                words = word.findall(t or "")
                left = np.zeros(len(words) + 1, np.int32)
                for r in runs or ():
                    left[r["start"]] += 1
                    left[r["start"] + r["size"] + width - 1] -= 1
                stay = np.cumsum(left[:-1]) == 0
                n.append(len(words))
                m.append(int(len(words) - stay.sum()))
                texts.append(None if t is None else " ".join(words if not m[-1] else [w for w, s in zip(words, stay.tolist(), strict=True) if s]))
            cols = list(b.columns)[:-1]
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=[*b.schema.names[:-1], "n_words", "n_removed"])

    return in_batches(joined, run, T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))


def digest(df: DataFrame) -> DataFrame:
    """The columns of op8."""
    out = drop_repeats(df.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
