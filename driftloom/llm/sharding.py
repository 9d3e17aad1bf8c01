"""Shards of equal row counts by a seeded permutation of row numbers that anyone can work out.

Rows are numbered from 0 in the order of their key, ties in the order of the text's hash. A Feistel network over the
fewest bits that hold the numbers permutes them; a result that is no row number is put through again until it is one
(cycle walking), so the numbers from 0 to n - 1 are permuted among themselves. A permuted number p goes to shard p modulo the
number of shards, slot p divided by it: counts of shards differ by one at most, and slots have no gaps. Both are a
function of row number, n, shards and seed (``place``), and ``row_at`` gives the row number back.

Numbers come from a range partitioning by key, hash and place in the input, so that rows that repeat without end are dealt
to many tasks. Tasks number their own rows; the driver sees one count for each task. The rows are stored in between, where
a lost executor doesn't take them along.

The law is ``rows``: rows with equal texts are not kept together, as counts at most one apart leave no room for that.

Defined results: a null text has size 1 and the checksum of no bytes; rows with null keys come first; rows that are
equal in key and text are interchangeable; texts of any length are measured whole; an empty table gives an empty table;
columns of df that have the names of added ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.common import in_batches, named, stored, without

ROUNDS = 8
LAW = "rows"


def round_keys(seed: str) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8]) for i in range(ROUNDS)]


class Permutation:
    """Of the numbers below n, which is below 2**62."""

    def __init__(self, n: int, seed: str = "1"):
        self.n, self.keys = n, [np.uint64(k) for k in round_keys(seed)]
        bits = max((n - 1).bit_length(), 2)
        self.widths = bits - bits // 2, bits // 2  # of the left and the right part; they change places in each round

    @staticmethod
    def mixed(x: np.ndarray, key: np.uint64, width: int) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - width)

    def once(self, x: np.ndarray) -> np.ndarray:
        wl, wr = self.widths
        left, right = x >> np.uint64(wr), x & np.uint64((1 << wr) - 1)
        for k in self.keys:
            left, right = right, left ^ self.mixed(right, k, wl)
            wl, wr = wr, wl
        return (left << np.uint64(wr)) | right

    def back_once(self, x: np.ndarray) -> np.ndarray:
        wl, wr = self.widths  # an even number of rounds leaves them as they were
        left, right = x >> np.uint64(wr), x & np.uint64((1 << wr) - 1)
        for k in reversed(self.keys):
            wl, wr = wr, wl
            left, right = right ^ self.mixed(left, k, wl), left
        return (left << np.uint64(wr)) | right

    def walked(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, np.uint64))
        while len(out := np.flatnonzero(x >= np.uint64(self.n))):
            x[out] = step(x[out])
        return x.astype(np.int64)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return self.walked(numbers, self.once)

    def back(self, numbers: np.ndarray) -> np.ndarray:
        return self.walked(numbers, self.back_once)


def place(numbers: np.ndarray, n: int, shards: int = 16, seed: str = "1") -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers of a table of n rows."""
    p = Permutation(n, seed).of(numbers)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = 16, seed: str = "1") -> np.ndarray:
    """The row numbers at slots of shards."""
    return Permutation(n, seed).back(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64))


def numbered(df: DataFrame, order: list[str], seed_place: str = "row_number") -> tuple[DataFrame, int]:
    """(df with a column of global row numbers, number of rows); rows equal in all columns of order are interchangeable."""
    df = without(df, seed_place)
    at = [named(c) for c in order]
    dealt = df.withColumn(" at", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*at, F.col("` at`")).sortWithinPartitions(*at, F.col("` at`")).drop(" at")
    schema = T.StructType([*df.schema.fields, T.StructField(" task", T.IntegerType()), T.StructField(" place", T.LongType())])

    def run(batches):
        task, done = TaskContext.get().partitionId(), 0
        for b in batches:
            cols = [pa.array(np.full(b.num_rows, task, np.int32)), pa.array(np.arange(done, done + b.num_rows, dtype=np.int64))]
            done += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, " task", " place"])

    rows = stored(in_batches(dealt, run, schema))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col("` task`")).count().collect()}  # one row a task
    offsets, n = np.zeros(max(counts, default=0) + 1, np.int64), 0
    for task in sorted(counts):
        offsets[task], n = n, n + counts[task]
    sent = df.sparkSession.sparkContext.broadcast(offsets)  # one number a task
    schema = T.StructType([*df.schema.fields, T.StructField(seed_place, T.LongType())])

    def add(batches):
        for b in batches:
            number = sent.value[b.column(b.num_columns - 2).to_numpy()] + b.column(b.num_columns - 1).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(number)], names=[*b.schema.names[:-2], seed_place])

    return in_batches(rows, add, schema), n


def assign(df: DataFrame, order: list[str], shards: int = 16, seed: str = "1") -> DataFrame:
    """df with row_number, shard and slot. All columns of df are dealt by range once; give few where texts are large."""
    rows, n = numbered(without(df, "shard", "slot"), order)
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def run(batches):
        for b in batches:
            shard, slot = place(b.column(b.num_columns - 1).to_numpy(), n, shards, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard.astype(np.int32)), pa.array(slot)], names=[*b.schema.names, "shard", "slot"])

    return in_batches(rows, run, schema)


def write_shards(df: DataFrame, path: str, shards: int = 16) -> None:
    """Writes what assign() made as a folder a shard, in files of slots in order; a shard is dealt to as many tasks as it needs."""
    df.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(df: DataFrame) -> DataFrame:
    """The columns of op12."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    law, grown = F.lit(LAW).alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return assign(rows, ["doc_id", "text_crc32", "h", "size"]).select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
