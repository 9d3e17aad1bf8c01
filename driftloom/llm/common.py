"""Helpers shared by the text operators."""

from __future__ import annotations

import fcntl
import os
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from driftloom.session import ship
from driftloom.storage import shared_folder, stored  # noqa: F401  for the operators

#: Characters that separate words, as a Java, DuckDB and Python character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of bounded rows and bytes, from here on in the session; its own choices other than the defaults stand.

    A batch that holds a single text is as long as the text.
    """
    for name, default, value in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "67108864b", size)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(value))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [named(c) for c in df.columns]


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for column names of any kind: batches come and go by the names, which Spark doesn't see."""
    names, out = df.columns, [f.name for f in schema.fields]
    hidden = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def masked(batches):
        for b in run(x.rename_columns(names) for x in batches):
            yield b.rename_columns(hidden.names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(masked, hidden).toDF(*out)


def map_rows(df: DataFrame, columns: list[Column], f: Callable[[Iterator[list[list]]], Iterator[list[list]]], schema: str) -> DataFrame:
    """df.select(columns) in Arrow batches through f, which gets and gives lists of column lists."""
    small_batches(df.sparkSession)
    spark_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        for out in f([c.to_pylist() for c in b.columns] for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, arrow, strict=True)], schema=arrow)

    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, spark_schema)


def laid_out(name: str, size: int, write: Callable[[BinaryIO], None]) -> str:
    """The path of a file of size bytes in the executor's own folder; the first worker that asks writes it, all can map it.

    A lost executor's file is written anew by the next one, from what write() reads in the shared folder.
    """
    path = os.path.join(SparkFiles.getRootDirectory(), name)
    with open(f"{path}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(path):
            with open(f"{path}.new", "wb") as f:
                f.truncate(size)
                write(f)
            os.rename(f"{path}.new", path)
    return path


def stored_rows(files: list[str], columns: list[str]) -> Iterator[tuple]:
    """The rows of Parquet files of a stored table, read by a worker a few at a time."""
    for uri in files:
        fs, at = FileSystem.from_uri(uri)
        with fs.open_input_file(at) as source:
            for b in pq.ParquetFile(source).iter_batches(16, columns=columns):
                yield from zip(*[b.column(c).to_pylist() for c in columns], strict=True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns of these names in any case; what an operator adds takes the place of a clashing column."""
    low = {n.lower() for n in names}
    return df.select(*[named(c) for c in df.columns if c.lower() not in low])


def sha(col: Column) -> Column:
    return F.sha2(col, 256)
