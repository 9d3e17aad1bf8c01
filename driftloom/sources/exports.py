"""Writers that can be run again: escaped text, exports by key and period, swapped and versioned tables, manifests and claims."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import periods
from driftloom.sources import versions


def files(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = files(spark, path)
    return fs.exists(at)


def escaped(value: Column) -> Column:
    """A cell of the database's text format: backslash, tab and line ends escaped, null as backslash N."""
    text = value.cast("string")
    for plain, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return F.coalesce(text, F.lit("\\N"))


def copy_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """value: df as lines of the database's text format, for write.text()."""
    return df.select(F.concat_ws("\t", *[escaped(F.col(c)) for c in columns or df.columns]).alias("value"))


def export_by(spark: SparkSession, chunks: dict[str, Callable[[], DataFrame]], path: str, key: str, rows_per_file: int = 100_000, none: str = "none") -> list[str]:
    """Writes each chunk by the values of key (null under ``none``) into a folder of its own; chunks that are done are passed over. Returns those written."""
    done = []
    for name, make in chunks.items():
        at = f"{path.rstrip('/')}/chunk={name}"
        if not exists(spark, f"{at}/_SUCCESS"):
            df = make()
            df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit(none))).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("sep", "\t").option("compression", "gzip").partitionBy(key).csv(at)
            done.append(name)
    return done


def swap(df: DataFrame, path: str) -> None:
    """Puts df in the place of the table at path, written beside it first; a run that broke between the two renames is mended.

    Between the renames there is no table at path. Readers who must always find one take ``refresh`` and ``view``.
    """
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").parquet(new)
    (at, fs), (new_at, _), (old_at, _) = files(spark, path), files(spark, new), files(spark, old)
    if fs.exists(at):
        fs.delete(old_at, True)
        fs.rename(at, old_at)
    fs.rename(new_at, at)  # if this is not reached, .old is the table that was, and stays until the next one is in place
    fs.delete(old_at, True)


def refresh(df: DataFrame, path: str) -> int:
    """Commits df as the next version of a view; readers of view() see the one before until then, and never none."""
    return versions.commit(path, {"view": df})


def view(spark: SparkSession, path: str) -> DataFrame:
    return versions.current(spark, path)["view"]


def write_period(tables: dict[str, DataFrame], path: str, corpus: str, period: str) -> None:
    """The output of a period: each table under its name, corpus and period, in place of what was there; others stay."""
    for name, df in tables.items():
        out = df.withColumns({"corpus": F.lit(corpus), "period": F.lit(period)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus", "period").parquet(f"{path.rstrip('/')}/{name}")


def write_manifest(spark: SparkSession, path: str, facts: dict) -> None:
    """A JSON file beside the data, written after it: that it is there says that the data are whole."""
    at, fs = files(spark, f"{path.rstrip('/')}/_MANIFEST.json")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
    out.close()


def manifest(spark: SparkSession, path: str) -> dict | None:
    at, fs = files(spark, f"{path.rstrip('/')}/_MANIFEST.json")  # hidden from Spark's own readers
    return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(at), "UTF-8")) if fs.exists(at) else None


def claim(spark: SparkSession, path: str, name: str) -> bool:
    """Whether this caller is the first to ask for the name; of several at once one alone makes the mark (see ``versions``)."""
    return versions.made_once(spark, f"{path.rstrip('/')}/{name}.claim", name)


def search_windows(counts: DataFrame, cap: int, day: str = "day", n: str = "n") -> DataFrame:
    """resolution, window_start, window_end, n: quarters, or their months where a quarter reaches cap, or weeks where a month does.

    counts: hits a day. A search that reaches the cap would lose hits, so it is split until it does not, or is a week.
    """
    rows = counts.select(F.col(day).alias("day"), F.col(n).alias("n"))
    total = lambda by: F.sum("n").over(by)
    from pyspark.sql.window import Window

    rows = rows.withColumns({"q": F.trunc("day", "quarter"), "m": F.trunc("day", "month"), "w": F.trunc("day", "week")})
    rows = rows.withColumns({"nq": total(Window.partitionBy("q")), "nm": total(Window.partitionBy("m"))})
    kind = F.when(F.col("nq") < cap, "quarterly").when(F.col("nm") < cap, "monthly").otherwise("weekly")
    start = F.when(F.col("nq") < cap, F.col("q")).when(F.col("nm") < cap, F.col("m")).otherwise(F.greatest("w", "m"))
    g = rows.groupBy(kind.alias("resolution"), start.alias("window_start")).agg(F.sum("n").alias("n"))
    week_end = F.least(F.date_add(F.trunc("window_start", "week"), 6), F.last_day("window_start"))
    end = F.when(F.col("resolution") == "quarterly", periods.period_end(F.col("window_start"), "quarterly")).when(F.col("resolution") == "monthly", F.last_day("window_start")).otherwise(week_end)
    return g.select("resolution", "window_start", end.alias("window_end"), "n")
