"""Picks, pivots, shares, quality of tables and queues of jobs, over any table and its column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_rows(df: DataFrame, by: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each group in this order; Spark keeps a row a group in each task before it shuffles."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__k = 1").drop("__k")


def beside(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The distinct values of column, each with the next and the previous one; without by, values are few (periods)."""
    w = Window.partitionBy(*(by or [])).orderBy(column)
    return df.select(*(by or []), column).distinct().select(*(by or []), column, F.lead(column).over(w).alias(f"next_{column}"), F.lag(column).over(w).alias(f"previous_{column}"))


def last_values(df: DataFrame, by: str, order: str, value: str, n: int = 3) -> DataFrame:
    """by, h1 to hn: the value at the last period of each group, at the last but one, and so on."""
    ranked = df.withColumn("__h", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("__h") <= n)
    return ranked.groupBy(by).agg(*[F.max(F.when(F.col("__h") == h, F.col(value))).alias(f"h{h}") for h in range(1, n + 1)])


def top_ids(df: DataFrame, by: str, measure: Column, n: int) -> DataFrame:
    """The n ids of the largest measure over their rows; ties go to the smaller id."""
    return df.groupBy(by).agg(measure.alias("__m")).orderBy(F.desc("__m"), by).limit(n).select(by)


def fill_rates(df: DataFrame, **filled: Column) -> DataFrame:
    """One row: n, and for each name the share of rows in which its column is not null."""
    return df.agg(F.count("*").alias("n"), *[F.round(F.count(c) / F.count("*"), 4).alias(k) for k, c in filled.items()])


def contract(df: DataFrame, by: str, bad: Column, levels: dict[str, float]) -> DataFrame:
    """by, null_rate, severity: the share of bad rows, and the first level (name to share) that it exceeds, else ok."""
    rate = df.groupBy(by).agg(F.avg(F.coalesce(bad, F.lit(False)).cast("double")).alias("bad"))
    severity = F.coalesce(*[F.when(F.col("bad") > share, name) for name, share in levels.items()], F.lit("ok"))
    return rate.select(by, F.round("bad", 4).alias("null_rate"), severity.alias("severity"))


def beyond_mark(df: DataFrame, marks: DataFrame, key: str, at: str, start: Column) -> DataFrame:
    """The rows of df after their key's mark (marks: key, mark), or after start if it has none."""
    return df.join(marks, key, "left").filter(F.col(at) > F.coalesce("mark", start)).drop("mark")


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isin(values))


def gaps_over(df: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """df with gap_s, the whole seconds to the key's next row, where these are over so many."""
    gap = F.unix_timestamp(F.lead(at).over(Window.partitionBy(key).orderBy(at, tie))) - F.unix_timestamp(at)
    return df.withColumn("gap_s", gap.cast("bigint")).filter(F.col("gap_s") > seconds)


def under_history(series: DataFrame, at: str, value: str, history: int = 10, share: float = 0.7) -> DataFrame:
    """at, value, mean of series (a row a day) where value is under this share of the mean of the history rows before, all of which must be there."""
    w = Window.orderBy(at).rowsBetween(-history, -1)
    s = series.withColumns({"mean": F.avg(value).over(w), "__n": F.count("*").over(w)})
    return s.filter((F.col("__n") >= history) & (F.col(value) < share * F.col("mean"))).select(at, value, F.round("mean", 3).alias("mean"))


# A queue is a table job, bin, status (pending, claimed, done, failed), priority, tries, worker, beat (last sign of life), error.


def claim(jobs: DataFrame, workers: DataFrame, now: Column) -> DataFrame:
    """jobs with the next pending job of each bin claimed by the bin's worker (workers: bin, worker), by priority, then job."""
    nxt = first_rows(jobs.filter("status = 'pending'").join(workers.select("bin", F.col("worker").alias("__w")), "bin"), ["bin"], ["priority", "job"])
    return taken(jobs, nxt.select("job", "__w"), {"status": F.lit("claimed"), "worker": F.col("__w"), "beat": now, "tries": F.col("tries") + 1})


def finish(jobs: DataFrame, ended: DataFrame, now: Column, most_tries: int = 3) -> DataFrame:
    """jobs after reports (ended: job, worker, error): done without an error, else pending again, or failed after most_tries; reports of a worker that lost the job don't count."""
    own = ended.select("job", F.col("worker").alias("__by"), F.col("error").alias("__error"), F.lit(True).alias("__w"))
    ok = F.col("__error").isNull()
    status = F.when(ok, "done").when(F.col("tries") >= most_tries, "failed").otherwise("pending")
    counts = own.join(jobs.filter("status = 'claimed'").select("job", F.col("worker").alias("__owner")), "job").filter("__by = __owner").drop("__owner", "__by")
    return taken(jobs, counts, {"status": status, "worker": F.when(ok, F.col("worker")), "beat": now, "error": F.col("__error")})


def reassign(jobs: DataFrame, now: Column, seconds: int = 1800, most_tries: int = 3) -> DataFrame:
    """jobs whose claim has shown no sign of life for so many seconds pending again, or failed after most_tries."""
    stale = (F.col("status") == "claimed") & (F.unix_timestamp(now) - F.unix_timestamp("beat") > seconds)
    lost = jobs.filter(stale).select("job", F.lit(True).alias("__w"))
    status = F.when(F.col("tries") >= most_tries, "failed").otherwise("pending")
    return taken(jobs, lost, {"status": status, "worker": F.lit(None).cast("string"), "error": F.lit("no sign of life")})


def taken(jobs: DataFrame, some: DataFrame, values: dict[str, Column]) -> DataFrame:
    """jobs with these values for those of some (job, __w and what values need)."""
    here = F.col("__w").isNotNull()
    both = jobs.join(some, "job", "left")
    return both.select(*[F.when(here, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns])
