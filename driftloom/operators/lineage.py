"""Clusters matched from period to period; periods are consecutive whole numbers, clusters carry unit centroids.

Scores join clusters of one period with those of the one before: few rows against their members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions.vectors import dot, normalised

STRONG, WEAK, SPLIT = 0.9, 0.7, 0.6


def period_centroids(rows: DataFrame) -> DataFrame:
    """period, c, u (unit mean vector), n, of rows period, c, v."""
    parts = rows.select("period", "c", F.posexplode("v").alias("i", "x")).groupBy("period", "c", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    g = parts.groupBy("period", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"), F.max("n").alias("n"))
    return g.select("period", "c", normalised(F.col("m")).alias("u"), "n")


def scored(cents: DataFrame) -> DataFrame:
    before = cents.select((F.col("period") + 1).alias("period"), F.col("c").alias("parent"), F.col("u").alias("pu"))
    return cents.select("period", F.col("c").alias("child"), "u").join(before, "period").withColumn("s", dot(F.col("u"), F.col("pu")))


def candidates(cents: DataFrame, weak: float = WEAK) -> DataFrame:
    return scored(cents).select("period", "child", "parent", F.round("s", 6).alias("score")).filter(F.col("score") >= weak)


def greedy(cand: DataFrame) -> DataFrame:
    """The best parent of each child, then the best such child of each parent; losers are new."""
    child = Window.partitionBy("period", "child").orderBy(F.desc("score"), "parent")
    parent = Window.partitionBy("period", "parent").orderBy(F.desc("score"), "child")
    one = cand.withColumn("k", F.row_number().over(child)).filter("k = 1")
    return one.withColumn("k", F.row_number().over(parent)).filter("k = 1").drop("k")


def match_types(cents: DataFrame, matches: DataFrame) -> DataFrame:
    kind = F.when(F.col("score") >= STRONG, "continuation").when(F.col("score").isNotNull(), "weak").otherwise("new")
    return cents.select("period", F.col("c").alias("child")).join(matches, ["period", "child"], "left").select("period", "child", "parent", "score", kind.alias("match_type"))


def lifecycle(cents: DataFrame, types: DataFrame) -> DataFrame:
    kept = types.filter("parent is not null").select("period", F.col("parent").alias("c"), F.lit(1).alias("hit"))
    gone = cents.select((F.col("period") + 1).alias("period"), "c").join(kept, ["period", "c"], "left").groupBy("period").agg(F.count_if(F.col("hit").isNull()).alias("n_died"))
    n = [F.count_if(F.col("match_type") == k).alias(v) for k, v in (("new", "n_new"), ("continuation", "n_continued"), ("weak", "n_weak"))]
    return types.groupBy("period").agg(*n).join(gone, "period")


def births_deaths(cents: DataFrame, least: float = WEAK) -> DataFrame:
    s = scored(cents)
    born = s.groupBy("period", "child").agg(F.max("s").alias("m")).groupBy("period").agg(F.count_if(F.round("m", 6) < least).alias("n_births"))
    died = s.groupBy("period", "parent").agg(F.max("s").alias("m")).groupBy("period").agg(F.count_if(F.round("m", 6) < least).alias("n_deaths"))
    return born.join(died, "period")


def drift(cents: DataFrame, matches: DataFrame) -> DataFrame:
    now = cents.select("period", F.col("c").alias("child"), F.col("u").alias("a"), "n")
    then = cents.select((F.col("period") + 1).alias("period"), F.col("c").alias("parent"), F.col("u").alias("b"), F.col("n").alias("n0"))
    far = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return matches.join(now, ["period", "child"]).join(then, ["period", "parent"]).select("period", "child", "parent", F.round(far, 6).alias("drift"), (F.col("n") - F.col("n0")).alias("growth"))


def surprise(cents: DataFrame) -> DataFrame:
    """How far a centroid lies from the line through its best match and that one's best match; 0..2."""
    def best(rows: DataFrame, by: list[str], u: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc(F.round(dot(F.col(u), F.col("pu")), 9)), "pc")
        return rows.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")

    def lagged(n: int) -> DataFrame:
        return cents.select((F.col("period") + n).alias("period"), F.col("c").alias("pc"), F.col("u").alias("pu"))

    one = best(cents.select("period", "c", "u").join(lagged(1), "period"), ["period", "c"], "u").select("period", "c", "u", F.col("pu").alias("u1"))
    two = best(one.join(lagged(2), "period"), ["period", "c"], "u1").withColumn("g", F.zip_with("u1", "pu", lambda x, y: 2 * x - y))
    return two.select("period", "c", F.round(F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - dot(F.col("u"), normalised(F.col("g"))))), 6).alias("surprise"))
