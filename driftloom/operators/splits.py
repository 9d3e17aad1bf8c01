"""Splits, mergers and composite scores of clusters that share members from one period to the next.

members: period, c, chunk (distinct), and a weight w where cores are asked for. Periods are consecutive whole numbers.
Members meet by (period, chunk), so a large cluster is spread over the shuffle; pairs of clusters are few against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators.lineage import SPLIT, WEAK


def core(members: DataFrame) -> DataFrame:
    """The members whose weight is at least the median of their period."""
    median = members.groupBy("period").agg(F.percentile("w", 0.5).alias("median"))  # one row a period
    return members.join(F.broadcast(median), "period").filter("w >= median").drop("median")


def shared(members: DataFrame) -> DataFrame:
    """(period, child, parent, chunk): what a cluster has in common with one of the period before."""
    before = members.select((F.col("period") + 1).alias("period"), F.col("c").alias("parent"), "chunk")
    return members.select("period", F.col("c").alias("child"), "chunk").join(before, ["period", "chunk"]).select("period", "child", "parent", "chunk")


def overlap(members: DataFrame) -> DataFrame:
    """(period, child, parent, n_shared, overlap, churn): overlap is of the parent's members, churn one less the Jaccard of both."""
    size = members.groupBy("period", "c").count()
    pairs = shared(members).groupBy("period", "child", "parent").agg(F.count("*").alias("n_shared"))
    pairs = pairs.join(size.toDF("period", "child", "nc"), ["period", "child"])
    pairs = pairs.join(size.select((F.col("period") + 1).alias("period"), F.col("c").alias("parent"), F.col("count").alias("np")), ["period", "parent"])
    both = F.col("nc") + F.col("np") - F.col("n_shared")
    return pairs.select("period", "child", "parent", "n_shared", F.round(F.col("n_shared") / F.col("np"), 6).alias("overlap"), F.round(1 - F.col("n_shared") / both, 6).alias("churn"))


def composite(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """candidates (period, child, parent, score) with overlap, core_overlap and composite; a signal of zero drops its weight."""
    key = ["period", "child", "parent"]
    whole = overlap(members).select(*key, "overlap")
    inner = overlap(core(members)).select(*key, F.col("overlap").alias("core_overlap"))
    df = candidates.join(whole, key, "left").join(inner, key, "left").fillna(0.0, ["overlap", "core_overlap"])
    o, c = F.col("overlap"), F.col("core_overlap")
    available = F.lit(0.5) + F.when(o > 0, 0.3).otherwise(0.0) + F.when(c > 0, 0.2).otherwise(0.0)
    return df.withColumn("composite", F.round((F.lit(0.5) * F.col("score") + F.lit(0.3) * o + F.lit(0.2) * c) / available, 6))


def jointly(candidates: DataFrame, members: DataFrame, whole: str, part: str) -> DataFrame:
    """(period, whole, n_parts, coverage) where two candidates or more together hold SPLIT of the whole's members."""
    size = members.groupBy("period", "c").count().withColumnRenamed("c", whole)
    if whole == "parent":
        size = size.withColumn("period", F.col("period") + 1)
    held = shared(members).join(candidates.select("period", "child", "parent"), ["period", "child", "parent"], "left_semi")
    held = held.groupBy("period", whole).agg(F.countDistinct("chunk").alias("held"))
    parts = candidates.groupBy("period", whole).agg(F.countDistinct(part).alias("n_parts")).filter("n_parts >= 2")
    coverage = F.round(F.col("held") / F.col("count"), 6)
    return parts.join(held, ["period", whole]).join(size, ["period", whole]).select("period", whole, "n_parts", coverage.alias("coverage")).filter(F.col("coverage") >= SPLIT)


def splits(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Parents whose children, all of which inherit the id, cover them together."""
    return jointly(candidates, members, "parent", "child")


def mergers(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Children that are covered by several parents together."""
    return jointly(candidates, members, "child", "parent")


def split_children(scored: DataFrame, members: DataFrame) -> DataFrame:
    """(period, child, parent): the children of a split, of candidates with a composite of WEAK or better."""
    own = scored.filter(F.col("composite") >= WEAK)
    return own.join(splits(own, members).select("period", "parent"), ["period", "parent"], "left_semi").select("period", "child", "parent")
