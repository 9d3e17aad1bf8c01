"""Clusters over four periods, made from the embeddings: vectors move a little from period to period, cluster 0 falls in two in
period 1, cluster 5 joins cluster 6 in period 2, cluster 3 is away in period 2 and cluster 4 ends there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.plans.core import table

OBS = """obs AS (SELECT p AS period, CAST(CASE WHEN p >= 1 AND label = 0 AND vec_id % 2 = 1 THEN 100 WHEN p >= 2 AND label = 5 THEN 6 ELSE label END AS BIGINT) AS c, vec_id AS chunk,
  list_transform(embedding, lambda x, i: x::DOUBLE + 0.01::DOUBLE * p * ((i - 1) % 3 - 1)) AS v FROM embeddings, (SELECT unnest(range(4)) AS p)
  WHERE label IS NOT NULL AND NOT (label = 3 AND p = 2) AND NOT (label = 4 AND p >= 2))"""
UNIT = "list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"
MEANS = f"""means AS (SELECT period, c, m, {UNIT.format(v='m')} AS u, n FROM (SELECT period, c, list(m ORDER BY i) AS m, any_value(n) AS n FROM
  (SELECT period, c, i, avg(x) AS m, count(*) AS n FROM (SELECT period, c, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM obs) GROUP BY 1, 2, 3) GROUP BY 1, 2))"""


def observed(s: SparkSession, d: str) -> DataFrame:
    """period, c, chunk, v."""
    e = table(s, d, "embeddings").filter("label is not null").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")))
    e = e.filter("not (label = 3 and p = 2) and not (label = 4 and p >= 2)")
    c = F.when((F.col("p") >= 1) & (F.col("label") == 0) & (F.col("vec_id") % 2 == 1), 100).when((F.col("p") >= 2) & (F.col("label") == 5), 6).otherwise(F.col("label"))
    moved = F.transform("embedding", lambda x, i: x.cast("double") + F.lit(0.01) * F.col("p") * (i % 3 - 1))
    return e.select(F.col("p").alias("period"), c.cast("long").alias("c"), F.col("vec_id").alias("chunk"), moved.alias("v"))
