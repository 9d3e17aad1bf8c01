"""Edges, voids, gaps, bridges and member measures of clusters, from a neighbour list and an assignment.

edges: src, dst, sim. members: id, c (cluster). Assignments are joined on keys; no pair of clusters is met but those that
share an edge, except for voids, which compare centroids (few against members).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions.vectors import dot, normalised
from driftloom.storage import stored


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "sim").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))


def undirected(edges: DataFrame) -> DataFrame:
    """One row a pair: the larger similarity, at least 0."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.greatest(F.max("sim"), F.lit(0.0)).alias("weight"))


def labelled(edges: DataFrame, members: DataFrame) -> DataFrame:
    """edges with the clusters of both ends, ca and cb."""
    return edges.join(members.toDF("src", "ca"), "src").join(members.toDF("dst", "cb"), "dst")


def cluster_edges(edges: DataFrame, members: DataFrame, canonical: bool = False) -> DataFrame:
    """Shared edges of cluster pairs and what part of each cluster they touch. canonical: all edges, pairs in order."""
    both = labelled(edges if canonical else edges.filter("src < dst"), members).filter("ca <> cb")
    if canonical:
        swap = F.col("ca") > F.col("cb")
        both = both.select(
            F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("dst"),
            F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"),
        )
    sizes = members.groupBy("c").agg(F.count("*").alias("n"))
    pairs = both.groupBy("ca", "cb").agg(F.count("*").alias("n_shared_edges"), F.countDistinct("src").alias("na"), F.countDistinct("dst").alias("nb"))
    pairs = pairs.join(sizes.toDF("ca", "sa"), "ca").join(sizes.toDF("cb", "sb"), "cb")
    a, b = F.round(F.col("na") / F.col("sa"), 6), F.round(F.col("nb") / F.col("sb"), 6)
    return pairs.select(F.col("ca").alias("cluster_a"), F.col("cb").alias("cluster_b"), "n_shared_edges", a.alias("overlap_a"), b.alias("overlap_b"), F.greatest(a, b).alias("overlap"))


def bridges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Members of either cluster of a pair with an out-neighbour in the other."""
    out = labelled(edges, members).filter("ca <> cb").groupBy("ca", "cb").agg(F.countDistinct("src").alias("n"))
    return out.groupBy(F.least("ca", "cb").alias("cluster_a"), F.greatest("ca", "cb").alias("cluster_b")).agg(F.sum("n").alias("n_bridges"))


def centroids(df: DataFrame, cluster: str, vec: str) -> DataFrame:
    """c, centroid: mean of the vectors as they are."""
    parts = df.select(F.col(cluster).alias("c"), F.posexplode(vec).alias("i", "x")).groupBy("c", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def voids(cents: DataFrame, pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs of clusters (a < b) whose centroids are near but that share no edge. cents: a row a cluster."""
    unit = cents.select("c", normalised(F.col("centroid")).alias("u"))
    near = unit.toDF("a", "ua").join(unit.toDF("b", "ub"), F.col("a") < F.col("b")).withColumn("distance", 1 - dot(F.col("ua"), F.col("ub"))).filter(F.col("distance") <= threshold)
    shared = pairs.select(F.least("cluster_a", "cluster_b").alias("a"), F.greatest("cluster_a", "cluster_b").alias("b")).distinct()
    return near.join(shared, ["a", "b"], "left_anti").select("a", "b", F.round("distance", 6).alias("distance"))


def member_measures(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Of each member, over its out-neighbours: point_density (a mean distance), boundary_score, uncertainty, boundary_proximity, and energy (1 / density)."""
    d = 1 - F.col("sim")
    own = labelled(edges, members).groupBy("src").agg(
        F.avg(d).alias("m"), F.stddev_pop(d).alias("s"), F.count("*").alias("n"), F.avg((F.col("ca") != F.col("cb")).cast("double")).alias("foreign")
    )
    own = members.join(own.withColumnRenamed("src", "id"), "id", "left")
    density = F.coalesce("m", F.lit(0.0))
    spread = F.when(F.col("n") >= 2, F.col("s")).otherwise(0.0)
    return own.select(
        "id", "c", density.alias("point_density"), (1 - density).alias("mean_similarity"), F.coalesce("foreign", F.lit(0.0)).alias("boundary_score"),
        F.coalesce(spread / (F.col("m") + 1e-9), F.lit(0.0)).alias("uncertainty"), F.coalesce(spread, F.lit(0.0)).alias("boundary_proximity"), (1 / F.greatest(density, F.lit(1e-9))).alias("energy"),
    )


#: The measures of a member.
MEASURES = ["point_density", "mean_similarity", "boundary_score", "uncertainty", "boundary_proximity", "energy"]


def centroid_distances(vectors: DataFrame, members: DataFrame, cents: DataFrame) -> DataFrame:
    """id, c, distance_to_centroid: one less the product of a member's unit vector and its cluster's mean as it is. vectors: id, v."""
    own = members.join(vectors, "id").join(cents, "c")
    return own.select("id", "c", (1 - dot(normalised(F.col("v")), F.col("centroid"))).alias("distance_to_centroid"))


def cluster_stats(measures: DataFrame) -> DataFrame:
    """Of each cluster: mean density, share of outliers (over mean + 2 sigma), mean uncertainty, boundary sharpness (P90 - P10 from 5 members on)."""
    w = Window.partitionBy("c")
    m = measures.withColumns({"mu": F.avg("point_density").over(w), "sd": F.stddev_pop("point_density").over(w)})
    sharp = F.expr("percentile(boundary_score, 0.9) - percentile(boundary_score, 0.1)")
    return m.groupBy("c").agg(
        F.count("*").alias("size"), F.round(F.avg("point_density"), 6).alias("mean_density"),
        F.round(F.avg((F.col("point_density") > F.col("mu") + 2 * F.col("sd")).cast("double")), 4).alias("outlier_fraction"),
        F.round(F.avg("uncertainty"), 6).alias("mean_uncertainty"), F.round(F.when(F.count("*") >= 5, sharp), 6).alias("boundary_sharpness"),
    )


def degrees(edges: DataFrame, members: DataFrame) -> DataFrame:
    pairs = stored(undirected(edges))  # or neighbours are searched for each use
    d = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("degree"))
    n = members.count()
    return members.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.round(F.coalesce("degree", F.lit(0)) / max(1, n - 1), 6).alias("degree_centrality"))


def triangles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Triangles and clustering of each node. Pairs are directed from the node of lower degree, which bounds the two-hop join."""
    pairs = stored(undirected(edges).select("a", "b"))  # or neighbours are searched for each use
    d = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("d"))
    both = pairs.join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))
    two = out.toDF("u", "v").join(out.toDF("v", "w"), "v")
    tri = two.join(out.toDF("u", "w"), ["u", "w"])
    t = tri.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    got = members.select("id").join(d, "id", "left").join(t, "id", "left").fillna(0, ["d", "t"])
    return got.select("id", F.col("t").alias("triangle_count"), F.round(F.when(F.col("d") > 1, 2 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0), 6).alias("clustering_coeff"))


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, from sums a pair of clusters, so edges are read once; NaN if all weights are 0, null without edges."""
    e = undirected(edges).join(members.toDF("a", "ca"), "a").join(members.toDF("b", "cb"), "b")
    sums = e.groupBy("ca", "cb").agg(F.sum("weight").alias("w"))
    own = F.struct(F.col("ca").alias("c"), F.col("w").alias("k"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("w"))
    other = F.struct(F.col("cb").alias("c"), F.col("w").alias("k"), F.lit(0.0).alias("w"))
    per = sums.select(F.inline(F.array(own, other))).groupBy("c").agg(F.sum("k").alias("k"), F.sum("w").alias("w"))
    total = per.agg((F.sum("k") / 2).alias("m"), F.sum("w").alias("w"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    q = F.try_divide("w", "m") - resolution * F.try_divide("kk", 4 * F.col("m") * F.col("m"))
    return total.select(F.round(F.when(F.col("m") == 0, float("nan")).otherwise(q), 6).alias("modularity"))


def attractors(edges: DataFrame, measures: DataFrame, least: int = 5) -> DataFrame:
    """Of each cluster of ``least`` members: densest and sparsest members among their neighbours in both directions (two or more)."""
    m = measures.select("id", "c", "point_density")
    near = symmetric(edges).join(m.toDF("src", "c", "own"), "src").join(m.toDF("dst", "c2", "other"), "dst").filter("c = c2")
    per = near.groupBy("src", "c").agg(F.count("*").alias("n"), F.max("other").alias("hi"), F.min("other").alias("lo"), F.first("own").alias("own")).filter("n >= 2")
    flags = per.groupBy("c").agg(F.count_if(F.col("own") < F.col("lo")).alias("n_attractors"), F.count_if(F.col("own") > F.col("hi")).alias("n_saddles"))
    sizes = m.groupBy("c").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return sizes.join(flags, "c", "left").select("c", F.coalesce("n_attractors", F.lit(0)).alias("n_attractors"), F.coalesce("n_saddles", F.lit(0)).alias("n_saddles"))


def size_entropy(members: DataFrame) -> DataFrame:
    s = members.groupBy("c").agg(F.count("*").alias("n"))
    p = F.col("n") / F.col("total")
    return s.join(F.broadcast(s.agg(F.sum("n").alias("total")))).agg(F.round(-F.sum(p * F.log2(p + 1e-12)), 6).alias("entropy"), F.round(F.log2(F.count("*")) + F.sum(p * F.log2(p + 1e-12)), 6).alias("kl_from_uniform"))


def pagerank(edges: DataFrame, members: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """A fixed number of rounds over the undirected graph; nodes without edges keep what all get."""
    n = members.count()
    pairs = undirected(edges)
    arcs = pairs.select(F.col("a").alias("s"), F.col("b").alias("t")).union(pairs.select("b", "a"))
    arcs = stored(arcs.join(arcs.groupBy("s").agg(F.count("*").alias("d")), "s"))
    rank = members.select("id", F.lit(1.0 / n).alias("r"))
    for done in range(1, rounds + 1):
        got = arcs.join(rank.toDF("s", "r"), "s").groupBy(F.col("t").alias("id")).agg(F.sum(F.col("r") / F.col("d")).alias("g"))
        rank = members.select("id").join(got, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("g", F.lit(0.0))).alias("r"))
        if done % 4 == 0 and done < rounds:  # or the plan grows with the rounds
            rank = stored(rank)
    return rank.select("id", F.round("r", 8).alias("pagerank"))


def two_nearest_dim(edges: DataFrame, members: DataFrame) -> DataFrame:
    """c, n, two_nn_dim: members over the sum of the logs of their second to their first neighbour's distance (1 - sim)."""
    d = edges.filter("rank <= 2").groupBy("src").agg(F.max(F.when(F.col("rank") == 1, 1 - F.col("sim"))).alias("d1"), F.max(F.when(F.col("rank") == 2, 1 - F.col("sim"))).alias("d2"))
    mu = members.join(d.withColumnRenamed("src", "id"), "id").filter("d1 > 0 and d2 is not null").withColumn("l", F.log(F.col("d2") / F.col("d1")))
    return mu.groupBy("c").agg(F.count("*").alias("n"), (F.count("*") / F.nullif(F.sum("l"), F.lit(0.0))).alias("two_nn_dim"))


def merged_measures(edges: DataFrame, members: DataFrame, bundle: DataFrame, rank: DataFrame) -> DataFrame:
    """One row a node: bundle's measures, triangles, degree and rank (id, pagerank) side by side; nodes that a measure lacks keep their row."""
    out = bundle.drop("degree").join(degrees(edges, members), "id", "full")
    return out.join(triangles(edges, members), "id", "left").join(rank, "id", "left")


def topology(edges: DataFrame, members: DataFrame, measures: DataFrame, speed: DataFrame, paths: DataFrame) -> DataFrame:
    """One row a cluster: attractors, saddles, mean way and propagation speed. speed: c, propagation_speed; paths: c, avg_path_length."""
    sizes = members.groupBy("c").agg(F.count("*").alias("size"))
    return sizes.join(attractors(edges, measures), "c", "left").join(paths, "c", "left").join(speed, "c", "left")
