"""What lies between clusters: dark matter, gaps of all pairs, and how similarity falls along the neighbour graph.

rows: c (null for none), chunk, v (unit vectors); cents: c, m (mean). Members meet points (midpoints of pairs, centroids,
members of other clusters) in blocks: a task multiplies the vectors of one block by those of another, and returns a row for
each point or pair of clusters, its best of the block. So a member makes a row for each block of points, not for each point.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions.vectors import dot, normalised
from driftloom.operators import all_pairs
from driftloom.operators.clusters import labelled
from driftloom.storage import stored

JUNK, VOID_RADIUS, FRINGE_RADIUS, BOUNDARY = 2, 0.15, 0.20, 0.3
#: Vectors of a block.
BLOCK = 4096


def dark_matter(members: DataFrame, junk: int = JUNK) -> DataFrame:
    """members (id, c) with is_dark_matter: no cluster, -1, or one of at most junk members."""
    size = members.filter("c is not null").groupBy("c").agg(F.count("*").alias("__n"))
    dark = F.col("c").isNull() | (F.col("c") == -1) | (F.coalesce("__n", F.lit(0)) <= junk)
    return members.join(size, "c", "left").select(*members.columns, dark.alias("is_dark_matter"))


def gap_type(weight: Column, near: Column, fringe_a: Column, fringe_b: Column) -> Column:
    return F.when(weight > 0.15, "bridge").when(near >= 3, "proto_cluster").when((near > 0) | (fringe_a > 0.1) | (fringe_b > 0.1), "fringe").otherwise("void")


def midpoints(cents: DataFrame) -> DataFrame:
    """a, b, centroid_distance, mid of all pairs a < b of clusters."""
    left, right = cents.select(F.col("c").alias("a"), F.col("m").alias("ma")), cents.select(F.col("c").alias("b"), F.col("m").alias("mb"))
    both = left.crossJoin(right).filter("a < b")  # clusters, not members: a row a pair is the result
    return both.select("a", "b", (1 - dot(F.col("ma"), F.col("mb"))).alias("centroid_distance"), normalised(F.zip_with("ma", "mb", lambda x, y: x + y)).alias("mid"))


def met(left: DataFrame, right: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of each block of left with each block of right; both are dealt by a hash of their key k."""

    def dealt(df: DataFrame, own: str, other: str, blocks: int, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    m, n = (max(1, -(-df.count() // BLOCK)) for df in (left, right))
    return dealt(left, "i", "j", m, n).groupBy("i", "j").cogroup(dealt(right, "j", "i", n, m).groupBy("i", "j")).applyInArrow(f, schema)


def matrix(t: pa.Table, name: str) -> np.ndarray:
    flat = t.column(name).combine_chunks()
    return np.array(flat.flatten(), np.float64).reshape(len(flat), -1)


def nearest_of_points(rows: DataFrame, points: DataFrame, kind: str, radius: float) -> DataFrame:
    """(k, d, chunk, dark, n): of each point the nearest member, ties to the smaller chunk, and dark members within the radius.

    rows: k (chunk), v, dark; points: k of type kind, p.
    """

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"k": y.column("k")[:0], "d": pa.array([], pa.float64()), "chunk": x.column("k")[:0], "dark": pa.array([], pa.bool_()), "n": pa.array([], pa.int64())})
        x = x.sort_by("k")
        dark = np.array(x.column("dark"), bool)
        d = np.round(1 - matrix(x, "v") @ matrix(y, "p").T, 9)
        at = d.argmin(0)
        near = (d[dark] < radius).sum(0)
        return pa.table({"k": y.column("k"), "d": pa.array(d[at, np.arange(d.shape[1])]), "chunk": x.column("k").take(pa.array(at)), "dark": pa.array(dark[at]), "n": pa.array(near, pa.int64())})

    chunk = rows.schema["k"].dataType.simpleString()
    found = met(rows, points, best, f"k {kind}, d double, chunk {chunk}, dark boolean, n long")
    return found.groupBy("k").agg(F.min(F.struct("d", "chunk", "dark")).alias("best"), F.sum("n").alias("n"))


def gaps(rows: DataFrame, cents: DataFrame, weights: DataFrame, boundary: DataFrame, junk: int = JUNK, void_radius: float = VOID_RADIUS, fringe_radius: float = FRINGE_RADIUS, boundary_least: float = BOUNDARY, most_pairs: int | None = None) -> DataFrame:
    """One row a pair of clusters of one period, however many; only a caller who names most_pairs, as the reference does, gets none beyond. weights: a, b, weight_ab, weight_ba; boundary: chunk, boundary_score."""
    if most_pairs is not None:
        clusters = cents.count()
        if clusters * (clusters - 1) // 2 > most_pairs:
            cents, rows = cents.filter("false"), rows.filter("false")
    points = stored(midpoints(cents))
    marked = dark_matter(rows.select(F.col("chunk").alias("id"), "c"), junk)
    members = stored(rows.join(marked.select(F.col("id").alias("chunk"), F.col("is_dark_matter").alias("dark")), "chunk").select(F.col("chunk").alias("k"), "c", "v", "dark"))
    n_dark = members.filter("dark").agg(F.count("*").alias("n_dark"))
    c = cents.schema["c"].dataType.simpleString()
    pair = points.select(F.struct("a", "b").alias("k"), F.col("mid").alias("p"))
    per = nearest_of_points(members.select("k", "v", "dark"), pair, f"struct<a:{c},b:{c}>", void_radius).select("k.a", "k.b", "best", F.col("n").alias("n_dark_near"))
    sizes = members.filter("c is not null").groupBy("c").agg(F.count("*").alias("n"))
    fringe = nearest_of_points(members.filter("dark").select("k", "v", "dark"), cents.select(F.col("c").alias("k"), F.col("m").alias("p")), c, fringe_radius).select(F.col("k").alias("c"), F.col("n").alias("f"))
    density = cents.select("c").join(fringe, "c", "left").join(sizes, "c", "left")
    density = density.select("c", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("f", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("fringe"))
    out = points.drop("mid").join(per, ["a", "b"]).join(density.toDF("a", "size_a", "fringe_density_a"), "a").join(density.toDF("b", "size_b", "fringe_density_b"), "b")
    own = members.filter("c <> -1").select("c", F.col("k").alias("chunk"), "v")
    out = out.join(edge_distance(own, boundary, boundary_least), ["a", "b"], "left").join(weights, ["a", "b"], "left").join(n_dark)
    ab, ba = F.coalesce("weight_ab", F.lit(0.0)), F.coalesce("weight_ba", F.lit(0.0))
    near_density = F.when(F.col("n_dark_near") > 0, F.col("n_dark_near") / (void_radius**2 * F.col("n_dark") + 1e-9)).otherwise(0.0)
    return out.select(
        F.col("a").alias("cluster_a"), F.col("b").alias("cluster_b"), "centroid_distance", F.coalesce("boundary_distance", "centroid_distance").alias("boundary_distance"),
        F.col("best.d").alias("void_depth"), "n_dark_near", near_density.alias("dark_density_near"), "fringe_density_a", "fringe_density_b", F.greatest(ab, ba).alias("connection_weight"),
        ab.alias("weight_ab"), ba.alias("weight_ba"), "size_a", "size_b", F.col("best.dark").alias("nearest_is_dark"),
        gap_type(F.greatest(ab, ba), F.col("n_dark_near"), F.col("fringe_density_a"), F.col("fringe_density_b")).alias("gap_type"),
    )


def edge_members(rows: DataFrame, boundary: DataFrame, least: float = BOUNDARY) -> DataFrame:
    """c, chunk, v of each cluster's boundary members, or of all if it has none."""
    own = rows.filter("c is not null").join(boundary, "chunk", "left").withColumn("edge", F.coalesce("boundary_score", F.lit(0.0)) > least)
    some = F.max("edge").over(Window.partitionBy("c"))
    return own.withColumn("some", some).filter("edge or not some").select("c", "chunk", "v")


def edge_distance(rows: DataFrame, boundary: DataFrame, least: float = BOUNDARY) -> DataFrame:
    """a, b, boundary_distance: the least distance of boundary members of two clusters a < b; a row a pair of clusters and block goes on."""
    c = rows.schema["c"].dataType.simpleString()

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b, least = [], [], []
        if x.num_rows and y.num_rows:
            x, y = x.sort_by("c"), y.sort_by("c")
            d = np.round(1 - matrix(x, "v") @ matrix(y, "v").T, 9)
            own, other = (np.array(t.column("c")) for t in (x, y))
            first, first_other = (np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) for o in (own, other))
            low = np.minimum.reduceat(np.minimum.reduceat(d, first, axis=0), first_other, axis=1)
            for i, p in enumerate(own[first].tolist()):
                for j, q in enumerate(other[first_other].tolist()):
                    if p < q:
                        a.append(p)
                        b.append(q)
                        least.append(low[i, j])
        kind = x.schema.field("c").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind), "d": pa.array(least, pa.float64())})

    e = stored(edge_members(rows, boundary, least).select(F.col("chunk").alias("k"), "c", "v"))
    return met(e, e, best, f"a {c}, b {c}, d double").groupBy("a", "b").agg(F.min("d").alias("boundary_distance"))


def propagation(edges: DataFrame, members: DataFrame, vectors: DataFrame, sources: int = 20, least: int = 5) -> DataFrame:
    """c, propagation_speed: the slope of mean cosine at 1, 2 and 3 hops within a cluster, from up to so many sources.

    Sources are those of the smallest hash; clusters of fewer than least members, or that three hops don't reach, get null.
    edges: src, dst; members: id, c; vectors: id, u (unit). Edges are read once; those within clusters are stored, and so is each hop.
    """
    size = members.groupBy("c").agg(F.count("*").alias("n"))
    inside = labelled(edges.select("src", "dst"), members).filter("ca = cb")
    inside = stored(inside.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).distinct())
    order = F.row_number().over(Window.partitionBy("c").orderBy(F.md5(F.col("id").cast("string")), "id"))
    start = members.withColumn("k", order).filter(F.col("k") <= sources).select("c", F.col("id").alias("s"))
    known = stored(start.select("c", "s", F.col("s").alias("t"), F.lit(0).alias("hop")))
    front = known
    for hop in (1, 2, 3):
        step = front.select("c", "s", F.col("t").alias("src")).join(inside, "src").select("c", "s", F.col("dst").alias("t")).distinct()
        front = stored(step.join(known.select("s", "t"), ["s", "t"], "left_anti").select("c", "s", "t", F.lit(hop).alias("hop")))
        known = known.union(front)
    reached = known.filter("hop > 0")
    near = vectors.join(reached.select(F.explode(F.array("s", "t")).alias("id")).distinct(), "id", "left_semi")  # or all vectors are brought to unit length
    sims = reached.join(near.toDF("s", "us"), "s").join(near.toDF("t", "ut"), "t")
    m = sims.groupBy("c").agg(*[F.avg(F.when(F.col("hop") == h, dot(F.col("us"), F.col("ut")))).alias(f"m{h}") for h in (1, 2, 3)])
    speed = F.when((F.col("n") >= least) & F.col("m2").isNotNull(), (F.col("m3") - F.col("m1")) / 2)
    return size.join(m, "c", "left").select("c", speed.alias("propagation_speed"))


def propagation_from_all(arcs: DataFrame, members: DataFrame, vectors: DataFrame, least: int = 5) -> DataFrame:
    """As propagation(), from all members. arcs: g (the cluster as text), s, t, both ways and within clusters."""
    size = members.groupBy("c").agg(F.count("*").alias("n"))
    sums = all_pairs.cosines(arcs, vectors).groupBy("g").agg(*[(F.sum(f"s{h}") / F.nullif(F.sum(f"n{h}"), F.lit(0))).alias(f"m{h}") for h in (1, 2, 3)])
    speed = F.when((F.col("n") >= least) & F.col("m2").isNotNull(), (F.col("m3") - F.col("m1")) / 2)
    return size.join(sums, F.col("c").cast("string") == F.col("g"), "left").select("c", speed.alias("propagation_speed"))


def touching(edges: DataFrame, members: DataFrame) -> DataFrame:
    """a, b, weight_ab, weight_ba of pairs a < b: the share of a's members with a neighbour (either way) in b, and of b's in a.

    edges: src, dst, ca, cb.
    """
    out = edges.filter("ca <> cb")
    both = out.select("ca", "cb", "src").union(out.select("cb", "ca", "dst"))
    share = both.groupBy("ca", "cb").agg(F.countDistinct("src").alias("k")).join(members.groupBy("c").agg(F.count("*").alias("n")).toDF("ca", "n"), "ca")
    share = share.select("ca", "cb", (F.col("k") / F.col("n")).alias("w"))
    ab, ba = share.filter("ca < cb").toDF("a", "b", "weight_ab"), share.filter("ca > cb").toDF("b", "a", "weight_ba")
    return ab.join(ba, ["a", "b"], "full")
