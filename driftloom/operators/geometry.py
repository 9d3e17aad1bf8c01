"""Where members and clusters lie and how they move. rows: period, c, chunk, v; periods are consecutive whole numbers.

Means are worked out once (one row a cluster and period) and joined by key. What compares a row with all clusters of its
period reads them as one array a period, so no row is multiplied by the number of clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions.vectors import cosine, dot, norm, normalised
from driftloom.storage import stored


def means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m (mean vector), u (the same at length 1), n. Sums are combined in each task before the shuffle."""
    parts = rows.select(*keys, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    g = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"), F.max("n").alias("n"))
    return g.select(*keys, "m", normalised(F.col("m")).alias("u"), "n")


def before(table: DataFrame, *columns: str, by: int = 1) -> DataFrame:
    """The table one period later, its other columns with the prefix p_."""
    keep = [F.col(c) if c in ("c", "chunk") else F.col(c).alias(f"p_{c}") for c in columns]
    return table.select((F.col("period") + by).alias("period"), *keep)


def minus(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def distances(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """period, c, chunk, distance (1 - cosine to the own mean), l2."""
    near = rows.join(cents.select("period", "c", "m", "u"), ["period", "c"])
    return near.select("period", "c", "chunk", (1 - dot(normalised(F.col("v")), F.col("u"))).alias("distance"), norm(minus("v", "m")).alias("l2"))


def spreads(found: DataFrame, bins: int = 20) -> DataFrame:
    """Of each cluster, from distances(): mean and L2 spread, entropy of a histogram of distances over 0..2, skewness, kurtosis and variation."""
    key = ["period", "c"]
    at = found.withColumns({"bin": F.least(F.lit(bins - 1), F.floor(F.col("distance") * (bins / 2))), "d": F.col("distance") - F.avg("distance").over(Window.partitionBy(*key))})
    counts = at.groupBy(*key, "bin").agg(F.count("*").alias("k"))
    share = counts.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy(*key)))
    entropy = share.groupBy(*key).agg((-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias("distance_entropy"))
    m = {k: F.avg(F.pow("d", F.lit(k))) for k in (2, 3, 4)}
    stats = at.groupBy(*key).agg(
        F.avg("distance").alias("mean_intra_distance"), F.avg("l2").alias("l2_spread"), (m[3] / F.pow(m[2], F.lit(1.5))).alias("skewness"),
        (m[4] / (m[2] * m[2]) - 3).alias("kurtosis"), (F.sqrt(m[2]) / F.avg("distance")).alias("cv"),
    )
    return stats.join(entropy, key)


def of_period(cents: DataFrame) -> DataFrame:
    """One row a period: an array of its clusters and their unit means."""
    return cents.groupBy("period").agg(F.collect_list(F.struct("c", "u")).alias("cs"))


def nearest_other(rows: DataFrame, cents: DataFrame, own: str = "c") -> DataFrame:
    """rows (with a unit vector u) and the nearest cluster other than their own: nearest, distance; ties go to the smaller one."""
    others = F.filter("cs", lambda x: x["c"] != F.col(own))
    best = F.array_min(F.transform(others, lambda x: F.struct(F.round(1 - dot(F.col("u"), x["u"]), 9).alias("d"), x["c"].alias("c"))))
    out = rows.join(of_period(cents), "period").withColumn("best", best)
    return out.drop("cs").select(*rows.columns, F.col("best.c").alias("nearest"), F.col("best.d").alias("distance"))


def nearest_clusters(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """Of each chunk."""
    return nearest_other(rows.select("period", "c", "chunk", normalised(F.col("v")).alias("u")), cents).drop("u")


def nearest_centroids(cents: DataFrame) -> DataFrame:
    """Of each cluster."""
    return nearest_other(cents.select("period", "c", "u"), cents).drop("u")


def corpus_drift(rows: DataFrame) -> DataFrame:
    """period, drift: cosine distance of the mean of all rows to that of the period before."""
    whole = means(rows, ["period"])
    return whole.join(before(whole, "u"), "period").select("period", (1 - dot(F.col("u"), F.col("p_u"))).alias("drift"))


def velocities(cents: DataFrame) -> DataFrame:
    """period, c, velocity (vector from the mean of the period before), speed, stability (cosine of the two)."""
    both = cents.join(before(cents, "c", "m", "u"), ["period", "c"])
    out = both.select("period", "c", minus("m", "p_m").alias("velocity"), dot(F.col("u"), F.col("p_u")).alias("stability"))
    return out.withColumn("speed", norm(F.col("velocity")))


def drift_direction(moved: DataFrame) -> DataFrame:
    """moved (velocities()) with alignment: cosine of each velocity and the mean velocity of its period; and with_before, of it and the one before."""
    mean = means(moved.select("period", F.col("velocity").alias("v")), ["period"]).select("period", F.col("m").alias("mean"))
    last = moved.select((F.col("period") + 1).alias("period"), "c", F.col("velocity").alias("last"))
    out = moved.join(mean, "period").join(last, ["period", "c"], "left")
    return out.select(*moved.columns, cosine(F.col("velocity"), F.col("mean")).alias("alignment"), F.when(F.col("last").isNotNull(), cosine(F.col("velocity"), F.col("last"))).alias("velocity_alignment"))


def trajectories(rows: DataFrame) -> DataFrame:
    """Of each chunk and period: its cluster before, changes and clusters so far, first period, periods so far and those in this cluster."""
    w = Window.partitionBy("chunk").orderBy("period")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    last = F.lag("c").over(w)
    out = rows.select("chunk", "period", "c", last.alias("previous"), F.coalesce((last != F.col("c")).cast("int"), F.lit(0)).alias("changed"))
    own = Window.partitionBy("chunk", "c").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({
        "n_changes": F.sum("changed").over(upto), "n_clusters": F.size(F.collect_set("c").over(upto)), "first_period": F.min("period").over(upto),
        "n_periods": F.count("*").over(upto), "n_in_cluster": F.count("*").over(own),
    })


def histories(cents: DataFrame) -> DataFrame:
    """One row a cluster: its periods in order, sizes, and the way its mean has gone."""
    steps = cents.join(before(cents, "c", "m"), ["period", "c"], "left").withColumn("step", F.when(F.col("p_m").isNotNull(), norm(minus("m", "p_m"))))
    g = steps.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("period", "n"))).alias("h"), F.sum("step").alias("path"), F.count("*").alias("n_periods"))
    return g.select("c", "n_periods", F.array_join(F.transform("h", lambda x: F.concat(x["period"], F.lit(":"), x["n"])), ",").alias("sizes"), "path")


def centroid_pairs(cents: DataFrame) -> DataFrame:
    """period, a, b, distance of all clusters a < b of a period (clusters, which are few against members)."""
    a, b = cents.select("period", F.col("c").alias("a"), F.col("u").alias("ua")), cents.select("period", F.col("c").alias("b"), F.col("u").alias("ub"))
    return a.join(b, "period").filter("a < b").select("period", "a", "b", (1 - dot(F.col("ua"), F.col("ub"))).alias("distance"))


def convergence(pairs: DataFrame) -> DataFrame:
    """pairs of two periods with convergence: what part of their distance they have lost, 0..1."""
    then = pairs.select((F.col("period") + 1).alias("period"), "a", "b", F.col("distance").alias("before"))
    lost = (F.col("before") - F.col("distance")) / F.greatest(F.col("before"), F.lit(1e-9))
    return pairs.join(then, ["period", "a", "b"]).withColumn("convergence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), lost)))


def converging(found: DataFrame, least: float = 0.01, within: float = 1.0) -> DataFrame:
    """period, n_converging: pairs that come together and are near."""
    return found.groupBy("period").agg(F.count_if((F.col("convergence") >= least) & (F.col("distance") <= within)).alias("n_converging"))


def precursors(series: DataFrame, gap: str, converging: str, least_gap: float, many: int) -> DataFrame:
    """series with is_precursor and why: a small gap, many converging pairs, or both."""
    small, drawn = F.col(gap) <= least_gap, F.col(converging) >= many
    why = F.when(small & drawn, "both").when(small, "gap").when(drawn, "converging").otherwise("none")
    return series.select("*", (small | drawn).alias("is_precursor"), why.alias("why"))


def lineage_depth(rows: DataFrame) -> DataFrame:
    """Of each chunk and period: in how many earlier periods its present cluster had members."""
    present = rows.select("period", "c").distinct()
    depth = present.select("period", "c", (F.row_number().over(Window.partitionBy("c").orderBy("period")) - 1).alias("depth"))
    return rows.select("period", "c", "chunk").join(depth, ["period", "c"])


def seldom_settled(found: DataFrame, least: int, sigmas: float = 1.0) -> DataFrame:
    """Chunks that were no outliers (distance within sigmas of their cluster's mean) in fewer than least periods."""
    w = Window.partitionBy("period", "c")
    inside = F.col("distance") <= F.avg("distance").over(w) + sigmas * F.stddev_pop("distance").over(w)
    return found.select("chunk", "period", inside.alias("inside")).groupBy("chunk").agg(F.count_if("inside").alias("n_settled")).filter(F.col("n_settled") < least)


def surprise_levels(found: DataFrame) -> DataFrame:
    """Distances seen at three levels: a chunk's z-score in its cluster, the cluster's in its period, the period's mean."""
    w = Window.partitionBy("period", "c")
    sd = F.stddev_samp("distance").over(w)
    chunk = found.select("period", "c", "chunk", F.when(sd != 0, (F.col("distance") - F.avg("distance").over(w)) / sd).alias("chunk_surprise"))
    cluster = found.groupBy("period", "c").agg(F.avg("distance").alias("cluster_surprise"))
    corpus = found.groupBy("period").agg(F.avg("distance").alias("corpus_surprise"))
    return chunk.join(cluster, ["period", "c"]).join(corpus, "period")


def reachable(pairs: DataFrame) -> DataFrame:
    """c, n_reachable: clusters one edge away; pairs: cluster_a, cluster_b."""
    both = pairs.select(F.col("cluster_a").alias("c"), F.col("cluster_b").alias("o")).union(pairs.select("cluster_b", "cluster_a"))
    return both.groupBy("c").agg(F.countDistinct("o").alias("n_reachable"))


def hops(pairs: DataFrame) -> DataFrame:
    """a, b, hops of all clusters that edges join, by breadth, however far; pairs: cluster_a, cluster_b. Each round is stored, so plans don't grow."""
    arcs = pairs.select(F.col("cluster_a").alias("a"), F.col("cluster_b").alias("b")).union(pairs.select("cluster_b", "cluster_a")).distinct()
    arcs = stored(arcs)
    known = arcs.withColumn("hops", F.lit(1))
    front, before, n = known, None, 1
    while True:
        n += 1
        step = front.select("a", F.col("b").alias("via")).join(arcs.toDF("via", "b"), "via").filter("a <> b").select("a", "b").distinct()
        for seen in (front, before):  # what is next to a node is as far as it, or one hop nearer or farther
            step = step if seen is None else step.join(seen.select("a", "b"), ["a", "b"], "left_anti")
        far = stored(step.withColumn("hops", F.lit(n)))
        if far.isEmpty():
            return known
        known, front, before = known.union(far), far, front
