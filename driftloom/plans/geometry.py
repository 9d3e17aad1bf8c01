"""Geometry and movement of the clusters of four periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import clusters, panel
from driftloom.operators import geometry as ops
from driftloom.plans.core import query, table
from driftloom.plans.graph import BOTH, SIZES, E, cluster_edges
from driftloom.plans.graph import CENTS as LABEL_CENTS
from driftloom.plans.observed import MEANS, OBS, UNIT, observed

BASE = f"WITH {OBS}, {MEANS}"
DIST = f"""{BASE}, dist AS (SELECT o.period, o.c, o.chunk, {UNIT.format(v='o.v')} AS uv, 1 - list_inner_product(o.v, c.u) / sqrt(list_inner_product(o.v, o.v)) AS distance,
  sqrt(list_sum(list_transform(list_zip(o.v, c.m), lambda z: (z[1] - z[2]) ** 2))) AS l2 FROM obs o JOIN means c USING (period, c))"""
PREV = "prev AS (SELECT period + 1 AS period, c, m AS pm, u AS pu, n AS pn FROM means)"
SUB = "list_transform(list_zip(m, pm), lambda z: z[1] - z[2])"
VEL = f"{BASE}, {PREV}, vel AS (SELECT period, c, {SUB} AS velocity, list_inner_product(u, pu) AS stability FROM means JOIN prev USING (period, c))"
LEN = "sqrt(list_inner_product({v}, {v}))"


def r(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def cents(s, d):
    return ops.means(observed(s, d), ["period", "c"])


def found(s, d):
    return ops.distances(observed(s, d), cents(s, d))


@query("centroid_distance", f"{DIST} SELECT period, c, chunk, round(distance, 6) AS distance, round(l2, 6) AS l2 FROM dist")
def centroid_distance(s, d):
    return r(found(s, d), "distance", "l2")


@query("cluster_spreads", f"""{DIST}, b AS (SELECT *, least(19, floor(distance * 10)) AS bin, distance - avg(distance) OVER (PARTITION BY period, c) AS d FROM dist),
  h AS (SELECT period, c, -sum(k / n * log2(k / n + 1e-12)) AS distance_entropy FROM (SELECT period, c, bin, count(*) AS k, sum(count(*)) OVER (PARTITION BY period, c) AS n FROM b GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT period, c, round(avg(distance), 6) AS mean_intra_distance, round(avg(l2), 6) AS l2_spread, round(avg(d ** 3) / avg(d ** 2) ** 1.5, 4) AS skewness, round(avg(d ** 4) / avg(d ** 2) ** 2 - 3, 4) AS kurtosis,
  round(sqrt(avg(d ** 2)) / avg(distance), 6) AS cv, round(any_value(distance_entropy), 6) AS distance_entropy FROM b JOIN h USING (period, c) GROUP BY 1, 2""")
def cluster_spreads(s, d):
    return r(r(ops.spreads(found(s, d)), "skewness", "kurtosis", digits=4), "mean_intra_distance", "l2_spread", "cv", "distance_entropy")


@query("nearest_clusters", f"""{DIST} SELECT period, c, chunk, arg_min(o, (dd, o)) AS nearest, min(dd) AS distance FROM
  (SELECT d.period, d.c, chunk, m.c AS o, round(1 - list_inner_product(uv, u), 9) AS dd FROM dist d JOIN means m ON d.period = m.period AND d.c <> m.c) GROUP BY 1, 2, 3""".replace("min(dd) AS distance", "round(min(dd), 6) AS distance"))
def nearest_clusters(s, d):
    return r(ops.nearest_clusters(observed(s, d), cents(s, d)), "distance")


@query("nearest_centroids", f"{BASE} SELECT a.period, a.c, round(min(round(1 - list_inner_product(a.u, b.u), 9)), 6) AS distance, arg_min(b.c, (round(1 - list_inner_product(a.u, b.u), 9), b.c)) AS nearest FROM means a JOIN means b ON a.period = b.period AND a.c <> b.c GROUP BY 1, 2")
def nearest_centroids(s, d):
    return r(ops.nearest_centroids(cents(s, d)), "distance")


@query("corpus_drift", f"""WITH {OBS}, whole AS (SELECT period, list(m ORDER BY i) AS m FROM (SELECT period, i, avg(x) AS m FROM (SELECT period, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM obs) GROUP BY 1, 2) GROUP BY 1)
  SELECT a.period, round(1 - list_cosine_similarity(a.m, b.m), 6) AS drift FROM whole a JOIN whole b ON a.period = b.period + 1""")
def corpus_drift(s, d):
    return r(ops.corpus_drift(observed(s, d)), "drift")


@query("velocity_vectors", f"{VEL} SELECT period, c, list_transform(velocity, lambda x: round(x, 6)) AS velocity, round({LEN.format(v='velocity')}, 6) AS speed, round(stability, 6) AS stability FROM vel")
def velocity_vectors(s, d):
    return r(ops.velocities(cents(s, d)).withColumn("velocity", F.transform("velocity", lambda x: F.round(x, 6))), "speed", "stability")


@query("drift_direction", f"""{VEL}, mv AS (SELECT period, list(x ORDER BY i) AS mean FROM (SELECT period, i, avg(x) AS x FROM (SELECT period, unnest(range(1, len(velocity) + 1)) AS i, unnest(velocity) AS x FROM vel) GROUP BY 1, 2) GROUP BY 1)
  SELECT v.period, v.c, round(list_cosine_similarity(v.velocity, mean), 6) AS alignment, round(list_cosine_similarity(v.velocity, b.velocity), 6) AS velocity_alignment
  FROM vel v JOIN mv USING (period) LEFT JOIN vel b ON b.period = v.period - 1 AND b.c = v.c""")
def drift_direction(s, d):
    return r(ops.drift_direction(ops.velocities(cents(s, d))), "alignment", "velocity_alignment").select("period", "c", "alignment", "velocity_alignment")


@query("chunk_trajectory", f"""WITH {OBS}, t AS (SELECT chunk, period, c, lag(c) OVER w AS previous FROM obs WINDOW w AS (PARTITION BY chunk ORDER BY period)), f AS (SELECT *, CASE WHEN previous <> c THEN 1 ELSE 0 END AS changed FROM t)
  SELECT chunk, period, c, previous, changed, CAST(sum(changed) OVER w AS BIGINT) AS n_changes, CAST(len(list_distinct(list(c) OVER w)) AS INTEGER) AS n_clusters, min(period) OVER w AS first_period, count(*) OVER w AS n_periods,
  count(*) OVER (PARTITION BY chunk, c ORDER BY period) AS n_in_cluster FROM f WINDOW w AS (PARTITION BY chunk ORDER BY period)""")
def chunk_trajectory(s, d):
    return ops.trajectories(observed(s, d))


@query("centroid_history", f"""{BASE}, {PREV}, st AS (SELECT period, c, n, CASE WHEN pm IS NOT NULL THEN sqrt(list_sum(list_transform(list_zip(m, pm), lambda z: (z[1] - z[2]) ** 2))) END AS step FROM means LEFT JOIN prev USING (period, c))
  SELECT c, count(*) AS n_periods, string_agg(period || ':' || n, ',' ORDER BY period) AS sizes, round(sum(step), 6) AS path FROM st GROUP BY c""")
def centroid_history(s, d):
    return r(ops.histories(cents(s, d)), "path")


PAIRS = f"{BASE}, pr AS (SELECT a.period, a.c AS a, b.c AS b, 1 - list_inner_product(a.u, b.u) AS distance FROM means a JOIN means b ON a.period = b.period AND a.c < b.c)"
CONV = f"{PAIRS}, cv AS (SELECT n.period, n.a, n.b, n.distance, greatest(0, least(1, (o.distance - n.distance) / greatest(o.distance, 1e-9))) AS convergence FROM pr n JOIN pr o ON n.period = o.period + 1 AND n.a = o.a AND n.b = o.b)"


def conv(s, d):
    return ops.convergence(ops.centroid_pairs(cents(s, d)))


@query("convergence_score", f"{CONV} SELECT period, a, b, round(distance, 6) AS distance, round(convergence, 6) AS convergence FROM cv")
def convergence_score(s, d):
    return r(conv(s, d), "distance", "convergence").drop("before")


@query("converging_pairs", f"{CONV} SELECT period, count(*) FILTER (WHERE convergence >= 0.01 AND distance <= 1.0) AS n_converging FROM cv GROUP BY period")
def converging_pairs(s, d):
    return ops.converging(conv(s, d))


@query("precursor_flags", f"""{CONV}, x AS (SELECT period, count(*) FILTER (WHERE convergence >= 0.01 AND distance <= 1.0) AS n_converging, round(min(distance), 6) AS gap FROM cv GROUP BY period)
  SELECT period, gap, n_converging, gap <= 0.6 OR n_converging >= 30 AS is_precursor, CASE WHEN gap <= 0.6 AND n_converging >= 30 THEN 'both' WHEN gap <= 0.6 THEN 'gap' WHEN n_converging >= 30 THEN 'converging' ELSE 'none' END AS why FROM x""")
def precursor_flags(s, d):
    found = conv(s, d)
    series = ops.converging(found).join(found.groupBy("period").agg(F.round(F.min("distance"), 6).alias("gap")), "period")
    return ops.precursors(series, "gap", "n_converging", 0.6, 30)


@query("lineage_depth", f"WITH {OBS}, p AS (SELECT DISTINCT period, c FROM obs) SELECT o.period, o.c, o.chunk, CAST(count(p.period) AS INTEGER) AS depth FROM obs o LEFT JOIN p ON p.c = o.c AND p.period < o.period GROUP BY 1, 2, 3")
def lineage_depth(s, d):
    return ops.lineage_depth(observed(s, d))


@query("seldom_settled", f"""{DIST}, i AS (SELECT chunk, round(distance, 9) <= round(avg(distance) OVER w + stddev_pop(distance) OVER w, 9) AS inside FROM dist WINDOW w AS (PARTITION BY period, c))
  SELECT chunk, count(*) FILTER (WHERE inside) AS n_settled FROM i GROUP BY chunk HAVING count(*) FILTER (WHERE inside) < 2""")
def seldom_settled(s, d):
    return ops.seldom_settled(found(s, d), 2)


@query("surprise_levels", f"""{DIST} SELECT period, c, chunk, round((distance - avg(distance) OVER w) / nullif(stddev_samp(distance) OVER w, 0), 5) AS chunk_surprise, round(avg(distance) OVER w, 6) AS cluster_surprise,
  round(avg(distance) OVER (PARTITION BY period), 6) AS corpus_surprise FROM dist WINDOW w AS (PARTITION BY period, c)""")
def surprise_levels(s, d):
    return r(r(ops.surprise_levels(found(s, d)), "chunk_surprise", digits=5), "cluster_surprise", "corpus_surprise")


@query("perturbation", f"""{DIST}, x AS (SELECT period, c, chunk, abs(distance - lag(distance) OVER (PARTITION BY chunk ORDER BY period)) AS moved FROM dist) SELECT period, c, round(avg(moved), 6) AS mean_perturbation, round(max(moved), 6) AS most FROM x WHERE moved IS NOT NULL GROUP BY 1, 2""")
def perturbation(s, d):
    moved = panel.pressure_rate(found(s, d), "distance", "moved", "chunk").filter("moved is not null").withColumn("moved", F.abs("moved"))
    return r(moved.groupBy("period", "c").agg(F.avg("moved").alias("mean_perturbation"), F.max("moved").alias("most")), "mean_perturbation", "most")


EDGES = f"WITH {E}, {BOTH}, {SIZES}, ce AS (SELECT DISTINCT ca AS cluster_a, cb AS cluster_b FROM both_ends WHERE src < dst AND ca <> cb)"


@query("cluster_reachability", f"{EDGES} SELECT c, count(DISTINCT o) AS n_reachable FROM (SELECT cluster_a AS c, cluster_b AS o FROM ce UNION ALL SELECT cluster_b, cluster_a FROM ce) GROUP BY c")
def cluster_reachability(s, d):
    return ops.reachable(cluster_edges(s, d))


CHAIN = "ce AS (SELECT DISTINCT (c_nationkey + k) % 25 AS a, (c_nationkey + k + 1 + k * 3) % 25 AS b FROM customer, (SELECT unnest(range(2)) AS k) WHERE c_nationkey % 4 <> 3)"
WALK = f"""WITH RECURSIVE {CHAIN}, arcs AS (SELECT a, b FROM ce WHERE a <> b UNION SELECT b, a FROM ce WHERE a <> b), walk AS (SELECT a, b, 1 AS hops FROM arcs UNION SELECT w.a, arcs.b, hops + 1 FROM walk w JOIN arcs ON w.b = arcs.a WHERE hops < 25),
  hop AS (SELECT a, b, min(hops) AS hops FROM walk WHERE a <> b GROUP BY 1, 2)"""


def chain(s, d):
    """A sparse graph of nations, so that ways have some length."""
    c = table(s, d, "customer").filter("c_nationkey % 4 <> 3").select("c_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    e = c.select(((F.col("c_nationkey") + F.col("k")) % 25).alias("cluster_a"), ((F.col("c_nationkey") + F.col("k") + 1 + F.col("k") * 3) % 25).alias("cluster_b"))
    return e.filter("cluster_a <> cluster_b").distinct()


@query("graph_distance", f"{WALK} SELECT a, b, hops FROM hop")
def graph_distance(s, d):
    return ops.hops(chain(s, d))


@query("graph_diameter", f"{WALK} SELECT max(hops) AS diameter, round(avg(hops), 6) AS mean_path FROM hop")
def graph_diameter(s, d):
    return r(ops.hops(chain(s, d)).agg(F.max("hops").alias("diameter"), F.avg("hops").alias("mean_path")), "mean_path")


@query("cluster_pair_distance", f"{EDGES}, {LABEL_CENTS} SELECT cluster_a, cluster_b, round(list_cosine_similarity(x.centroid, y.centroid), 6) AS similarity FROM ce JOIN cents x ON x.c = cluster_a JOIN cents y ON y.c = cluster_b")
def cluster_pair_distance(s, d):
    from driftloom.functions.vectors import cosine

    m = clusters.centroids(table(s, d, "embeddings").filter("label is not null"), "label", "embedding")
    e = cluster_edges(s, d).join(m.toDF("cluster_a", "x"), "cluster_a").join(m.toDF("cluster_b", "y"), "cluster_b")
    return e.select("cluster_a", "cluster_b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("voids_per_period", f"""{PAIRS}, sh AS (SELECT DISTINCT x.period, least(x.c, y.c) AS a, greatest(x.c, y.c) AS b FROM obs x JOIN obs y ON x.period = y.period + 1 AND x.chunk = y.chunk AND x.c <> y.c)
  SELECT period, count(*) AS n_voids FROM pr WHERE round(distance, 9) <= 0.9 AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.period = pr.period AND sh.a = pr.a AND sh.b = pr.b) GROUP BY period""")
def voids_per_period(s, d):
    """Near pairs of clusters between which no member has moved."""
    rows = observed(s, d).select("period", "c", "chunk")
    moved = rows.join(rows.select((F.col("period") + 1).alias("period"), "chunk", F.col("c").alias("o")), ["period", "chunk"]).filter("c <> o")
    moved = moved.select("period", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b")).distinct()
    near = ops.centroid_pairs(cents(s, d)).filter(F.round("distance", 9) <= 0.9)
    return near.join(moved, ["period", "a", "b"], "left_anti").groupBy("period").agg(F.count("*").alias("n_voids"))
