"""Neighbour graphs over the embeddings table; a vector's label is its cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import clusters, gaps, shapes, spectra
from driftloom.operators import communities as leiden
from driftloom.operators import graph_rounds as rounds
from driftloom.operators.knn import knn
from driftloom.plans.core import query, table
from driftloom.storage import stored

K = 16


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(emb(spark, sf_dir), K)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("c")).filter("c is not null")


COS = "list_inner_product(a.u, b.u)"
UNIT = "SELECT vec_id AS id, label AS c, list_transform(embedding, lambda x: x::DOUBLE / CASE WHEN n = 0 THEN 1 ELSE n END) AS u FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)"
E = f"""unit AS ({UNIT}), edges AS (SELECT src, dst, sim, rank FROM (SELECT a.id AS src, b.id AS dst, round({COS}, 9) AS sim,
  row_number() OVER (PARTITION BY a.id ORDER BY round({COS}, 9) DESC, b.id) AS rank FROM unit a JOIN unit b ON a.id <> b.id) WHERE rank <= {K}),
members AS (SELECT vec_id AS id, label AS c FROM embeddings WHERE label IS NOT NULL)"""
BOTH = "both_ends AS (SELECT e.*, a.c AS ca, b.c AS cb FROM edges e JOIN members a ON e.src = a.id JOIN members b ON e.dst = b.id)"
PAIRS = "pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, greatest(max(sim), 0.0) AS weight FROM edges GROUP BY 1, 2)"
SIZES = "sizes AS (SELECT c, count(*) AS n FROM members GROUP BY c)"
RAW = """measures AS (SELECT m.id, m.c, coalesce(avg(1 - sim), 0) AS point_density, 1 - coalesce(avg(1 - sim), 0) AS mean_similarity,
  coalesce(avg(CASE WHEN ca <> cb THEN 1.0 ELSE 0.0 END) FILTER (WHERE src IS NOT NULL), 0) AS boundary_score,
  coalesce(CASE WHEN count(sim) >= 2 THEN stddev_pop(1 - sim) ELSE 0.0 END / (avg(1 - sim) + 1e-9), 0) AS uncertainty,
  coalesce(CASE WHEN count(sim) >= 2 THEN stddev_pop(1 - sim) ELSE 0.0 END, 0) AS boundary_proximity, 1 / greatest(coalesce(avg(1 - sim), 0), 1e-9) AS energy
  FROM members m LEFT JOIN both_ends ON src = m.id GROUP BY m.id, m.c)"""
MEASURES = RAW.replace("measures AS", "raw AS") + ", measures AS (SELECT id, c, " + ", ".join(f"round({m}, 6) AS {m}" for m in clusters.MEASURES) + " FROM raw)"
CENTS = "cents AS (SELECT c, list(m ORDER BY i) AS centroid FROM (SELECT label AS c, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings WHERE label IS NOT NULL) GROUP BY 1, 2) GROUP BY c)"
FEDGE = """SELECT ca AS cluster_a, cb AS cluster_b, n_shared_edges, round(na / a.n, 6) AS overlap_a, round(nb / b.n, 6) AS overlap_b, greatest(round(na / a.n, 6), round(nb / b.n, 6)) AS overlap
  FROM (SELECT ca, cb, count(*) AS n_shared_edges, count(DISTINCT src) AS na, count(DISTINCT dst) AS nb FROM {f} GROUP BY 1, 2) JOIN sizes a ON ca = a.c JOIN sizes b ON cb = b.c"""


@query("knn_topk", f"WITH {E} SELECT src, dst, round(sim, 6) AS sim, rank FROM edges")
def knn_topk(s, d):
    return edges(s, d).select("src", "dst", F.round("sim", 6).alias("sim"), "rank")


@query("knn_by_period", f"""WITH unit AS ({UNIT}) SELECT period, src, dst, round(sim, 6) AS sim, rank FROM (SELECT CAST(a.id % 4 AS VARCHAR) AS period, a.id AS src, b.id AS dst, round({COS}, 9) AS sim,
  row_number() OVER (PARTITION BY a.id ORDER BY round({COS}, 9) DESC, b.id) AS rank FROM unit a JOIN unit b ON a.id <> b.id AND a.id % 4 = b.id % 4) WHERE rank <= 8""")
def knn_by_period(s, d):
    out = knn(emb(s, d).withColumn("period", F.col("vec_id") % 4), 8, group="period")
    return out.select("period", "src", "dst", F.round("sim", 6).alias("sim"), "rank")


@query("knn_edge_dedup", f"WITH {E}, {PAIRS} SELECT a, b, round(weight, 6) AS weight FROM pairs")
def knn_edge_dedup(s, d):
    return clusters.undirected(edges(s, d)).withColumn("weight", F.round("weight", 6))


@query("cluster_edges", f"WITH {E}, {BOTH}, {SIZES}, f AS (SELECT * FROM both_ends WHERE src < dst AND ca <> cb) {FEDGE.format(f='f')}")
def cluster_edges(s, d):
    return clusters.cluster_edges(edges(s, d), members(s, d))


@query("cluster_edges_canonical", f"""WITH {E}, {BOTH}, {SIZES}, f AS (SELECT CASE WHEN ca > cb THEN dst ELSE src END AS src, CASE WHEN ca > cb THEN src ELSE dst END AS dst, least(ca, cb) AS ca, greatest(ca, cb) AS cb
  FROM both_ends WHERE ca <> cb) {FEDGE.format(f='f')}""")
def cluster_edges_canonical(s, d):
    return clusters.cluster_edges(edges(s, d), members(s, d), canonical=True)


@query("bridge_members", f"WITH {E}, {BOTH} SELECT least(ca, cb) AS cluster_a, greatest(ca, cb) AS cluster_b, CAST(sum(n) AS BIGINT) AS n_bridges FROM (SELECT ca, cb, count(DISTINCT src) AS n FROM both_ends WHERE ca <> cb GROUP BY 1, 2) GROUP BY 1, 2")
def bridge_members(s, d):
    return clusters.bridges(edges(s, d), members(s, d))


@query("cluster_centroids", f"WITH {CENTS} SELECT c, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM cents")
def cluster_centroids(s, d):
    return clusters.centroids(emb(s, d).filter("label is not null"), "label", "embedding").select("c", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query("void_pairs", f"""WITH {E}, {BOTH}, {CENTS}, cn AS (SELECT c, centroid, sqrt(list_inner_product(centroid, centroid)) AS n FROM cents),
  near AS (SELECT a.c AS a, b.c AS b, 1 - list_inner_product(a.centroid, b.centroid) / (a.n * b.n) AS distance FROM cn a JOIN cn b ON a.c < b.c)
  SELECT a, b, round(distance, 6) AS distance FROM near WHERE distance <= 1.2 AND NOT EXISTS (SELECT 1 FROM both_ends x WHERE src < dst AND rank <= 1 AND sim > 0.45 AND ((ca = a AND cb = b) OR (ca = b AND cb = a)))""")
def void_pairs(s, d):
    cents = clusters.centroids(emb(s, d).filter("label is not null"), "label", "embedding")
    return clusters.voids(cents, clusters.cluster_edges(edges(s, d).filter("rank <= 1 and sim > 0.45"), members(s, d)), 1.2)


@query("member_measures", f"WITH {E}, {BOTH}, {MEASURES} SELECT * FROM measures")
def member_measures(s, d):
    return clusters.member_measures(edges(s, d), members(s, d)).withColumns({m: F.round(m, 6) for m in clusters.MEASURES})


@query("cluster_stats", f"""WITH {E}, {BOTH}, {RAW}, st AS (SELECT *, avg(point_density) OVER (PARTITION BY c) AS mu, stddev_pop(point_density) OVER (PARTITION BY c) AS sd FROM measures)
  SELECT c, count(*) AS size, round(avg(point_density), 6) AS mean_density, round(avg(CASE WHEN point_density > mu + 2 * sd THEN 1.0 ELSE 0.0 END), 4) AS outlier_fraction, round(avg(uncertainty), 6) AS mean_uncertainty,
  round(CASE WHEN count(*) >= 5 THEN quantile_cont(boundary_score, 0.9) - quantile_cont(boundary_score, 0.1) END, 6) AS boundary_sharpness FROM st GROUP BY c""")
def cluster_stats(s, d):
    return clusters.cluster_stats(clusters.member_measures(edges(s, d), members(s, d)))


@query("graph_degree", f"WITH {E}, {PAIRS}, dg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY id) SELECT m.id, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) / ((SELECT count(*) FROM members) - 1), 6) AS degree_centrality FROM members m LEFT JOIN dg USING (id)")
def graph_degree(s, d):
    return clusters.degrees(edges(s, d), members(s, d))


@query("triangles", f"""WITH {E}, {PAIRS}, tri AS (SELECT x.a, x.b, y.b AS z FROM pairs x JOIN pairs y ON x.b = y.a JOIN pairs w ON w.a = x.a AND w.b = y.b),
  t AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT z FROM tri) GROUP BY id),
  dg AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY id)
  SELECT id, coalesce(t, 0) AS triangle_count, round(CASE WHEN coalesce(d, 0) > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0 END, 6) AS clustering_coeff FROM members LEFT JOIN dg USING (id) LEFT JOIN t USING (id)""")
def triangles(s, d):
    return clusters.triangles(edges(s, d), members(s, d))


@query("modularity", f"""WITH {E}, {PAIRS}, e2 AS (SELECT p.*, x.c AS ca, y.c AS cb FROM pairs p JOIN members x ON a = x.id JOIN members y ON b = y.id), m AS (SELECT sum(weight) AS m FROM e2),
  k AS (SELECT c, sum(weight) AS k FROM (SELECT ca AS c, weight FROM e2 UNION ALL SELECT cb, weight FROM e2) GROUP BY c), w AS (SELECT ca AS c, sum(weight) AS w FROM e2 WHERE ca = cb GROUP BY ca)
  SELECT round(sum(coalesce(w, 0) / m - (k / (2 * m)) ** 2), 6) AS modularity FROM k LEFT JOIN w USING (c), m""")
def modularity(s, d):
    return clusters.modularity(edges(s, d), members(s, d))


@query("attractors", f"""WITH {E}, {BOTH}, {MEASURES}, sy AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
  per AS (SELECT src, x.c, count(*) AS n, max(y.point_density) AS hi, min(y.point_density) AS lo, any_value(x.point_density) AS own FROM sy JOIN measures x ON src = x.id JOIN measures y ON dst = y.id AND x.c = y.c GROUP BY src, x.c HAVING count(*) >= 2)
  SELECT z.c, count(per.c) FILTER (WHERE own < lo) AS n_attractors, count(per.c) FILTER (WHERE own > hi) AS n_saddles FROM (SELECT c FROM members GROUP BY c HAVING count(*) >= 5) z LEFT JOIN per ON per.c = z.c GROUP BY z.c""")
def attractors(s, d):
    return clusters.attractors(edges(s, d), member_measures(s, d))


@query("size_entropy", f"WITH members AS (SELECT label AS c FROM embeddings WHERE label IS NOT NULL), {SIZES}, p AS (SELECT n / (SELECT sum(n) FROM sizes) AS p FROM sizes) SELECT round(-sum(p * log2(p + 1e-12)), 6) AS entropy, round(log2(count(*)) + sum(p * log2(p + 1e-12)), 6) AS kl_from_uniform FROM p")
def size_entropy(s, d):
    return clusters.size_entropy(members(s, d))


def ranks(rounds: int) -> str:
    out = f"WITH {E}, {PAIRS}, nn AS (SELECT count(*) AS n FROM members), arcs0 AS (SELECT a AS s, b AS t FROM pairs UNION ALL SELECT b, a FROM pairs), arcs AS MATERIALIZED (SELECT s, t, count(*) OVER (PARTITION BY s) AS d FROM arcs0), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM members, nn)"
    for i in range(1, rounds + 1):
        out += f", g{i} AS (SELECT t AS id, sum(r / d) AS g FROM arcs JOIN r{i - 1} ON s = id GROUP BY t), r{i} AS MATERIALIZED (SELECT id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(g, 0) AS r FROM members LEFT JOIN g{i} USING (id), nn)"
    return out + f" SELECT id, round(r, 8) AS pagerank FROM r{rounds}"


@query("pagerank_fixed", ranks(5))
def pagerank_fixed(s, d):
    return clusters.pagerank(edges(s, d), members(s, d), 5)


def grouped(s, d):
    """Edges and members of each period (vec_id modulo 4), as one row set a period."""
    e = knn(emb(s, d).withColumn("period", F.col("vec_id") % 4), 8, group="period")
    return e.select("period", "src", "dst", "sim")


#: The graphs of the periods: 8 neighbours, the larger similarity of a pair.
GRAPHS = f"""unit AS ({UNIT}), near AS (SELECT CAST(a.id % 4 AS VARCHAR) AS g, a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY round({COS}, 9) DESC, b.id) AS rank
  FROM unit a JOIN unit b ON a.id <> b.id AND a.id % 4 = b.id % 4), arcs AS MATERIALIZED (SELECT g, src AS s, dst AS t FROM near WHERE rank <= 8 UNION SELECT g, dst, src FROM near WHERE rank <= 8)"""


def levels(most: int, given: str) -> str:
    """(g, s, t, d, paths) of all pairs by the number of hops; deeper graphs than most would show as a difference."""
    out = f"{given}, l0 AS MATERIALIZED (SELECT g, s, s AS t, 0 AS d, 1.0::DOUBLE AS paths FROM (SELECT DISTINCT g, s FROM arcs)), f0 AS (SELECT g, s, t FROM l0)"
    for i in range(1, most + 1):
        out += f""", l{i} AS MATERIALIZED (SELECT l.g, l.s, a.t, {i} AS d, sum(l.paths) AS paths FROM l{i - 1} l JOIN arcs a ON a.g = l.g AND a.s = l.t
  WHERE NOT EXISTS (SELECT 1 FROM f{i - 1} f WHERE f.g = l.g AND f.s = l.s AND f.t = a.t) GROUP BY l.g, l.s, a.t), f{i} AS MATERIALIZED (SELECT * FROM f{i - 1} UNION ALL SELECT g, s, t FROM l{i})"""
    return out + ", pairs AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(most + 1)) + ")"


@query("core_number", f"""WITH RECURSIVE {GRAPHS}, peel AS (SELECT DISTINCT g, s AS id, 1 AS k FROM arcs UNION ALL
  SELECT g, id, CASE WHEN low THEN k ELSE k + 1 END FROM (SELECT p.g, p.id, p.k, coalesce(q.d, 0) AS d, bool_or(coalesce(q.d, 0) < p.k) OVER (PARTITION BY p.g) AS low FROM peel p
    LEFT JOIN (SELECT x.g, x.id, count(*) AS d FROM peel x JOIN arcs ON arcs.g = x.g AND arcs.s = x.id JOIN peel y ON y.g = x.g AND y.id = arcs.t GROUP BY 1, 2) q ON q.g = p.g AND q.id = p.id)
  WHERE NOT low OR d >= k) SELECT g AS period, id, CAST(max(k) - 1 AS BIGINT) AS core_number FROM peel GROUP BY 1, 2""")
def core_number(s, d):
    return rounds.core_numbers(period_arcs(s, d)).withColumnRenamed("g", "period")


@query("betweenness", f"""WITH {levels(9, GRAPHS)}, n AS (SELECT g, count(*) AS n FROM l0 GROUP BY g),
  way AS (SELECT st.g, sv.t AS id, sum(sv.paths * vt.paths / st.paths) AS b FROM pairs st JOIN pairs sv ON sv.g = st.g AND sv.s = st.s JOIN pairs vt ON vt.g = st.g AND vt.s = sv.t AND vt.t = st.t AND sv.d + vt.d = st.d
    WHERE sv.t <> st.s AND sv.t <> st.t GROUP BY 1, 2)
  SELECT l0.g AS period, l0.s AS id, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 9) AS betweenness FROM l0 JOIN n ON n.g = l0.g LEFT JOIN way ON way.g = l0.g AND way.id = l0.s""")
def betweenness(s, d):
    return rounds.betweenness(period_arcs(s, d)).select(F.col("g").alias("period"), "id", F.round("betweenness", 9).alias("betweenness"))


@query("harmonic", f"""WITH {levels(9, GRAPHS)}, h AS (SELECT g, s, coalesce(sum(1.0::DOUBLE / d) FILTER (WHERE d > 0), 0) AS h FROM pairs GROUP BY g, s)
  SELECT g AS period, s AS id, round(h / max(h) OVER (PARTITION BY g), 9) AS harmonic FROM h""")
def harmonic(s, d):
    return rounds.harmonic(period_arcs(s, d)).select(F.col("g").alias("period"), "id", F.round("harmonic", 9).alias("harmonic"))


@query("katz")
def katz(s, d):
    return rounds.katz(period_arcs(s, d)).withColumnRenamed("g", "period")


@query("eigenvector")
def eigenvector(s, d):
    return spectra.eigenvector(period_arcs(s, d)).withColumnRenamed("g", "period")


@query("spectral")
def spectral(s, d):
    return spectra.spectral(period_arcs(s, d)).withColumnRenamed("g", "period")


@query("communities")
def communities(s, d):
    return leiden.leiden(period_arcs(s, d)).withColumnRenamed("g", "period")


@query("pagerank_settled", f"""WITH RECURSIVE {E}, {PAIRS}, nn AS (SELECT count(*) AS n FROM members), both_ways AS (SELECT a AS s, b AS t FROM pairs UNION ALL SELECT b, a FROM pairs), arcs AS MATERIALIZED (SELECT s, t, count(*) OVER (PARTITION BY s) AS d FROM both_ways),
  pr AS (SELECT id, 1.0::DOUBLE / n AS r, 0 AS k FROM members, nn UNION ALL SELECT m.id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(x, 0), k + 1 FROM members m JOIN pr ON pr.id = m.id LEFT JOIN (SELECT t, sum(r / d) AS x FROM arcs JOIN pr ON s = id GROUP BY t) got ON got.t = m.id, nn WHERE k < 100)
  SELECT id, round(r, 7) AS pagerank FROM pr WHERE k = 100""")
def pagerank_settled(s, d):
    nodes = members(s, d).select(F.lit("all").alias("g"), "id")
    return rounds.pagerank(whole_arcs(s, d), nodes, tolerance=1e-11).select("id", F.round("pagerank", 7).alias("pagerank"))


def period_arcs(s, d):
    return rounds.arcs(grouped(s, d))


def whole_arcs(s, d):
    return rounds.arcs(edges(s, d).withColumn("period", F.lit("all")))


def inside(arcs, members):
    """The arcs within clusters, as graphs of their own: g tells period and cluster."""
    own = arcs.join(members.toDF("s", "c"), "s").join(members.toDF("t", "c2"), "t").filter("c = c2")
    return own.select(F.concat_ws(":", "g", F.col("c").cast("string")).alias("g"), "s", "t", "w")


def lengths(within):
    out = rounds.path_lengths(within)
    return out.select(F.substring_index("g", ":", 1).alias("period"), F.substring_index("g", ":", -1).cast("long").alias("c"), F.round("avg_path_length", 9).alias("avg_path_length"))


INSIDE = f"{GRAPHS.replace('arcs AS', 'every AS')}, c AS (SELECT vec_id AS id, label AS c FROM embeddings), arcs AS MATERIALIZED (SELECT g || ':' || x.c AS g, s, t FROM every JOIN c x ON x.id = s JOIN c y ON y.id = t WHERE x.c = y.c)"


@query("path_length", f"""WITH {levels(12, INSIDE)} SELECT split_part(g, ':', 1) AS period, CAST(split_part(g, ':', 2) AS BIGINT) AS c,
  round(CASE WHEN count(DISTINCT s) >= 3 THEN avg(d) FILTER (WHERE d > 0) END, 9) AS avg_path_length FROM pairs GROUP BY g""")
def path_length(s, d):
    return lengths(stored(inside(period_arcs(s, d), emb(s, d).select(F.col("vec_id").alias("id"), F.col("label").alias("c")))))


@query("cluster_geometry")
def cluster_geometry(s, d):
    return shapes.cluster_geometry(emb(s, d).select(F.col("label").alias("c"), F.col("embedding").alias("v")))


@query("intrinsic_dim")
def intrinsic_dim(s, d):
    return shapes.intrinsic_dim(edges(s, d), emb(s, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


@query("distance_to_centroid", f"WITH unit AS ({UNIT}), {CENTS} SELECT id, unit.c, round(1 - list_inner_product(u, centroid), 6) AS distance_to_centroid FROM unit JOIN cents ON unit.c = cents.c")
def distance_to_centroid(s, d):
    e = emb(s, d)
    cents = clusters.centroids(e.filter("label is not null"), "label", "embedding")
    out = clusters.centroid_distances(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), members(s, d), cents)
    return out.withColumn("distance_to_centroid", F.round("distance_to_centroid", 6))


#: Some vectors are taken out of their clusters, and cluster 9 is cut down to two, so that there is dark matter.
KEPT = "kept AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN NULL WHEN label = 9 AND r > 2 THEN -1 ELSE label END AS c FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id % 10 = 0, vec_id) AS r FROM embeddings))"


def kept(s, d):
    from pyspark.sql.window import Window

    r = F.row_number().over(Window.partitionBy("label").orderBy(F.col("vec_id") % 10 == 0, "vec_id"))
    c = F.when(F.col("vec_id") % 10 == 0, None).when((F.col("label") == 9) & (F.col("r") > 2), -1).otherwise(F.col("label"))
    return emb(s, d).withColumn("r", r).select(F.col("vec_id").alias("id"), c.alias("c"), F.col("embedding").alias("v"))


DARK = f"{KEPT}, sz AS (SELECT c, count(*) AS n FROM kept GROUP BY c), marked AS (SELECT id, kept.c, kept.c IS NULL OR kept.c = -1 OR coalesce(n, 0) <= 2 AS is_dark_matter FROM kept LEFT JOIN sz ON kept.c = sz.c)"


@query("dark_matter", f"WITH {DARK} SELECT * FROM marked")
def dark_matter(s, d):
    return gaps.dark_matter(kept(s, d).select("id", "c"))


GAPS = f"""WITH {E}, {DARK}, gm AS (SELECT id, c FROM marked WHERE c IS NOT NULL AND c <> -1), ends AS (SELECT e.*, x.c AS ca, y.c AS cb FROM edges e JOIN gm x ON e.src = x.id JOIN gm y ON e.dst = y.id),
cn AS (SELECT c, list(m ORDER BY i) AS m FROM (SELECT c, i, avg(x) AS m FROM (SELECT gm.c, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS x FROM gm JOIN unit USING (id)) GROUP BY 1, 2) GROUP BY c),
pt AS (SELECT a, b, cd, list_transform(s, lambda x: x / sqrt(list_inner_product(s, s))) AS mid FROM (SELECT p.c AS a, q.c AS b, 1 - list_inner_product(p.m, q.m) AS cd, list_transform(list_zip(p.m, q.m), lambda z: z[1] + z[2]) AS s FROM cn p JOIN cn q ON p.c < q.c)),
near AS (SELECT a, b, k.id, is_dark_matter, round(1 - list_inner_product(u, mid), 9) AS dd FROM pt, marked k JOIN unit ON unit.id = k.id),
per AS (SELECT a, b, min(dd) AS void_depth, arg_min(is_dark_matter, (dd, id)) AS nearest_is_dark, count(*) FILTER (WHERE is_dark_matter AND dd < 0.9) AS n_dark_near FROM near GROUP BY 1, 2),
nd AS (SELECT count(*) AS n_dark FROM marked WHERE is_dark_matter), gs AS (SELECT c, count(*) AS n FROM gm GROUP BY c),
fr AS (SELECT cn.c, count(*) FILTER (WHERE round(1 - list_inner_product(u, m), 9) < 0.95) / any_value(n) AS f, any_value(n) AS n FROM cn JOIN gs USING (c), marked k JOIN unit ON unit.id = k.id WHERE is_dark_matter GROUP BY cn.c),
bs AS (SELECT gm.id, gm.c, coalesce(avg(CASE WHEN ca <> cb THEN 1.0 ELSE 0.0 END) FILTER (WHERE src IS NOT NULL), 0) > 0.9 AS edge FROM gm LEFT JOIN ends ON src = gm.id GROUP BY 1, 2),
em AS (SELECT id, c FROM (SELECT *, bool_or(edge) OVER (PARTITION BY c) AS any_edge FROM bs) WHERE edge OR NOT any_edge),
bd AS (SELECT x.c AS a, y.c AS b, min(round(1 - list_inner_product(p.u, q.u), 9)) AS boundary_distance FROM em x JOIN em y ON x.c < y.c JOIN unit p ON p.id = x.id JOIN unit q ON q.id = y.id GROUP BY 1, 2),
tw AS (SELECT ca, cb, count(DISTINCT src) AS k FROM (SELECT ca, cb, src FROM ends WHERE ca <> cb UNION ALL SELECT cb, ca, dst FROM ends WHERE ca <> cb) GROUP BY 1, 2)
SELECT pt.a AS cluster_a, pt.b AS cluster_b, round(cd, 6) AS centroid_distance, round(boundary_distance, 6) AS boundary_distance, round(void_depth, 6) AS void_depth, n_dark_near, round(CASE WHEN n_dark_near > 0 THEN n_dark_near / (0.81 * n_dark + 1e-9) ELSE 0 END, 6) AS dark_density_near,
  round(fa.f, 6) AS fringe_density_a, round(fb.f, 6) AS fringe_density_b, round(coalesce(w1.k / fa.n, 0), 6) AS weight_ab, round(coalesce(w2.k / fb.n, 0), 6) AS weight_ba, round(greatest(coalesce(w1.k / fa.n, 0), coalesce(w2.k / fb.n, 0)), 6) AS connection_weight,
  fa.n AS size_a, fb.n AS size_b, nearest_is_dark, CASE WHEN greatest(coalesce(w1.k / fa.n, 0), coalesce(w2.k / fb.n, 0)) > 0.15 THEN 'bridge' WHEN n_dark_near >= 3 THEN 'proto_cluster' WHEN n_dark_near > 0 OR fa.f > 0.1 OR fb.f > 0.1 THEN 'fringe' ELSE 'void' END AS gap_type
FROM pt JOIN per USING (a, b) JOIN fr fa ON fa.c = pt.a JOIN fr fb ON fb.c = pt.b LEFT JOIN bd USING (a, b) LEFT JOIN tw w1 ON w1.ca = pt.a AND w1.cb = pt.b LEFT JOIN tw w2 ON w2.ca = pt.b AND w2.cb = pt.a, nd"""


@query("gap_pairs", GAPS)
def gap_pairs(s, d):
    """Radii are wide, as random vectors are far from each other."""
    from driftloom.functions.vectors import normalised
    from driftloom.operators import geometry

    rows = kept(s, d).select("c", F.col("id").alias("chunk"), normalised(F.col("v")).alias("v"))
    real = rows.filter("c is not null and c <> -1")
    cents = geometry.means(real, ["c"]).select("c", "m")
    gm = real.select(F.col("chunk").alias("id"), "c")
    e = stored(clusters.labelled(edges(s, d), gm))
    score = e.groupBy(F.col("src").alias("chunk")).agg(F.avg((F.col("ca") != F.col("cb")).cast("double")).alias("boundary_score"))
    weights = gaps.touching(e, gm)
    out = gaps.gaps(rows, cents, weights, score, void_radius=0.9, fringe_radius=0.95, boundary_least=0.9)
    names = ["centroid_distance", "boundary_distance", "void_depth", "dark_density_near", "fringe_density_a", "fringe_density_b", "weight_ab", "weight_ba", "connection_weight"]
    return out.withColumns({n: F.round(n, 6) for n in names})


PROP = f"""WITH {E}, adj AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) JOIN members x ON x.id = src JOIN members y ON y.id = dst WHERE x.c = y.c),
st AS (SELECT c, id AS s FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY md5(CAST(id AS VARCHAR)), id) AS k FROM members) WHERE k <= 20),
h1 AS (SELECT DISTINCT c, s, dst AS t FROM st JOIN adj ON src = s), h2 AS (SELECT DISTINCT c, s, dst AS t FROM h1 JOIN adj ON src = h1.t EXCEPT SELECT c, s, t FROM h1 EXCEPT SELECT c, s, s FROM st),
h3 AS (SELECT DISTINCT c, s, dst AS t FROM h2 JOIN adj ON src = h2.t EXCEPT SELECT c, s, t FROM h2 EXCEPT SELECT c, s, t FROM h1 EXCEPT SELECT c, s, s FROM st),
al AS (SELECT c, s, t, 1 AS hop FROM h1 WHERE s <> t UNION ALL SELECT c, s, t, 2 FROM h2 UNION ALL SELECT c, s, t, 3 FROM h3),
mn AS (SELECT al.c, avg(list_inner_product(a.u, b.u)) FILTER (WHERE hop = 1) AS m1, avg(list_inner_product(a.u, b.u)) FILTER (WHERE hop = 2) AS m2, avg(list_inner_product(a.u, b.u)) FILTER (WHERE hop = 3) AS m3 FROM al JOIN unit a ON a.id = s JOIN unit b ON b.id = t GROUP BY 1)
SELECT z.c, round(CASE WHEN n >= 5 AND m2 IS NOT NULL THEN (m3 - m1) / 2 END, 6) AS propagation_speed FROM (SELECT c, count(*) AS n FROM members GROUP BY c) z LEFT JOIN mn USING (c)"""


@query("propagation_speed", PROP)
def propagation_speed(s, d):
    from driftloom.functions.vectors import normalised

    u = emb(s, d).select(F.col("vec_id").alias("id"), normalised(F.col("embedding")).alias("u"))
    return gaps.propagation(edges(s, d), members(s, d), u).withColumn("propagation_speed", F.round("propagation_speed", 6))


@query("two_nearest_dim", f"""WITH {E}, d AS (SELECT src, max(1 - sim) FILTER (WHERE rank = 1) AS d1, max(1 - sim) FILTER (WHERE rank = 2) AS d2 FROM edges WHERE rank <= 2 GROUP BY src)
  SELECT c, count(*) AS n, round(count(*) / sum(ln(d2 / d1)), 4) AS two_nn_dim FROM members JOIN d ON src = id WHERE d1 > 0 AND d2 IS NOT NULL GROUP BY c""")
def two_nearest_dim(s, d):
    return clusters.two_nearest_dim(edges(s, d), members(s, d)).withColumn("two_nn_dim", F.round("two_nn_dim", 4))


def bundle(arcs):
    """One row a node: all measures of its graph side by side."""
    degree = arcs.groupBy("g", F.col("s").alias("id")).agg(F.count("*").alias("degree"))
    for more in (leiden.leiden(arcs), rounds.core_numbers(arcs), rounds.betweenness(arcs), rounds.harmonic(arcs), spectra.eigenvector(arcs), rounds.katz(arcs)):
        degree = degree.join(more, ["g", "id"])
    return degree


@query("graph_bundle")
def graph_bundle(s, d):
    return bundle(period_arcs(s, d)).withColumnRenamed("g", "period")


@query("graph_measures")
def graph_measures(s, d):
    e, m = stored(edges(s, d)), members(s, d)
    arcs = rounds.arcs(e.withColumn("period", F.lit("all")))
    rank = rounds.pagerank(arcs, m.select(F.lit("all").alias("g"), "id")).drop("g")
    return clusters.merged_measures(e, m, bundle(arcs).drop("g"), rank)


@query("topology")
def topology(s, d):
    """Ways and speeds are those from all members of a cluster; propagation_speed takes 20 of each."""
    from driftloom.functions.vectors import normalised

    e, m = stored(edges(s, d)), members(s, d)
    within = stored(inside(rounds.arcs(e.withColumn("period", F.lit("all"))), m))
    paths = lengths(within).select("c", "avg_path_length")
    u = emb(s, d).select(F.col("vec_id").alias("id"), normalised(F.col("embedding")).alias("u"))
    speed = gaps.propagation_from_all(within.withColumn("g", F.substring_index("g", ":", -1)), m, u).withColumn("propagation_speed", F.round("propagation_speed", 6))
    return clusters.topology(e, m, clusters.member_measures(e, m), speed, paths)
