"""Rules, laws, roll-ups, scores and attributions over the panel: cohesion stands for mean price, drift for its change."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.operators import panel as series_ops
from driftloom.operators import rules as ops
from driftloom.plans.core import query, table
from driftloom.plans.panel import P, W, panel

BASE = f"""{P}, b AS (SELECT lineage || '@' || period AS t, split_part(lineage, ':', 1) AS corpus, lineage, period, CAST(size AS DOUBLE) AS size, round(value) AS cohesion, round(abs(value - lag(value) {W})) AS drift,
  CAST(size - lag(size) {W} AS DOUBLE) AS pressure, CAST(row_number() {W} AS DOUBLE) AS persistence, lead(size) {W} < 3 AS dies, lead(size) {W} AS size_next FROM panel)"""


def base(s, d):
    w = Window.partitionBy("lineage").orderBy("period")
    p = panel(s, d)
    return p.select(
        F.concat("lineage", F.lit("@"), "period").alias("t"), F.split_part("lineage", F.lit(":"), F.lit(1)).alias("corpus"), "lineage", "period", F.col("size").cast("double").alias("size"), F.round("value").alias("cohesion"),
        F.round(F.abs(F.col("value") - F.lag("value").over(w))).alias("drift"), (F.col("size") - F.lag("size").over(w)).cast("double").alias("pressure"), F.row_number().over(w).cast("double").alias("persistence"),
        (F.lead("size").over(w) < 3).alias("dies"), F.lead("size").over(w).alias("size_next"),
    )


MINED = ["size", "cohesion", "drift", "pressure"]


def level_sql(c: str) -> str:
    return f"SELECT t, '{c}_' || CASE WHEN {c} <= lo THEN 'low' WHEN {c} <= hi THEN 'mid' ELSE 'high' END AS item FROM b, (SELECT quantile_cont({c}, 0.33) AS lo, quantile_cont({c}, 0.67) AS hi FROM b) WHERE true"


SETS = f"""{BASE}, items AS ({' UNION ALL '.join(level_sql(c) for c in MINED)}), o AS (SELECT t, 'dies' AS outcome FROM b WHERE dies UNION ALL SELECT t, 'grows' FROM b WHERE size_next > size),
  sets AS (SELECT t, item AS s FROM items UNION ALL SELECT a.t, a.item || '+' || b.item FROM items a JOIN items b ON a.t = b.t AND a.item < b.item
  UNION ALL SELECT a.t, a.item || '+' || b.item || '+' || c.item FROM items a JOIN items b ON a.t = b.t AND a.item < b.item JOIN items c ON a.t = c.t AND b.item < c.item),
  n AS (SELECT count(DISTINCT t) AS n FROM items), k AS (SELECT s, count(*) AS k FROM sets GROUP BY s), m AS (SELECT outcome, count(*) AS m FROM o GROUP BY 1), h AS (SELECT s, outcome, count(*) AS hit FROM sets JOIN o USING (t) GROUP BY 1, 2)"""


@query("rule_mining", f"""{SETS} SELECT s AS antecedent, outcome AS consequent, round(hit / n, 6) AS support, round(hit / k, 6) AS confidence, round(hit / k / (m / n), 6) AS lift, round(hit / k / (m / n) * hit / k, 6) AS score
  FROM h JOIN k USING (s) JOIN m USING (outcome), n WHERE hit >= 0.03 * n AND round(hit / k, 9) >= 0.1 AND round(hit / k / (m / n), 9) >= 1.0""")
def rule_mining(s, d):
    """With lower bounds than the defaults, as the made-up panel follows few rules."""
    r = mined(s, d)
    return r.withColumns({c: F.round(c, 6) for c in ("support", "confidence", "lift", "score")})


def mined(s, d):
    b = base(s, d)
    out = b.filter("dies").select("t", F.lit("dies").alias("outcome")).union(b.filter("size_next > size").select("t", F.lit("grows")))
    return ops.rules(ops.levels(b, MINED, "t"), out, "t", 0.03, 0.1, 1.0)


LAW = {"pressure": "pressure > pressure_p75", "large_loose": "size > size_p75 AND cohesion < cohesion_p25", "low_persistence": "persistence < persistence_p25", "small_drifting": "drift > drift_p75 AND size < size_p25", "small_dense": "cohesion > cohesion_p75 AND size < size_p25"}
CUTS = [("pressure", 0.75), ("size", 0.25), ("size", 0.75), ("cohesion", 0.25), ("cohesion", 0.75), ("persistence", 0.25), ("drift", 0.75)]
TESTED = f"""{BASE}, q AS (SELECT corpus, {', '.join(f'quantile_cont({c}, {q}) AS {c}_p{round(100 * q)}' for c, q in CUTS)} FROM b GROUP BY corpus), x AS (SELECT b.*, q.* EXCLUDE (corpus) FROM b JOIN q USING (corpus) WHERE dies IS NOT NULL),
  law AS ({' UNION ALL '.join(f"SELECT corpus, period, dies, '{n}' AS law FROM x WHERE {c}" for n, c in LAW.items())}),
  res AS (SELECT corpus, period, law, count(*) AS n_predicted, count(*) FILTER (WHERE dies) AS n_confirming, count(*) FILTER (WHERE NOT dies) AS n_refuting FROM law GROUP BY 1, 2, 3)"""
STATUS = "CASE WHEN n_confirming > n_refuting THEN 'confirmed' ELSE 'refuted' END"


def tested(s, d):
    cuts: dict = {}
    for c, q in CUTS:
        cuts.setdefault(c, []).append(q)
    return ops.backtest(ops.with_thresholds(base(s, d), cuts, "corpus"), ops.DEATH_LAWS, "dies", "corpus")


@query("law_backtest", f"{TESTED} SELECT *, {STATUS} AS status, round(n_confirming / n_predicted, 3) AS accuracy FROM res")
def law_backtest(s, d):
    return tested(s, d)


@query("law_accuracy", f"""{TESTED} SELECT law, count(*) AS n_periods, count(*) FILTER (WHERE n_confirming > n_refuting) AS n_confirmed, round(count(*) FILTER (WHERE n_confirming > n_refuting) / count(*), 4) AS rate,
  round(sum(n_confirming) / sum(n_predicted), 4) AS hits FROM res GROUP BY law""")
def law_accuracy(s, d):
    return ops.accuracy(tested(s, d))


PHASE = f"""{BASE}, s AS (SELECT corpus, period, CAST(count(*) AS DOUBLE) AS connectivity, CAST(sum(size) AS DOUBLE) AS entropy FROM b GROUP BY 1, 2), l AS (SELECT *, lead(entropy) OVER (PARTITION BY corpus ORDER BY period) AS nxt FROM s),
  q AS (SELECT corpus, quantile_cont(connectivity, 0.25) AS c25, quantile_cont(entropy, 0.75) AS e75 FROM s GROUP BY 1), x AS (SELECT l.*, c25, e75, nxt >= e75 AS hit FROM l JOIN q USING (corpus) WHERE nxt IS NOT NULL)"""


@query("phase_laws", f"""{PHASE}, law AS (SELECT corpus, period, hit, 'connectivity_drop' AS law FROM x WHERE connectivity < c25 UNION ALL SELECT corpus, period, hit, 'entropy_ceiling' FROM x WHERE entropy > e75)
  SELECT corpus, period, law, count(*) AS n_predicted, count(*) FILTER (WHERE hit) AS n_confirming, count(*) FILTER (WHERE NOT hit) AS n_refuting, CASE WHEN bool_or(hit) THEN 'confirmed' ELSE 'refuted' END AS status, round(count(*) FILTER (WHERE hit) / count(*), 3) AS accuracy FROM law GROUP BY 1, 2, 3""")
def phase_laws(s, d):
    """Connectivity stands for the number of clusters, entropy for their members."""
    g = base(s, d).groupBy("corpus", "period").agg(F.count("*").cast("double").alias("connectivity"), F.sum("size").alias("entropy"))
    x = ops.with_thresholds(g, {"connectivity": [0.25], "entropy": [0.75]}, "corpus")
    nxt = F.lead("entropy").over(Window.partitionBy("corpus").orderBy("period"))
    return ops.backtest(x.withColumn("hit", nxt >= F.col("entropy_p75")), ops.PHASE_LAWS, "hit", "corpus")


NATIONS = """e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(n) / 100.0::DOUBLE AS weight, sum(n) % 3 = 0 AS is_new, sum(n) % 3 = 1 AS is_lost, CAST(max(n) - min(n) AS DOUBLE) AS weight_change, min(n) / max(n)::DOUBLE AS overlap FROM
  (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2) GROUP BY 1, 2),
  v AS (SELECT c_nationkey AS c, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey / 25.0::DOUBLE END AS risk, count(*) AS size, round(avg(c_acctbal)) AS cohesion, CAST(count(*) % 7 AS DOUBLE) AS betweenness, CAST(count(*) % 5 AS DOUBLE) AS triangles, CAST(c_nationkey % 4 AS DOUBLE) AS drift, c_nationkey % 6 AS stage FROM customer GROUP BY 1)"""


def nations(s, d):
    o, c, sup = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "supplier")
    j = table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey")).filter("c_nationkey <> s_nationkey")
    n = j.groupBy(F.col("c_nationkey").alias("x"), F.col("s_nationkey").alias("y")).agg(F.count("*").alias("n"))
    e = n.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        (F.sum("n") / 100).alias("weight"), (F.sum("n") % 3 == 0).alias("is_new"), (F.sum("n") % 3 == 1).alias("is_lost"), (F.max("n") - F.min("n")).cast("double").alias("weight_change"), (F.min("n") / F.max("n")).alias("overlap")
    )
    k = F.col("c_nationkey")
    v = c.groupBy("c_nationkey").agg(F.count("*").alias("size"), F.round(F.avg("c_acctbal")).alias("cohesion"))
    v = v.select(k.alias("c"), F.when(k % 5 != 0, k / 25.0).alias("risk"), "size", "cohesion", (F.col("size") % 7).cast("double").alias("betweenness"), (F.col("size") % 5).cast("double").alias("triangles"), (k % 4).cast("double").alias("drift"), (k % 6).alias("stage"))
    return e, v


AROUND = """round(avg(risk), 6) AS neighbor_avg_risk, round(max(risk), 6) AS neighbor_max_risk, round(min(risk), 6) AS neighbor_min_risk, round(avg(size), 6) AS neighbor_avg_size, round(avg(cohesion), 4) AS neighbor_avg_cohesion, round(avg(betweenness), 6) AS neighbor_avg_betweenness,
  max(betweenness) AS neighbor_max_betweenness, round(avg(triangles), 6) AS neighbor_avg_triangles, round(avg(drift), 6) AS neighbor_avg_drift, max(drift) AS neighbor_max_drift, round(avg(weight), 6) AS avg_edge_weight, round(max(weight), 6) AS max_edge_weight, count(*) AS n_neighbors,
  count(*) FILTER (WHERE is_new) AS n_new_edges, count(*) FILTER (WHERE is_lost) AS n_lost_edges, round(sum(weight * coalesce(risk, 0)), 4) AS weighted_dying_pressure, max(CASE WHEN stage = 4 THEN 1 ELSE 0 END) AS has_crystallizing_neighbor, count(*) FILTER (WHERE risk > 0.7) AS n_dying_neighbors"""


@query("neighbour_features", f"WITH {NATIONS} SELECT x.c, {AROUND} FROM (SELECT a AS c, b AS o, weight, is_new, is_lost FROM e UNION ALL SELECT b, a, weight, is_new, is_lost FROM e) x JOIN v ON v.c = x.o GROUP BY x.c")
def neighbour_features(s, d):
    out = ops.neighbourhood(*nations(s, d))
    four = {"neighbor_avg_cohesion", "weighted_dying_pressure"}
    return out.withColumns({c: F.round(c, 4 if c in four else 6) for c, t in out.dtypes if t == "double" and not c.startswith(("neighbor_max_b", "neighbor_max_d"))})


@query("edge_rollup", f"WITH {NATIONS} SELECT c, round(avg(weight), 6) AS avg_weight, round(avg(weight_change), 6) AS avg_weight_change, count(*) FILTER (WHERE is_new) AS n_new, count(*) FILTER (WHERE is_lost) AS n_lost, round(avg(overlap), 6) AS avg_overlap FROM (SELECT a AS c, * FROM e UNION ALL SELECT b, * FROM e) GROUP BY c")
def edge_rollup(s, d):
    return ops.edges_rolled_up(nations(s, d)[0]).withColumns({c: F.round(c, 6) for c in ("avg_weight", "avg_weight_change", "avg_overlap")})


MEASURES = {"quantity": "l_quantity", "price": "round(l_extendedprice)", "discount": "l_discount * 100", "tax": "l_tax * 100", "lag": "CAST(l_linenumber AS DOUBLE)", "supp": "CAST(l_suppkey AS DOUBLE)", "part": "CAST(l_partkey AS DOUBLE)", "cust": "CAST(o_custkey AS DOUBLE)", "total": "round(o_totalprice)", "line2": "CAST(l_linenumber * l_linenumber AS DOUBLE)", "half": "l_quantity / 2", "dq": "l_quantity - l_linenumber", "kq": "l_quantity * l_linenumber", "q2": "l_quantity * l_quantity"}
FLAGS = {"returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "bulky": "l_quantity > 40", "cheap": "l_extendedprice < 10000"}


@query("member_rollup", f"SELECT c_nationkey AS c, {', '.join(f'round(avg({x}), 3) AS avg_{n}' for n, x in MEASURES.items())}, {', '.join(f'CAST(count(*) FILTER (WHERE {x}) AS BIGINT) AS n_{n}' for n, x in FLAGS.items())} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def member_rollup(s, d):
    """Eighteen measures of members, by cluster."""
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = j.select(F.col("c_nationkey").alias("c"), *[F.expr(x).alias(n) for n, x in (MEASURES | FLAGS).items()])
    return ops.rolled_up(rows, ["c"], list(MEASURES), list(FLAGS)).withColumns({f"avg_{n}": F.round(f"avg_{n}", 3) for n in MEASURES})


COEF = {"size": 0.5, "cohesion": -0.001, "persistence": 0.25}
SCORE = "1 / (1 + exp(-(0.5 * size - 0.0000001 * cohesion + 0.05 * persistence) / 3))"
MODEL = f"{BASE}, sc AS (SELECT *, round({SCORE}, 6) AS risk FROM b)"


def scored(s, d):
    return base(s, d).withColumn("risk", F.round(F.expr(SCORE), 6))


@query("attribution", f"""{BASE}, m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in COEF)} FROM b), a AS ({' UNION ALL '.join(f"SELECT t, '{c}' AS feature, {w}::DOUBLE * ({c} - m_{c}) AS attribution FROM b, m" for c, w in COEF.items())})
  SELECT t, feature, round(attribution, 5) AS attribution, row_number() OVER (PARTITION BY t ORDER BY round(abs(attribution), 9) DESC, feature) AS rank FROM a""")
def attribution(s, d):
    return ops.linear_attribution(base(s, d), COEF, ["t"]).withColumn("attribution", F.round("attribution", 5))


@query("attribution_summary", f"""{BASE}, m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in COEF)} FROM b), a AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {w}::DOUBLE * ({c} - m_{c}) AS attribution FROM b, m" for c, w in COEF.items())})
  SELECT feature, round(avg(abs(attribution)), 5) AS mean_abs, round(stddev_samp(attribution), 5) AS sd FROM a GROUP BY feature""")
def attribution_summary(s, d):
    return ops.linear_attribution(base(s, d), COEF, ["t"]).groupBy("feature").agg(F.round(F.avg(F.abs("attribution")), 5).alias("mean_abs"), F.round(F.stddev_samp("attribution"), 5).alias("sd"))


FULL = " + ".join(f"{w}::DOUBLE * {c}" for c, w in COEF.items())


@query("zero_ablation", f"""{BASE}, z AS (SELECT avg((size_next - ({FULL})) ** 2) AS whole, {', '.join(f'avg((size_next - ({FULL}) + {w}::DOUBLE * {c}) ** 2) AS {c}' for c, w in COEF.items())} FROM b WHERE size_next IS NOT NULL)
  {' UNION ALL '.join(f"SELECT '{c}' AS feature, round(({c} - whole) / whole, 6) AS rise FROM z" for c in COEF)}""")
def zero_ablation(s, d):
    rows = base(s, d).filter("size_next is not null")
    whole = rows.agg(F.avg(F.pow(F.col("size_next") - sum((F.lit(w) * F.col(c) for c, w in COEF.items()), F.lit(0.0)), F.lit(2))).alias("w"))
    return ops.zero_ablation(rows, COEF, "size_next").join(F.broadcast(whole)).select("feature", F.round(F.col("rise") / F.col("w"), 6).alias("rise"))


@query("impact_ranking", f"{BASE}, i AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, abs({w}::DOUBLE) * stddev_samp({c}) AS impact FROM b" for c, w in COEF.items())}) SELECT feature, round(impact, 4) AS impact, row_number() OVER (ORDER BY impact DESC, feature) AS place FROM i")
def impact_ranking(s, d):
    return ops.ranked_by_impact(base(s, d), COEF).withColumn("impact", F.round("impact", 4))


@query("score_write", f"""{MODEL}, old AS (SELECT lineage, period, 0.5::DOUBLE AS risk, 'v1' AS version FROM sc UNION ALL SELECT lineage, period, 0.1, 'v2' FROM sc WHERE size > 3), w AS (SELECT * FROM old WHERE version <> 'v2' UNION ALL SELECT lineage, period, risk, 'v2' FROM sc)
  SELECT version, count(*) AS n, count(DISTINCT (lineage, period)) AS n_keys, round(avg(risk), 6) AS mean, min(risk) AS least, max(risk) AS most, count(*) FILTER (WHERE risk > 0.7) AS n_high FROM w GROUP BY version""")
def score_write(s, d):
    x = scored(s, d).select("lineage", "period", "risk")
    old = x.select("lineage", "period", F.lit(0.5).alias("risk"), F.lit("v1").alias("version")).union(scored(s, d).filter("size > 3").select("lineage", "period", F.lit(0.1), F.lit("v2")))
    return ops.verified(ops.written(old, x, "v2", ["lineage", "period"]), ["lineage", "period"]).withColumn("mean", F.round("mean", 6))


@query("high_risk", f"{MODEL} SELECT lineage, period, risk FROM sc WHERE period = (SELECT max(period) FROM sc) AND risk >= 0.3")
def high_risk(s, d):
    return ops.high_risk(scored(s, d), 0.3).select("lineage", "period", "risk")


@query("score_history", f"{MODEL} SELECT lineage, period, 0.5::DOUBLE AS risk FROM sc WHERE size > 3 UNION ALL SELECT lineage, period, risk FROM sc WHERE size <= 3")
def score_history(s, d):
    x = scored(s, d)
    return ops.history(x.filter("size > 3").select("lineage", "period", F.lit(0.5).alias("risk")), x.select("lineage", "period", "risk"), ["lineage", "period"])


@query("cross_corpus_scores", f"""{MODEL}, mu AS (SELECT corpus, avg(risk) AS m, stddev_pop(risk) AS sd FROM sc GROUP BY 1) SELECT lineage, period, round((risk - m) / sd, 4) AS z FROM sc, (SELECT m, sd FROM mu WHERE corpus = 'BUILDING')""")
def cross_corpus_scores(s, d):
    """All corpora scored against the distribution of one."""
    x = scored(s, d)
    one = x.filter("corpus = 'BUILDING'").agg(F.avg("risk").alias("m"), F.stddev_pop("risk").alias("sd"))
    return x.join(F.broadcast(one)).select("lineage", "period", F.round(ops.divided(F.col("risk") - F.col("m"), F.col("sd")), 4).alias("z"))


@query("training_corpus", """WITH k AS (SELECT n_name AS corpus, CASE WHEN n_nationkey % 3 = 0 THEN r_name END AS parent FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0)
  SELECT n_name AS corpus, CASE WHEN k.corpus IS NULL THEN 'base' ELSE coalesce(parent, n_name) END AS train FROM nation LEFT JOIN k ON k.corpus = n_name""")
def training_corpus(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = n.filter("n_nationkey % 5 <> 0").select(F.col("n_name").alias("corpus"), F.when(F.col("n_nationkey") % 3 == 0, F.col("r_name")).alias("parent"))
    return ops.training_corpus(n.select(F.col("n_name").alias("corpus")), known, "base")


TERMINAL = f"""{BASE}, l AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY period DESC) AS k, max(period) OVER () AS last FROM b),
  a AS (SELECT corpus, CAST(split_part(lineage, ':', 2) AS INT) % 3 AS kind, avg(CASE WHEN k = 1 AND period < last THEN 1.0 ELSE 0 END) FILTER (WHERE k = 1) AS death_rate, avg(CASE WHEN size >= 6 THEN 1.0 ELSE 0 END) FILTER (WHERE k = 1) AS reborn_rate,
  1 - avg(CASE WHEN k = 1 AND period < last THEN 1.0 ELSE 0 END) FILTER (WHERE k = 1) AS survival_rate, avg(drift) / 100000 AS drift, avg(size) AS size FROM l GROUP BY 1, 2)"""


def terminal(s, d):
    w = Window.partitionBy("lineage").orderBy(F.desc("period"))
    l = base(s, d).withColumn("k", F.row_number().over(w)).join(F.broadcast(base(s, d).agg(F.max("period").alias("last"))))
    one = F.col("k") == 1
    death = F.avg(F.when(one, (F.col("period") < F.col("last")).cast("double")))
    g = l.groupBy("corpus", (F.split_part("lineage", F.lit(":"), F.lit(2)).cast("int") % 3).alias("kind"))
    a = g.agg(death.alias("death_rate"), F.avg(F.when(one, (F.col("size") >= 6).cast("double"))).alias("reborn_rate"), (F.avg("drift") / 100000).alias("drift"), F.avg("size").alias("size"))
    return a.withColumn("survival_rate", 1 - F.col("death_rate"))


@query("archetype_names", f"""{TERMINAL} SELECT corpus, kind, round(death_rate, 6) AS death_rate, CASE WHEN death_rate > 0.6 THEN 'death_precursor' WHEN reborn_rate > 0.3 THEN 'cyclical_reborn' WHEN survival_rate > 0.85 AND drift < 0.1 THEN 'stable_persistent'
  WHEN survival_rate > 0.75 AND drift > 0.2 THEN 'active_drifter' WHEN death_rate > 0.3 THEN 'at_risk' ELSE 'mixed' END AS name FROM a""")
def archetype_names(s, d):
    a = terminal(s, d)
    return a.select("corpus", "kind", F.round("death_rate", 6).alias("death_rate"), ops.archetype_name(F.col("death_rate"), F.col("reborn_rate"), F.col("survival_rate"), F.col("drift")).alias("name"))


@query("archetype_similarity", f"""{TERMINAL}, v AS (SELECT corpus, CAST(kind AS VARCHAR) AS name, [death_rate, reborn_rate, drift, size / 10] AS v FROM a), p AS (SELECT x.corpus, x.name, y.corpus || '/' || y.name AS best, round(list_cosine_similarity(x.v, y.v), 6) AS similarity FROM v x JOIN v y ON x.corpus <> y.corpus)
  SELECT corpus, name, best, similarity, similarity >= 0.85 AS universal FROM (SELECT *, row_number() OVER (PARTITION BY corpus, name ORDER BY similarity DESC, best) AS k FROM p) WHERE k = 1""")
def archetype_similarity(s, d):
    a = terminal(s, d).select("corpus", F.col("kind").cast("string").alias("name"), F.array("death_rate", "reborn_rate", "drift", F.col("size") / 10).alias("v"))
    return ops.alike(a)


@query("features_in_every_corpus", f"""{BASE}, f AS ({' UNION ALL '.join(f"SELECT corpus, '{c}' AS feature FROM b GROUP BY 1 HAVING abs(corr({c}, size_next)) > 0.05" for c in MINED)}) SELECT feature, count(DISTINCT corpus) AS n_corpora FROM f GROUP BY 1 HAVING count(DISTINCT corpus) = (SELECT count(DISTINCT corpus) FROM f)""")
def features_in_every_corpus(s, d):
    g = base(s, d).groupBy("corpus").agg(*[F.abs(F.corr(c, F.col("size_next").cast("double"))).alias(c) for c in MINED])
    found = g.select("corpus", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in MINED])).alias("x")).select("corpus", "x.*").filter("r > 0.05")
    return ops.in_every(found, "corpus", "feature")


@query("model_metrics", f"""{MODEL}, y AS (SELECT corpus, risk, CASE WHEN size_next < size THEN 1.0::DOUBLE ELSE 0 END AS y FROM sc WHERE size_next IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY corpus ORDER BY risk) + (count(*) OVER (PARTITION BY corpus, risk) - 1) / 2 AS rk FROM y)
  SELECT corpus, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc, round(2 * count(*) FILTER (WHERE risk >= 0.5 AND y = 1) / (count(*) FILTER (WHERE risk >= 0.5) + sum(y)), 6) AS f1,
  round(sqrt(avg((y - risk) ** 2)), 6) AS rmse, round(1 - sum((y - risk) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM r GROUP BY corpus""")
def model_metrics(s, d):
    rows = scored(s, d).filter("size_next is not null").withColumn("y", (F.col("size_next") < F.col("size")).cast("double"))
    return ops.measured(rows, "y", "risk", "corpus").withColumns({c: F.round(c, 6) for c in ("auc", "f1", "rmse", "r2")})


@query("auc_rank", "WITH x AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rk FROM x) SELECT round((sum(rk * quality) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * sum(1 - quality)), 6) AS auc FROM r")
def auc_rank(s, d):
    rows = table(s, d, "labels").filter("quality is not null").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return ops.measured(rows, "quality", "n_chars").select(F.round("auc", 6).alias("auc"))


@query("temporal_triples", f"{P}, s AS (SELECT period, CAST(sum(size) AS BIGINT) AS x FROM panel GROUP BY period), l AS (SELECT period, x AS x_0, lag(x, 1) OVER w AS x_1, lag(x, 2) OVER w AS x_2 FROM s WINDOW w AS (ORDER BY period)) SELECT * FROM l WHERE x_2 IS NOT NULL")
def temporal_triples(s, d):
    return ops.triples(panel(s, d).groupBy("period").agg(F.sum("size").alias("x")))


@query("sample_graphs", """WITH n AS (SELECT DISTINCT CAST(date_trunc('year', o_orderdate) AS DATE) AS period, c_nationkey AS c FROM orders JOIN customer ON o_custkey = c_custkey), e AS (SELECT period, a.c AS a, b.c AS b, 0.5::DOUBLE AS weight FROM n a JOIN n b USING (period) WHERE a.c + 1 = b.c AND year(period) % 2 = 0)
  SELECT period, a, b, weight, false AS complete FROM e UNION ALL SELECT a.period, a.c, b.c, 1.0, true FROM n a JOIN n b USING (period) WHERE a.c < b.c AND a.period NOT IN (SELECT period FROM e)""")
def sample_graphs(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = o.select(F.trunc("o_orderdate", "year").alias("period"), F.col("c_nationkey").alias("c")).distinct()
    e = n.withColumnRenamed("c", "a").join(n.withColumnRenamed("c", "b"), "period").filter("a + 1 = b and year(period) % 2 = 0").select("period", "a", "b", F.lit(0.5).alias("weight"))
    return ops.sample_edges(n, e)


@query("findings", f"{BASE}, m AS ({' UNION ALL '.join(f"SELECT '{c}' AS name, round(corr({c}, size_next), 6) AS v FROM b" for c in MINED)}) SELECT place, place || '. ' || name || ' = ' || printf('%.3f', v) AS finding FROM (SELECT *, row_number() OVER (ORDER BY round(abs(v), 9) DESC, name) AS place FROM m WHERE abs(v) >= 0.01)")
def findings(s, d):
    one = base(s, d).agg(*[F.round(F.corr(c, F.col("size_next").cast("double")), 6).alias(c) for c in MINED])
    m = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in MINED])).alias("x")).select("x.*")
    return ops.findings(m, "name", "v", 0.01)


@query("prediction_age", f"""{P}, m AS (SELECT *, avg(value) OVER (PARTITION BY lineage) AS mu, row_number() {W} AS i, count(*) OVER (PARTITION BY lineage) AS n FROM panel),
  s AS (SELECT lineage, period, i, n, value < 0.8 * mu AS shock, min(CASE WHEN value >= mu THEN i END) OVER (PARTITION BY lineage ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back FROM m) SELECT lineage, period, n - i AS age FROM s WHERE shock AND back IS NULL""")
def prediction_age(s, d):
    """Of shocks that are still open: the periods since."""
    p = panel(s, d).withColumn("later", F.count("*").over(Window.partitionBy("lineage").orderBy("period").rowsBetween(1, Window.unboundedFollowing)))
    return series_ops.recovery(p, "value").filter("recovery is null").select("lineage", "period", F.col("later").alias("age"))


@query("citation_rate", """WITH q AS (SELECT c_nationkey AS c, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, count(*) / count(DISTINCT o_orderkey) AS rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY c ORDER BY period) AS DOUBLE) AS k FROM q)
  SELECT c, round(avg(rate), 6) AS mean_rate, round(regr_slope(rate, k), 6) AS trend, count(*) AS n FROM k GROUP BY c""")
def citation_rate(s, d):
    """Lines an order stand for citations a chunk."""
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    q = j.groupBy(F.col("c_nationkey").alias("lineage"), F.trunc("o_orderdate", "quarter").alias("period")).agg((F.count("*") / F.countDistinct("o_orderkey")).alias("rate"))
    f = series_ops.series_features(q, "rate")
    m = q.groupBy("lineage").agg(F.avg("rate").alias("mean_rate"))
    return f.join(m, "lineage").select(F.col("lineage").alias("c"), F.round("mean_rate", 6).alias("mean_rate"), F.round("trend", 6).alias("trend"), "n")


FEED = "SELECT corpus, lineage, period, coalesce(size, 0.0) AS size, coalesce(cohesion, 0.5) AS cohesion, coalesce(drift, 1.5) AS drift, coalesce(pressure, 0.0) AS pressure, CAST(coalesce(dies, false) AS INTEGER) AS dies FROM b"


@query("event_training", f"{BASE} {FEED} WHERE dies IS NOT NULL")
def event_training(s, d):
    return feed(base(s, d).filter("dies is not null"))


def feed(rows):
    x = series_ops.imputed(rows, {"size": 0.0, "cohesion": 0.5, "drift": 1.5, "pressure": 0.0})
    return series_ops.numeric(x, ["dies"]).select("corpus", "lineage", "period", "size", "cohesion", "drift", "pressure", "dies")


@query("event_training_cross", f"{BASE}, f AS ({FEED}) SELECT 'own' AS origin, * FROM f WHERE corpus = 'BUILDING' UNION ALL SELECT 'other', * FROM f WHERE corpus IN ('MACHINERY', 'FURNITURE')")
def event_training_cross(s, d):
    f = feed(base(s, d))
    return f.filter("corpus = 'BUILDING'").select(F.lit("own").alias("origin"), "*").union(f.filter(F.col("corpus").isin("MACHINERY", "FURNITURE")).select(F.lit("other"), "*"))


@query("active_clusters", f"""{BASE}, l AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY period DESC) AS k FROM b), md AS (SELECT median(drift) AS m FROM l WHERE k = 1) SELECT lineage, period, size, round(coalesce(drift, m), 4) AS drift FROM l, md WHERE k = 1""")
def active_clusters(s, d):
    l = base(s, d).withColumn("k", F.row_number().over(Window.partitionBy("lineage").orderBy(F.desc("period")))).filter("k = 1")
    return l.join(F.broadcast(l.agg(F.median("drift").alias("m")))).select("lineage", "period", "size", F.round(F.coalesce("drift", "m"), 4).alias("drift"))


@query("gone_next", f"{P}, k AS (SELECT DISTINCT period, lead(period) OVER (ORDER BY period) AS nxt FROM (SELECT DISTINCT period FROM panel)) SELECT p.lineage, p.period, NOT EXISTS (SELECT 1 FROM panel x WHERE x.lineage = p.lineage AND x.period = k.nxt) AS gone FROM panel p JOIN k ON k.period = p.period WHERE nxt IS NOT NULL")
def gone_next(s, d):
    p = panel(s, d).select("lineage", "period")
    k = p.select("period").distinct().withColumn("nxt", F.lead("period").over(Window.orderBy("period"))).filter("nxt is not null")
    there = p.select("lineage", F.col("period").alias("nxt"), F.lit(True).alias("there"))
    return p.join(k, "period").join(there, ["lineage", "nxt"], "left").select("lineage", "period", F.col("there").isNull().alias("gone"))
