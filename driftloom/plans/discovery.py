"""Lineage matching, backtests, rules and learning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.operators import formulas, learn, lineage, matcher, trajectories
from driftloom.operators import panel as series_ops
from driftloom.operators import rules as ops
from driftloom.plans.core import plain, query, table
from driftloom.plans.observed import MEANS, OBS, observed
from driftloom.plans.panel import PANEL, P, W, panel
from driftloom.plans.rules import BASE, base, level_sql

CENTS = f"{OBS}, {MEANS}, cents AS (SELECT period, c, u, n FROM means)"
CAND = f"{CENTS}, cand AS (SELECT a.period, a.c AS child, b.c AS parent, round(list_inner_product(a.u, b.u), 6) AS score FROM cents a JOIN cents b ON a.period = b.period + 1 WHERE round(list_inner_product(a.u, b.u), 6) >= {lineage.WEAK})"
GREEDY = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, child ORDER BY score DESC, parent) AS k FROM cand) WHERE k = 1), two AS (SELECT * FROM (SELECT period, child, parent, score, row_number() OVER (PARTITION BY period, parent ORDER BY score DESC, child) AS k FROM one) WHERE k = 1)"
TYPES = f"types AS (SELECT c.period, c.c AS child, two.parent, two.score, CASE WHEN two.score >= {lineage.STRONG} THEN 'continuation' WHEN two.score IS NOT NULL THEN 'weak' ELSE 'new' END AS match_type FROM cents c LEFT JOIN two ON c.period = two.period AND c.c = two.child)"


def cents(s, d):
    return lineage.period_centroids(observed(s, d))


@query("match_candidates", f"WITH {CAND} SELECT * FROM cand")
def match_candidates(s, d):
    return lineage.candidates(cents(s, d))


@query("match_greedy", f"WITH {CAND}, {GREEDY} SELECT period, child, parent, score FROM two")
def match_greedy(s, d):
    return lineage.greedy(match_candidates(s, d))


@query("match_types", f"WITH {CAND}, {GREEDY}, {TYPES} SELECT * FROM types")
def match_types(s, d):
    return lineage.match_types(cents(s, d), match_greedy(s, d))


@query("lifecycle_counts", f"WITH {CAND}, {GREEDY}, {TYPES}, gone AS (SELECT p.period + 1 AS period, count(*) FILTER (WHERE two.parent IS NULL) AS n_died FROM cents p LEFT JOIN two ON two.period = p.period + 1 AND two.parent = p.c GROUP BY 1) SELECT t.period, count(*) FILTER (WHERE match_type = 'new') AS n_new, count(*) FILTER (WHERE match_type = 'continuation') AS n_continued, count(*) FILTER (WHERE match_type = 'weak') AS n_weak, any_value(n_died) AS n_died FROM types t JOIN gone ON t.period = gone.period GROUP BY t.period")
def lifecycle_counts(s, d):
    return lineage.lifecycle(cents(s, d), match_types(s, d))


@query("births_deaths", f"WITH {CENTS}, best AS (SELECT a.period, a.c, max(list_inner_product(a.u, b.u)) AS s FROM cents a JOIN cents b ON a.period = b.period + 1 GROUP BY 1, 2), back AS (SELECT b.period + 1 AS period, b.c, max(list_inner_product(a.u, b.u)) AS s FROM cents a JOIN cents b ON a.period = b.period + 1 GROUP BY 1, 2) SELECT period, n_births, n_deaths FROM (SELECT period, count(*) FILTER (WHERE round(s, 6) < 0.7) AS n_births FROM best GROUP BY period) JOIN (SELECT period, count(*) FILTER (WHERE round(s, 6) < 0.7) AS n_deaths FROM back GROUP BY period) USING (period)")
def births_deaths(s, d):
    return lineage.births_deaths(cents(s, d))


@query("churn_drift", f"WITH {CAND}, {GREEDY} SELECT two.period, child, parent, round(sqrt(list_sum(list_transform(list_zip(a.u, b.u), lambda z: (z[1] - z[2]) ** 2))), 6) AS drift, a.n - b.n AS growth FROM two JOIN cents a ON a.period = two.period AND a.c = child JOIN cents b ON b.period = two.period - 1 AND b.c = parent")
def churn_drift(s, d):
    return lineage.drift(cents(s, d), match_greedy(s, d))


@query("surprise", f"WITH {CENTS}, p AS (SELECT a.period, a.c, a.u, b.c AS p1, b.u AS u1, row_number() OVER (PARTITION BY a.period, a.c ORDER BY round(list_inner_product(a.u, b.u), 9) DESC, b.c) AS k FROM cents a JOIN cents b ON a.period = b.period + 1), q AS (SELECT p.period, p.c, p.u, u1, b.u AS u2, row_number() OVER (PARTITION BY p.period, p.c ORDER BY round(list_inner_product(u1, b.u), 9) DESC, b.c) AS k2 FROM p JOIN cents b ON b.period = p.period - 2 WHERE p.k = 1), x AS (SELECT period, c, u, list_transform(list_zip(u1, u2), lambda z: 2 * z[1] - z[2]) AS g FROM q WHERE k2 = 1) SELECT period, c, round(least(2.0, greatest(0.0, 1 - list_inner_product(u, g) / sqrt(list_inner_product(g, g)))), 6) AS surprise FROM x")
def surprise(s, d):
    return lineage.surprise(cents(s, d))


def match_members(s, d):
    return observed(s, d).select("period", "c", "chunk", F.get("v", F.lit(0)).alias("w"))


@query("lineage_ids")
def lineage_ids(s, d):
    return matcher.match(cents(s, d), match_members(s, d)).withColumn("score", F.round("score", 6))


@query("lineage_ids_seeded")
def lineage_ids_seeded(s, d):
    """Periods from 1 on, with the clusters of period 0 as the context they begin from."""
    c = cents(s, d)
    seed = c.filter("period = 0").select("period", "c", F.format_string("%06d", F.col("c") + 500).alias("lineage"))
    return matcher.match(c, match_members(s, d), seed).withColumn("score", F.round("score", 6))


@query("match_summary")
def match_summary(s, d):
    return matcher.summary(matcher.match(cents(s, d), match_members(s, d)))


TRACE = f"""{P}, k0 AS (SELECT split_part(lineage, ':', 1) AS corpus, lineage, period, CAST(size AS DOUBLE) AS size, round(value) AS cohesion, row_number() {W} AS age_periods, size < 5 AS is_dead FROM panel),
  k1 AS (SELECT *, age_periods = 1 AS is_new, cohesion - lag(cohesion) {W} AS velocity, size - lag(size) {W} AS growth_rate FROM k0), k2 AS (SELECT *, velocity - lag(velocity) {W} AS acceleration FROM k1),
  trace AS (SELECT *, abs(velocity) AS drift_magnitude, acceleration - lag(acceleration) {W} AS jerk, CASE WHEN NOT is_dead AND lag(is_dead) {W} THEN 1 END AS reborn_after_periods FROM k2)"""
TRACED = ["size", "cohesion", "drift_magnitude", "jerk", "acceleration", "velocity", "age_periods", "growth_rate"]


def trace(s, d):
    """The panel with a cluster's measures: price for cohesion, under five orders for dead, five or more after that for reborn."""
    p = panel(s, d)
    p = p.select(F.split_part("lineage", F.lit(":"), F.lit(1)).alias("corpus"), "lineage", "period", F.col("size").cast("double").alias("size"), F.round("value").alias("cohesion"), (F.col("size") < 5).alias("is_dead"))
    w = Window.partitionBy("lineage").orderBy("period")
    p = series_ops.kinematics(p, "cohesion").withColumns({"age_periods": F.row_number().over(w), "growth_rate": series_ops.change(F.col("size"), w)})
    return p.withColumns({"is_new": F.col("age_periods") == 1, "drift_magnitude": F.abs("velocity"), "reborn_after_periods": F.when(~F.col("is_dead") & F.lag("is_dead").over(w), 1)})


BACK = {n: {a: c for a, c in cols.items() if c in TRACED or c == "is_dead"} for n, cols in trajectories.BEFORE.items()}
LAGGED = ", ".join(f"coalesce(lag(CAST({c} AS DOUBLE), {n}) OVER g, 0) AS {a}_t{n}" for n, cols in BACK.items() for a, c in cols.items())


@query("trajectory_fingerprint", f"""{TRACE}, l AS (SELECT corpus, lineage, {', '.join(f'CAST(coalesce({c}, 0) AS DOUBLE) AS {c}' for c in TRACED)}, {LAGGED}, lag(size, 3) OVER g AS far, row_number() OVER (PARTITION BY lineage ORDER BY period DESC) AS k
  FROM trace WHERE size >= 3 AND NOT is_new WINDOW g AS (PARTITION BY lineage ORDER BY period)) SELECT * EXCLUDE (far, k) FROM l WHERE k = 1 AND far IS NOT NULL""")
def trajectory_fingerprint(s, d):
    """With those of the columns that the panel has; tests/test_trajectories.py takes all 36."""
    return trajectories.fingerprint(trace(s, d), TRACED, BACK)


@query("terminal_rates", f"""{TRACE}, a AS (SELECT corpus, lineage, 'a' || CAST(min(size) AS INTEGER) % 4 AS archetype FROM trace GROUP BY 1, 2), e AS (SELECT * FROM trace WHERE size >= 3 QUALIFY row_number() OVER (PARTITION BY lineage ORDER BY period DESC) = 1),
  j AS (SELECT a.*, coalesce(is_dead, false) AS dead, coalesce(reborn_after_periods, 0) AS reborn, coalesce(drift_magnitude, 0) AS drift, coalesce(cohesion, 0) AS coh, age_periods FROM a LEFT JOIN e USING (corpus, lineage))
  SELECT archetype, count(*) AS n, round(count(*) FILTER (WHERE dead) / count(*), 6) AS death_rate, round(sum(reborn) / count(*), 6) AS reborn_rate, round(count(*) FILTER (WHERE NOT dead) / count(*), 6) AS survival_rate, round(sum(drift) / count(*), 4) AS mean_drift,
  round(sum(coh) / count(*), 4) AS mean_cohesion, round(avg(age_periods) FILTER (WHERE dead), 4) AS mean_age_dead, list_slice(list(lineage ORDER BY corpus, lineage), 1, 3) AS examples FROM j GROUP BY archetype""")
def terminal_rates(s, d):
    """Archetypes by the smallest size's remainder, as k-means can't be said in SQL."""
    t = trace(s, d)
    a = t.groupBy("corpus", "lineage").agg(F.concat(F.lit("a"), F.min("size").cast("int") % 4).alias("archetype"))
    got = trajectories.terminal_rates(a, t)
    return got.withColumns({c: F.round(c, k) for k, cs in ((6, ["death_rate", "reborn_rate", "survival_rate"]), (4, ["mean_drift", "mean_cohesion", "mean_age_dead"])) for c in cs})


SHARED = ["size", "cohesion", "drift", "pressure"]
OWN_RULES = f"""{BASE}, items AS ({' UNION ALL '.join(level_sql(c).replace('SELECT t,', 'SELECT corpus, t,') for c in SHARED)}), o AS (SELECT corpus, t, 'dies' AS outcome FROM b WHERE dies UNION ALL SELECT corpus, t, 'grows' FROM b WHERE size_next > size),
  sets AS (SELECT corpus, t, item AS s FROM items WHERE item IS NOT NULL UNION ALL SELECT a.corpus, a.t, a.item || '+' || b.item FROM items a JOIN items b ON a.t = b.t AND a.item < b.item), n AS (SELECT corpus, count(DISTINCT t) AS n FROM items GROUP BY 1),
  k AS (SELECT corpus, s, count(*) AS k FROM sets GROUP BY 1, 2), m AS (SELECT corpus, outcome, count(*) AS m FROM o GROUP BY 1, 2), h AS (SELECT corpus, s, outcome, count(*) AS hit FROM sets JOIN o USING (corpus, t) GROUP BY 1, 2, 3),
  r AS (SELECT corpus, s AS antecedent, outcome AS consequent, hit / k AS confidence, hit / k / (m / n) AS lift FROM h JOIN k USING (corpus, s) JOIN m USING (corpus, outcome) JOIN n USING (corpus) WHERE hit >= 0.03 * n AND round(hit / k, 9) >= 0.1 AND round(hit / k / (m / n), 9) >= 1.0)"""


def own_rules(s, d):
    b = base(s, d)
    levels = ops.levels(b.withColumn("t", F.struct("corpus", "t")), SHARED, "t").select("t.*", "item")
    out = b.filter("dies").select("corpus", "t", F.lit("dies").alias("outcome")).union(b.filter("size_next > size").select("corpus", "t", F.lit("grows")))
    return trajectories.rules_by_corpus(levels, out, "t", support=0.03, confidence=0.1, lift=1.0)


@query("rule_overlap", f"{OWN_RULES} SELECT antecedent, consequent, count(*) AS n_corpora, round(avg(lift), 6) AS mean_lift, round(avg(confidence), 6) AS mean_confidence, list(corpus ORDER BY corpus) AS corpora FROM r GROUP BY 1, 2 HAVING count(*) >= 2")
def rule_overlap(s, d):
    return trajectories.rule_overlap(own_rules(s, d)).withColumns({c: F.round(c, 6) for c in ("mean_lift", "mean_confidence")})


@query("threshold_advice", f"""{OWN_RULES}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE lift > 5) AS lift_5, count(*) FILTER (WHERE lift > 3) AS lift_3, count(*) FILTER (WHERE lift * confidence > 5) AS score_5, count(*) FILTER (WHERE lift * confidence > 3) AS score_3,
  count(*) FILTER (WHERE lift > 2) AS lift_2 FROM r) SELECT *, CASE WHEN lift_5 BETWEEN 50 AND 200 THEN 'lift>5' WHEN lift_3 BETWEEN 50 AND 200 THEN 'lift>3' WHEN score_5 BETWEEN 50 AND 200 THEN 'score>5' WHEN score_3 BETWEEN 50 AND 200 THEN 'score>3'
  WHEN lift_2 BETWEEN 50 AND 200 THEN 'lift>2' WHEN total <= 200 THEN 'all rules' WHEN lift_3 > 0 THEN 'lift>3' ELSE 'none' END AS advice FROM c""")
def threshold_advice(s, d):
    return trajectories.threshold_advice(own_rules(s, d))


SURVIVAL = f"""{TRACE}, f AS (SELECT lineage, count(*) AS duration, max(CAST(is_dead AS INTEGER)) AS observed_death, arg_min(size, period) AS s0, arg_min(CASE WHEN size % 2 = 0 THEN cohesion END, period) FILTER (WHERE is_new) AS c0 FROM trace GROUP BY lineage),
  lives AS (SELECT lineage, duration, observed_death, s0 AS size_at_entry, coalesce(c0, (SELECT quantile_cont(c0, 0.5) FROM f), 0) AS even_at_entry FROM f)"""


def lives(s, d):
    return trajectories.survival_rows(trace(s, d).withColumn("even", F.when(F.col("size") % 2 == 0, F.col("cohesion"))), ["size", "even"])


@query("survival_dataset", f"{SURVIVAL} SELECT * FROM lives")
def survival_dataset(s, d):
    """even: the price where the first size is even, so that the rest is filled with the median."""
    return lives(s, d)


@query("kaplan_meier", "WITH life AS (SELECT o_custkey, count(*) AS t, max(o_orderdate) < TIMESTAMP '2001-01-01' AS d FROM orders GROUP BY o_custkey), e AS (SELECT t, count(*) FILTER (WHERE d) AS dead, count(*) AS leaving FROM life GROUP BY t), r AS (SELECT a.t, a.dead, CAST(sum(b.leaving) AS BIGINT) AS at_risk FROM e a JOIN e b ON b.t >= a.t GROUP BY 1, 2) SELECT a.t, a.dead, a.at_risk, round(product(1 - b.dead / b.at_risk), 6) AS survival FROM r a JOIN r b ON b.t <= a.t GROUP BY 1, 2, 3")
def kaplan_meier(s, d):
    life = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("duration"), (F.max("o_orderdate") < F.lit("2001-01-01").cast("timestamp")).alias("observed_death"))
    return trajectories.kaplan_meier(life).withColumn("survival", F.round("survival", 6))


plain("confirmation_rate", "SELECT event_type, round(count(*) FILTER (WHERE value > 50) * 1.0E0 / count(*), 4) AS rate, count(*) AS n FROM {events} GROUP BY event_type")
plain("hop_mean", "WITH f AS (SELECT c_nationkey AS n, avg(c_acctbal) AS x FROM {customer} GROUP BY 1), e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey), h1 AS (SELECT a AS n, avg(x) AS x FROM e JOIN f ON b = f.n GROUP BY a), h2 AS (SELECT a AS n, avg(x) AS x FROM e JOIN h1 ON b = h1.n GROUP BY a) SELECT f.n, round(f.x, 4) AS x0, round(h1.x, 4) AS x1, round(h2.x, 4) AS x2 FROM f LEFT JOIN h1 ON f.n = h1.n LEFT JOIN h2 ON f.n = h2.n")
plain("baseline_r2", f"WITH {PANEL}, x AS (SELECT CAST(size AS DOUBLE) AS size, CAST(lead(size) OVER (PARTITION BY lineage ORDER BY period) AS DOUBLE) AS nxt FROM panel) SELECT round(power(corr(size, nxt), 2), 5) AS r2 FROM x WHERE nxt IS NOT NULL")
plain("metric_unpivot", f"WITH {PANEL}, m AS (SELECT period, CAST(count(*) AS DOUBLE) AS clusters, CAST(sum(size) AS DOUBLE) AS total, round(avg(value), 3) AS value FROM panel GROUP BY period) SELECT period, 'clusters' AS metric, clusters AS x FROM m UNION ALL SELECT period, 'total', total FROM m UNION ALL SELECT period, 'value', value FROM m")
plain("class_weight", "SELECT round(sum(1 - quality) * 1.0E0 / sum(quality), 6) AS neg_over_pos FROM {labels}")
plain("period_features_next", f"WITH {PANEL}, s AS (SELECT period, sum(size) AS n, round(avg(value), 3) AS v FROM panel GROUP BY period) SELECT period, n, v, lead(n) OVER (ORDER BY period) AS n_next FROM s")
plain("top_features", "SELECT event_type AS feature, round(avg(abs(value)), 4) AS mean_abs, round(stddev_samp(value), 4) AS sd FROM {events} GROUP BY event_type ORDER BY mean_abs DESC LIMIT 3")


@query("l1_logistic")
def l1_logistic(s, d):
    return learn.l1_logistic(learn.panel_features(table(s, d, "orders"), table(s, d, "customer")))


@query("gbt_death")
def gbt_death(s, d):
    return learn.gbt(learn.panel_features(table(s, d, "orders"), table(s, d, "customer")))


@query("tree_attribution")
def tree_attribution(s, d):
    made = learn.gbt_attributions(learn.panel_features(table(s, d, "orders"), table(s, d, "customer")))
    return made.withColumn("attribution", F.round("attribution", 6))


@query("symbolic_formulas")
def symbolic_formulas(s, d):
    """Formulas for the next period's size; tests/test_formulas.py holds the search against planted laws."""
    got = formulas.search(learn.panel_features(table(s, d, "orders"), table(s, d, "customer")), learn.FEATURES, "next")
    return got.withColumns({c: F.round(c, 6) for c in ("r2", "slope", "intercept")})


@query("kmeans_archetypes")
def kmeans_archetypes(s, d):
    return learn.archetypes(learn.panel_features(table(s, d, "orders"), table(s, d, "customer")))


@query("cox")
def cox(s, d):
    return learn.cox(learn.panel_features(table(s, d, "orders"), table(s, d, "customer")))


@query("phase_regressor")
def phase_regressor(s, d):
    from driftloom.operators import panel as ops
    from driftloom.plans.panel import panel

    p = panel(s, d)
    series = ops.phase_scores(p).join(ops.entropy_series(p), "period")
    return learn.phase_regressor(series, ["phase_transition_score", "entropy", "n_clusters"], "phase_transition_score")
