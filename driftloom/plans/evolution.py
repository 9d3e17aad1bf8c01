"""Splits and mergers over four periods, durations and small-cluster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import splits as ops
from driftloom.operators.lineage import SPLIT, WEAK
from driftloom.plans.core import plain, query
from driftloom.plans.discovery import CAND, match_candidates
from driftloom.plans.observed import OBS, observed
from driftloom.plans.panel import PANEL

MEMBERS = "members AS (SELECT period, c, chunk, v[1] AS w FROM obs)"
CORE = "core AS (SELECT m.* FROM members m JOIN (SELECT period, quantile_cont(w, 0.5) AS median FROM members GROUP BY period) USING (period) WHERE w >= median)"


def pairs(name: str, of: str) -> str:
    return f"""{name}_size AS (SELECT period, c, count(*) AS n FROM {of} GROUP BY 1, 2), {name} AS (SELECT s.period, child, parent, n_shared, round(n_shared / p.n, 6) AS overlap, round(1 - n_shared / (k.n + p.n - n_shared), 6) AS churn
  FROM (SELECT a.period, a.c AS child, b.c AS parent, count(*) AS n_shared FROM {of} a JOIN {of} b ON a.period = b.period + 1 AND a.chunk = b.chunk GROUP BY 1, 2, 3) s
  JOIN {name}_size k ON k.period = s.period AND k.c = child JOIN {name}_size p ON p.period = s.period - 1 AND p.c = parent)"""


COMPOSITE = f"""{CAND}, {MEMBERS}, {CORE}, {pairs("al", "members")}, {pairs("inner_", "core")},
comp AS (SELECT *, round((0.5::DOUBLE * score + 0.3::DOUBLE * overlap + 0.2::DOUBLE * core_overlap) / (0.5::DOUBLE + CASE WHEN overlap > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN core_overlap > 0 THEN 0.2::DOUBLE ELSE 0 END), 6) AS composite
  FROM (SELECT cand.*, coalesce(al.overlap, 0) AS overlap, coalesce(inner_.overlap, 0) AS core_overlap FROM cand LEFT JOIN al USING (period, child, parent) LEFT JOIN inner_ USING (period, child, parent)))"""


def jointly(name: str, of: str, whole: str, part: str) -> str:
    back = "- 1" if whole == "parent" else ""
    return f"""{name} AS (SELECT period, {whole}, n_parts, round(held / n, 6) AS coverage FROM (SELECT period, {whole}, count(DISTINCT {part}) AS n_parts FROM {of} GROUP BY 1, 2 HAVING count(DISTINCT {part}) >= 2)
  JOIN (SELECT a.period, {of}.{whole}, count(DISTINCT a.chunk) AS held FROM members a JOIN members b ON a.period = b.period + 1 AND a.chunk = b.chunk JOIN {of} ON {of}.period = a.period AND child = a.c AND parent = b.c GROUP BY 1, 2) h USING (period, {whole})
  JOIN (SELECT period AS since, c, count(*) AS n FROM members GROUP BY 1, 2) ON since = period {back} AND c = {whole} WHERE round(held / n, 6) >= {SPLIT})"""


def members(s, d):
    return observed(s, d).select("period", "c", "chunk", F.get("v", F.lit(0)).alias("w"))


@query("member_overlap", f"WITH {OBS}, {MEMBERS}, {pairs('al', 'members')} SELECT * FROM al")
def member_overlap(s, d):
    return ops.overlap(members(s, d))


@query("composite_score", f"WITH {COMPOSITE} SELECT * FROM comp")
def composite_score(s, d):
    return ops.composite(match_candidates(s, d), members(s, d))


#: Candidates of these queries: any pair of clusters that share a member.
TIES = f"{OBS}, {MEMBERS}, ties AS (SELECT DISTINCT a.period, a.c AS child, b.c AS parent FROM members a JOIN members b ON a.period = b.period + 1 AND a.chunk = b.chunk)"


def ties(s, d):
    return ops.shared(members(s, d)).select("period", "child", "parent").distinct()


@query("split_parents", f"WITH {TIES}, {jointly('sp', 'ties', 'parent', 'child')} SELECT * FROM sp")
def split_parents(s, d):
    return ops.splits(ties(s, d), members(s, d))


@query("merger_targets", f"WITH {TIES}, {jointly('mg', 'ties', 'child', 'parent')} SELECT * FROM mg")
def merger_targets(s, d):
    return ops.mergers(ties(s, d), members(s, d))


@query("split_children", f"WITH {COMPOSITE}, own AS (SELECT * FROM comp WHERE composite >= {WEAK}), {jointly('sp', 'own', 'parent', 'child')} SELECT period, child, parent FROM own SEMI JOIN sp USING (period, parent)")
def split_children(s, d):
    return ops.split_children(composite_score(s, d), members(s, d))


# Durations from filing to grant: here from order to shipment, a cluster a nation, in whole days.
DAYS = "days AS (SELECT c_nationkey AS c, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, CAST({diff} AS DOUBLE) AS days FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey)"
AGGREGATES = """per AS (SELECT c, period, avg(days) AS mean, stddev_samp(days) AS sd, count(*) AS n FROM days GROUP BY 1, 2),
  agg AS (SELECT c, period, n, mean, sd, CAST(row_number() OVER (PARTITION BY c ORDER BY period) AS DOUBLE) AS k FROM per),
  tr AS (SELECT c, regr_slope(mean, k) AS trend FROM agg GROUP BY c)"""
SPARK_DAYS = DAYS.replace("{diff}", "datediff(l_shipdate, o_orderdate)")
DUCK_DAYS = DAYS.replace("{diff}", "date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))")


def durations(name: str, text: str) -> None:
    plain(name, f"WITH {SPARK_DAYS}, {AGGREGATES} {text}", f"WITH {DUCK_DAYS}, {AGGREGATES} {text}")


durations("prosecution_aggregates", "SELECT agg.c, period, n, round(mean, 5) AS mean_days, round(sd, 5) AS sd_days, round(trend, 5) AS trend FROM agg JOIN tr ON agg.c = tr.c")
durations("prosecution_percentile", "SELECT c, period, round(percent_rank() OVER (PARTITION BY period ORDER BY round(mean, 6)), 6) AS percentile FROM agg")
durations(
    "prosecution_heat",
    "SELECT c, period, round(0.5E0 * percent_rank() OVER (PARTITION BY period ORDER BY n) + 0.5E0 * (1 - percent_rank() OVER (PARTITION BY period ORDER BY round(mean, 6))), 6) AS heat FROM agg",
)
plain("shadow_clusters", f"WITH {PANEL} SELECT period, count(*) AS n_shadow, sum(size) AS n_members FROM panel WHERE size < 3 GROUP BY period", f"WITH {PANEL} SELECT period, count(*) AS n_shadow, CAST(sum(size) AS BIGINT) AS n_members FROM panel WHERE size < 3 GROUP BY period")
plain("perturbation_score", f"WITH {PANEL}, m AS (SELECT lineage, period, abs(value - avg(value) OVER (PARTITION BY period)) AS far FROM panel) SELECT lineage, period, round((far - lag(far) OVER (PARTITION BY lineage ORDER BY period)) / 100, 1) AS perturbation FROM m")
