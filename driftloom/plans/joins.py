"""Joins, picks, upserts, quality and control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import tables as ops
from driftloom.plans.core import query, table
from driftloom.plans.panel import PANEL as PANEL_TEXT
from driftloom.plans.panel import panel
from driftloom.sources import readers

PANEL = PANEL_TEXT.replace("{orders}", "orders").replace("{customer}", "customer")
E = "e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, n FROM (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) WHERE a < b)"
OLD = "old AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS v FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT c_custkey AS k, upper(c_name) AS v FROM customer WHERE c_custkey % 5 <> 0)"


def old_and_new(s, d):
    """Two states of one table: every second customer with some names missing, and four of five with other names."""
    c = table(s, d, "customer")
    old = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("v"))
    return old, c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("v"))


@query("void_ends", f"WITH {E} SELECT a AS c FROM e WHERE n < 20 UNION SELECT b FROM e WHERE n < 20")
def void_ends(s, d):
    cust, supp = table(s, d, "customer"), table(s, d, "supplier")
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    rare = j.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).count().filter("count < 20 and a < b")
    return rare.select(F.explode(F.array("a", "b")).alias("c")).distinct()


@query("distinct_on_pick", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS k FROM orders) WHERE k = 1")
def distinct_on_pick(s, d):
    return ops.first_rows(table(s, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("lateral_pick", "SELECT p_partkey, max_price, suppliers FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS max_price, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey")
def lateral_pick(s, d):
    own = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("max_price"), F.countDistinct("l_suppkey").alias("suppliers"))
    return table(s, d, "part").select("p_partkey").join(own, "p_partkey", "left")


@query("next_period", f"WITH {PANEL}, p AS (SELECT DISTINCT period FROM panel) SELECT period, lead(period) OVER (ORDER BY period) AS next_period, lag(period) OVER (ORDER BY period) AS previous_period FROM p")
def next_period(s, d):
    return ops.beside(panel(s, d), "period")


@query("horizon_pivot", f"WITH {PANEL}, k AS (SELECT lineage, size, row_number() OVER (PARTITION BY lineage ORDER BY period DESC) AS h FROM panel) SELECT lineage, max(CASE WHEN h = 1 THEN size END) AS h1, max(CASE WHEN h = 2 THEN size END) AS h2, max(CASE WHEN h = 3 THEN size END) AS h3 FROM k GROUP BY lineage")
def horizon_pivot(s, d):
    return ops.last_values(panel(s, d), "lineage", "period", "size")


@query("semi_by_codes", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment LIKE 'B%')")
def semi_by_codes(s, d):
    some = table(s, d, "customer").filter(F.col("c_mktsegment").startswith("B")).select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(some, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("anti_insert", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1996-01-01')")
def anti_insert(s, d):
    early = table(s, d, "orders").filter("o_orderdate < timestamp '1996-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").join(early, "c_custkey", "left_anti").select("c_custkey")


@query("upsert_keep", f"WITH {OLD} SELECT k, v FROM old UNION ALL SELECT k, v FROM new WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.k = new.k)")
def upsert_keep(s, d):
    return readers.upsert(*old_and_new(s, d), ["k"], "keep")


@query("upsert_fill_null", f"WITH {OLD} SELECT coalesce(old.k, new.k) AS k, coalesce(old.v, new.v) AS v FROM old FULL OUTER JOIN new ON old.k = new.k")
def upsert_fill_null(s, d):
    return readers.upsert(*old_and_new(s, d), ["k"], "fill")


@query("replace_partition", f"WITH {OLD} SELECT k, v FROM old WHERE k % 4 <> 0 UNION ALL SELECT k, v FROM new WHERE k % 4 = 0")
def replace_partition(s, d):
    old, new = old_and_new(s, d)
    return old.filter("k % 4 <> 0").union(new.filter("k % 4 = 0"))


@query("shared_top", "SELECT l_partkey FROM (SELECT l_partkey FROM lineitem GROUP BY l_partkey ORDER BY sum(l_quantity) DESC, l_partkey LIMIT 100) INTERSECT SELECT l_partkey FROM (SELECT l_partkey FROM lineitem GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey LIMIT 100)")
def shared_top(s, d):
    rows = table(s, d, "lineitem")
    return ops.top_ids(rows, "l_partkey", F.sum("l_quantity"), 100).join(ops.top_ids(rows, "l_partkey", F.count("*"), 100), "l_partkey", "left_semi")


@query("ordered_arrays", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 2")
def ordered_arrays(s, d):
    own = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.count("*").alias("n")).filter(F.size("p") >= 2)
    return own.select("o_custkey", F.array_join(F.array_sort("p"), ";").alias("priorities"), "n")


@query("filter_aggregates", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n_big, round(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2) AS discounted FROM lineitem GROUP BY l_returnflag")
def filter_aggregates(s, d):
    dear = F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("n_big"), F.round(F.sum(dear), 2).alias("discounted"))


@query("fill_rates", "SELECT count(*) AS n, round(count(text) * 1.0E0 / count(*), 4) AS text_rate, round(count(nullif(lang, 'en')) * 1.0E0 / count(*), 4) AS other_lang_rate, round(count(source) * 1.0E0 / count(*), 4) AS source_rate FROM documents")
def fill_rates(s, d):
    return ops.fill_rates(table(s, d, "documents"), text_rate=F.col("text"), other_lang_rate=F.nullif("lang", F.lit("en")), source_rate=F.col("source"))


@query("phase_contract", "WITH r AS (SELECT source, avg(CASE WHEN text IS NULL OR length(text) < 200 THEN 1.0E0 ELSE 0.0E0 END) AS bad FROM documents GROUP BY source) SELECT source, round(bad, 4) AS null_rate, CASE WHEN bad > 0.25 THEN 'critical' WHEN bad > 0.10 THEN 'error' WHEN bad > 0.05 THEN 'warning' ELSE 'ok' END AS severity FROM r")
def phase_contract(s, d):
    bad = F.col("text").isNull() | (F.length("text") < 200)
    return ops.contract(table(s, d, "documents"), "source", bad, {"critical": 0.25, "error": 0.10, "warning": 0.05})


@query("high_water_increment", "WITH m AS (SELECT user_id, max(ts) AS mark FROM events WHERE event_id % 2 = 0 GROUP BY user_id) SELECT e.event_id, e.user_id FROM events e LEFT JOIN m ON e.user_id = m.user_id WHERE e.ts > coalesce(m.mark, TIMESTAMP '2020-01-01')")
def high_water_increment(s, d):
    """Every second event is there already; these set the marks."""
    e = table(s, d, "events")
    marks = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("mark"))
    return ops.beyond_mark(e.select("event_id", "user_id", "ts"), marks, "user_id", "ts", F.expr("timestamp '2020-01-01'")).select("event_id", "user_id")


@query("stale_claims", "SELECT event_id, user_id, gap_s FROM (SELECT event_id, user_id, CAST(floor(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) - floor(epoch(ts)) AS BIGINT) AS gap_s FROM events) WHERE gap_s > 1800")
def stale_claims(s, d):
    return ops.gaps_over(table(s, d, "events"), "user_id", "ts", "event_id", 1800).select("event_id", "user_id", "gap_s")


@query("next_job", "SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') WHERE k = 1")
def next_job(s, d):
    return ops.first_rows(table(s, d, "orders").filter("o_orderstatus = 'O'"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_orderpriority", "o_orderkey")


@query("jobs_by_bin", "SELECT o_orderpriority AS bin, o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM orders GROUP BY 1, 2 HAVING count(*) >= 3")
def jobs_by_bin(s, d):
    g = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("bin"), F.col("o_orderstatus").alias("status"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price")).filter("n >= 3")


@query("price_anomaly", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS price FROM orders GROUP BY 1), h AS (SELECT day, price, avg(price) OVER w AS mean, count(*) OVER w AS n FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT day, price, round(mean, 3) AS mean FROM h WHERE n >= 10 AND price < 0.7 * mean")
def price_anomaly(s, d):
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / F.count("*")
    days = table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(cents.alias("price"))
    return ops.under_history(days, "day", "price")


@query("default_config", "SELECT source, count(*) AS n, CASE WHEN count(*) < 50 THEN 0.5 ELSE 0.3 END AS void_threshold, CASE WHEN count(*) < 40 THEN 8 ELSE 16 END AS k FROM documents GROUP BY source")
def default_config(s, d):
    g = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.select("source", "n", F.when(F.col("n") < 50, 0.5).otherwise(0.3).alias("void_threshold"), F.when(F.col("n") < 40, 8).otherwise(16).alias("k"))


@query("person_dimension", "SELECT lower(trim(c_name)) AS name, c_nationkey AS country, min(c_custkey) AS person_id, count(*) AS n FROM customer GROUP BY 1, 2")
def person_dimension(s, d):
    g = table(s, d, "customer").groupBy(F.lower(F.trim("c_name")).alias("name"), F.col("c_nationkey").alias("country"))
    return g.agg(F.min("c_custkey").alias("person_id"), F.count("*").alias("n"))


@query("family_dedup", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(date_trunc('year', o_orderdate) AS DATE) ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def family_dedup(s, d):
    first = ops.first_rows(table(s, d, "orders").withColumn("y", F.trunc("o_orderdate", "year")), ["o_custkey", "y"], ["o_orderdate", "o_orderkey"])
    return first.join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = ANY(['1-URGENT', '2-HIGH', 'none'])")
def in_list(s, d):
    return ops.in_list(table(s, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "none"]).select("o_orderkey", "o_orderpriority")


QUEUE = """jobs AS (SELECT o_orderkey AS job, o_orderpriority AS bin, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'claimed' ELSE 'done' END AS status, CAST(o_custkey % 5 AS INTEGER) AS priority,
  CAST(o_orderkey % 4 AS INTEGER) AS tries, CASE WHEN o_orderstatus = 'P' THEN 'w' || CAST(o_custkey % 3 AS VARCHAR) END AS worker, o_orderdate AS beat, CAST(NULL AS VARCHAR) AS error FROM orders)"""


def queue(s, d):
    o = table(s, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "claimed").otherwise("done")
    worker = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("w"), (F.col("o_custkey") % 3).cast("string")))
    return o.select(
        F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("bin"), status.alias("status"), (F.col("o_custkey") % 5).cast("int").alias("priority"),
        (F.col("o_orderkey") % 4).cast("int").alias("tries"), worker.alias("worker"), F.col("o_orderdate").alias("beat"), F.lit(None).cast("string").alias("error"),
    )


NOW = "1998-06-01"


@query("jobs_claimed", f"""WITH {QUEUE}, nx AS (SELECT job FROM (SELECT job, row_number() OVER (PARTITION BY bin ORDER BY priority, job) AS k FROM jobs WHERE status = 'pending') WHERE k = 1)
  SELECT jobs.job, bin, CASE WHEN nx.job IS NULL THEN status ELSE 'claimed' END AS status, CASE WHEN nx.job IS NULL THEN tries ELSE tries + 1 END AS tries, CASE WHEN nx.job IS NULL THEN worker ELSE 'for ' || bin END AS worker FROM jobs LEFT JOIN nx ON jobs.job = nx.job""")
def jobs_claimed(s, d):
    jobs = queue(s, d)
    workers = jobs.select("bin").distinct().withColumn("worker", F.concat(F.lit("for "), "bin"))
    return ops.claim(jobs, workers, F.lit(NOW).cast("timestamp")).select("job", "bin", "status", "tries", "worker")


@query("jobs_finished", f"""WITH {QUEUE}, ended AS (SELECT job, 'w1' AS worker, CASE WHEN job % 2 = 0 THEN 'broke' END AS error FROM jobs), own AS (SELECT jobs.job, ended.error FROM jobs JOIN ended ON jobs.job = ended.job AND jobs.worker = ended.worker WHERE status = 'claimed')
  SELECT jobs.job, CASE WHEN own.job IS NULL THEN status WHEN own.error IS NULL THEN 'done' WHEN tries >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN own.job IS NOT NULL AND own.error IS NOT NULL THEN NULL ELSE worker END AS worker, coalesce(own.error, jobs.error) AS error FROM jobs LEFT JOIN own ON jobs.job = own.job""")
def jobs_finished(s, d):
    jobs = queue(s, d)
    ended = jobs.select("job", F.lit("w1").alias("worker"), F.when(F.col("job") % 2 == 0, "broke").alias("error"))
    return ops.finish(jobs, ended, F.lit(NOW).cast("timestamp")).select("job", "status", "worker", "error")


@query("jobs_reassigned", f"""WITH {QUEUE}, j AS (SELECT *, status = 'claimed' AND epoch(TIMESTAMP '{NOW}') - epoch(beat) > 1800 AS lost FROM jobs)
  SELECT job, CASE WHEN NOT lost THEN status WHEN tries >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN NOT lost THEN worker END AS worker, CASE WHEN lost THEN 'no sign of life' END AS error FROM j""")
def jobs_reassigned(s, d):
    return ops.reassign(queue(s, d), F.lit(NOW).cast("timestamp")).select("job", "status", "worker", "error")
