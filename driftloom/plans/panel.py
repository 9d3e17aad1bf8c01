"""Periods, texts and the cluster panel: lineage = market segment and nation, period = quarter of the order date, value =
mean price in cents (from whole cents, so that engines agree on it to the last bit).

The queries call the library's functions; the SQL beside each says the same in another way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import periods, texts
from driftloom.operators import panel as ops
from driftloom.plans.core import query, table

PANEL = """panel AS (SELECT concat(c_mktsegment, ':', c_nationkey) AS lineage, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, count(*) AS size,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) AS value FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2)"""
P = f"WITH {PANEL}".replace("{orders}", "orders").replace("{customer}", "customer")
W = "OVER (PARTITION BY lineage ORDER BY period)"


def day():
    return F.col("o_orderdate").cast("date")


def orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders")


def panel(s: SparkSession, d: str) -> DataFrame:
    o = orders(s, d).select("o_custkey", F.trunc(day(), "quarter").alias("period"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    c = table(s, d, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(":"), "c_nationkey").alias("lineage"))
    per = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("lineage", "period").agg(F.count("*").alias("size"), F.sum("cents").cast("double").alias("cents"))
    return per.select("lineage", "period", "size", (F.col("cents") / F.col("size")).alias("value"))


@query("period_start", """SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
  CAST(date_trunc('year', o_orderdate) AS DATE) AS y, CAST(date_trunc('week', o_orderdate) AS DATE) AS w FROM orders""")
def period_start(s, d):
    names = {"q": "quarterly", "m": "monthly", "y": "annual", "w": "weekly"}
    return orders(s, d).select("o_orderkey", *[periods.period_start(F.col("o_orderdate"), r).alias(k) for k, r in names.items()])


EARLY = "CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN DATE '{early}' ELSE {late} END"


def bounds_sql(name: str, unit: str, last: str) -> str:
    start = f"CAST(date_trunc('{unit}', o_orderdate) AS DATE)"
    return f"{EARLY.format(early='1900-01-01', late=start)} AS {name}_start, {EARLY.format(early='1995-12-31', late=last.format(start=start))} AS {name}_end"


BOUNDS = [("q", "quarter", "last_day(CAST({start} + INTERVAL 2 MONTH AS DATE))"), ("m", "month", "last_day({start})"), ("y", "year", "last_day(CAST({start} + INTERVAL 11 MONTH AS DATE))"), ("w", "week", "CAST({start} + INTERVAL 6 DAY AS DATE)")]


@query("period_bounds", f"SELECT o_orderkey, {', '.join(bounds_sql(*b) for b in BOUNDS)} FROM orders")
def period_bounds(s, d):
    made = {k: periods.period_bounds(F.col("o_orderdate"), r, "1996-01-01") for k, r in {"q": "quarterly", "m": "monthly", "y": "annual", "w": "weekly"}.items()}
    return orders(s, d).select("o_orderkey", *[b[part].alias(f"{k}_{part}") for k, b in made.items() for part in ("start", "end")])


@query("period_label", """SELECT o_orderkey, concat(year(x), '_Q', quarter(x)) AS q, concat(year(x), '_M', lpad(CAST(month(x) AS VARCHAR), 2, '0')) AS m,
  concat(isoyear(x), '_W', lpad(CAST(weekofyear(x) AS VARCHAR), 2, '0')) AS w, CAST(year(x) AS VARCHAR) AS y,
  CASE WHEN x < DATE '1997-01-01' THEN 'pre_1997' ELSE CAST(year(x) AS VARCHAR) END AS cut FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS x FROM orders)""")
def period_label(s, d):
    names = {"q": "quarterly", "m": "monthly", "y": "annual", "w": "weekly"}
    return orders(s, d).select("o_orderkey", *[periods.period_label(day(), r).alias(k) for k, r in names.items()], periods.period_label(day(), "annual", "1997-01-01").alias("cut"))


SERIES = " UNION ALL ".join(f"""SELECT '{name}' AS resolution, greatest(CAST(w AS DATE), low) AS window_start, least(CAST(w + INTERVAL 1 {unit} - INTERVAL 1 DAY AS DATE), high) AS window_end
  FROM (SELECT unnest(generate_series(date_trunc('{unit}', low), CAST(high AS TIMESTAMP), INTERVAL 1 {unit})) AS w, low, high FROM span)""" for name, unit in (("monthly", "month"), ("quarterly", "quarter"), ("weekly", "week"), ("annual", "year")))


@query("window_series", f"WITH span AS (SELECT CAST(min(o_orderdate) AS DATE) AS low, CAST(max(o_orderdate) AS DATE) AS high FROM orders) {SERIES}")
def window_series(s, d):
    span = orders(s, d).agg(F.min(day()).alias("low"), F.max(day()).alias("high"))
    made = [periods.windows(span, r).select(F.lit(r).alias("resolution"), "window_start", "window_end") for r in ("monthly", "quarterly", "weekly", "annual")]
    return made[0].union(made[1]).union(made[2]).union(made[3])


RAW_DATE = "CASE WHEN o_orderkey % 5 = 0 THEN '20201301' WHEN o_orderkey % 7 = 0 THEN '2020' ELSE {day} END"


@query("date_parse", f"SELECT o_orderkey, CASE WHEN length(t) = 8 THEN CAST(try_strptime(t, '%Y%m%d') AS DATE) END AS d FROM (SELECT o_orderkey, {RAW_DATE.format(day=chr(115) + 'trftime(o_orderdate, ' + chr(39) + '%Y%m%d' + chr(39) + ')')} AS t FROM orders)")
def date_parse(s, d):
    raw = orders(s, d).select("o_orderkey", F.expr(RAW_DATE.format(day="date_format(o_orderdate, 'yyyyMMdd')")).alias("t"))
    return raw.select("o_orderkey", periods.compact_date(F.col("t")).alias("d"))


BAD_DATE = "CASE WHEN o_orderkey % 6 = 0 THEN '9176-06-01' WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE {day} END"


@query("date_valid", f"SELECT o_orderkey, CASE WHEN year(x) BETWEEN 1800 AND 2030 THEN x END AS d FROM (SELECT o_orderkey, TRY_CAST({BAD_DATE.format(day='CAST(CAST(o_orderdate AS DATE) AS VARCHAR)')} AS DATE) AS x FROM orders)")
def date_valid(s, d):
    raw = orders(s, d).select("o_orderkey", F.expr(BAD_DATE.format(day="CAST(CAST(o_orderdate AS DATE) AS STRING)")).alias("t"))
    return raw.select("o_orderkey", periods.valid_date(F.col("t")).alias("d"))


@query("epoch_year", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(year(ts) AS INTEGER) AS y FROM events")
def epoch_year(s, d):
    return table(s, d, "events").select("event_id", periods.epoch_seconds(F.col("ts")).alias("seconds"), F.year("ts").alias("y"))


@query("id_normalise", """SELECT c_custkey, nullif(lower(trim(CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE concat(' 10.1/', upper(c_name), ' ') END)), '') AS doi,
  nullif(upper(trim(concat(' pmc', CAST(c_custkey AS VARCHAR)))), '') AS pmcid, replace(concat('https://openalex.org/W', CAST(c_custkey AS VARCHAR)), 'https://openalex.org/', '') AS work,
  concat('PMID:', CAST(c_custkey AS VARCHAR)) AS pmid_key FROM customer""")
def id_normalise(s, d):
    key = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" 10.1/"), F.upper("c_name"), F.lit(" ")))
    return table(s, d, "customer").select(
        "c_custkey", texts.doi(raw).alias("doi"), texts.pmcid(F.concat(F.lit(" pmc"), key)).alias("pmcid"),
        texts.work_id(F.concat(F.lit("https://openalex.org/W"), key)).alias("work"), texts.keyed("PMID", texts.pmid(key)).alias("pmid_key"),
    )


CODE = "concat(substr('ABCDEFGHY', CAST(p_partkey % 9 + 1 AS INT), 1), lpad(CAST(p_size AS VARCHAR(9)), 2, '0'), 'L  ', CAST(p_partkey AS VARCHAR(20)), '/', lpad(CAST(p_size AS VARCHAR(9)), 2, '0'), '        20060101AFI20250627BHCN')"
#: One code in three is malformed or has blanks around it.
MIXED = f"CASE p_partkey % 15 WHEN 0 THEN lower({CODE}) WHEN 1 THEN replace({CODE}, '/', '-') WHEN 2 THEN replace({CODE}, 'AFI', 'AXI') WHEN 3 THEN concat('  ', {CODE}, ' ') WHEN 4 THEN replace({CODE}, 'L  ', '7  ') ELSE {CODE} END"
IPCR = r"^([A-H])(\d{2})([A-Z])\s+(\d+)/(\d+)\s+(\d{8})([ACN])([FILS])([A-Z])"
IPCR_NAMES = ["section", "class", "subclass", "group", "subgroup", "version", "level", "position", "value"]
CPC = r"^([A-HY])(\d{2})([A-Z])\s*(\d+)/(\d+)"


def fields_sql(pattern: str, names: list[str], of: str) -> str:
    return ", ".join(f"nullif(regexp_extract({of}, '{pattern}', {i}), '') AS \"f_{n}\"" for i, n in enumerate(names, 1))


@query("ipcr_parse", f"SELECT p_partkey, {fields_sql(IPCR, IPCR_NAMES, 'trim(s)')} FROM (SELECT p_partkey, {MIXED} AS s FROM part)")
def ipcr_parse(s, d):
    made = table(s, d, "part").select("p_partkey", texts.ipcr(F.expr(MIXED)).alias("x"))
    return made.select("p_partkey", *[F.col("x")[n].alias(f"f_{n}") for n in IPCR_NAMES])


@query("cpc_parse", f"""SELECT p_partkey, {fields_sql(CPC, IPCR_NAMES[:5], 'trim(c)')}, CASE WHEN length(s) <= 4 THEN s ELSE substr(s, 1, 4) || '  ' || substr(s, 5) END AS spaced
  FROM (SELECT p_partkey, c, regexp_replace(c, '\\s', '', 'g') AS s FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN substr(c, 1, 4) ELSE substr(c, 1, instr(c, '/') + 2) END AS c FROM (SELECT p_partkey, {MIXED} AS c FROM part)))""")
def cpc_parse(s, d):
    raw = table(s, d, "part").select("p_partkey", F.expr(MIXED).alias("c"))
    raw = raw.withColumn("s", F.when(F.col("p_partkey") % 10 == 0, F.substring("c", 1, 4)).otherwise(F.substr("c", F.lit(1), F.instr("c", "/") + 2)))
    made = raw.withColumn("x", texts.cpc(F.col("s")))
    return made.select("p_partkey", *[F.col("x")[n].alias(f"f_{n}") for n in IPCR_NAMES[:5]], texts.cpc_spaced(F.col("s")).alias("spaced"))


@query("sentence_chunks", r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk, c[i] AS text FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM
  (SELECT doc_id, CASE WHEN len(s) > 0 THEN s[1:5] WHEN length(t) >= 20 THEN [left(t, 2000)] ELSE [] END AS c FROM
  (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.?!])\s+([A-Z0-9"(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: length(x) >= 20) AS s FROM
  (SELECT doc_id, trim(CASE WHEN doc_id % 9 = 0 THEN '  ' || left(text, 30) || chr(10) ELSE text END, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents WHERE text IS NOT NULL))))""")
def sentence_chunks(s, d):
    """One text in nine is cut to 30 characters with blanks around, so that some are too short."""
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("  "), F.left("text", F.lit(30)), F.lit("\n"))).otherwise(F.col("text"))
    made = table(s, d, "documents").filter("text is not null").select("doc_id", texts.sentences(text).alias("c"))
    return made.select("doc_id", F.posexplode("c").alias("chunk", "text"))


@query("text_fallback", """WITH p AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS abstract, CASE WHEN doc_id % 6 = 3 THEN NULL ELSE concat('title ', doc_id) END AS title FROM documents),
  f AS (SELECT *, nullif(trim(abstract), '') AS a, nullif(trim(title), '') AS t FROM p)
  SELECT doc_id, CASE WHEN a IS NOT NULL THEN abstract WHEN t IS NOT NULL THEN title END AS text,
  CASE WHEN a IS NOT NULL THEN CASE WHEN lang = 'en' THEN 'abstract_en' ELSE 'abstract_xx' END WHEN t IS NOT NULL THEN CASE WHEN lang = 'en' THEN 'title_en' ELSE 'title_xx' END END AS provenance FROM f""")
def text_fallback(s, d):
    docs = table(s, d, "documents")
    abstract = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))
    title = F.when(F.col("doc_id") % 6 == 3, None).otherwise(F.concat(F.lit("title "), "doc_id"))
    one = lambda text: F.array(F.struct("lang", text.alias("text")))
    return docs.select("doc_id", texts.resolved_text(one(abstract), one(title)).alias("x")).select("doc_id", "x.text", "x.provenance")


@query("text_clean", "SELECT doc_id, translate(concat(coalesce(source, ''), ' ', coalesce(text, '')), chr(9) || chr(10) || chr(13), '   ') AS text FROM documents")
def text_clean(s, d):
    return table(s, d, "documents").select("doc_id", texts.chunk_text(F.col("source"), F.col("text")).alias("text"))


@query("json_props", """SELECT event_id, json_extract_string(props, '$.k') AS k, event_type, round(value, 4) AS value, '{"id":' || event_id || ',"t":"' || event_type || '"}' AS js FROM events""")
def json_props(s, d):
    js = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("t")))
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type", F.round("value", 4).alias("value"), js.alias("js"))


@query("inverted_index", r"""WITH w AS (SELECT item_id, i, string_split(text, ' ') AS a FROM (SELECT *, 1 AS i FROM benchmark)), p AS (SELECT item_id, unnest(a) AS word, unnest(range(len(a))) AS pos FROM w),
  ix AS (SELECT item_id, word, list(pos ORDER BY pos) AS places FROM p GROUP BY 1, 2), back AS (SELECT item_id, word, unnest(places) AS pos FROM ix)
  SELECT item_id, count(DISTINCT word) AS n_words, string_agg(word, ' ' ORDER BY pos) AS text FROM back GROUP BY item_id""")
def inverted_index(s, d):
    words = table(s, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    index = words.groupBy("item_id", "word").agg(F.array_sort(F.collect_list("pos")).alias("at")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("ix"))
    return index.select("item_id", F.size("ix").cast("long").alias("n_words"), texts.from_inverted(F.col("ix")).alias("text"))


@query("markup_fields", r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS n_links, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs FROM pages""")
def markup_fields(s, d):
    found = lambda pattern: F.size(F.regexp_extract_all("html", F.lit(pattern), 0))
    return table(s, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), found("<a ").alias("n_links"), found("<p[ >]").alias("n_paragraphs"))


RAW_NUMBER = "CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'NULL' WHEN event_id % 4 = 2 THEN 'x1' ELSE concat(CAST(event_id AS VARCHAR(20)), '.0') END"


@query("coercions", f"""SELECT event_id, CAST(TRY_CAST(CASE WHEN t NOT IN ('', 'NULL') THEN t END AS DOUBLE) AS BIGINT) AS n, lower(CASE WHEN event_id % 2 = 0 THEN 'True' ELSE '0' END) IN ('true', 't', '1', 'yes') AS b,
  CAST(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END, false) AS INTEGER) AS as_int, [CAST(event_id AS FLOAT), CAST(0.5 AS FLOAT)] AS v FROM (SELECT event_id, {RAW_NUMBER} AS t FROM events)""")
def coercions(s, d):
    e = table(s, d, "events").select("event_id", F.expr(RAW_NUMBER).alias("t"), F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("event_id") % 2 == 0).alias("as_int"))
    e = ops.numeric(e, ["as_int"])
    return e.select(
        "event_id", texts.whole(F.col("t")).alias("n"), texts.flag(F.when(F.col("event_id") % 2 == 0, "True").otherwise("0")).alias("b"), "as_int",
        texts.vector(F.concat(F.lit("["), "event_id", F.lit(",0.5]"))).alias("v"),
    )


@query("lag_panel", f"{P} SELECT lineage, period, size, value, lag(coalesce(size, 0), 1) {W} AS size_1, lag(coalesce(size, 0), 2) {W} AS size_2, lag(coalesce(value, 0), 3) {W} AS value_3 FROM panel")
def lag_panel(s, d):
    return ops.lags(panel(s, d), {"size": [1, 2], "value": [3]})


@query("lead_targets", f"{P} SELECT lineage, period, lead(size) {W} AS size_next, lead(value) {W} AS value_next, lead(period) {W} IS NULL AS is_last FROM panel")
def lead_targets(s, d):
    return ops.leads(panel(s, d), ["size", "value"]).select("lineage", "period", "size_next", "value_next", "is_last")


def small(s, d):
    return panel(s, d).withColumn("is_dead", (F.col("size") < 3).cast("int"))


FLAG = f"{P}, f AS (SELECT *, CASE WHEN size < 3 THEN 1 ELSE 0 END AS is_dead FROM panel)"


@query("dies_within_4", f"{FLAG} SELECT lineage, period, max(is_dead) OVER (PARTITION BY lineage ORDER BY period ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS dies_within_4 FROM f")
def dies_within_4(s, d):
    return ops.dies_within(small(s, d)).select("lineage", "period", "dies_within_4")


@query("die_window_trailing", f"{FLAG} SELECT lineage, period, max(is_dead) OVER (PARTITION BY lineage ORDER BY period ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS die_window FROM f")
def die_window_trailing(s, d):
    return ops.die_window(small(s, d)).select("lineage", "period", "die_window")


@query("period_rank", f"{P} SELECT lineage, period, round(percent_rank() OVER (PARTITION BY period ORDER BY size), 6) AS size_percentile, round(percent_rank() OVER (PARTITION BY period ORDER BY value), 6) AS value_percentile FROM panel")
def period_rank(s, d):
    return ops.ranks(panel(s, d), ["size", "value"]).select("lineage", "period", *[F.round(c, 6).alias(c) for c in ("size_percentile", "value_percentile")])


@query("kinematics", f"{P}, v AS (SELECT *, size - lag(size) {W} AS velocity FROM panel), a AS (SELECT *, velocity - lag(velocity) {W} AS acceleration FROM v) SELECT lineage, period, velocity, acceleration, acceleration - lag(acceleration) {W} AS jerk FROM a")
def kinematics(s, d):
    return ops.kinematics(panel(s, d), "size").select("lineage", "period", "velocity", "acceleration", "jerk")


@query("entropy_series", f"{P}, t AS (SELECT *, size * 1.0E0 / sum(size) OVER (PARTITION BY period) AS p FROM panel) SELECT period, round(-sum(p * log2(p + 1e-12)), 6) AS entropy, count(*) AS n_clusters FROM t GROUP BY period")
def entropy_series(s, d):
    return ops.entropy_series(panel(s, d)).withColumn("entropy", F.round("entropy", 6))


@query("entropy_slope", f"""{P}, t AS (SELECT *, size * 1.0E0 / sum(size) OVER (PARTITION BY period) AS p FROM panel), e AS (SELECT period, -sum(p * log2(p + 1e-12)) AS h FROM t GROUP BY period),
  i AS (SELECT period, h, CAST(row_number() OVER (ORDER BY period) AS DOUBLE) AS k FROM e) SELECT period, CASE WHEN k > 1 THEN round(regr_slope(h, k) OVER (ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 5) END AS slope FROM i""")
def entropy_slope(s, d):
    return ops.slope_series(ops.entropy_series(panel(s, d)), "entropy").select("period", F.round("slope", 5).alias("slope"))


@query("first_last_trend", f"""{P}, i AS (SELECT *, CAST(row_number() {W} AS DOUBLE) AS k, row_number() OVER (PARTITION BY lineage ORDER BY period DESC) AS back, size - lag(size) {W} AS d FROM panel)
  SELECT lineage, min_by(size, period) AS first_size, max_by(size, period) AS last_size, max(size) - min(size) AS size_range, round(regr_slope(CAST(size AS DOUBLE), k), 5) AS trend, max(d) FILTER (WHERE back = 1) AS last_diff,
  round(avg(size) FILTER (WHERE back <= 3), 5) AS last3_mean, round(stddev_pop(size) FILTER (WHERE back <= 3), 5) AS last3_sd, min(size) FILTER (WHERE back <= 3) AS last3_min, max(size) FILTER (WHERE back <= 3) AS last3_max, count(*) AS n
  FROM i GROUP BY lineage""")
def first_last_trend(s, d):
    return ops.series_features(panel(s, d), "size").withColumns({c: F.round(c, 5) for c in ("trend", "last3_mean", "last3_sd")})


@query("terciles", f"{P}, b AS (SELECT quantile_cont(value, 0.33) AS lo, quantile_cont(value, 0.67) AS hi FROM panel) SELECT lineage, period, CASE WHEN value <= lo THEN 'low' WHEN value <= hi THEN 'mid' ELSE 'high' END AS value_level FROM panel CROSS JOIN b")
def terciles(s, d):
    return ops.terciles(panel(s, d), "value").select("lineage", "period", "value_level")


@query("chrono_split", f"{P}, k AS (SELECT *, dense_rank() OVER (ORDER BY period) AS r FROM panel), n AS (SELECT count(DISTINCT period) AS n FROM panel) SELECT lineage, period, r <= greatest(1, floor(0.8 * n)) AS is_train FROM k CROSS JOIN n")
def chrono_split(s, d):
    return ops.chrono_split(panel(s, d)).select("lineage", "period", "is_train")


@query("fresh_cutoff", f"{P}, m AS (SELECT *, max(period) OVER (PARTITION BY lineage) AS last_period FROM panel) SELECT lineage, period, size FROM m WHERE period <= CAST(last_period - INTERVAL 6 MONTH AS DATE)")
def fresh_cutoff(s, d):
    return ops.fresh_cutoff(panel(s, d)).select("lineage", "period", "size")


@query("owner_hhi", """WITH s AS (SELECT c_nationkey, c_custkey, sum(o_totalprice) AS v, count(*) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), t AS (SELECT *, v / sum(v) OVER (PARTITION BY c_nationkey) AS share FROM s)
  SELECT c_nationkey, round(sum(share * share), 6) AS hhi, round(max(share), 6) AS top_share, count(*) AS n_owners, round(count(*) / sum(m), 6) AS owner_ratio FROM t GROUP BY c_nationkey""")
def owner_hhi(s, d):
    rows = orders(s, d).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return ops.concentration(rows, "c_nationkey", "c_custkey", "o_totalprice").withColumns({c: F.round(c, 6) for c in ("hhi", "top_share", "owner_ratio")})


@query("running_state", """SELECT event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS clicks_so_far, count(*) OVER w AS seen, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seen_in_type,
  round(count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) / count(*) OVER w, 6) AS persistence FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def running_state(s, d):
    made = ops.running_state(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type", "click")
    return made.select("event_id", "clicks_so_far", "seen", "seen_in_type", F.round(F.col("seen_in_type") / F.col("seen"), 6).alias("persistence"))


@query("moments", """SELECT label, n, round(m3 / power(m2, 1.5), 5) AS skewness, round(m4 / (m2 * m2) - 3, 5) AS kurtosis, round(sqrt(m2), 6) AS sd, round(sqrt(m2) / mu, 5) AS cv
  FROM (SELECT c_nationkey AS label, count(*) AS n, any_value(mu) AS mu, avg(power(c_acctbal - mu, 2)) AS m2, avg(power(c_acctbal - mu, 3)) AS m3, avg(power(c_acctbal - mu, 4)) AS m4
  FROM (SELECT c_nationkey, c_acctbal, avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS mu FROM customer) GROUP BY c_nationkey)""")
def moments(s, d):
    m = ops.moments(table(s, d, "customer"), "c_nationkey", "c_acctbal")
    return m.select(F.col("c_nationkey").alias("label"), "n", *[F.round(c, k).alias(c) for c, k in (("skewness", 5), ("kurtosis", 5), ("sd", 6), ("cv", 5))])


@query("minmax_scale", "SELECT c_custkey, round((c_acctbal - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS scaled FROM (SELECT c_custkey, c_acctbal, min(c_acctbal) OVER (PARTITION BY c_nationkey) AS lo, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS hi FROM customer)")
def minmax_scale(s, d):
    return ops.minmax(table(s, d, "customer"), "c_acctbal", "c_nationkey").select("c_custkey", F.round("scaled", 6).alias("scaled"))


def series(s, d):
    return panel(s, d).groupBy("period").agg(F.sum("size").alias("n"), F.count("*").alias("k"))


@query("period_deltas", f"""{P}, s AS (SELECT period, CAST(sum(size) AS BIGINT) AS n FROM panel GROUP BY period), d AS (SELECT period, n, n - lag(n, 1) OVER (ORDER BY period) AS d1, n - lag(n, 2) OVER (ORDER BY period) AS d2 FROM s)
  SELECT period, n, d1, d2, round(avg(abs(d1)) OVER (ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS mean_abs FROM d""")
def period_deltas(s, d):
    return ops.period_deltas(series(s, d).select("period", "n"), "n").withColumn("mean_abs", F.round("mean_abs", 4))


@query("backtest_bounds", f"{P}, p AS (SELECT DISTINCT period FROM panel), k AS (SELECT period, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS n FROM p) SELECT period, i FROM k WHERE n >= 10 AND i > floor(n * 0.2) AND i <= n - 2")
def backtest_bounds(s, d):
    return ops.backtest_bounds(panel(s, d))


@query("novelty_z", f"{P} SELECT lineage, period, round((value - avg(value) OVER (PARTITION BY period)) / nullif(stddev_samp(value) OVER (PARTITION BY period), 0), 5) AS z FROM panel")
def novelty_z(s, d):
    return ops.z_scores(panel(s, d), "value").select("lineage", "period", F.round("z", 5).alias("z"))


@query("cluster_age", f"{P}, k AS (SELECT lineage, period, dense_rank() OVER (ORDER BY period) AS i FROM panel), g AS (SELECT *, i - row_number() {W} AS island FROM k) SELECT lineage, period, row_number() OVER (PARTITION BY lineage, island ORDER BY period) AS age FROM g")
def cluster_age(s, d):
    return ops.ages(panel(s, d)).select("lineage", "period", "age")


@query("marginal_entropy", f"""{P}, t AS (SELECT lineage, period, CAST(size AS DOUBLE) AS s, CAST(sum(size) OVER (PARTITION BY period) AS DOUBLE) AS n, sum(size * log2(size)) OVER (PARTITION BY period) AS l FROM panel)
  SELECT lineage, period, round((log2(n) - l / n) - CASE WHEN n > s THEN log2(n - s) - (l - s * log2(s)) / (n - s) ELSE 0 END, 5) AS impact FROM t""")
def marginal_entropy(s, d):
    return ops.marginal_entropy(panel(s, d)).select("lineage", "period", F.round("impact", 5).alias("impact"))


@query("recovery_time", f"""{P}, m AS (SELECT *, avg(value) OVER (PARTITION BY lineage) AS mu, row_number() {W} AS i FROM panel), s AS (SELECT lineage, period, i, value < 0.8 * mu AS shock,
  min(CASE WHEN value >= mu THEN i END) OVER (PARTITION BY lineage ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back FROM m) SELECT lineage, period, back - i AS recovery FROM s WHERE shock""")
def recovery_time(s, d):
    return ops.recovery(panel(s, d), "value").select("lineage", "period", "recovery")


@query("cross_resolution", f"""{P}, c AS (SELECT period, CAST(sum(size) AS BIGINT) AS n FROM panel GROUP BY period) SELECT c.period, c.n, y.period AS parent, y.n AS parent_n, round(c.n * 1.0E0 / y.n, 6) AS share
  FROM c JOIN (SELECT CAST(date_trunc('year', period) AS DATE) AS period, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1) y ON CAST(date_trunc('year', c.period) AS DATE) = y.period""")
def cross_resolution(s, d):
    return ops.cross_resolution(series(s, d), "n").select("period", "n", "parent", "parent_n", F.round("share", 6).alias("share"))


@query("phase_score", f"""{P}, t AS (SELECT lineage, period, size, size * 1.0E0 / sum(size) OVER (PARTITION BY period) AS p, lag(size) {W} AS before FROM panel),
  s AS (SELECT period, count(*) AS n, -sum(p * log2(p + 1e-12)) AS h, avg(CASE WHEN before IS NULL THEN 1.0E0 ELSE abs(size - before) * 1.0E0 / greatest(size, before) END) AS turnover, max(p) AS top FROM t GROUP BY period),
  d AS (SELECT *, lag(h) OVER (ORDER BY period) AS h0, lag(top) OVER (ORDER BY period) AS top0, lag(n) OVER (ORDER BY period) AS n0 FROM s)
  SELECT period, CASE WHEN h0 IS NOT NULL THEN round(0.35 * least(1.0E0, turnover) + 0.30 * least(1.0E0, abs(top - top0) / greatest(top0, 1e-9)) + 0.20 * least(1.0E0, abs(h - h0) / greatest(h0, 1e-9)) + 0.15 * least(1.0E0, abs(n - n0) * 1.0E0 / greatest(n0, 1)), 6) END AS phase_transition_score FROM d""")
def phase_score(s, d):
    return ops.phase_scores(panel(s, d)).select("period", F.round("phase_transition_score", 6).alias("phase_transition_score"))


@query("pressure_rate", f"{P} SELECT lineage, period, round(value - lag(value) {W}, 4) AS boundary_pressure_rate FROM panel")
def pressure_rate(s, d):
    return ops.pressure_rate(panel(s, d), "value").select("lineage", "period", F.round("boundary_pressure_rate", 4).alias("boundary_pressure_rate"))


@query("feature_matrix", f"""{P}, r AS (SELECT *, percent_rank() OVER (PARTITION BY period ORDER BY size) AS r FROM panel), x AS (SELECT lineage, period, size, value, lag(size, 1) {W} AS size_1, lag(size, 3) {W} AS size_3, r, lead(size) {W} AS y FROM r)
  SELECT lineage, period, size, coalesce(size_1, 0.0) AS size_1, coalesce(size_3, 1.5) AS size_3, round(size * coalesce(size_1, 0.0), 4) AS size_x_size_1, round(value / 1000 * r, 1) AS value_x_rank, y < 3 AS dies_next FROM x WHERE size >= 3 AND y IS NOT NULL""")
def feature_matrix(s, d):
    """Lags, defaults, products and the next period's outcome, of clusters of three members or more."""
    x = ops.leads(ops.lags(ops.ranks(panel(s, d), ["size"]), {"size": [1, 3]}, fill=None), ["size"])
    x = ops.imputed(x, {"size_1": 0.0, "size_3": 1.5}).filter("size >= 3 and size_next is not null")
    x = ops.interactions(x.withColumn("thousands", F.col("value") / 1000), [("size", "size_1"), ("thousands", "size_percentile")])
    return x.select(
        "lineage", "period", "size", "size_1", "size_3", F.round("size_x_size_1", 4).alias("size_x_size_1"), F.round("thousands_x_size_percentile", 1).alias("value_x_rank"),
        (F.col("size_next") < 3).alias("dies_next"),
    )
