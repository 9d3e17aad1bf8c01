"""Scans, picks, increments, caches and progress over the generated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import records as ops
from driftloom.plans.core import query, table
from driftloom.plans.observed import OBS, observed


@query("code_index", """WITH r AS (SELECT l_orderkey AS id, p_type AS code, min(l_linenumber) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type LIKE 'S%' OR p_type LIKE 'PRO%' GROUP BY 1, 2)
  SELECT id, string_agg(code, ';' ORDER BY k, code) AS codes FROM r GROUP BY id""")
def code_index(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    made = ops.code_index(rows.select(F.col("l_orderkey").alias("id"), F.col("p_type").alias("code"), F.col("l_linenumber").alias("k")), ["S", "PRO"], "id", "code", "k")
    return made.select("id", F.array_join("codes", ";").alias("codes"))


FILED = "CASE WHEN l_linenumber = 1 THEN '9176-06-01' WHEN l_linenumber = 2 AND l_orderkey % 3 = 0 THEN 'soon' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)) END"


@query("filing_dates", f"""SELECT l_orderkey, min(x) AS filing_date FROM (SELECT l_orderkey, TRY_CAST({FILED} AS DATE) AS x FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
  WHERE year(x) BETWEEN 1800 AND 2030 GROUP BY 1""")
def filing_dates(s, d):
    ids = table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ops.filing_dates(table(s, d, "lineitem").select("l_orderkey", F.expr(FILED).alias("day")), ids, "l_orderkey", "day")


META = "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'design' ELSE 'utility' END AS patent_type, CASE WHEN o_orderstatus = 'P' THEN '1' WHEN o_orderstatus = 'O' THEN '0' END AS withdrawn, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS patent_date FROM {orders}"


def meta(s, d):
    return s.sql(META, orders=table(s, d, "orders"))


DUCK_META = META.replace("{orders}", "orders")
GUARD = "patent_type = 'utility' AND coalesce(withdrawn, '0') <> '1'"


@query("patent_metadata", f"SELECT o_orderkey, patent_date FROM ({DUCK_META}) WHERE {GUARD} AND year(CAST(patent_date AS DATE)) BETWEEN 1996 AND 1999")
def patent_metadata(s, d):
    return ops.metadata(meta(s, d), 1996, 1999).select("o_orderkey", "patent_date")


@query("patent_skipped", f"""SELECT count(*) FILTER (WHERE patent_type <> 'utility') AS n_kind, count(*) FILTER (WHERE patent_type = 'utility' AND coalesce(withdrawn, '0') = '1') AS n_withdrawn,
  count(*) FILTER (WHERE {GUARD} AND NOT ok) AS n_date, count(*) FILTER (WHERE {GUARD} AND ok) AS n_kept FROM (SELECT *, year(CAST(patent_date AS DATE)) BETWEEN 1996 AND 1999 AS ok FROM ({DUCK_META}))""")
def patent_skipped(s, d):
    return ops.skipped(meta(s, d), 1996, 1999)


@query("merged_codes", "SELECT l_orderkey, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS codes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def merged_codes(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    parts = rows.groupBy("l_orderkey", "l_returnflag").agg(F.collect_set("p_brand").alias("codes"))
    return ops.merged_codes(parts, "l_orderkey").select("l_orderkey", F.array_join("codes", ";").alias("codes"))


@query("parties", """SELECT l_orderkey AS doc_id, l_returnflag AS sequence, data_format, name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY data_format <> 'docdb', data_format, name) AS k FROM
  (SELECT l_orderkey, l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'docdb' ELSE 'original' END AS data_format, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)) WHERE k = 1""")
def parties(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    form = F.when(F.col("l_linestatus") == "O", "docdb").otherwise("original")
    return ops.parties(rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("sequence"), form.alias("data_format"), F.col("s_name").alias("name")))


@query("citations", """SELECT doc_id, 'patent' AS kind, CAST(doc_id + 1 AS VARCHAR) AS cited FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'text', left(text, 4000) FROM documents WHERE doc_id % 3 <> 0 AND nullif(trim(text), '') IS NOT NULL""")
def citations(s, d):
    rows = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") + 1).cast("string")).otherwise("").alias("cited_patent"), F.col("text").alias("npl_text"))
    patents, others = ops.citations(rows)
    return patents.select("doc_id", F.lit("patent").alias("kind"), F.col("cited_patent").alias("cited")).union(others.select("doc_id", F.lit("text"), "npl_text"))


@query("english_first", """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'en' ELSE 'de' END AS lang, text FROM conversations WHERE nullif(trim(text), '') IS NOT NULL)
  SELECT conv_id, coalesce(arg_min(text, (turn, text)) FILTER (WHERE lang = 'en'), arg_min(text, (turn, text))) AS title FROM c GROUP BY conv_id""")
def english_first(s, d):
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"))
    parts = F.transform("a", lambda x: F.struct(F.when(x["turn"] % 2 == 1, "en").otherwise("de").alias("lang"), x["text"].alias("text")))
    return c.select("conv_id", ops.english_first(parts).alias("title")).filter("title is not null")


@query("cpc_symbols", "SELECT l_orderkey, string_agg(code, ';' ORDER BY k, code) AS codes FROM (SELECT l_orderkey, 'H01L' || (p_size % 5) || '/' || (p_size % 3) AS code, min(l_linenumber) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1")
def cpc_symbols(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    one = F.struct(F.col("l_linenumber"), F.lit("H").alias("section"), F.lit("01").alias("class"), F.lit("L").alias("subclass"), (F.col("p_size") % 5).alias("group"), (F.col("p_size") % 3).alias("subgroup"))
    g = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("a"))
    return g.select("l_orderkey", F.array_join(ops.cpc_codes(F.col("a")), ";").alias("codes"))


@query("availability_date", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE) END) AS d FROM orders""")
def availability_date(s, d):
    document = F.when(F.col("o_orderkey") % 3 == 0, "2020").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    direct = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(F.date_add("o_orderdate", 1), "yyyyMMdd"))
    return table(s, d, "orders").select("o_orderkey", ops.availability(document, direct).alias("d"))


def marks(s, d):
    return table(s, d, "events").filter("event_id % 2 = 0 and user_id % 7 <> 0").groupBy("user_id").agg(F.max("ts").alias("mark"))


MARKS = "m AS (SELECT user_id, max(ts) AS mark FROM events WHERE event_id % 2 = 0 AND user_id % 7 <> 0 GROUP BY user_id)"


@query("new_counts", f"WITH {MARKS} SELECT user_id, count(*) AS n_new FROM events LEFT JOIN m USING (user_id) WHERE ts > coalesce(mark, TIMESTAMP '2024-01-10') GROUP BY user_id")
def new_counts(s, d):
    return ops.new_counts(table(s, d, "events"), marks(s, d), "user_id", "ts", "2024-01-10")


@query("stale_sources", f"""WITH {MARKS}, n AS (SELECT user_id, count(*) AS n_new FROM events LEFT JOIN m USING (user_id) WHERE ts > coalesce(mark, TIMESTAMP '2024-01-10') GROUP BY user_id)
  SELECT u.user_id, coalesce(n_new, 0) AS n_new, CASE WHEN n_new IS NULL THEN 'fetch' ELSE 'local' END AS via FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN n USING (user_id)""")
def stale_sources(s, d):
    """Keys whose stored rows bring nothing new are asked for elsewhere."""
    users = table(s, d, "events").select("user_id").distinct()
    got = users.join(ops.new_counts(table(s, d, "events"), marks(s, d), "user_id", "ts", "2024-01-10"), "user_id", "left")
    return got.select("user_id", F.coalesce("n_new", F.lit(0)).alias("n_new"), F.when(F.col("n_new").isNull(), "fetch").otherwise("local").alias("via"))


@query("prefix_counts", "WITH p AS (SELECT DISTINCT substr(p_type, 1, 3) AS prefix FROM part UNION SELECT DISTINCT substr(p_type, 1, 1) FROM part) SELECT prefix, count(*) AS n FROM p JOIN part ON starts_with(p_type, prefix) GROUP BY prefix")
def prefix_counts(s, d):
    part = table(s, d, "part")
    p = part.select(F.substring("p_type", 1, 3).alias("prefix")).union(part.select(F.substring("p_type", 1, 1))).distinct()
    return ops.prefix_counts(part, p, "p_type")


@query("query_text", "SELECT c_mktsegment, string_agg('cpc=' || n || '*', ' or ' ORDER BY n) AS q FROM (SELECT DISTINCT c_mktsegment, c_nationkey AS n FROM customer) GROUP BY 1")
def query_text(s, d):
    g = table(s, d, "customer").groupBy("c_mktsegment").agg(F.array_sort(F.collect_set("c_nationkey")).cast("array<string>").alias("p"))
    return g.select("c_mktsegment", ops.query_text(F.col("p")).alias("q"))


INCOMING = "SELECT doc_id // 2 AS id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS text, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE source END AS source FROM documents"


def incoming(s, d):
    doc = F.col("doc_id")
    return table(s, d, "documents").select(F.floor(doc / 2).alias("id"), F.when(doc % 4 == 0, "").otherwise(F.col("text")).alias("text"), F.when(doc % 8 != 0, F.col("source")).alias("source"))


@query("insertable", f"""SELECT id, source, n FROM (SELECT id, source, length(text) AS n, row_number() OVER (PARTITION BY id ORDER BY text NULLS FIRST, source NULLS FIRST) AS k FROM ({INCOMING})
  WHERE coalesce(nullif(trim(text), ''), nullif(trim(source), '')) IS NOT NULL AND id NOT IN (SELECT doc_id FROM labels)) WHERE k = 1""")
def insertable(s, d):
    made = ops.insertable(incoming(s, d), table(s, d, "labels").select(F.col("doc_id").alias("id")), "id", "text", "source")
    return made.select("id", "source", F.length("text").alias("n"))


@query("backfilled", f"WITH r AS ({INCOMING}), f AS (SELECT id, min(text) AS v FROM r WHERE nullif(trim(text), '') IS NOT NULL GROUP BY id) SELECT id, length(coalesce(nullif(trim(text), ''), v)) AS n FROM r LEFT JOIN f USING (id)")
def backfilled(s, d):
    rows = incoming(s, d)
    return ops.backfilled(rows, rows, "id", "text").select("id", F.length("text").alias("n"))


@query("read_through", "SELECT 'hit' AS what, count(*) AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT 'fetch', count(*) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 = 0) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def read_through(s, d):
    hit, fetch = ops.read_through(table(s, d, "documents").filter("doc_id % 3 = 0"), table(s, d, "labels"), "doc_id")
    return hit.agg(F.lit("hit").alias("what"), F.count("*").alias("n")).union(fetch.agg(F.lit("fetch"), F.count("*")))


@query("store_merge", "SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, -1 FROM embeddings WHERE vec_id % 3 = 0")
def store_merge(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label")
    return ops.appended(e.filter("vec_id % 3 <> 0"), e.withColumn("label", F.lit(-1)), "vec_id")


STATES = "CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'error' END"


@query("progress_states", f"""WITH o AS (SELECT o_orderkey AS name, {STATES} AS s, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS n, CASE WHEN o_orderstatus = 'P' THEN 'failed' END AS e FROM orders WHERE o_orderkey % 5 <> 0),
  x AS (SELECT o_orderkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'error' END AS s, CASE WHEN o_orderkey % 4 = 0 THEN 1 END AS n, CASE WHEN o_orderkey % 2 = 1 THEN 'again' END AS e FROM orders WHERE o_orderkey % 3 = 1)
  SELECT coalesce(o.name, x.name) AS name, CASE WHEN o.s = 'done' THEN 'done' ELSE coalesce(x.s, o.s) END AS status, coalesce(x.n, o.n) AS n_done, CASE WHEN coalesce(x.s, o.s) = 'done' THEN NULL ELSE coalesce(x.e, o.e) END AS error FROM o FULL JOIN x ON o.name = x.name""")
def progress_states(s, d):
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    old = o.filter(k % 5 != 0).select(k.alias("name"), F.expr(STATES).alias("status"), F.when(k % 3 != 0, F.col("o_custkey")).alias("n_done"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error"))
    new = o.filter(k % 3 == 1).select(k.alias("name"), F.when(k % 2 == 0, "done").otherwise("error").alias("status"), F.when(k % 4 == 0, 1).alias("n_done"), F.when(k % 2 == 1, "again").alias("error"))
    return ops.progress(old, new)


@query("run_lookup", """WITH n AS (SELECT source AS corpus, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), c AS (SELECT 'src' || k AS corpus, 10 + k AS k FROM (SELECT unnest(range(5)) AS k))
  SELECT n.corpus, n, CASE WHEN c.corpus IS NOT NULL THEN c.k WHEN regexp_matches(n.corpus, '^src1[0-9]$') THEN 16 END AS k, c.corpus IS NULL AND regexp_matches(n.corpus, '^src1[0-9]$') AS derived FROM n LEFT JOIN c ON c.corpus = n.corpus""")
def run_lookup(s, d):
    names = table(s, d, "documents").filter("source is not null").groupBy(F.col("source").alias("corpus")).agg(F.count("*").alias("n"))
    configs = s.range(5).select(F.concat(F.lit("src"), "id").alias("corpus"), (F.col("id") + 10).alias("k"))
    return ops.configured(names, configs, "^src1[0-9]$", {"k": 16})


@query("latest_context", f"WITH {OBS} SELECT chunk, c, period FROM obs WHERE period = (SELECT max(period) FROM obs)")
def latest_context(s, d):
    return ops.latest(observed(s, d)).select("chunk", "c", "period")


@query("patched_lifecycle", f"""WITH {OBS}, p AS (SELECT period, c, count(*) AS n, NULL::BIGINT AS n_before FROM obs GROUP BY 1, 2), f AS (SELECT period + 1 AS period, c, n AS n_before FROM p)
  SELECT p.period, p.c, p.n, f.n_before FROM p LEFT JOIN f ON f.period = p.period AND f.c = p.c""")
def patched_lifecycle(s, d):
    p = observed(s, d).groupBy("period", "c").agg(F.count("*").alias("n"))
    found = p.select((F.col("period") + 1).alias("period"), "c", F.col("n").alias("n_before"))
    return ops.patched(p.withColumn("n_before", F.lit(None).cast("long")), found, ["period", "c"], ["n_before"])


OFFER = "(o_custkey / (1 + o_orderkey % 50) / 3600 + 0.65) * o_totalprice"


@query("cheapest_offer", f"SELECT o_orderpriority, arg_min(o_orderkey, ({OFFER}, o_orderkey)) AS offer, round(min({OFFER}), 4) AS cost FROM orders GROUP BY 1")
def cheapest_offer(s, d):
    o = table(s, d, "orders").withColumn("offer", F.col("o_orderkey"))
    made = ops.offers(o, F.col("o_custkey"), 1 + F.col("o_orderkey") % 50, F.col("o_totalprice"), "o_orderpriority")
    return made.withColumn("cost", F.round("cost", 4))


@query("runtime_minutes", "SELECT source, round(greatest(10.0, count(*) * 1000 / 2900.0), 4) AS minutes FROM documents GROUP BY source")
def runtime_minutes(s, d):
    g = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.select("source", F.round(ops.runtime_minutes(F.col("n") * 1000), 4).alias("minutes"))


@query("corpora_by_size", "SELECT source, count(*) AS n, count(*) FILTER (WHERE nullif(trim(text), '') IS NOT NULL) AS n_full, coalesce(bool_or(lang = 'en'), false) AS has_english, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY source")
def corpora_by_size(s, d):
    from pyspark.sql.window import Window

    full = F.nullif(F.trim("text"), F.lit("")).isNotNull()
    g = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(full).alias("n_full"), F.coalesce(F.bool_or(F.col("lang") == "en"), F.lit(False)).alias("has_english"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.col("source").asc_nulls_last())))


CAP = 180


@query("search_windows", f"""WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
  r AS (SELECT *, sum(n) OVER (PARTITION BY date_trunc('quarter', day)) AS nq, sum(n) OVER (PARTITION BY date_trunc('month', day)) AS nm FROM c),
  k AS (SELECT n, CASE WHEN nq < {CAP} THEN 'quarterly' WHEN nm < {CAP} THEN 'monthly' ELSE 'weekly' END AS resolution, CAST(CASE WHEN nq < {CAP} THEN date_trunc('quarter', day) WHEN nm < {CAP} THEN date_trunc('month', day) ELSE greatest(date_trunc('week', day), date_trunc('month', day)) END AS DATE) AS s FROM r)
  SELECT resolution, s AS window_start, CASE resolution WHEN 'quarterly' THEN last_day(CAST(s + INTERVAL 2 MONTH AS DATE)) WHEN 'monthly' THEN last_day(s) ELSE least(CAST(date_trunc('week', s) + INTERVAL 6 DAY AS DATE), last_day(s)) END AS window_end, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1, 2""")
def search_windows(s, d):
    from driftloom.sources.exports import search_windows as windows

    o = table(s, d, "orders")
    return windows(o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n")), CAP)


@query("copy_lines", r"""SELECT doc_id, doc_id || chr(9) || coalesce(replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r'), '\N') || chr(9) || coalesce(lang, '\N') AS value FROM documents""")
def copy_lines(s, d):
    from driftloom.sources.exports import escaped

    docs = table(s, d, "documents")
    return docs.select("doc_id", F.concat_ws("\t", *[escaped(F.col(c)) for c in ("doc_id", "text", "lang")]).alias("value"))




@query("xml_children", "SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_linenumber AS sequence, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def xml_children(s, d):
    """Orders written as XML and read back: one child row a line."""
    from driftloom.sources import records as xml

    j = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    line = F.concat(F.lit('<party sequence="'), "l_linenumber", F.lit('"><name>'), "s_name", F.lit("</name></party>"))
    docs = j.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("x"))
    text = F.concat(F.lit('<e:doc doc-id="'), "l_orderkey", F.lit('"><title>x &unknown; y</title>'), "x", F.lit("</e:doc>"))

    def extract(e):
        return {"doc_id": e.get("doc-id"), "parties": [{"sequence": int(p.get("sequence")), "name": xml.said(xml.first(p, "name"))} for p in xml.find_all(e, "party")]}

    rows = xml.parsed(docs.select(text.alias("record")), extract, "doc_id string, parties array<struct<sequence:int,name:string>>")
    return xml.tables(rows, "doc_id")["parties"]
