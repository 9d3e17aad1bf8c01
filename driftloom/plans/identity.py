"""Works of five sources, made of the customers: each source knows some of them, by some of their identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftloom.functions import texts
from driftloom.operators import identity as ops
from driftloom.plans.core import query, table
from driftloom.storage import shared_folder, stored

K = "CAST(c_custkey AS VARCHAR)"
D = "lower('10.1/' || c_name)"
SOURCES = f"""oa AS (SELECT 'W' || lpad({K}, 7, '0') AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {D} END AS doi, CASE WHEN c_custkey % 3 = 0 THEN {K} END AS pmid, CASE WHEN c_custkey % 14 = 0 THEN 'PMC' || {K} END AS pmcid,
    'title ' || {K} AS title, 1990 + c_custkey % 30 AS year FROM customer WHERE c_custkey % 2 = 0),
  pm AS (SELECT {K} AS pmid, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {D} END AS doi, c_mktsegment AS journal FROM customer WHERE c_custkey % 3 = 0),
  s2 AS (SELECT 'S' || {K} AS s2_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {D} END AS doi, CASE WHEN c_custkey % 3 = 0 THEN {K} END AS pmid, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS journal_name, 'venue' AS venue FROM customer WHERE c_custkey % 11 < 4),
  ep AS (SELECT 'PMC' || {K} AS pmcid, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {D} END AS doi, CASE WHEN c_custkey % 6 = 0 THEN {K} END AS pmid FROM customer WHERE c_custkey % 5 = 0),
  cr AS (SELECT {D} AS doi, 'publisher ' || (c_custkey % 9) AS publisher, CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE '2001-02-03' END AS issued, '2003-01-01' AS online FROM customer WHERE c_custkey % 3 <> 1)"""
BY = "SELECT {k}, min(work) AS w FROM {t} WHERE {k} IS NOT NULL GROUP BY 1"


def link_sql(name: str, source: str, works: str, keys: list[str]) -> str:
    """The first key that finds a work."""
    joins = " ".join(f"LEFT JOIN ({BY.format(k=k, t=works)}) {k}_ ON {k}_.{k} = s.{k}" for k in keys)
    how = " ".join(f"WHEN {k}_.w IS NOT NULL THEN '{k}'" for k in keys)
    return f"{name} AS (SELECT s.*, coalesce({', '.join(f'{k}_.w' for k in keys)}) AS work, CASE {how} END AS how FROM {source} s {joins})"


CHAIN = f"""WITH {SOURCES},
  w1 AS (SELECT min(id) AS work, doi, arg_min(pmid, id) AS pmid0, min(id) AS i FROM oa WHERE doi IS NOT NULL GROUP BY doi),
  w2 AS (SELECT oa.id AS work, oa.doi, oa.pmid, oa.pmcid FROM oa JOIN w1 ON oa.id = w1.i UNION ALL SELECT id, doi, pmid, pmcid FROM oa WHERE doi IS NULL AND coalesce(pmid, pmcid) IS NOT NULL),
  pd AS (SELECT doi, min(pmid) AS p FROM pm WHERE doi IS NOT NULL GROUP BY doi), w3a AS (SELECT work, w2.doi, coalesce(pmid, p) AS pmid, pmcid FROM w2 LEFT JOIN pd ON w2.doi = pd.doi),
  w3 AS (SELECT * FROM w3a UNION ALL SELECT 'PMID:' || pmid, min(doi), pmid, NULL FROM pm WHERE pmid NOT IN (SELECT pmid FROM w3a WHERE pmid IS NOT NULL) GROUP BY pmid),
  {link_sql('l4', 's2', 'w3', ['doi', 'pmid'])},
  f4 AS (SELECT work, min(doi) AS d, min(pmid) AS p, min(s2_id) AS s2_id FROM l4 WHERE work IS NOT NULL GROUP BY work),
  w4 AS (SELECT w3.work, coalesce(doi, d) AS doi, coalesce(pmid, p) AS pmid, pmcid, s2_id FROM w3 LEFT JOIN f4 ON w3.work = f4.work UNION ALL SELECT 'S2:' || s2_id, doi, pmid, NULL, s2_id FROM l4 WHERE work IS NULL),
  {link_sql('l5', 'ep', 'w4', ['doi', 'pmid', 'pmcid'])},
  f5 AS (SELECT work, min(doi) AS d, min(pmid) AS p, min(pmcid) AS c FROM l5 WHERE work IS NOT NULL GROUP BY work),
  w5 AS (SELECT w4.work, coalesce(doi, d) AS doi, coalesce(pmid, p) AS pmid, coalesce(pmcid, c) AS pmcid, s2_id FROM w4 LEFT JOIN f5 ON w4.work = f5.work UNION ALL SELECT 'PMC:' || pmcid, doi, pmid, pmcid, NULL FROM l5 WHERE work IS NULL),
  {link_sql('l6', 'cr', 'w5', ['doi'])}, {link_sql('l3', 'pm', 'w5', ['doi', 'pmid'])}"""


def sources(s, d):
    c = table(s, d, "customer")
    key, n = F.col("c_custkey").cast("string"), F.col("c_custkey")
    doi = texts.doi(F.concat(F.lit(" 10.1/"), F.upper("c_name")))
    none = F.lit(None).cast("string")
    oa = c.filter(n % 2 == 0).select(
        F.concat(F.lit("W"), F.lpad(key, 7, "0")).alias("id"), F.when(n % 7 != 0, doi).alias("doi"), F.when(n % 3 == 0, key).alias("pmid"),
        F.when(n % 14 == 0, texts.pmcid(F.concat(F.lit("pmc"), key))).alias("pmcid"), F.concat(F.lit("title "), key).alias("title"), (1990 + n % 30).alias("year"),
    )
    pm = c.filter(n % 3 == 0).select(key.alias("pmid"), F.when(n % 5 != 0, doi).alias("doi"), F.col("c_mktsegment").alias("journal"))
    s2 = c.filter(n % 11 < 4).select(
        F.concat(F.lit("S"), key).alias("s2_id"), F.when(n % 4 != 0, doi).alias("doi"), F.when(n % 3 == 0, key).alias("pmid"), F.when(n % 2 == 0, F.col("c_mktsegment")).otherwise(none).alias("journal_name"), F.lit("venue").alias("venue")
    )
    ep = c.filter(n % 5 == 0).select(F.concat(F.lit("PMC"), key).alias("pmcid"), F.when(n % 4 != 0, doi).alias("doi"), F.when(n % 6 == 0, key).alias("pmid"))
    cr = c.filter(n % 3 != 1).select(doi.alias("doi"), F.concat(F.lit("publisher "), n % 9).alias("publisher"), F.when(n % 3 == 0, "none").otherwise("2001-02-03").alias("issued"), F.lit("2003-01-01").alias("online"))
    return oa, pm, s2, ep, cr


def after_pubmed(s, d):
    oa, pm, *_ = sources(s, d)
    return ops.add_pubmed(ops.seed(oa), pm)


def after_s2(s, d):
    works = stored(after_pubmed(s, d))
    links = ops.link(works, sources(s, d)[2], ("doi", "pmid"))
    return stored(ops.add_linked(works, links, "s2_id", "S2")), links


def after_epmc(s, d):
    works, links = after_s2(s, d)
    own = stored(ops.link(works, sources(s, d)[3], ("doi", "pmid", "pmcid")))
    return stored(ops.add_linked(works, own, "pmcid", "PMC")), links, own


@query("identity_seed", f"{CHAIN} SELECT work, doi, pmid, pmcid FROM w2")
def identity_seed(s, d):
    return ops.seed(sources(s, d)[0])


@query("identity_pubmed", f"{CHAIN} SELECT work, doi, pmid, pmcid FROM w3")
def identity_pubmed(s, d):
    return after_pubmed(s, d)


@query("identity_scholar", f"{CHAIN} SELECT s2_id, work, how FROM l4")
def identity_scholar(s, d):
    return after_s2(s, d)[1].select("s2_id", "work", "how")


@query("identity_link", f"{CHAIN} SELECT pmcid, work, how FROM l5")
def identity_link(s, d):
    return after_epmc(s, d)[2].select("pmcid", "work", "how")


@query("identity_works", f"{CHAIN} SELECT work, doi, pmid, pmcid, s2_id FROM w5")
def identity_works(s, d):
    return after_epmc(s, d)[0].select("work", "doi", "pmid", "pmcid", "s2_id")


COUNTS = " UNION ALL ".join(f"SELECT DISTINCT work, {i} AS k FROM {t} WHERE work IS NOT NULL" for i, t in enumerate(("l3", "l4", "l5", "l6")))


@query("identity_source_count", f"{CHAIN} SELECT w5.work, CAST(1 + count(k) AS BIGINT) AS source_count FROM w5 LEFT JOIN ({COUNTS}) c ON c.work = w5.work GROUP BY w5.work")
def identity_source_count(s, d):
    _, pm, _, _, cr = sources(s, d)
    works, l4, l5 = after_epmc(s, d)
    return ops.counted(works, [ops.link(works, pm, ("doi", "pmid")), l4, l5, ops.link(works, cr, ("doi",))]).select("work", F.col("source_count").cast("long").alias("source_count"))


SECTIONS = "SELECT CAST(c_custkey AS VARCHAR) AS pmid, k AS sequence, 'part ' || k || ' of ' || c_name AS text, CASE WHEN k = 2 THEN NULL ELSE 'term ' || (c_custkey * k % 5) END AS term FROM customer, (SELECT unnest(range(3)) AS k) WHERE c_custkey % 3 = 0"
FACTS = f"""sec AS ({SECTIONS}), ab AS (SELECT pmid, string_agg(text, chr(10) || chr(10) ORDER BY sequence) AS abstract FROM sec GROUP BY 1), ms AS (SELECT pmid, list_sort(list(DISTINCT term) FILTER (WHERE term IS NOT NULL)) AS terms FROM sec GROUP BY 1),
  jr AS (SELECT pmid, min(journal) AS journal FROM pm GROUP BY 1), oaf AS (SELECT id, title, year FROM oa), sf AS (SELECT s2_id, coalesce(journal_name, venue) AS j2 FROM s2),
  cf AS (SELECT doi, min(publisher) AS publisher, min(CAST(year(coalesce(TRY_CAST(issued AS DATE), TRY_CAST(online AS DATE))) AS INTEGER)) AS cyear FROM cr GROUP BY 1)"""
ENRICH = f"""{CHAIN}, {FACTS}, rich AS (SELECT w5.*, title, coalesce(CAST(oaf.year AS INTEGER), cyear) AS year, abstract, terms, coalesce(journal, j2) AS journal, publisher,
  EXISTS (SELECT 1 FROM ep WHERE ep.pmcid = w5.pmcid) AS has_fulltext FROM w5 LEFT JOIN oaf ON oaf.id = w5.work LEFT JOIN ab ON ab.pmid = w5.pmid LEFT JOIN ms ON ms.pmid = w5.pmid LEFT JOIN jr ON jr.pmid = w5.pmid LEFT JOIN sf ON sf.s2_id = w5.s2_id LEFT JOIN cf ON cf.doi = w5.doi)"""
FILLED = ["title", "year", "abstract", "journal", "publisher"]


def section_rows(s, d):
    c = table(s, d, "customer").filter("c_custkey % 3 = 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    text = F.concat(F.lit("part "), "k", F.lit(" of "), "c_name")
    return c.select(F.col("c_custkey").cast("string").alias("pmid"), F.col("k").alias("sequence"), text.alias("text"), F.when(F.col("k") != 2, F.concat(F.lit("term "), F.col("c_custkey") * F.col("k") % 5)).alias("term"))


def enriched(s, d):
    oa, pm, s2, ep, cr = sources(s, d)
    works, parts = after_epmc(s, d)[0], section_rows(s, d)
    works = ops.filled(works, oa.select(F.col("id").alias("work"), "title", F.col("year").cast("int").alias("year")), ["title", "year"])
    works = ops.filled(works, ops.sections(parts, "pmid"), ["abstract"], "pmid")
    works = ops.filled(works, ops.terms(parts, "pmid", "term"), ["terms"], "pmid")
    works = stored(ops.filled(works, pm.groupBy("pmid").agg(F.min("journal").alias("journal")), ["journal"], "pmid"))
    works = ops.filled(works, s2.select("s2_id", F.coalesce("journal_name", "venue").alias("journal")), ["journal"], "s2_id")
    facts = cr.groupBy("doi").agg(F.min("publisher").alias("publisher"), F.min(ops.year_of(F.col("issued"), F.col("online"))).alias("year"))
    works = stored(ops.filled(works, facts, ["publisher", "year"], "doi"))
    return ops.flagged(works, ep, "pmcid")


@query("identity_enrich", f"{ENRICH} SELECT work, doi, pmid, pmcid, title, year, abstract, array_to_string(terms, ';') AS terms, journal, publisher, has_fulltext FROM rich")
def identity_enrich(s, d):
    return enriched(s, d).select("work", "doi", "pmid", "pmcid", "title", "year", "abstract", F.array_join("terms", ";").alias("terms"), "journal", "publisher", "has_fulltext")


COVERED = ["doi", "pmid", "pmcid", "s2_id", "title", "year", "abstract", "journal", "publisher"]


@query("identity_coverage", f"{ENRICH} SELECT count(*) AS n, {', '.join(f'count({c}) AS with_{c}' for c in COVERED)} FROM rich")
def identity_coverage(s, d):
    return ops.coverage(enriched(s, d), COVERED)


@query("identity_resumed", f"{CHAIN} SELECT 'seed' AS pass, count(*) AS n, 1 AS runs FROM w2 UNION ALL SELECT 'pubmed', count(*), 1 FROM w3")
def identity_resumed(s, d):
    """Two passes, each asked for twice: the second time they are read."""
    oa, pm, *_ = sources(s, d)
    folder, rows = f"{shared_folder(s).rstrip('/')}/passes-{uuid.uuid4().hex}", []
    for _ in range(2):
        one, first = ops.run_pass(s, folder, "seed", lambda: ops.seed(oa))
        two, second = ops.run_pass(s, folder, "pubmed", lambda one=one: ops.add_pubmed(one, pm))
        rows.append((first, second))
    runs = [sum(x) for x in zip(*rows, strict=True)]
    made = [t.agg(F.lit(n).alias("pass"), F.count("*").alias("n"), F.lit(r).alias("runs")) for t, n, r in zip((one, two), ("seed", "pubmed"), runs, strict=True)]
    return made[0].union(made[1]).select("pass", "n", "runs")


@query("ordered_sections", "SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, coalesce(text, '')) AS body FROM conversations GROUP BY conv_id")
def ordered_sections(s, d):
    return ops.sections(table(s, d, "conversations"), "conv_id", order="turn", out="body")
