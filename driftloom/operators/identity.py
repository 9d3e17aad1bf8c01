"""The same work across sources: seeds, cascading links by identifiers, facts filled in where they are missing.

works: work, doi, pmid, pmcid (and what passes add). Identifiers are normalised before they come here. A pass takes works
and a source and gives works again; an identifier that several rows of a source share is settled by the smallest id, so a
pass that runs twice changes nothing. Rows without an identifier don't take part in its join, or they would all meet in
one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDS = ("doi", "pmid", "pmcid")


def seed(source: DataFrame, key: str = "id") -> DataFrame:
    """One row a DOI (the smallest key wins), then one for each row without a DOI that has a PMID or PMCID."""
    first = source.filter("doi is not null").groupBy("doi").agg(F.min_by(F.struct(key, "pmid", "pmcid"), key).alias("s"))
    by_doi = first.select(F.col(f"s.{key}").alias("work"), "doi", "s.pmid", "s.pmcid")
    rest = source.filter("doi is null and coalesce(pmid, pmcid) is not null")
    return by_doi.unionByName(rest.select(F.col(key).alias("work"), "doi", "pmid", "pmcid"))


def index(works: DataFrame, key: str) -> DataFrame:
    """key, __w: the smallest work that has it."""
    return works.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("work").alias("__w"))


def link(works: DataFrame, source: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """source with work and how: the first of keys by which it is found; null for none.

    One left join a key, whose hits are told apart by the order of keys. A null key stands for a value of the row's own, which
    no work has, so that rows without the key are dealt out and not joined in one task.
    """
    out = source.withColumn("__row", F.monotonically_increasing_id().cast("string"))
    for key in keys:
        found = index(works, key).select(F.col(key).cast("string").alias("__key"), F.col("__w").alias(f"__w_{key}"))
        out = out.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), "__row"))).join(found, "__key", "left").drop("__key")
    hits = [F.col(f"__w_{key}") for key in keys]
    how = F.coalesce(*[F.when(h.isNotNull(), key) for h, key in zip(hits, keys, strict=True)])
    return out.select(*source.columns, F.coalesce(*hits).alias("work"), how.alias("how"))


def filled(works: DataFrame, facts: DataFrame, columns: list[str], on: str = "work") -> DataFrame:
    """works with each of columns (added where works lack it) from facts where it is null; facts: one row for each value of on."""
    have = set(works.columns)
    right = facts.select(on, *[F.col(c).alias(f"__{c}") for c in columns])
    with_key, without = (works, None) if on == "work" else (works.filter(F.col(on).isNotNull()), works.filter(F.col(on).isNull()))
    made = {c: F.coalesce(F.col(c), F.col(f"__{c}")) if c in have else F.col(f"__{c}") for c in columns}
    out = with_key.join(right, on, "left").withColumns(made).select(*works.columns, *[c for c in columns if c not in have])
    return out if without is None else out.unionByName(without, allowMissingColumns=True)


def add_pubmed(works: DataFrame, source: DataFrame, namespace: str = "PMID") -> DataFrame:
    """PMIDs to works of the same DOI that have none; then a new work for each PMID that no work has."""
    by_doi = source.filter("doi is not null").groupBy("doi").agg(F.min("pmid").alias("pmid"))
    now = filled(works, by_doi, ["pmid"], "doi")
    known = now.filter("pmid is not null").select("pmid").distinct()
    new = source.groupBy("pmid").agg(F.min("doi").alias("doi")).join(known, "pmid", "left_anti")
    return now.unionByName(new.select(F.concat(F.lit(f"{namespace}:"), "pmid").alias("work"), "doi", "pmid"), allowMissingColumns=True)


def add_linked(works: DataFrame, links: DataFrame, own: str, namespace: str) -> DataFrame:
    """works with the identifiers of linked rows where they are missing, and a work for each row that is linked with none."""
    ids = [c for c in IDS if c in links.columns]
    extra = [] if own in ids else [own]
    facts = links.filter("work is not null").groupBy("work").agg(*[F.min(c).alias(c) for c in [*ids, *extra]])
    now = filled(works, facts, [*ids, *extra])
    new = links.filter("work is null").select(F.concat(F.lit(f"{namespace}:"), own).alias("work"), *ids, *extra)
    return now.unionByName(new, allowMissingColumns=True)


def counted(works: DataFrame, links: list[DataFrame], base: Column | int = 1) -> DataFrame:
    """works with source_count: base and the sources with a linked row, recounted from the links, so that a second run gives the same."""
    every = None
    for i, own in enumerate(links):
        one = own.filter("work is not null").select("work", F.lit(i).alias("source")).distinct()
        every = one if every is None else every.union(one)
    n = every.groupBy("work").agg(F.count("*").alias("__n"))
    return works.join(n, "work", "left").withColumn("source_count", F.lit(base) + F.coalesce("__n", F.lit(0))).drop("__n")


def sections(parts: DataFrame, key: str, text: str = "text", order: str = "sequence", out: str = "abstract") -> DataFrame:
    """key, out: the parts in order with a blank line between."""
    g = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t")))).alias("s"))
    return g.select(key, F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias(out))


def terms(rows: DataFrame, key: str, term: str, out: str = "terms") -> DataFrame:
    """key, out: its distinct terms in order."""
    return rows.filter(F.col(term).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(term)).alias(out))


def year_of(*dates: Column) -> Column:
    """Of the first date that is one."""
    return F.year(F.coalesce(*[d.try_cast("date") for d in dates]))


def flagged(works: DataFrame, full: DataFrame, on: str, out: str = "has_fulltext") -> DataFrame:
    """works with whether full (a table of texts) has their identifier."""
    have = full.select(on).filter(F.col(on).isNotNull()).distinct().withColumn("__has", F.lit(True))
    own = works.filter(F.col(on).isNotNull()).join(have, on, "left").withColumn(out, F.coalesce("__has", F.lit(False)))
    rest = works.filter(F.col(on).isNull()).withColumn(out, F.lit(False))
    return own.select(*works.columns, out).unionByName(rest.select(*works.columns, out))


def coverage(works: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, and for each column how many works have it."""
    return works.agg(F.count("*").alias("n"), *[F.count(c).alias(f"with_{c}") for c in columns])


def run_pass(spark: SparkSession, folder: str, name: str, f: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The stored result of a pass and whether it was worked out now; a pass that has ended is read, one that broke off runs again."""
    path = f"{folder.rstrip('/')}/{name}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fresh = not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
    if fresh:
        f().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), fresh
