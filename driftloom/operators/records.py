"""Records of documents: scans with guards, picks among languages and formats, increments, caches, backfills and progress."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions import periods, texts


def starts_with(code: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(code, F.lit(p))
    return out


def code_index(rows: DataFrame, prefixes: list[str], key: str = "patent_id", code: str = "code", order: str = "sequence") -> DataFrame:
    """key, codes: of records with a code under one of the prefixes, those codes, distinct, as first seen."""
    first = rows.filter(starts_with(F.col(code), prefixes)).groupBy(key, code).agg(F.min(order).alias("at"))
    g = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", code))).alias("s"))
    return g.select(key, F.transform("s", lambda x: x[code]).alias("codes"))


def filing_dates(rows: DataFrame, ids: DataFrame, key: str = "patent_id", day: str = "filing_date", low: int = 1800, high: int = 2030) -> DataFrame:
    """key, filing_date: the earliest valid one of the records in ids."""
    good = rows.join(ids.select(key).distinct(), key, "left_semi").withColumn("__d", periods.valid_date(F.col(day), low, high)).filter("__d is not null")
    return good.groupBy(key).agg(F.min("__d").alias("filing_date"))


def metadata(rows: DataFrame, low: int, high: int, kind: str = "patent_type", withdrawn: str = "withdrawn", day: str = "patent_date") -> DataFrame:
    """Utility records that are not withdrawn and whose date is of low..high."""
    return rows.filter((F.col(kind) == "utility") & (F.coalesce(F.col(withdrawn), F.lit("0")) != "1") & F.year(periods.as_date(F.col(day))).between(low, high))


def skipped(rows: DataFrame, low: int, high: int, kind: str = "patent_type", withdrawn: str = "withdrawn", day: str = "patent_date") -> DataFrame:
    """One row: how many records each guard of metadata() leaves out, in its order, and how many stay."""
    out_kind, out_withdrawn = F.col(kind) != "utility", F.coalesce(F.col(withdrawn), F.lit("0")) == "1"
    out_day = ~F.coalesce(F.year(periods.as_date(F.col(day))).between(low, high), F.lit(False))
    return rows.agg(
        F.count_if(out_kind).alias("n_kind"), F.count_if(~out_kind & out_withdrawn).alias("n_withdrawn"),
        F.count_if(~out_kind & ~out_withdrawn & out_day).alias("n_date"), F.count_if(~out_kind & ~out_withdrawn & ~out_day).alias("n_kept"),
    )


def merged_codes(parts: DataFrame, key: str = "patent_id", codes: str = "codes") -> DataFrame:
    """key, codes: of records that several prefixes brought, the union of their codes."""
    return parts.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(codes)))).alias(codes))


def parties(rows: DataFrame, doc: str = "doc_id", seq: str = "sequence", form: str = "data_format", name: str = "name", best: str = "docdb") -> DataFrame:
    """One row a document and sequence: name and country, those of the best format before others."""
    order = Window.partitionBy(doc, seq).orderBy((F.col(form) != best).cast("int"), form, name)
    return rows.filter(F.col(name).isNotNull()).withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")


def citations(rows: DataFrame, patent: str = "cited_patent", text: str = "npl_text", most: int = 4000) -> tuple[DataFrame, DataFrame]:
    """Citations of patents, and those of other texts, cut to so many characters."""
    is_patent = texts.filled(F.col(patent)).isNotNull()
    other = rows.filter(~is_patent & texts.filled(F.col(text)).isNotNull())
    return rows.filter(is_patent).drop(text), other.withColumn(text, F.left(text, F.lit(most))).drop(patent)


def english_first(parts: Column, english: str = "en") -> Column:
    """Of an array of (lang, text): the first English text, else the first one."""
    full = F.filter(parts, lambda x: texts.filled(x["text"]).isNotNull())
    own = F.filter(full, lambda x: x["lang"] == english)
    return F.coalesce(F.get(own, F.lit(0))["text"], F.get(full, F.lit(0))["text"])


def cpc_codes(parts: Column) -> Column:
    """Of an array of (section, class, subclass, group, subgroup): distinct symbols, as they come."""
    made = F.transform(parts, lambda x: F.concat(x["section"], x["class"], x["subclass"], x["group"], F.lit("/"), x["subgroup"]))
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull()))


def availability(document: Column, direct: Column) -> Column:
    """The date of the document id, else the one given directly."""
    return F.coalesce(periods.compact_date(document), periods.compact_date(direct))


def increment(rows: DataFrame, marks: DataFrame, key: str, day: str, default: str = "2020-01-01") -> DataFrame:
    """rows after their key's mark (a row a key), or after the default where it has none."""
    m = marks.select(F.col(key), F.col("mark").cast("timestamp").alias("__mark"))
    return rows.join(m, key, "left").filter(F.col(day) > F.coalesce("__mark", F.lit(default).cast("timestamp"))).drop("__mark")


def new_counts(rows: DataFrame, marks: DataFrame, key: str, day: str, default: str = "2020-01-01") -> DataFrame:
    return increment(rows, marks, key, day, default).groupBy(key).agg(F.count("*").alias("n_new"))


def prefix_counts(rows: DataFrame, prefixes: DataFrame, code: str, prefix: str = "prefix") -> DataFrame:
    """prefix, n: a row under several prefixes counts for each. Prefixes meet codes by equal heads, one join a length."""
    lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().collect()]  # a handful of lengths
    parts = [rows.select(F.substring(code, 1, n).alias(prefix)).groupBy(prefix).agg(F.count("*").alias("n")).join(prefixes.filter(F.length(prefix) == n), prefix, "left_semi") for n in sorted(lengths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def query_text(prefixes: Column, field: str = "cpc") -> Column:
    """The search that asks for any of the prefixes."""
    return F.array_join(F.transform(prefixes, lambda p: F.concat(F.lit(f"{field}="), p, F.lit("*"))), " or ")


def insertable(rows: DataFrame, stored: DataFrame, key: str, *of: str) -> DataFrame:
    """New rows: their key is not stored, and not all of the columns are blank; the first of a key."""
    full = rows.filter(F.coalesce(*[texts.filled(F.col(c)) for c in of]).isNotNull()) if of else rows
    new = full.join(stored.select(key), key, "left_anti")
    order = Window.partitionBy(key).orderBy(*[F.col(c) for c in rows.columns if c != key])
    return new.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")


def backfilled(rows: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """rows with column where it is blank taken from found, of which each key's smallest value counts."""
    one = found.filter(texts.filled(F.col(column)).isNotNull()).groupBy(key).agg(F.min(column).alias("__v"))
    return rows.join(one, key, "left").withColumn(column, F.coalesce(texts.filled(F.col(column)), F.col("__v"))).drop("__v")


def read_through(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what the cache has of the wanted keys, the keys to fetch)."""
    keys = wanted.select(key).distinct()
    return cache.join(keys, key, "left_semi"), keys.join(cache.select(key), key, "left_anti")


def appended(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """store and those rows whose key it doesn't hold."""
    return store.unionByName(rows.join(store.select(key), key, "left_anti"))


def progress(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Upsert of states (key, status, n_done, error): counters that are null keep what they were; what is done stays done."""
    o, n = old.select(key, *[F.col(c).alias(f"o_{c}") for c in ("status", "n_done", "error")]), new.select(key, "status", "n_done", "error")
    both = o.join(n, key, "full")
    return both.select(
        key, F.when(F.col("o_status") == "done", "done").otherwise(F.coalesce("status", "o_status")).alias("status"), F.coalesce("n_done", "o_n_done").alias("n_done"),
        F.when(F.coalesce("status", "o_status") == "done", None).otherwise(F.coalesce("error", "o_error")).alias("error"),
    )


def configured(names: DataFrame, configs: DataFrame, pattern: str, columns: Mapping[str, object], key: str = "corpus") -> DataFrame:
    """names with their configuration; where none is stored, defaults for names that fit the pattern, else null. derived tells which."""
    got = names.join(configs.withColumn("__has", F.lit(True)), key, "left")
    fits = F.col(key).rlike(pattern)
    made = {c: F.when(F.col("__has"), F.col(c)).when(fits, F.lit(v)) for c, v in columns.items()}
    return got.withColumns(made).select(*names.columns, *columns, (F.col("__has").isNull() & fits).alias("derived"))


def latest(rows: DataFrame, period: str = "period") -> DataFrame:
    """The rows of the last period."""
    return rows.join(F.broadcast(rows.agg(F.max(period).alias(period))), period)  # one row


def patched(rows: DataFrame, found: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with columns of found where it has the key, in one write: no table is changed in place."""
    right = found.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    out = rows.join(right, keys, "left")
    return out.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*rows.columns)


def offers(rows: DataFrame, jobs: Column, rate: Column, price: Column, group: str, fixed_hours: float = 0.65) -> DataFrame:
    """group, offer: the cheapest by total cost (hours of work and fixed ones, times price); rows have a column offer."""
    cost = (jobs / rate / 3600 + fixed_hours) * price
    return rows.withColumn("cost", cost).groupBy(group).agg(F.min_by("offer", F.struct("cost", "offer")).alias("offer"), F.min("cost").alias("cost"))


def runtime_minutes(n: Column, per_minute: float = 2900.0, least: float = 10.0) -> Column:
    return F.greatest(F.lit(least), n / per_minute)
