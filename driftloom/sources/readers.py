"""Readers and writers: delimited and JSON-lines text, archives of XML, guarded imports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Tokens that stand for null in delimited text: fixed values of the format.
NULLS = ("", "NULL", r"\N")
PERIODS = {"weekly": "week", "monthly": "month", "quarterly": "quarter", "annual": "year"}


def quoted_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A quoted table with a header; only the named columns are parsed."""
    df = spark.read.csv(path, sep="\t", quote='"', escape='"', header=True)
    return df.select(*columns) if columns else df


def abstracts(spark: SparkSession, folder: str, ids: DataFrame, names: tuple[str, ...] = ("g_patent_abstract.tsv", "g_abstract.tsv")) -> DataFrame:
    """patent_id, abstract of the first of the named files that is there, for ids (patent_id); blanks around go, empty ones too. Raises if there is none."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = spark.read.csv(path.toString(), sep="\t", quote='"', escape='"', header=True, multiLine=True).toDF("patent_id", "abstract")
            rows = rows.select("patent_id", F.btrim("abstract", F.lit(" \t\n\r\f\x0b")).alias("abstract")).filter("abstract <> ''")
            return rows.join(ids.select("patent_id").distinct(), "patent_id", "left_semi")
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")


def nulls(c: str) -> Column:
    return F.when(~F.col(c).isin(*NULLS), F.col(c))


def whole(c: str) -> Column:
    """"125.0" as 125, what is no number as null."""
    return F.expr(f"try_cast(try_cast(`{c}` as double) as bigint)")


def vector(c: str) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(c, r"[\[\],]", " "), " +"), lambda x: x != ""), lambda x: x.cast("float"))


def period_start(date: Column, resolution: str) -> Column:
    if resolution not in PERIODS:
        raise ValueError(f"unknown resolution {resolution!r}")
    return F.trunc(date, PERIODS[resolution]) if resolution != "weekly" else F.date_trunc("week", date).cast("date")


def chunks(spark: SparkSession, path: str, resolution: str = "quarterly", year_from: int = 0) -> DataFrame:
    """chunk_id, text, period_start of a headerless file of three columns; short lines, bad dates and early years go, and the first text of a (chunk, period) stays."""
    raw = spark.read.schema("chunk_id string, text string, filing_date string").csv(path, sep="\t", quote="", mode="PERMISSIVE")
    d = raw.withColumn("d", F.expr("try_cast(filing_date as date)")).filter("d is not null").filter(F.year("d") >= year_from)
    d = d.withColumn("period_start", period_start(F.col("d"), resolution))
    w = Window.partitionBy("chunk_id", "period_start").orderBy("filing_date", "text")
    return d.withColumn("k", F.row_number().over(w)).filter("k = 1").select("chunk_id", "text", "period_start")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, compressed or not; malformed lines go; the directories' partition columns come along."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def abstract_of(index: Column) -> Column:
    """The text of an inverted index map<word, array<position>>."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def zipped_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """file, record, error: the records of a tag in the XML files of (nested) zip archives, one archive to a task at a time.

    A file that can't be read gives one row with its error; the others go on. Document types and unknown entities are
    cut before splitting.
    """
    import re

    open_close = re.compile(rf"<(?:\w+:)?{re.escape(tag)}[\s>].*?</(?:\w+:)?{re.escape(tag)}>", re.S)
    doctype, entity = re.compile(r"<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", re.S), re.compile(r"&(?!amp;|lt;|gt;|quot;|apos;|#)\w+;")

    def files(name: str, data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for n in z.namelist():
                    if n.lower().endswith(".zip"):
                        yield from files(f"{name}/{n}", z.read(n))
                    elif n.lower().endswith(".xml"):
                        yield f"{name}/{n}", z.read(n), None
        except (zipfile.BadZipFile, OSError) as e:
            yield name, None, str(e)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                for name, data, error in files(r["path"], r["content"]):
                    rows = [(name, None, error)] if data is None else [(name, m[0], None) for m in open_close.finditer(entity.sub(" ", doctype.sub("", data.decode("utf-8", "replace"))))]
                    yield pa.RecordBatch.from_pydict({k: pa.array([x[i] for x in rows], pa.string()) for i, k in enumerate(("file", "record", "error"))})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return raw.mapInArrow(run, "file string, record string, error string")


def patents(records: DataFrame) -> DataFrame:
    """Titles and abstracts, English first, and distinct classes, of flat patent records."""
    x = lambda p: F.xpath("record", F.lit(p))
    first = lambda a, b: F.coalesce(F.get(x(a), F.lit(0)), F.get(x(b), F.lit(0)))
    return records.filter("record is not null").select(
        F.get(x("/*/@doc-number"), F.lit(0)).alias("doc_number"), F.get(x("/*/@country"), F.lit(0)).alias("country"), F.expr("to_date(try_to_timestamp(get(xpath(record, '/*/@date-publ'), 0), 'yyyyMMdd'))").alias("published"),
        first("//invention-title[@lang='en']/text()", "//invention-title/text()").alias("title"), first("//abstract[@lang='en']//text()", "//abstract//text()").alias("abstract"),
        F.array_distinct(x("//classification-symbol/text()")).alias("classes"),
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str], mode: str = "keep") -> DataFrame:
    """old and new as one: keep (old rows win), replace (new rows win) or fill (new values where old ones are null). new: one row a key."""
    if mode == "keep":
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))
    if mode == "replace":
        return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
    if mode != "fill":
        raise ValueError(f"unknown mode {mode!r}")
    a, b = old.alias("a"), new.alias("b")
    j = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    return j.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in old.columns])


def write_partitions(df: DataFrame, path: str, by: str, replace: bool = True) -> None:
    """Writes df by partition. replace: partitions that df holds are replaced, others stay."""
    mode = "overwrite" if replace else "append"
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Floats with six places, NULL for null, blanks for tabs and line ends."""
    cols = [F.format_string("%.6f", F.col(f.name).cast("double")).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.translate(F.col(f.name).cast("string"), "\t\n\r", "   ").alias(f.name) for f in df.schema]
    df.select(*[F.when(F.col(f.name).isNotNull(), c).alias(f.name) for f, c in zip(df.schema, cols, strict=True)]).write.option("sep", "\t").option("nullValue", "NULL").option("compression", "gzip").csv(path, header=True)


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """file, ok: whether each file's SHA-1 is the manifest's (file, sha1)."""
    own = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha1("content").alias("own"))
    return manifest.join(own, "file", "left").select("file", F.coalesce(F.lower("sha1") == F.col("own"), F.lit(False)).alias("ok"))
