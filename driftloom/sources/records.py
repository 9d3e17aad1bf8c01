"""Records of patent and article XML as nested rows, and their child tables.

Files are split into records as they stream by, so memory is bounded by a record. A record is parsed on its own without
document types or entities, and one that can't be parsed gives a row with its error. Child tables are explodes of the one
stored parse.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from driftloom.sources import versions
from driftloom.storage import stored

CHUNK = 1 << 20
ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);|#)\w+;")


def split_records(source: BinaryIO, tag: str) -> Iterator[str]:
    """The elements of a tag (with any prefix) in a stream of XML, wrapped or bare; what lies between them is passed over."""
    name = re.escape(tag)
    opens, closes = re.compile(rf"<(?:[\w.-]+:)?{name}(?=[\s/>])"), re.compile(rf"</(?:[\w.-]+:)?{name}\s*>|(?<=/)>")
    text, at, more = "", None, True
    decode = io.TextIOWrapper(source, "utf-8", "replace").read
    while more or at is not None:
        if at is None:
            m = opens.search(text)
            if m:
                text, at = text[m.start() :], len(m[0])
                continue
            text = text[-(len(tag) + 80) :]
        else:
            head = text.find(">", at)
            m = closes.search(text, at) if head >= 0 and text[head - 1] != "/" else None
            if head >= 0 and text[head - 1] == "/":
                yield text[: head + 1]
                text, at = text[head + 1 :], None
                continue
            while m and m[0] == ">":  # an empty element inside
                m = closes.search(text, m.end())
            if m:
                yield text[: m.end()]
                text, at = text[m.end() :], None
                continue
        if not more:
            return
        new = decode(CHUNK)
        more = bool(new)
        text += new


def members(name: str, data: bytes) -> Iterator[tuple[str, BinaryIO | None, str | None]]:
    """(name, stream, error) of the XML files in a zip, a tar, or archives in them; a bad one doesn't stop the others."""
    try:
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for n in z.namelist():
                    if n.lower().endswith((".zip", ".tar", ".tar.gz", ".tgz")):
                        yield from members(f"{name}/{n}", z.read(n))
                    elif n.lower().endswith((".xml", ".nxml")):
                        with z.open(n) as f:
                            yield f"{name}/{n}", f, None
        elif name.lower().endswith((".tar", ".tar.gz", ".tgz")):
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    if m.isfile() and m.name.lower().endswith((".xml", ".nxml")):
                        yield f"{name}/{m.name}", t.extractfile(m), None
        else:
            yield name, io.BytesIO(data), None
    except Exception as e:  # noqa: BLE001  whatever is wrong with one archive is its row
        yield name, None, f"{type(e).__name__}: {e}"


def archived(spark: SparkSession, path: str, tag: str, pattern: str = "*.{zip,tar,tar.gz,tgz,xml}", done: DataFrame | None = None) -> DataFrame:
    """file, record, error of all archives under path but those in done (a column archive), so that a load that broke off goes on."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                for name, source, error in members(r["path"], r["content"]):
                    try:
                        for record in split_records(source, tag) if source is not None else ():
                            yield row(r["path"], name, record, None)
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                    if error:
                        yield row(r["path"], name, None, error)

    def row(archive, name, record, error):
        return pa.RecordBatch.from_pydict({k: pa.array([v], pa.string()) for k, v in (("archive", archive), ("file", name), ("record", record), ("error", error))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    if done is not None:
        files = files.join(done.select(F.col("archive").alias("path")).distinct(), "path", "left_anti")
    return files.mapInArrow(run, "archive string, file string, record string, error string")


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse(record: str) -> ET.Element:
    record = ENTITY.sub(" ", record)
    for prefix in set(re.findall(r"[<\s]([A-Za-z][\w.-]*):[\w.-]+[\s=/>]", record)) - {"xml", "xmlns"}:
        record = re.sub(r"^(<[^\s/>]+)", rf'\1 xmlns:{prefix}="{prefix}"', record, count=1) if f"xmlns:{prefix}=" not in record else record
    return ET.fromstring(record)


def find_all(at: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in at.iter() if local(e.tag) == name]


def first(at: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        at = next((e for e in at if local(e.tag) == name), None) if at is not None else None
    return at


def said(at: ET.Element | None) -> str | None:
    """All text within, blanks drawn together; null for none."""
    return (" ".join("".join(at.itertext()).split()) or None) if at is not None else None


PATENT = """doc_id string, country string, doc_number string, kind string, family_id string, date_publ string, is_representative boolean,
titles array<struct<lang:string,data_format:string,text:string>>, abstracts array<struct<lang:string,data_format:string,text:string>>,
ipcr array<struct<sequence:int,text:string>>, classifications array<struct<sequence:int,section:string,class:string,subclass:string,group:string,subgroup:string,action_date:string>>,
applicants array<struct<sequence:int,data_format:string,name:string,country:string>>, inventors array<struct<sequence:int,data_format:string,name:string,country:string>>,
priority_claims array<struct<sequence:int,country:string,doc_number:string,date:string>>, citations array<struct<sequence:int,cited_patent:string,npl_text:string>>,
designated_states array<struct<country:string>>, related_documents array<struct<relation:string,doc_number:string>>"""


def number(value: str | None) -> int | None:
    return int(value) if value and value.isdigit() else None


def patent(e: ET.Element) -> dict:
    """One record in all its languages and formats."""
    get = e.attrib.get

    def texts(name: str) -> list[dict]:
        return [{"lang": x.get("lang"), "data_format": x.get("data-format"), "text": t} for x in find_all(e, name) if (t := said(x))]

    def people(item: str, name: str) -> list[dict]:
        return [
            {"sequence": number(x.get("sequence")), "data_format": x.get("data-format"), "name": said(first(x, name, "name")), "country": said(first(x, "residence", "country"))}
            for x in find_all(e, item)
        ]

    def cited(x: ET.Element) -> dict:
        doc = first(x, "patcit", "document-id")
        parts = [said(first(doc, k)) for k in ("country", "doc-number", "kind")] if doc is not None else []
        text = said(first(x, "nplcit", "text"))
        return {"sequence": number(x.get("sequence")), "cited_patent": "".join(p for p in parts if p) or None, "npl_text": text[:4000] if text else None}

    flag = {"YES": True, "NO": False}.get(get("is-representative") or "")
    symbol = ("section", "class", "subclass", "main-group", "subgroup")
    return {
        "doc_id": get("doc-id"), "country": get("country"), "doc_number": get("doc-number"), "kind": get("kind"), "family_id": get("family-id"), "date_publ": get("date-publ"), "is_representative": flag,
        "titles": texts("invention-title"), "abstracts": texts("abstract"),
        "ipcr": [{"sequence": number(x.get("sequence")), "text": t} for x in find_all(e, "classification-ipcr") if (t := said(first(x, "text")))],
        "classifications": [
            dict(zip(("section", "class", "subclass", "group", "subgroup"), [said(first(x, n)) for n in symbol], strict=True)) | {"sequence": number(x.get("sequence")), "action_date": said(first(x, "action-date", "date"))}
            for x in find_all(e, "patent-classification")
        ],
        "applicants": people("applicant", "applicant-name"), "inventors": people("inventor", "inventor-name"),
        "priority_claims": [
            {"sequence": number(x.get("sequence")), "country": said(first(x, "document-id", "country")), "doc_number": said(first(x, "document-id", "doc-number")), "date": said(first(x, "document-id", "date"))}
            for x in find_all(e, "priority-claim")
        ],
        "citations": [cited(x) for x in find_all(e, "citation")],
        "designated_states": [{"country": c} for x in find_all(e, "designation-of-states") for y in find_all(x, "country") if (c := said(y))],
        "related_documents": [{"relation": local(x.tag), "doc_number": n} for r in find_all(e, "related-documents") for x in r for y in find_all(x, "doc-number")[:1] if (n := said(y))],
    }


ARTICLE = """pmid string, pmcid string, doi string, title string, journal string, published string, abstract string, keywords array<string>,
authors array<struct<sequence:int,surname:string,given_names:string>>, sections array<struct<sequence:int,level:int,title:string,text:string>>,
references array<struct<sequence:int,pmid:string,doi:string,text:string>>"""


def article(e: ET.Element) -> dict:
    """Ids, dates, authors, references, and the body's sections with their level and sequence, however deep they lie."""
    front, body = first(e, "front"), first(e, "body")
    meta = first(front, "article-meta")
    ids = {x.get("pub-id-type"): said(x) for x in (meta if meta is not None else ()) if local(x.tag) == "article-id"}
    dates = [x for x in (meta if meta is not None else ()) if local(x.tag) == "pub-date"]
    day = "-".join(v.zfill(2) for p in ("year", "month", "day") if dates and (v := said(first(dates[0], p)))) or None
    out: list[dict] = []

    def walk(at: ET.Element, level: int) -> None:
        for sec in at:
            if local(sec.tag) == "sec":
                text = "\n".join(t for p in sec if local(p.tag) == "p" and (t := said(p)))
                out.append({"sequence": len(out) + 1, "level": level, "title": said(first(sec, "title")), "text": text or None})
                walk(sec, level + 1)

    if body is not None:
        walk(body, 1)

    def cited(i: int, ref: ET.Element) -> dict:
        own = {x.get("pub-id-type"): said(x) for x in find_all(ref, "pub-id")}
        return {"sequence": i, "pmid": own.get("pmid"), "doi": own.get("doi"), "text": said(ref)}

    authors = [x for x in find_all(meta, "contrib") if x.get("contrib-type") == "author"] if meta is not None else []
    return {
        "pmid": ids.get("pmid"), "pmcid": ids.get("pmc") or ids.get("pmcid"), "doi": ids.get("doi"), "title": said(first(meta, "title-group", "article-title")),
        "journal": said(next(iter(find_all(front, "journal-title")), None)) if front is not None else None, "published": day, "abstract": said(first(meta, "abstract")),
        "keywords": [k for x in (find_all(meta, "kwd") if meta is not None else ()) if (k := said(x))],
        "authors": [{"sequence": i, "surname": said(first(a, "name", "surname")), "given_names": said(first(a, "name", "given-names"))} for i, a in enumerate(authors, 1)],
        "sections": out, "references": [cited(i, r) for i, r in enumerate(find_all(e, "ref"), 1)],
    }


GRANT = "abstract string, claims string, description string"


def grant(e: ET.Element) -> dict:
    """The text of a grant: its claims are parted by line ends."""
    claims = "\n".join(t for x in find_all(e, "claim") if (t := said(x)))
    return {"abstract": said(next(iter(find_all(e, "abstract")), None)), "claims": claims or None, "description": said(next(iter(find_all(e, "description")), None))}


def parsed(records: DataFrame, extract: Callable[[ET.Element], dict], schema: str, record: str = "record") -> DataFrame:
    """records with the columns that extract makes, and parse_error; its own columns but the record stay."""
    keep = [c for c in records.columns if c not in (record, "parse_error")]
    made = StructType.fromDDL(f"{schema}, parse_error string")
    whole = StructType([*[f for f in records.schema.fields if f.name in keep], *made.fields])
    arrow, names = to_arrow_schema(made), [f.name for f in made.fields]

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(b.schema.get_field_index(record)).to_pylist():
                try:
                    rows.append((extract(parse(text)) if text is not None else {}) | {"parse_error": None})
                except Exception as e:  # noqa: BLE001  the record's own row says so
                    rows.append({"parse_error": f"{type(e).__name__}: {e}"})
            cols = [pa.array([r.get(n) for r in rows], arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], *cols], names=[*keep, *names])

    return records.mapInArrow(run, whole)


def tables(rows: DataFrame, key: str) -> dict[str, DataFrame]:
    """The document table and one child table for each array of structs, with the key in it; parsed once and stored."""
    rows = stored(rows)
    nested = [f.name for f in rows.schema.fields if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
    out = {"document": rows.drop(*nested)}
    for n in nested:
        out[n] = rows.select(key, F.explode(n).alias("x")).select(key, "x.*")
    return out


def write_tables(made: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """Each table to a folder of its name, the document table last: it tells that its children are there. A run that breaks leaves children; see ``load_tables``."""
    for name in [*[n for n in made if n != "document"], "document"]:
        made[name].write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")


def load_tables(made: dict[str, DataFrame], path: str, key: str = "doc_id", **more) -> int:
    """All tables as one commit beside what is there (see ``versions``); documents that come again take their own place, children too."""
    return versions.append(path, made, {n: [key] for n in made}, **more)


def unknown_paths(records: DataFrame, known: list[str], record: str = "record") -> DataFrame:
    """path, n: element paths beyond the known ones, which tell that a format has moved."""

    def run(batches):
        for b in batches:
            seen: dict[str, int] = {}
            for text in b.column(0).to_pylist():
                try:
                    todo = [(parse(text), "")] if text else []
                except ET.ParseError:
                    continue
                while todo:
                    e, above = todo.pop()
                    here = f"{above}/{local(e.tag)}"
                    seen[here] = seen.get(here, 0) + 1
                    todo += [(x, here) for x in e]
            yield pa.RecordBatch.from_pydict({"path": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    found = records.select(record).mapInArrow(run, "path string, n long").groupBy("path").agg(F.sum("n").alias("n"))
    return found.filter(~F.col("path").isin(known)) if known else found
