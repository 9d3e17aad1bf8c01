"""Archives, records and exports over small fixtures."""

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from driftloom.sources import exports, records, versions

PATENT = """<exch:doc-list xmlns:exch="x"><exch:exchange-document doc-id="7" country="EP" doc-number="123" kind="A1" family-id="9" date-publ="20200102" is-representative="YES">
<exch:bibliographic-data><exch:classifications-ipcr><classification-ipcr sequence="1"><text>H01L  21/00        20060101AFI20250627BHCN</text></classification-ipcr></exch:classifications-ipcr>
<exch:patent-classifications><patent-classification sequence="1"><section>H</section><class>01</class><subclass>L</subclass><main-group>21</main-group><subgroup>00</subgroup><action-date><date>20130101</date></action-date></patent-classification></exch:patent-classifications>
<exch:parties><exch:applicants><exch:applicant sequence="1" data-format="docdb"><exch:applicant-name><name>ACME &nbsp; Co</name></exch:applicant-name><residence><country>DE</country></residence></exch:applicant>
<exch:applicant sequence="1" data-format="original"><exch:applicant-name><name>Acme</name></exch:applicant-name></exch:applicant></exch:applicants>
<exch:inventors><exch:inventor sequence="1" data-format="docdb"><exch:inventor-name><name>DOE</name></exch:inventor-name></exch:inventor></exch:inventors></exch:parties>
<exch:designation-of-states><country>FR</country><country>IT</country></exch:designation-of-states>
<exch:priority-claims><exch:priority-claim sequence="1"><document-id><country>US</country><doc-number>55</doc-number><date>20190101</date></document-id></exch:priority-claim></exch:priority-claims>
<exch:invention-title lang="de" data-format="docdba">Titel</exch:invention-title><exch:invention-title lang="en" data-format="docdba">Title</exch:invention-title>
<exch:references-cited><exch:citation sequence="1"><patcit><document-id><country>US</country><doc-number>42</doc-number><kind>A</kind></document-id></patcit></exch:citation><exch:citation sequence="2"><nplcit><text>%s</text></nplcit></exch:citation></exch:references-cited>
</exch:bibliographic-data><exch:abstract lang="en"><exch:p>An <b>abstract</b>.</exch:p></exch:abstract></exch:exchange-document></exch:doc-list>""" % ("x" * 5000)
ARTICLE = """<article><front><journal-meta><journal-title-group><journal-title>J</journal-title></journal-title-group></journal-meta><article-meta><article-id pub-id-type="pmid">1</article-id><article-id pub-id-type="doi">10.1/a</article-id>
<title-group><article-title>T <i>x</i></article-title></title-group><contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>J</given-names></name></contrib></contrib-group>
<pub-date><day>3</day><month>2</month><year>2021</year></pub-date><abstract><p>A.</p></abstract><kwd-group><kwd>k1</kwd></kwd-group></article-meta></front>
<body><sec><title>One</title><p>p1</p><p>p2</p><sec><title>One.a</title><p>q</p></sec></sec><sec><title>Two</title></sec></body><back><ref-list><ref><mixed-citation>R <pub-id pub-id-type="doi">10.1/b</pub-id></mixed-citation></ref></ref-list></back></article>"""


def archives(folder) -> None:
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.xml", "<!DOCTYPE x [<!ENTITY y 'z'>]>" + PATENT)
    with zipfile.ZipFile(folder / "outer.zip", "w") as z:
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("bad.zip", b"no archive")
    with tarfile.open(folder / "two.tar.gz", "w:gz") as t:
        for n, text in (("x.nxml", ARTICLE), ("y.nxml", "<articles>" + ARTICLE * 2 + "</articles>")):
            m = tarfile.TarInfo(n)
            m.size = len(text)
            t.addfile(m, io.BytesIO(text.encode()))


def test_archives_and_patents(spark, tmp_path):
    archives(tmp_path)
    rows = records.archived(spark, str(tmp_path), "exchange-document")
    assert rows.filter("error is not null").count() == 1 and rows.filter("record is not null").count() == 1
    made = records.tables(records.parsed(rows.filter("record is not null"), records.patent, records.PATENT), "doc_id")
    doc = made["document"].first()
    assert (doc.doc_id, doc.country, doc.family_id, doc.is_representative, doc.parse_error) == ("7", "EP", "9", True, None)
    got = {n: [tuple(r)[1:] for r in t.collect()] for n, t in made.items() if n != "document"}
    assert sorted(got["titles"]) == [("de", "docdba", "Titel"), ("en", "docdba", "Title")] and got["abstracts"] == [("en", None, "An abstract.")]
    assert got["classifications"] == [(1, "H", "01", "L", "21", "00", "20130101")] and got["ipcr"][0][1].startswith("H01L")
    assert sorted(got["applicants"]) == [(1, "docdb", "ACME Co", "DE"), (1, "original", "Acme", None)] and got["inventors"] == [(1, "docdb", "DOE", None)]
    assert got["priority_claims"] == [(1, "US", "55", "20190101")] and sorted(got["designated_states"]) == [("FR",), ("IT",)]
    assert (1, "US42A", None) in got["citations"] and max(len(x[2] or "") for x in got["citations"]) == 4000
    records.write_tables(made, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "titles")).count() == 2
    for _ in range(2):  # a load that runs again adds nothing
        records.load_tables(made, str(tmp_path / "db"))
        assert versions.current(spark, str(tmp_path / "db"))["titles"].count() == 2
    left = records.archived(spark, str(tmp_path), "exchange-document", done=rows.select("archive").distinct())
    assert left.count() == 0


def test_articles(spark, tmp_path):
    archives(tmp_path)
    rows = records.archived(spark, str(tmp_path), "article", "*.tar.gz")
    found = records.parsed(rows, records.article, records.ARTICLE).collect()
    assert len(found) == 3
    a = found[0]
    assert (a.pmid, a.doi, a.title, a.journal, a.published, a.abstract, a.keywords) == ("1", "10.1/a", "T x", "J", "2021-02-03", "A.", ["k1"])
    assert [tuple(s) for s in a.sections] == [(1, 1, "One", "p1\np2"), (2, 2, "One.a", "q"), (3, 1, "Two", None)]
    assert [tuple(r) for r in a.references] == [(1, None, "10.1/b", "R 10.1/b")] and a.authors[0].surname == "Doe"
    odd = records.unknown_paths(rows, ["/article/body/sec/title"]).filter(F.col("path").contains("/sec/title")).collect()
    assert [tuple(r) for r in odd] == [("/article/body/sec/sec/title", 3)]


def test_records_that_cannot_be_parsed_tell_so(spark):
    rows = spark.createDataFrame([(1, "<a><b></a>"), (2, None), (3, "<g><abstract>A</abstract><claim>1</claim><claim>2</claim></g>")], "k int, record string")
    got = {r.k: r for r in records.parsed(rows, records.grant, records.GRANT).collect()}
    assert got[1].parse_error and got[2].claims is None and (got[3].abstract, got[3].claims) == ("A", "1\n2")


def test_records_that_lie_across_chunks(monkeypatch):
    monkeypatch.setattr(records, "CHUNK", 7)
    text = "<w><d>one</d>junk<p:d a='1'>two<e/></p:d><dd>no</dd><d/></w>"
    assert list(records.split_records(io.BytesIO(text.encode()), "d")) == ["<d>one</d>", "<p:d a='1'>two<e/></p:d>", "<d/>"]


def test_exports_can_be_run_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb", "x"), (2, None, None), (3, "c", "x")], "id int, text string, code string")
    path, calls = str(tmp_path / "ex"), []
    chunks = {"2020": lambda: calls.append(1) or df, "2021": lambda: calls.append(2) or df.filter("id > 1")}
    assert exports.export_by(spark, chunks, path, "code") == ["2020", "2021"]
    assert exports.export_by(spark, chunks, path, "code") == [] and calls == [1, 2]
    assert sorted(p.name for p in (tmp_path / "ex" / "chunk=2020").iterdir() if p.is_dir()) == ["code=none", "code=x"]
    table = str(tmp_path / "t")
    exports.swap(df, table)
    exports.swap(df.filter("id = 1"), table)
    assert spark.read.parquet(table).count() == 1 and not (tmp_path / "t.old").exists()
    for period, part in (("p1", df), ("p2", df), ("p1", df.filter("id = 2"))):
        exports.write_period({"edges": part}, str(tmp_path / "w"), "c", period)
    assert spark.read.parquet(str(tmp_path / "w" / "edges")).groupBy("period").count().orderBy("period").collect() == [("p1", 1), ("p2", 3)]
    assert exports.manifest(spark, table) is None
    exports.write_manifest(spark, table, {"n": 1})
    assert exports.manifest(spark, table) == {"n": 1}
    assert exports.claim(spark, str(tmp_path), "job") and not exports.claim(spark, str(tmp_path), "job")
    lines = [r.value for r in exports.copy_lines(df).collect()]
    assert lines == ["1\ta\\tb\tx", "2\t\\N\t\\N", "3\tc\tx"]
