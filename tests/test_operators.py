import gzip
import io
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.operators import clusters, geometry, graph_rounds, matcher, spectra
from driftloom.operators.knn import knn
from driftloom.sources import readers
from driftloom.streaming import events


def test_knn_over_blocks_is_one_matrix(spark):
    x = np.random.default_rng(1).normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    key = lambda d: sorted((r.src, r.dst, r.rank) for r in d.collect())
    assert key(knn(df, 5)) == key(knn(df, 5, block=7))
    assert knn(df.limit(0), 5).count() == 0


def test_knn_multiplies_few_pairs_in_double_precision(monkeypatch):
    """Neighbours of a block are those of the whole product, copies and ties too, though few columns are looked at closely."""
    from driftloom.operators import knn as ops

    x = np.random.default_rng(3).normal(size=(9000, 16)).astype(np.float32)
    x[100:400] = x[100]  # copies: ties go to the smaller id
    x[7000:7050] = x[100]
    x[8000] = 0
    ids = np.random.default_rng(4).permutation(9000)
    t = pa.table({"id": pa.array(ids, pa.int64()), "v": pa.array(list(x), pa.list_(pa.float32()))})
    looked = []
    unit = ops.Vectors.unit
    right = ops.Vectors(t)
    left = ops.Vectors(t.slice(0, 600))
    monkeypatch.setattr(ops.Vectors, "unit", lambda self, rows: (looked.append(1 if isinstance(rows, slice) else 0), unit(self, rows))[1])
    src, dst, sim = ops.nearest(left, right, 16)
    n = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    u = x.astype(np.float64) / np.where(n == 0, 1, n)
    s = np.round(u[:600] @ u.T, 9)
    s[np.arange(600), np.arange(600)] = -np.inf
    got = {(a, b): c for a, b, c in zip(src.tolist(), dst.tolist(), sim.tolist(), strict=True)}
    assert len(got) == len(src) == 600 * 16
    for i in range(600):
        best = sorted(range(9000), key=lambda j: (-s[i, j], ids[j]))[:16] if i % 37 == 0 or i in (100, 399) else []
        assert all(got[ids[i], ids[j]] == pytest.approx(s[i, j], abs=2e-9) for j in best)
    blocks = -(-600 // ops.ROWS)
    assert sum(looked) <= blocks * (1 + 3)  # each block's own rows, its first slice, and slices with many copies


def test_void_needs_nearness_and_no_edge(spark):
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "c int, centroid array<double>")
    pairs = spark.createDataFrame([], "cluster_a int, cluster_b int")
    assert [(r.a, r.b) for r in clusters.voids(cents, pairs).collect()] == [(0, 1)]
    assert clusters.voids(cents, spark.createDataFrame([(1, 0)], "cluster_a int, cluster_b int")).count() == 0


def test_hops_have_no_end(spark):
    way = spark.createDataFrame([(i, i + 1) for i in range(15)], "cluster_a int, cluster_b int")
    got = {(r.a, r.b): r.hops for r in geometry.hops(way).collect()}
    assert got == {(i, j): abs(i - j) for i in range(16) for j in range(16) if i != j}


def test_lineage_is_reborn_within_lookback(spark):
    rows = [(0, 0, [1.0, 0.0], 1), (1, 5, [0.0, 1.0], 1), (2, 7, [1.0, 0.05], 1), (2, 8, [0.0, 1.0], 1)]
    none = spark.createDataFrame([], "period long, c long, chunk long, w double")
    cents = spark.createDataFrame(rows, "period long, c long, u array<double>, n long")
    got = {(r.period, r.c): (r.lineage, r.match_type) for r in matcher.match(cents, none).collect()}
    assert got[2, 7] == (got[0, 0][0], "reborn") and got[2, 8] == (got[1, 5][0], "continuation")
    assert {(r.period, r.c): r.match_type for r in matcher.match(cents, none, lookback=0).collect()}[2, 7] == "new"


def test_matcher_splits_merges_and_seeds(spark):
    """The clusters of four periods: 0 splits, 3 is away for a period, 4 ends, 5 joins 6."""
    from driftloom.plans import discovery, evolution

    rows = {(r.period, r.c): r for r in discovery.lineage_ids(spark, "/root/testdata/sf0.001").collect()}
    assert rows[1, 0].match_type == rows[1, 100].match_type == "new"  # halves too far from the whole (composite 0.66)
    parted = [tuple(r) for r in evolution.split_children(spark, "/root/testdata/sf0.001").collect()]
    assert parted and all(rows[p, c].match_type == "split_child" and rows[p, c].lineage == rows[p - 1, parent].lineage for p, c, parent in parted)
    assert (3, 3) in rows and rows[3, 3].match_type == "reborn" and rows[3, 3].lineage == rows[1, 3].lineage and rows[3, 3].gap == 2
    assert (2, 4) not in rows and rows[2, 6].lineage == rows[1, 6].lineage
    for p in range(4):  # one lineage for each cluster but for split children
        own = [r for r in rows.values() if r.period == p and r.match_type != "split_child"]
        assert len({r.lineage for r in own}) == len(own)
    seeded = {(r.period, r.c): r.lineage for r in discovery.lineage_ids_seeded(spark, "/root/testdata/sf0.001").collect()}
    assert min(p for p, _ in seeded) == 1 and seeded[1, 7] == "000507"


def test_children_of_a_split_inherit(spark):
    cents = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 2, [0.995, 0.0998]), (1, 3, [0.995, -0.0998]), (1, 4, [0.0, 1.0])], "period long, c long, u array<double>")
    own = [(0, 1, i, 1.0) for i in range(10)] + [(1, 2 + i // 5, i, 1.0) for i in range(10)] + [(1, 4, 99, 1.0)]
    got = {(r.period, r.c): (r.lineage, r.match_type) for r in matcher.match(cents, spark.createDataFrame(own, "period long, c long, chunk long, w double")).collect()}
    assert got[1, 2] == got[1, 3] == (got[0, 1][0], "split_child") and got[1, 4][1] == "new"


def test_the_weaker_claim_is_demoted(spark):
    """Two reborn claims on one lineage: the higher score keeps it."""
    own = spark.createDataFrame([("x", 0, 1), ("x", 1, 9), ("x", 2, 2), ("x", 2, 3)], "corpus string, period long, c long")
    none = spark.createDataFrame([], "corpus string, period long, c long, parent long, score double")
    back = spark.createDataFrame([("x", 2, 2, 1, 0.8, 2), ("x", 2, 3, 1, 0.9, 2)], "corpus string, period long, c long, parent long, score double, gap int")
    rows, _ = matcher.advance(matcher.empty(spark), none, none, back, own, 2)
    got = {(r.period, r.c): (r.lineage, r.match_type) for r in rows.collect()}
    assert got[2, 3] == (got[0, 1][0], "reborn") and got[2, 2][1] == "new" and got[2, 2][0] not in (got[0, 1][0], got[1, 9][0])


def test_chunks(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a\tx\t2020-02-03\na\ty\t2020-03-03\nb\tz\t2020-13-01\nc\tw\nd\tv\t1980-01-01\n")
    got = readers.chunks(spark, str(tmp_path / "c.tsv"), year_from=1990).collect()
    assert [(r.chunk_id, r.text, str(r.period_start)) for r in got] == [("a", "x", "2020-01-01")]
    with pytest.raises(ValueError):
        readers.period_start(F.col("x"), "hourly")


def test_json_lines_and_inverted_index(spark, tmp_path):
    d = tmp_path / "updated_date=2020-01-01"
    d.mkdir()
    with gzip.open(d / "part_0.gz", "wt") as f:
        f.write('{"id":"W1","ix":{"hello":[0,2],"big":[1]}}\n{"id": bad\n')
    got = readers.json_lines(spark, str(tmp_path), "id string, ix map<string,array<int>>").withColumn("t", readers.abstract_of(F.col("ix"))).collect()
    assert [(r.id, r.t, str(r.updated_date)) for r in got] == [("W1", "hello big hello", "2020-01-01")]


def test_zipped_records_go_on_after_a_bad_file(spark, tmp_path):
    inner = io.BytesIO()
    doc = '<!DOCTYPE x><a><doc doc-number="1" country="EP" date-publ="20200102"><invention-title lang="de">T</invention-title><invention-title lang="en">E</invention-title></doc></a>'
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.xml", doc)
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("i.zip", inner.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no")
    rows = readers.zipped_records(spark, str(tmp_path), "doc")
    assert rows.filter("error is not null").count() == 1
    p = readers.patents(rows).collect()
    assert [(r.doc_number, r.title, str(r.published)) for r in p] == [("1", "E", "2020-01-02")]


def test_abstracts_come_from_the_first_file_there_is(spark, tmp_path):
    ids = spark.createDataFrame([("1",), ("2",), ("4",)], "patent_id string")
    with pytest.raises(FileNotFoundError):
        readers.abstracts(spark, str(tmp_path), ids)
    (tmp_path / "g_abstract.tsv").write_text('patent_id\tpatent_abstract\n1\t" one ""quoted""\nline "\n2\t"  "\n3\tthree\n4\tfour\n')
    got = {r.patent_id: r.abstract for r in readers.abstracts(spark, str(tmp_path), ids).collect()}
    assert got == {"1": 'one "quoted"\nline', "4": "four"}
    (tmp_path / "g_patent_abstract.tsv").write_text("patent_id\tpatent_abstract\n2\ttwo\n")
    assert [r.abstract for r in readers.abstracts(spark, str(tmp_path), ids).collect()] == ["two"]


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    got = lambda mode: {r.k: r.v for r in readers.upsert(old, new, ["k"], mode).collect()}
    assert got("keep") == {1: "a", 2: None, 3: "z"}
    assert got("replace") == {1: "x", 2: "y", 3: "z"}
    assert got("fill") == {1: "a", 2: "y", 3: "z"}


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.periods(events.source(spark, str(tmp_path / "in"), src.schema), late="60 days")
    q = stream.writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = src.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").start.alias("p"), "event_type").count()
    got = {(r.period_start, r.event_type): r.n for r in spark.table("streamed").collect()}
    assert got == {(r.p, r.event_type): r["count"] for r in batch.collect()}


def test_spectral_of_a_large_period(spark):
    """3100 nodes in a ring with three chords each: no dense matrix is made."""
    n = 3100
    ring = spark.range(n).select(F.lit("p").alias("period"), F.col("id").alias("src"), F.explode(F.array(*[((F.col("id") * m + k) % n) for m, k in ((1, 1), (7, 3), (13, 5), (19, 11))])).alias("dst"), F.lit(1.0).alias("sim")).filter("src <> dst")
    m = np.zeros((n, n))
    for r in ring.collect():
        m[r.src, r.dst] = m[r.dst, r.src] = -1
    np.fill_diagonal(m, -m.sum(1))
    e = np.linalg.eigvalsh(m)
    got = spectra.spectral(graph_rounds.arcs(ring)).first()
    assert got.n == n
    assert got.algebraic_connectivity == pytest.approx(e[1], abs=1e-6)
    assert got.spectral_gap == pytest.approx(e[2] - e[1], abs=1e-6)


def test_spectral_with_a_hub(spark):
    """A node that is tied to hundreds doesn't slow the eigenvalues of the others down."""
    rng = np.random.default_rng(5)
    pairs = {(60 * g + i, 60 * g + int(j)) for g in range(4) for i in range(60) for j in rng.integers(0, 60, 4) if i != j}
    pairs |= {(59, 60), (10, 130), (70, 131), (119, 120), (125, 190), (179, 180)} | {(i, 240) for i in range(60)}
    weight = lambda b: 20.0 if b == 240 else 1.0
    m = np.zeros((241, 241))
    for a, b in pairs:
        m[a, b] = m[b, a] = -weight(b)
    np.fill_diagonal(m, -m.sum(1))
    arcs = graph_rounds.arcs(spark.createDataFrame([("p", a, b, weight(b)) for a, b in pairs], "period string, src long, dst long, sim double"))
    values, _ = spectra.lowest(spectra.laplacian(arcs), 3, 5, most=4)
    assert np.allclose(values["p"], np.linalg.eigvalsh(m)[:3], atol=1e-5)


def test_what_does_not_settle_raises(spark):
    way = spark.range(400).select(F.lit("p").alias("period"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("sim"))
    with pytest.raises(RuntimeError):
        spectra.lowest(spectra.laplacian(graph_rounds.arcs(way)), 3, 5, most=1)


def test_graph_bundle_against_plain_python(spark):
    from driftloom.plans import graph as plans
    from driftloom.plans import registry

    data = "/root/testdata/sf0.001"
    edges = plans.grouped(spark, data).filter("period = '1'").collect()
    near: dict[int, set[int]] = {}
    weight: dict = {}
    for r in edges:
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
        weight[min(r.src, r.dst), max(r.src, r.dst)] = max(0.0, r.sim, weight.get((min(r.src, r.dst), max(r.src, r.dst)), 0.0))
    ids = sorted(near)
    a = np.array([[float(q in near[p]) for q in ids] for p in ids])
    got = {r.id: r for r in plans.graph_bundle(spark, data).filter("period = '1'").collect()}
    assert sorted(got) == ids and all(got[p].degree == len(near[p]) for p in ids)
    core = {}
    for k in range(1, max(map(len, near.values())) + 1):  # what is left when nodes of fewer than k neighbours go
        left = set(ids)
        while gone := {p for p in left if len(near[p] & left) < k}:
            left -= gone
        core |= dict.fromkeys(left, k)
    assert all(got[p].core_number == core.get(p, 0) for p in ids)
    far = np.where(a > 0, 1.0, np.inf)
    np.fill_diagonal(far, 0)
    for k in range(len(ids)):
        far = np.minimum(far, far[:, k : k + 1] + far[k : k + 1])
    with np.errstate(divide="ignore"):
        h = np.where(far > 0, 1 / far, 0).sum(1)
    assert np.allclose([got[p].harmonic for p in ids], h / h.max())
    values, vectors = np.linalg.eigh(a)
    assert np.allclose([got[p].eigenvector for p in ids], np.abs(vectors[:, -1]), atol=1e-4)
    x = np.ones(len(ids))
    for _ in range(50):
        x = 1 + a @ x / (1 + a.sum(1).max())
    assert np.allclose([got[p].katz for p in ids], x / np.linalg.norm(x))
    m = -a * np.array([[weight.get((min(p, q), max(p, q)), 0.0) for q in ids] for p in ids])
    np.fill_diagonal(m, -m.sum(1))
    e = np.sort(np.linalg.eigvalsh(m))
    s = registry.queries()["spectral"](spark, data).filter("period = '1'").first()
    assert np.allclose([s.algebraic_connectivity, s.spectral_gap], [e[1], e[2] - e[1]])
    if len(ids) <= 256:  # all nodes are sources
        paths = np.zeros((len(ids), len(ids)))
        for i in range(len(ids)):
            paths[i, i] = 1
            for d in range(1, int(far[np.isfinite(far)].max()) + 1):
                for j in np.flatnonzero(far[i] == d):
                    paths[i, j] = paths[i][(a[j] > 0) & (far[i] == d - 1)].sum()
        between = np.zeros(len(ids))
        for v in range(len(ids)):
            on = (far[:, v : v + 1] + far[v : v + 1] == far) & np.isfinite(far)
            share = np.where(on & (paths > 0), paths[:, v : v + 1] * paths[v : v + 1] / np.maximum(paths, 1), 0)
            share[v], share[:, v] = 0, 0
            np.fill_diagonal(share, 0)
            between[v] = share.sum()
        assert np.allclose([got[p].betweenness for p in ids], between / ((len(ids) - 1) * (len(ids) - 2)))
    part = {p: got[p].community for p in ids}
    total = sum(weight.values())
    degree = {p: sum(w for k, w in weight.items() if p in k) for p in ids}
    q = sum(w for (x, y), w in weight.items() if part[x] == part[y]) / total - sum((sum(degree[p] for p in ids if part[p] == c) / (2 * total)) ** 2 for c in set(part.values()))
    assert q > 0.2 and part[ids[0]] is not None


def test_gaps_over_blocks_are_those_of_one(spark, monkeypatch):
    from driftloom.operators import gaps
    from driftloom.plans import graph as plans

    one = sorted(map(tuple, plans.gap_pairs(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(gaps, "BLOCK", 150)
    assert sorted(map(tuple, plans.gap_pairs(spark, "/root/testdata/sf0.001").collect())) == one and len(one) > 30
    cents = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "c int, m array<double>")
    rows = spark.createDataFrame([(i % 4, i, [1.0, 0.0]) for i in range(12)], "c int, chunk long, v array<double>")
    none = spark.createDataFrame([], "a int, b int, weight_ab double, weight_ba double"), spark.createDataFrame([], "chunk long, boundary_score double")
    assert gaps.gaps(rows, cents, *none).count() == 6 and gaps.gaps(rows, cents, *none, most_pairs=5).count() == 0


def test_gaps_have_no_limit_of_pairs(spark):
    """145 clusters are 10,440 pairs: beyond 10,000 there were none."""
    from driftloom.operators import gaps

    cents = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(145)], "c int, m array<double>")
    rows = spark.createDataFrame([(i, i, [float(np.cos(i)), float(np.sin(i))]) for i in range(145)], "c int, chunk long, v array<double>")
    none = spark.createDataFrame([], "a int, b int, weight_ab double, weight_ba double"), spark.createDataFrame([], "chunk long, boundary_score double")
    assert gaps.gaps(rows, cents, *none).count() == 145 * 144 // 2


def test_topology_takes_all_members_as_sources(spark):
    """Speeds against plain hops from every member; with 20 sources a cluster they differ."""
    from driftloom.plans import graph as plans

    data = "/root/testdata/sf0.001"
    got = {r.c: r.propagation_speed for r in plans.topology(spark, data).collect()}
    label = {r.id: r.c for r in plans.members(spark, data).collect()}
    unit = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in plans.emb(spark, data).collect()}
    near: dict[int, set[int]] = {i: set() for i in label}
    for r in plans.edges(spark, data).collect():
        if label[r.src] == label[r.dst]:
            near[r.src].add(r.dst)
            near[r.dst].add(r.src)
    sums = {c: [[], [], []] for c in set(label.values())}
    for i, c in label.items():
        seen, front = {i}, {i}
        for hop in range(3):
            front = {k for j in front for k in near[j]} - seen
            seen |= front
            sums[c][hop] += [unit[i] @ unit[k] for k in front]
    want = {c: (np.mean(m[2]) - np.mean(m[0])) / 2 for c, m in sums.items()}
    assert got == pytest.approx(want, abs=1e-6)


def test_paths_and_shapes_against_plain_python(spark):
    from driftloom.plans import graph as plans

    data = "/root/testdata/sf0.001"
    vec = {r.vec_id: (r.label, np.array(r.embedding, np.float64)) for r in plans.emb(spark, data).collect()}
    shapes = {r.c: r for r in plans.cluster_geometry(spark, data).collect()}
    for c, r in shapes.items():
        x = np.stack([v for label, v in vec.values() if label == c])
        s = np.linalg.svd(x, compute_uv=False)
        assert np.isclose(r.elongation, np.clip(s[0] / s[1], 1, 100)) and np.isclose(r.volume, np.prod(s[:3])) and r.size == len(x)
        z = x - x.mean(0)
        axis = np.linalg.svd(z)[2][0]
        p = z @ (axis * np.sign(axis[np.abs(axis).argmax()]))
        assert np.isclose(r.pc1_skew, (p**3).mean() / (p**2).mean() ** 1.5, atol=1e-6) and np.isclose(r.pc1_kurt, (p**4).mean() / (p**2).mean() ** 2 - 3, atol=1e-6)
    near: dict[int, list[int]] = {}
    for r in plans.edges(spark, data).collect():
        near.setdefault(r.src, []).append(r.dst)
    dims = {r.id: r.intrinsic_dim for r in plans.intrinsic_dim(spark, data).collect()}
    for i, own in list(near.items())[:60]:
        e = np.linalg.svd(np.stack([vec[j][1] for j in own]) - np.mean([vec[j][1] for j in own], 0), compute_uv=False) ** 2
        assert dims[i] == int((np.cumsum(e) / e.sum() < 0.9).sum()) + 1
    assert plans.topology(spark, data).count() == len(shapes) and plans.graph_measures(spark, data).filter("pagerank is null or core_number is null").count() == 0


def test_scores_against_a_corpus_of_equal_risks(spark, tmp_path):
    """Large sizes all have risk 1, so the deviation is 0: z is what SQL's doubles give, not an error."""
    import datetime

    import duckdb

    from driftloom.plans import registry

    day = datetime.datetime(2020, 2, 3)
    spark.createDataFrame([(1, "BUILDING", 1), (2, "MACHINERY", 1), (3, "MACHINERY", 2)], "c_custkey long, c_mktsegment string, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(c, day + datetime.timedelta(days=91 * q), 10.0) for c, n in ((1, 200), (2, 200), (3, 2)) for q in range(2) for _ in range(n)]
    spark.createDataFrame(orders, "o_custkey long, o_orderdate timestamp, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = registry.queries()["cross_corpus_scores"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    for t in ("customer", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(registry.oracle_sql()["cross_corpus_scores"]).fetchall()
    key = lambda rows: sorted((a, str(b)[:10], str(z)) for a, b, z in rows)
    assert key(got) == key(want)
    assert {str(z) for *_, z in got} == {"nan", "-inf"}


def test_neighbours_found_in_slices_wait(monkeypatch):
    """What is found is multiplied and ranked as often as the columns double, not once a slice; results as by the whole product."""
    from driftloom.operators import knn as nn

    monkeypatch.setattr(nn, "COLUMNS", 64)
    x = np.random.default_rng(4).normal(size=(64 * 40 + 5, 16)).astype(np.float32)
    x[1000:1100] = x[7]  # copies
    v = nn.Vectors(pa.table({"id": np.arange(len(x)), "v": pa.array(x.tolist(), pa.list_(pa.float32()))}))
    calls, real = [], nn.few
    monkeypatch.setattr(nn, "few", lambda *a: calls.append(1) or real(*a))
    src, dst, sim = nn.nearest(v, v, 6)
    rows = -(-len(x) // nn.ROWS)
    assert len(calls) < 15 * rows
    u = v.unit(slice(None))
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -s), axis=1)[:, :6]
    got = np.zeros((len(x), 6))
    got[src, np.arange(len(src)) % 6] = sim
    assert np.allclose(got, np.take_along_axis(s, order, 1), atol=2e-9) and (dst.reshape(-1, 6) == order).mean() > 0.999
    flags = np.random.default_rng(5).random(1003) < 0.02
    assert nn.places(flags).tolist() == np.flatnonzero(flags).tolist()


def test_neighbours_are_searched_piece_by_piece(monkeypatch):
    """A block meets pieces as they come; of many copies a piece lends k + 1; results as by the whole product, slices without finds among them."""
    from driftloom.operators import knn as nn

    monkeypatch.setattr(nn, "COLUMNS", 32)
    n, k, pieces = 2400, 4, 6
    x = np.random.default_rng(6).normal(size=(n, 8)).astype(np.float32)
    x[300:1500] = x[7]  # copies: ties go to the smaller id
    x[2000] = np.nan
    whole = pa.table({"g": ["a"] * n, "id": np.arange(n), "c": pa.array(np.arange(n) % pieces, pa.int32()), "v": pa.array(list(x), pa.list_(pa.float32()))})
    rows = [nn.packed(whole.take(pa.array(np.flatnonzero(np.arange(n) % pieces == c))), k) for c in range(pieces)]
    assert max(r.column("met")[0].as_py() for r in rows) <= 200 + k + 1
    calls, real = [], nn.every
    monkeypatch.setattr(nn, "every", lambda *a: calls.append(1) or real(*a))
    blocks = 2
    batches = []
    for i in range(blocks):
        for c in sorted(range(pieces), key=lambda c: (c % blocks != i, c)):
            batches += rows[c].append_column("i", pa.array([i], pa.int32())).append_column("own", pa.array([c % blocks == i])).to_batches()
    got = pa.Table.from_batches(nn.searched(iter(batches), k)).to_pylist()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -np.inf)
    s[np.isnan(s)] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(n), s.shape), -s), axis=1)[:, :k]
    near = {(r["src"], r["rank"]): r for r in got}
    assert len(near) == len(got) == k * (n - 1)
    assert all(near[i, r + 1]["dst"] == order[i, r] and near[i, r + 1]["sim"] == pytest.approx(s[i, order[i, r]], abs=2e-9) for i in range(n) if i != 2000 for r in range(k))
    assert len(calls) <= 3 * -(-n // nn.ROWS)


def test_neighbours_are_dealt_as_pieces(spark):
    """What is shuffled to the blocks is a row a piece, and each block has a partition of its own."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(90)], "vec_id long, embedding array<float>")
    out = knn(df, 3, block=10)
    assert out.rdd.getNumPartitions() == 9 and sorted(out.rdd.mapPartitions(lambda p: [len({r.src for r in p})]).collect())[0] > 0
    assert out.count() == 270


def test_neighbours_are_searched_once(spark):
    """Degrees and triangles use their pairs several times; what the pairs come from is worked out once."""
    found = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            found.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.5), (2, 0, 0.5), (3, 0, 0.5)], "src long, dst long, sim double").mapInArrow(counted, "src long, dst long, sim double")
    members = spark.createDataFrame([(i, 0) for i in range(5)], "id long, c int")
    for f, name, want in ((clusters.degrees, "degree", [3, 2, 2, 1, 0]), (clusters.triangles, "triangle_count", [1, 1, 1, 0, 0])):
        before = found.value
        out = f(edges, members)
        assert [r[name] for r in sorted(out.collect())] == want
        out.collect()
        assert found.value - before == 4


def counted(df, found):
    """df, whose rows add to found whenever they are worked out."""

    def through(batches):
        for b in batches:
            found.add(b.num_rows)
            yield b

    return df.mapInArrow(through, df.schema)


def test_propagation_reads_its_edges_once(spark):
    """Hops go over stored edges within clusters; what the edges come from is worked out once, whatever hops and sums do."""
    from driftloom.operators import gaps

    found = spark.sparkContext.accumulator(0)
    way = [(i, i + 1) for i in range(5)] + [(1, 0), (2, 9), (9, 3), (6, 7)]
    edges = counted(spark.createDataFrame(way, "src long, dst long"), found)
    members = spark.createDataFrame([(i, 0) for i in range(6)] + [(6, 1), (7, 1), (9, 2)], "id long, c int")
    angle = lambda i: [float(np.cos(i / 4)), float(np.sin(i / 4))]
    vectors = spark.createDataFrame([(i, angle(i)) for i in (*range(8), 9)], "id long, u array<double>")
    out = gaps.propagation(edges, members, vectors)
    got = {r.c: r.propagation_speed for r in out.collect()}
    assert got == {0: pytest.approx((np.cos(3 / 4) - np.cos(1 / 4)) / 2), 1: None, 2: None}
    assert found.value == len(way)


def test_modularity_reads_its_edges_once(spark):
    """One pass, however the plan is cut; weights of 0 give what SQL's doubles give, not an error."""
    found = spark.sparkContext.accumulator(0)
    rows = [(0, 1, 0.5), (1, 0, 0.5), (1, 2, 0.25), (2, 3, 0.75), (3, 4, 0.5), (4, 2, -0.5), (5, 4, 0.5)]
    members = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)], "id long, c int")
    edges = spark.createDataFrame(rows, "src long, dst long, sim double")
    reuse, adaptive = "spark.sql.exchange.reuse", "spark.sql.adaptive.enabled"
    before = {name: spark.conf.get(name) for name in (reuse, adaptive)}
    try:
        spark.conf.set(reuse, "false")
        spark.conf.set(adaptive, "false")
        got = clusters.modularity(counted(edges, found), members, 2.0).first().modularity
    finally:
        for name, was in before.items():
            spark.conf.set(name, was)
    assert got == pytest.approx(1.75 / 2 - 2 * ((1.25 / 4) ** 2 + (2.75 / 4) ** 2), abs=1e-6)
    assert found.value == len(rows)
    assert np.isnan(clusters.modularity(edges.withColumn("sim", F.lit(0.0)), members).first().modularity)
    assert clusters.modularity(edges.limit(0), members).first().modularity is None


def test_blocks_bound_what_is_shuffled_and_held():
    """Every piece goes to every block: as many vectors as in 6 GB make under 4 GB of that on 12 cores, and a block of wide vectors stays small."""
    from driftloom.operators import knn as nn

    blocks, pieces = nn.shares(615_384, 64, 12)
    assert blocks * 615_384 * 64 * 4 < 4e9 and blocks >= 24
    assert 615_384 * 64 * 8 / pieces <= nn.PIECE and pieces % blocks == 0 and pieces < 2 * blocks
    for width in (64, 768, 4096):
        assert 10_000_000 // nn.shares(10_000_000, width, 12)[0] * width * 8 <= nn.BLOCK_BYTES
    assert nn.shares(1, 0, 12) == (1, 1)
    assert nn.shares(5000, 64, 12)[0] == 5
