"""Commits that break off or meet, and persistent ids by steps against the plain fold."""

import random
import threading

import plain_matcher
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.operators import matcher
from driftloom.sources import exports, versions


class Broken(RuntimeError):
    pass


def breaks_at(step):
    def stop(at):
        if at == step:
            raise Broken(at)

    return stop


def test_readers_see_all_of_a_commit_or_none(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = lambda n: {"document": spark.range(n).toDF("doc_id"), "child": spark.range(2 * n).select((F.col("id") % n).alias("doc_id"), "id")}
    for step in ("document", "child", "pointer"):
        with pytest.raises(Broken):
            versions.commit(path, docs(3), stop=breaks_at(step))
        with pytest.raises(FileNotFoundError):
            versions.current(spark, path)
    assert versions.commit(path, docs(3)) == 1
    for step in ("document", "child", "pointer"):
        with pytest.raises(Broken):
            versions.commit(path, docs(5), stop=breaks_at(step))
        assert {k: t.count() for k, t in versions.current(spark, path).items()} == {"document": 3, "child": 6}
    assert versions.commit(path, docs(5)) == 2
    assert {k: t.count() for k, t in versions.current(spark, path).items()} == {"document": 5, "child": 10}
    assert versions.current(spark, path, 1)["document"].count() == 3
    assert versions.vacuum(spark, path, keep=1) >= 2
    assert versions.current(spark, path)["child"].count() == 10
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path, 1)


def test_loads_that_run_again_add_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    first = {"document": spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string"), "child": spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id int, k int"), "seen": spark.createDataFrame([("x",)], "s string")}
    keys = {"document": ["doc_id"], "child": ["doc_id"]}
    for _ in range(2):
        versions.append(path, first, keys)
    second = {"document": spark.createDataFrame([(2, "B"), (3, "c")], "doc_id int, v string"), "child": spark.createDataFrame([(2, 9)], "doc_id int, k int"), "seen": spark.createDataFrame([("x",), ("y",)], "s string")}
    with pytest.raises(Broken):
        versions.append(path, second, keys, stop=breaks_at("pointer"))
    versions.append(path, second, keys)
    got = {k: sorted(map(tuple, t.collect())) for k, t in versions.current(spark, path).items()}
    assert got == {"document": [(1, "a"), (2, "B"), (3, "c")], "child": [(1, 1), (1, 2), (2, 9)], "seen": [("x",), ("y",)]}


def test_of_several_at_once_one_wins(spark, tmp_path):
    won, go = [], threading.Barrier(8)

    def ask(k):
        go.wait()
        for name in ("a", "b", "c"):
            if exports.claim(spark, str(tmp_path), name):
                won.append((name, k))

    threads = [threading.Thread(target=ask, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for n, _ in won) == ["a", "b", "c"]
    assert not [p for p in tmp_path.iterdir() if not p.name.endswith((".claim", ".crc"))]


def test_an_append_that_is_overtaken_starts_again(spark, tmp_path):
    path, met = str(tmp_path / "t"), []
    row = lambda i: {"d": spark.createDataFrame([(i,)], "id int")}
    versions.append(path, row(1), {"d": ["id"]})

    def other(at):
        if at == "pointer" and not met:
            met.append(1)
            versions.append(path, row(2), {"d": ["id"]})

    versions.append(path, row(3), {"d": ["id"]}, stop=other)
    assert sorted(r.id for r in versions.current(spark, path)["d"].collect()) == [1, 2, 3]


def test_a_view_is_always_there(spark, tmp_path):
    path = str(tmp_path / "v")
    exports.refresh(spark.range(3), path)
    old = exports.view(spark, path)
    exports.refresh(spark.range(5), path)
    assert (old.count(), exports.view(spark, path).count()) == (3, 5)


PAIR = "corpus string, period long, c long, parent long, score double"


def cases(seed):
    rng = random.Random(seed)
    own, pairs, parted, back = [], [], [], []
    for corpus in ("x", "y"):
        for p in range(6):
            now = sorted(rng.sample(range(9), rng.randint(2, 7)))
            own += [(corpus, p, c) for c in now]
            if p:
                for c in now:
                    for parent in rng.sample(range(9), 3):
                        pairs.append((corpus, p, c, parent, rng.choice([0.7, 0.75, 0.8, 0.9, 0.95])))
                some = [x for x in pairs if x[:2] == (corpus, p)]
                for parent in {x[3] for x in rng.sample(some, min(2, len(some)))}:
                    parted += [x for x in some if x[3] == parent] if sum(x[3] == parent for x in some) > 1 else []
            for c in now:
                for gap in (2, 3):
                    if p >= gap and rng.random() < 0.5:
                        back.append((corpus, p, c, rng.randrange(9), rng.choice([0.7, 0.8, 0.9]), gap))
    return own, pairs, parted, back


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_by_steps_are_those_of_the_fold(spark, tmp_path, seed):
    """Two corpora at once, and again with the state stored and loaded after three periods."""
    own, pairs, parted, back = cases(seed)
    rows = [(k, "cluster", p, c, None, None, None, None) for k, p, c in own]
    rows += [(k, kind, p, c, a, 1, s, None) for kind, made in (("pair", pairs), ("split", parted)) for k, p, c, a, s in made]
    rows += [(k, "back", p, c, a, g, s, None) for k, p, c, a, s, g in back]
    names = ["corpus", "kind", "period", "c", "parent", "gap", "score", "lineage"]
    exp = []
    for corpus in ("x", "y"):
        made = plain_matcher.fold(pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows if r[0] == corpus]))
        exp += [tuple(r.values()) for r in made.to_pylist()]
    exp.sort(key=str)
    frames = [spark.createDataFrame(x, t) for x, t in ((pairs, PAIR), (parted, PAIR), (back, PAIR + ", gap int"), (own, "corpus string, period long, c long"))]
    got, _ = matcher.advance(matcher.empty(spark), *frames, 2)
    assert sorted(map(tuple, got.collect()), key=str) == exp
    assert {r[4] for r in exp} >= {"new", "weak", "continuation", "split_child", "reborn"}
    early, state = matcher.advance(matcher.empty(spark), *[f.filter("period < 3") for f in frames], 2)
    matcher.save(state, str(tmp_path / "state"))
    late, state = matcher.advance(matcher.load(spark, str(tmp_path / "state")), *[f.filter("period >= 3") for f in frames], 2)
    assert sorted(map(tuple, early.union(late).collect()), key=str) == exp
    assert {r.period for r in state.ids.select("period").distinct().collect()} == {3, 4, 5}


def test_corpora_go_through_their_periods_together(spark):
    cents = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 2, [0.99, 0.14]), (2, 3, [0.99, -0.14])], "period long, c long, u array<double>")
    none = spark.createDataFrame([], "period long, c long, chunk long, w double")
    rows, state = matcher.match_corpora({"a": (cents, none), "b": (cents.filter("period > 0"), none)}, matcher.empty(spark))
    got = {(r.corpus, r.period): (r.lineage, r.match_type) for r in rows.collect()}
    assert got["a", 2] == ("000000", "continuation") and got["b", 1] == ("000000", "new") and got["b", 2] == ("000000", "continuation")
    alone = {(r.period): (r.lineage, r.match_type) for r in matcher.match(cents, none).collect()}
    assert alone == {p: got["a", p] for p in range(3)}
    assert {r.corpus: r.next for r in state.numbers.collect()} == {"a": 1, "b": 1}
