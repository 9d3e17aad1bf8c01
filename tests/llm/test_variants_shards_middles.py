"""Spelling variants, sharding and fill-in-the-middle against brute force, over null, empty, long, tied and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from driftloom.llm import fim, queries, sharding, spelling

SCHEMA = "doc_id long, text string, N int, Shard string, output int, root string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    stems = ["".join(rng.choices("abcdeé", k=rng.randint(5, 9))) for _ in range(60)]

    def varied(w):
        i = rng.randrange(len(w))
        return w if rng.random() < 0.8 else (w[:i] + rng.choice("abxÿ") + w[i + rng.randint(0, 1) :])

    texts = [None, "", " \n", "\0", "<P> text", "a<S", "<<M>>", "x" * 70_000, "é" * 9 + "𝒳€ A", "Ünï×÷cØde ÅSTRÖM"]
    texts += [" ".join(varied(rng.choice(stems)).upper() if rng.random() < 0.1 else varied(rng.choice(stems)) for _ in range(rng.randint(1, 300))) for _ in range(80)]
    texts += ["".join(rng.choices("ab<PSM>é€𝒳 \n", k=rng.randint(1, 60))) for _ in range(300)]
    out = [(i, t, 1, "s", 2, "r") for i, t in enumerate(texts)]
    return [*out, out[12], out[12], out[3], (None, texts[11], None, None, None, None), (None, None, None, None, None, None), (5, "another text of number five", 0, "", 0, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def out(df):
    return sorted(map(tuple, df.collect()), key=str)


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return any(u == v[:i] + v[i + 1 :] for i in range(len(v)))


def test_spelling_variants(docs, rows):
    counts = Counter()
    for k, t, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    others = {w: sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x)) for w in words}
    form = {w: x[0] if x and words[x[0]] >= 5 * words[w] else None for w, x in others.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    exp = [(w, form[w], root(w), n, len(others[w]), words.get(form[w])) for w, n in words.items()]
    assert sum(f is not None for f in form.values()) > 10
    assert out(spelling.digest(docs)) == sorted(exp, key=str)


def test_spelling_chains(spark):
    words = spark.createDataFrame([("aaaaaa", 1), ("aaaaab", 5), ("aaaabb", 25), ("aaabbb", 125), ("aabbbb", 125), ("zzzzzz", 3), ("zzzzzy", 14)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.forms(words).collect()}
    assert got["aaaaaa"] == ("aaaaab", "aaabbb", 1) and got["aaaabb"] == ("aaabbb", "aaabbb", 2)
    assert got["aaabbb"] == (None, "aaabbb", 2) and got["zzzzzz"] == (None, "zzzzzz", 1)


@pytest.mark.parametrize(("min_chars", "most"), [(4, 6), (4, 10_000), (0, 7), (1, 9)])
def test_split_parts_lose_no_pair(spark, min_chars, most):
    rng = random.Random(most)
    words = {"".join(rng.choices("ab", k=rng.randint(4, 8))) for _ in range(200)} | {"aaaa" + "".join(rng.choices("abc", k=rng.randint(0, 3))) for _ in range(80)}
    got = out(spelling.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), min_chars, most).select("word", "near"))
    assert got == sorted(((u, v) for u in words for v in words if near(u, v)), key=str)


def test_trie_walks_past_edits_in_every_place():
    rng = random.Random(4)
    for _ in range(200):
        words = sorted({"".join(rng.choices("abcé", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 50))})
        pairs = [(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if near(u, v)]
        assert sorted(spelling.Trie(words).near()) == pairs
        for k in (1, 3):
            assert {x for x in pairs if words[x[0]][:k] != words[x[1]][:k]} <= set(spelling.Trie(words).near(k))


def test_sharding(spark, docs, rows):
    got = sharding.digest(docs).collect()
    assert len(got) == len(rows)
    base = sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str)
    assert base == sorted(((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows), key=str)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(16)]
    assert set(slots) == set(range(16)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.digest(docs.repartition(7, "N")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_sharding_numbers_rows_in_order_and_places_are_computable(docs, rows):
    got = sharding.assign(docs.select("doc_id", "Shard", "N"), ["doc_id"], 5, "x").collect()
    got.sort(key=lambda r: r.row_number)
    assert [r.row_number for r in got] == list(range(len(rows)))
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    shard, slot = sharding.place(np.arange(len(rows)), len(rows), 5, "x")
    assert [(r.shard, r.slot) for r in got] == list(zip(shard.tolist(), slot.tolist(), strict=True))
    assert sharding.row_at(shard, slot, len(rows), 5, "x").tolist() == list(range(len(rows)))


def test_sharding_with_one_key_for_all(spark):
    df = spark.range(1000).selectExpr("cast(1 as long) AS doc_id", "'same' AS text")
    got = sharding.digest(df).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [62] * 8 + [63] * 8


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = sharding.Permutation(n, "seed")
    y = p.of(np.arange(n))
    assert sorted(y.tolist()) == list(range(n)) and p.back(y).tolist() == list(range(n))
    assert n < 1000 or (y != sharding.Permutation(n, "other").of(np.arange(n))).mean() > 0.9


def test_written_shards(spark, docs, rows, tmp_path):
    sharding.write_shards(sharding.assign(docs.drop("N"), ["doc_id", "text"], 4), f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == sorted(len(range(i, len(rows), 4)) for i in range(4))
    assert sorted(str(r.text) for r in back.collect()) == sorted(str(r[1]) for r in rows)


def test_fill_in_middle(docs, rows):
    exp = []
    for k, t, *_ in rows:
        t = t or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        n = len(units)
        digest = hashlib.sha256(f"1:{'' if k is None else k}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        made = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        plain = form == "plain"
        exp.append((k, n, form, None if plain else len(p), None if plain else len(m), hashlib.sha256(made.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert {e[2] for e in exp} == {"plain", "psm", "spm"}
    assert out(fim.digest(docs)) == sorted(exp, key=str)
    kept = fim.restore(fim.transform(docs))
    assert kept.columns.count("output") == 1 and all(r.restored == (r.text or "") for r in kept.collect())


def test_fill_in_middle_forgets_where_it_began():
    s = fim.Scanner()
    assert s.warm <= 4
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer("ab<PSM>é€𝒳\n".encode(), np.uint8), 10_000).tobytes()
    state, exp = 0, []
    for b in data:
        exp.append(int(s.marks[state * 256 + b]))
        state = int(s.after[state * 256 + b])
    assert s.scan(data).tolist() == exp


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_sharding", "op13_fill_in_middle"])
def test_empty_tables_and_sql(spark, docs, tmp_path, name):
    for where, df in (("none", docs.limit(0)), ("some", docs.filter("doc_id IS NOT NULL"))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{where}/documents.parquet")
        got = queries.queries()[name](spark, f"{tmp_path}/{where}")
        assert (got.count() == 0) == (where == "none")
        if sql := queries.oracle_sql().get(name):
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{where}/documents.parquet/*.parquet'")
            cur = con.execute(sql)
            names = [c[0] for c in cur.description]
            assert sorted(names) == sorted(got.columns)
            assert out(got.select(*names)) == sorted(cur.fetchall(), key=str)
