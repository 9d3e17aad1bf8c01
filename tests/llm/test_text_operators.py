"""The text operators against brute force, over texts that are null, empty, long, tied or repeated."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from driftloom.llm import bpe, embeddings, jaccard, langid, linededup, lm, mixing, quality, secrets, substrings
from driftloom.llm.automaton import Dfa, Parser

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, N_LINES int, secrets string, decoded int"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    shared = line(60)
    texts = [None, "", " \t\n ", "one", "A\nB\na \nb", "éİß Σ ΑΣ", "\n" * 30]
    texts += ["\n".join([line(12) + ".", "Common Line!", line(rng.randint(1, 40))]) for _ in range(30)]
    texts += [line(40) + " " + shared + " " + line(30) for _ in range(6)]
    base = line(120).split()
    for _ in range(5):
        t = list(base)
        t[rng.randrange(120)] = "zz"
        texts.append(" ".join(t))
    texts += [" ".join(base)] * 3 + ["same same " * 60, line(5000), "password = 'abcdef1' AKIA" + "A" * 16 + " " + "a1" * 15 + " token: x; token=token: abcdef PASSWD:0123456"]
    rows = [(i, t, "en" if i % 2 else "fr", f"src{i % 3}", len(t or ""), 1, "x", 2) for i, t in enumerate(texts)]
    return [*rows, rows[10], rows[10], (None, texts[8], None, None, None, None, None, None), (-5, "the end", "en", "src0", 7, 0, "", 0)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def out(df):
    return sorted(map(tuple, df.collect()), key=str)


def words(t):
    return WORD.findall(t or "")


def test_secrets(docs, rows):
    a = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    exp = []
    for r in rows:
        t = r[1] or ""
        m = [[(x.start(), k, x.end()) for x in re.finditer(p, t) if ok(x)] for k, (p, ok) in enumerate(((a, lambda x: len(x[1]) >= 6), ("AKIA[A-Z0-9]+", lambda x: len(x[0]) >= 20), ("[0-9a-f]+", lambda x: len(x[0]) >= 24)))]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(sum(m, [])))
        exp.append((r[0], *map(len, m), hashlib.sha256(joined.encode()).hexdigest()))
    assert out(secrets.digest(docs).drop("spans")) == sorted(exp, key=str)
    assert secrets.scan(docs).columns.count("secrets") == 1


def test_automaton_agrees_with_re():
    rng = random.Random(1)
    for pattern in ("a(b|c)*d", "[a-c]{2,3}x?", "(ab|a)(bc)?", "x+y{0,2}"):
        dfa = Dfa([Parser(pattern).parse()], anywhere=False)
        for _ in range(300):
            s = "".join(rng.choices("abcdxy", k=rng.randint(0, 6)))
            state = 0
            for b in s.encode():
                state = dfa.next[state][b]
            assert bool(dfa.accepts[state]) == bool(re.fullmatch(pattern, s)), (pattern, s)


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_padding()
    t.no_truncation()
    exp = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        exp.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert out(bpe.digest(docs)) == sorted(exp, key=str)
    back = bpe.decode(bpe.encode(docs)).select("text", "ids", "decoded").collect()
    assert all(r.decoded == t.decode(r.ids, skip_special_tokens=False) for r in back)


def test_bpe_agrees_on_every_code_point():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(bpe.default_path()), bpe.Bpe(bpe.default_path())
    t.no_padding()
    t.no_truncation()
    texts = [f"a{chr(c)}B" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(texts), 50_000):
        now = texts[i : i + 50_000]
        for x, e in zip(now, t.encode_batch(now, add_special_tokens=False), strict=True):
            assert np.frombuffer(own.encode(x), "<u4").tolist() == e.ids, hex(ord(x[1]))


def test_jaccard(docs, rows):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (words(r[1]) for r in rows)]
    n, up = len(rows), list(range(len(rows)))
    links = [0] * n

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    comp = {}
    for i in range(n):
        if rows[i][0] is not None:
            comp[root(i)] = min(comp.get(root(i), rows[i][0]), rows[i][0])
    exp = [(rows[i][0], links[i], comp.get(root(i)) if rows[i][0] is not None else None, rows[i][0] is None or comp[root(i)] == rows[i][0]) for i in range(n)]
    assert out(jaccard.digest(docs)) == sorted(exp, key=str)
    kept = jaccard.distinct_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for *_, c, k in [(*e[:2], e[2], e[3]) for e in exp] if c is not None}) + 1


def test_jaccard_misses_as_few_as_stated():
    assert (jaccard.runs_for(0.8), jaccard.near_for(0.8)) == (24, 36)
    for t in (0.3, 0.5, 0.65, 0.8, 0.95, 1.0):
        runs, least = jaccard.runs_for(t), jaccard.near_for(t)
        assert jaccard.missed(t, jaccard.DEPTH, runs, t) <= 0.0015 and jaccard.missed(t, 1, runs, t) < 1e-6
        assert sum(math.comb(64, m) * t**m * (1 - t) ** (64 - m) for m in range(least)) <= 5e-6


@pytest.mark.parametrize("threshold", [0.5, 0.65, 0.8])
def test_jaccard_finds_pairs_at_any_threshold(spark, threshold):
    """Lone pairs of texts around the threshold, against exact Jaccard; pairs near nothing else lean on their own links alone."""
    rng = random.Random(int(100 * threshold))
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(400):
        a = [word() for _ in range(120)]
        b, i = list(a), 0
        while 1:  # words replaced until the pair is about at the threshold
            b[rng.randrange(120)] = word()
            x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
            if len(x & y) / len(x | y) < threshold + 0.08:
                break
        texts += [a, b]
    exp = 0
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        exp += len(x & y) >= threshold * len(x | y)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = jaccard.near_duplicates(df, threshold=threshold).filter("n_links > 0").count() / 2
    assert exp > 100 and exp * 0.99 <= got <= exp


def test_jaccard_splits_large_buckets(spark):
    """One large group of near texts and one of texts that share a passage alone, against brute force."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    base, shared, texts = [word() for _ in range(200)], [word() for _ in range(40)], []
    for _ in range(120):
        t = list(base)
        for p in rng.sample(range(200), rng.choice([1, 2, 3, 8])):
            t[p] = word()
        texts.append(t)
    texts += [[*shared, *[word() for _ in range(80)]] for _ in range(120)]
    found = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    links = [sum(i != j and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(found)) for i, a in enumerate(found)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard.digest(df).collect()}
    assert max(links) > jaccard.BUCKET and max(links[120:]) == 0
    recall = sum(got[i] for i in range(240)) / sum(links)
    assert all(got[i] <= links[i] for i in range(240)) and recall > 0.99


def test_jaccard_makes_each_path_once(spark, monkeypatch):
    """Rows of a large bucket that go down are made once, and as often as the group has members, not pairs."""
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    made, tables, real = spark.sparkContext.accumulator(0), [], jaccard.next_level

    def counted(rows, level, threshold):
        def run(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        tables.append(real(rows, level, threshold))
        return tables[-1].mapInArrow(run, tables[-1].schema)

    monkeypatch.setattr(jaccard, "next_level", counted)
    got = []
    for n in (100, 200):
        made.value = 0
        tables.clear()
        df = spark.createDataFrame([(i, " ".join([*shared, *[f"w{rng.randrange(10**6)}" for _ in range(60)]])) for i in range(n)], "doc_id long, text string")
        assert jaccard.digest(df).filter("n_links > 0").count() == 0
        assert made.value == sum(t.count() for t in tables) > 0
        got.append(made.value)
    assert got[1] < 3 * got[0]


def test_distinct_documents_goes_by_rows(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, a, 0), (5, a, 0), (5, b, 0), (7, c, 0), (7, c, 0), (7, c, 1), (8, "", 0), (8, "", 0), (None, a, 0), (None, a, 0)]
    kept = jaccard.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string, `a.b` int"))
    assert kept.columns == ["doc_id", "text", "a.b"]
    got = Counter((r[0], r[1]) for r in kept.collect())
    assert got == Counter({(1, a): 1, (5, b): 1, (7, c): 1, (8, ""): 2, (None, a): 2})


CLASHING = ["a.b", "stop", "rest", "epochs", "leaf", "mark", "n", "__id", "h", "row"]


def test_columns_of_clashing_names(spark, rows):
    few = [(*r[:5], *[7] * len(CLASHING)) for r in rows[5:25]]
    df = spark.createDataFrame(few, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING))
    every = [secrets.scan, bpe.encode, linededup.drop_lines, linededup.clean, quality.judge, quality.clean, substrings.drop_repeats, jaccard.distinct_documents, mixing.mixed]
    every.append(lambda d: langid.predict(d, langid.fit(d, "text", "lang", "doc_id")))
    every.append(lambda d: mixing.mix(d, ["lang", "source"], [{}, {}], 0.5))
    for f in every:
        made = f(df)
        assert [c for c in made.columns if c in df.columns] == [c for c in df.columns if c != "__id" or c in made.columns]
        assert all(r["a.b"] == r["stop"] == 7 for r in made.collect())
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for _, f in corpus_pipeline.STAGES:
        made = f(spark, df, "")
        assert all(r["a.b"] == r["epochs"] == 7 for r in made.collect())


def test_lm(docs, rows):
    tok = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for r in rows:
        if not held(r[0]):
            c.update(tok(r[1]))
    n, v = sum(c.values()), len(c)
    for top in (10**6, 40):
        got = {(r.doc_id, r.n_tokens): r for r in lm.score(docs, top=top).collect()}
        for r in rows:
            w = tok(r[1])
            x = got[r[0], len(w)]
            assert (x.held_out, x.n_known, x.train_tokens) == (held(r[0]), sum(c[k] > 0 for k in w), n)
            assert math.isclose(x.base_score, sum(math.log10((c[k] + 1) / (n + v + 1)) for k in w), rel_tol=1e-9)
            assert x.score < 0
    a, b = lm.Tables(12), ["ababab" * 50, "abab", "xyxq"]
    a.add([b[0].encode()] * 20)
    m = lm.Mixer(12, np.stack([lm.log_odds(t).ravel() for t in a.counts]))
    s = m.scores([x.encode() for x in b])
    assert s[1] > s[2]


def test_lines(docs, rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    c = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")})
    exp = []
    for r in rows:
        own = (r[1] or "").split("\n")
        kept = [x for x in own if not (key(x) and c[key(x)] >= 10)]
        exp.append((r[0], len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert out(linededup.digest(docs)) == sorted(exp, key=str)
    assert linededup.drop_lines(docs, min_docs=2).filter("n_dropped > 0").count() > 0
    few = linededup.SHARD_KEYS
    linededup.SHARD_KEYS = 3  # many shards, mapped from a file: the same result
    try:
        mapped = linededup.drop_lines(docs.select("doc_id", "text"), min_docs=2, most_bytes=50)
        assert out(mapped) == out(linededup.drop_lines(docs.select("doc_id", "text"), min_docs=2, most_bytes=1 << 30))
    finally:
        linededup.SHARD_KEYS = few


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    assert sorted(linededup.PerfectHash.build(keys).index(keys).tolist()) == list(range(len(keys)))


def test_lines_equal_in_half_their_hash_are_told_apart(spark):
    df = spark.createDataFrame([(5, 1, 10), (5, 2, 20), (5, 3, 30), (6, 1, 40)], "hi long, lo long, n long")
    rows = linededup.build_arrays(df, 1).collect()
    shards = linededup.Shards.of([(r.shard, r.levels, r.prints, r.counts) for r in rows], 1)
    assert shards.counts(np.array([5, 5, 5, 6, 6], np.uint64), np.array([1, 2, 3, 1, 2], np.uint64)).tolist() == [10, 20, 30, 40, 0]


def test_language(docs, spark):
    rng = random.Random(2)
    said = {"en": "the of and to in".split(), "fr": "le la de et les".split()}
    rows = [(i, " ".join(rng.choices(said[g], k=20)) + " zzz", g) for i in range(120) for g in [rng.choice("en fr".split())]]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 ...", "fr"), (902, "the", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.digest(df).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901)] == [("und", 0.0)] * 2 and got[902].lang_pred == "en"
    assert langid.digest(docs).count() == docs.count()


def test_language_against_brute_force(spark):
    rng = random.Random(9)
    said = {"en": "the of and to in house river".split(), "fr": "le la de et les maison fleuve".split(), "de": "der die und das haus fluß".split()}
    rows = []
    for i in range(200):
        g = rng.choice(sorted(said))
        rows.append((i, " ".join(rng.choices(said[g], k=rng.randint(1, 8)) + [rng.choice(["houses", "flüsse", "Zzz9", "½²"])]), rng.choice([g, g, g, None])))
    rows += [(300, "½ ² ①", "en"), (301, "Ⅷ", None), (302, "dieser", None), (None, "the house", "en")]
    letters = lambda t: "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split()
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts = [Counter() for _ in range(5)]  # of words, then of n-grams
    for i, t, g in rows:
        if g and not held(i):
            for w in letters(t):
                counts[0][w, g] += 1
                for n in range(1, 5):
                    counts[n].update((x, g) for x in grams(w, n))
    langs = sorted({g for c in counts for _, g in c})
    names = [{x for x, _ in c} for c in counts]
    under = [{g: sum(m for (_, h), m in c.items() if h == g) + 0.1 * len(own) for g in langs} for c, own in zip(counts, names, strict=True)]
    log = lambda n, x, g: math.log((counts[n][x, g] + 0.1) / under[n][g])

    def word(w, g):
        if w in names[0]:
            return log(0, w, g)
        for n in range(4, 0, -1):
            if own := [x for x in grams(w, n) if x in names[n]]:
                return sum(log(n, x, g) for x in own) / len(own) - langid.PENALTY * (5 - n)
        return 0.0

    got = {r.doc_id: r for r in langid.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        total = {g: sum(word(w, g) for w in letters(t)) for g in langs}
        best = max(langs, key=lambda g: total[g])
        exp = (best, 1 / sum(math.exp(total[g] - total[best]) for g in langs)) if letters(t) else ("und", 0.0)
        assert got[i].lang_pred == exp[0] and math.isclose(got[i].score, exp[1], rel_tol=1e-9), t


def test_language_ties_go_to_the_first(spark):
    rows = [(0, "same", "fr"), (1, "same", "de"), (4, "same", None)]
    assert {r.lang_pred for r in langid.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {"de"}


def test_quality(docs, rows):
    exp = []
    for r in rows:
        t, w = r[1] or "", words(r[1])
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {i + k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(8)}
        own = [x for x in t.split("\n") if WORD.search(x)]
        exp.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    assert out(quality.digest(docs).drop("kept")) == sorted(exp, key=str)
    assert quality.clean(docs).columns == docs.columns


def test_substrings(docs, rows):
    seen, removed, texts = {}, {}, {(r[0], r[1]) for r in rows}
    order = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0))
    for i, t in order:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 19):
            if seen.setdefault(tuple(w[p : p + 20]), (i, p)) != (i, p):
                gone[p : p + 20] = True
        removed[i, t] = (len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    assert out(substrings.digest(docs)) == sorted(((r[0], *removed[r[0], r[1]]) for r in rows), key=str)


def test_substrings_in_small_shards_and_a_mapped_bitmap(docs, monkeypatch):
    plain = out(substrings.drop_repeats(docs.select("doc_id", "text")))
    assert out(substrings.drop_repeats(docs.select("doc_id", "text"), most_bytes=0)) == plain
    df, made = docs.select("doc_id", "text"), substrings.runs_of(np.array([True] * 7 + [False] + [True] * 3))
    monkeypatch.setattr(substrings, "STRETCH", 3)
    assert made.tolist() == [[0, 7], [8, 3]] and substrings.stretches(np.array([True] * 7 + [False] + [True] * 3)) == [(0, 3), (3, 3), (6, 1), (8, 3)]
    monkeypatch.setattr(substrings, "SYMBOLS", 40)
    assert out(substrings.drop_repeats(df)) == plain


def test_a_very_long_text(spark):
    """A million words: each operator reads the whole of it."""
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(10**6))
    df = spark.createDataFrame([(1, text, "en", "src0", len(text)), (2, text, "en", "src1", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.n_words - r.n_removed for r in substrings.digest(df).orderBy("doc_id").collect()] == [10**6, 0]
    assert [r.n_links for r in jaccard.digest(df).collect()] == [1, 1] and all(r.n_tokens > 10**6 for r in bpe.digest(df).collect())
    assert all(r.n_tokens == 10**6 + 1 and r.score < 0 for r in lm.digest(df).collect())
    assert all(r.n_words == 10**6 for r in quality.digest(df).collect()) and linededup.digest(df).count() == 2


def test_embeddings_of_doubles(spark):
    rows = [(1, [1e300, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.93, math.sqrt(1 - 0.93**2) + 1e-9], 0), (4, [5e-324, 0.0], 0), (5, [0.0, 1e-300], 0)]
    got = {r.vec_id: r.n_links for r in embeddings.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 2, 5: 0}


def test_embeddings_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 8))
    x = (np.repeat(centre, 20, 0) + 0.1 * rng.normal(size=(800, 8))).astype(np.float32)
    for name, value in (("TILE", 16), ("BLOCK", 3), ("BINS", 5)):
        monkeypatch.setattr(embeddings, name, value)
    got = {r.vec_id: r.n_links for r in embeddings.digest(spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(800)[:, None] % 3 == np.arange(800)[None, :] % 3)
    assert [got[i] for i in range(800)] == (near.sum(1) - 1).tolist() and near.sum() > 1600


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:140] = x[0] + 0.05 * rng.normal(size=(40, 16))
    x[200:230] = x[1]
    vecs = [v.tolist() for v in x]
    rows = [(i, v, i % 2 if i < 100 else 0) for i, v in enumerate(vecs)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, vecs[0], None), (904, [None, *vecs[0][1:]], 0), (905, [1.0, 2.0], 0), (906, [1.0, 2.0], 0), (907, [], 1)]
    tile = embeddings.TILE
    embeddings.TILE = 32
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    finally:
        embeddings.TILE = tile
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[:300]])
    s = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(s, False)
    comp = np.arange(300)
    for _ in range(300):
        comp = np.minimum(comp, np.where(s, comp[None, :], 300).min(1))
    assert all(got[i] == (int(s[i].sum()), int(comp[i])) for i in range(300))
    assert all(got[i] == (0, i) for i in (900, 901, 902, 903, 904, 907)) and got[905] == got[906] == (1, 905)


def test_shares():
    assert mixing.shares(100, [(1, 1000), (3, 1000)]) == [25, 75]
    assert mixing.shares(100, [(1, 10), (1, 1000), (2, 1000)]) == [10, 30, 60]
    assert mixing.shares(100, [(1, 10), (1, 20)]) == [10, 20]
    sizes = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000}
    assert mixing.budgets(sizes, [{}, {}], 400, 1) == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}


def test_mixing(docs, rows):
    got = mixing.mix(docs, ["lang", "source"], [{"en": 3}, {}], 0.5, 2, 1).collect()
    sizes, used = Counter(), Counter()
    for r in got:
        sizes[r.lang, r.source] += r.n_tokens
        used[r.lang, r.source] += r.n_tokens * r.n_copies
    plan = mixing.budgets(sizes, [{"en": 3}, {}], int(sum(sizes.values()) * 0.5), 2)
    for k, b in plan.items():
        own = [r for r in got if (r.lang, r.source) == k]
        assert used[k] <= b
        over = [r.n_tokens for r in own if r.n_copies == b // max(1, sizes[k])]
        assert used[k] == b or not over or used[k] + max(over) * 3 > b
    assert mixing.mixed(docs).columns == docs.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (secrets.digest, bpe.digest, jaccard.digest, lm.digest, linededup.digest, langid.digest, quality.digest, substrings.digest, mixing.digest, quality.clean, linededup.clean, jaccard.distinct_documents, mixing.mixed):
        assert f(none).count() == 0, f
    assert embeddings.digest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    now = docs
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        new = f(spark, now, "")
        assert new.columns == docs.columns if i < 4 else new.columns == [*docs.columns, "ids"]
        now = new.cache()
    assert 0 < now.count() < docs.count() * 3


def test_lm_tables_grow_with_the_training_text():
    assert [lm.bits_for(n) for n in (10**8, 5 * 10**8, 3 * 10**10)] == [19, 21, 27]
    texts = [" ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta", "x1", "é"], k=50)).encode() for i in range(40)]
    tables = lm.Tables(18)
    tables.add(texts[:20])
    tables.add(texts[20:])
    dense, cells = np.zeros((lm.CONTEXTS, 16 << 18), np.uint32), 16 << lm.part_bits(18)
    for h, blob in tables.parts():
        at, n = lm.unpacked(blob)
        first = h & 0xFFFFFFFF
        dense[h >> 32, first * cells : (first + 1) * cells] += lm.spread(at.astype(np.uint64), n, first << lm.part_bits(18), lm.part_bits(18)).astype(np.uint32)
    assert (dense == tables.counts).all() and (dense.sum(1) == 2 * sum(len(t) + 1 for t in texts)).all()
    data, starts = lm.joined(texts)
    top = max(int(e.max()) for *_, e in lm.slots(data, starts, 30))
    assert 1 << 37 < top < 1 << 38


def test_lm_learns_through_the_whole_text():
    rng = random.Random(3)
    tables, plain = lm.Tables(12), " ".join(rng.choices(["one", "two", "three", "four"], k=3000))
    tables.add([plain.encode()] * 3)
    m = lm.Mixer(12, np.stack([lm.log_odds(t).ravel() for t in tables.counts]))
    text = " ".join(rng.choices(["one", "two", "five", "sieben"], k=3000)).encode()
    cost = [m.scores([text[:n]])[0] for n in (512, 1024, 8192, 8704)]
    assert cost[3] - cost[2] > (cost[1] - cost[0]) * 0.97
    both = m.scores([text, text[:700], b""])
    assert np.allclose(both, [m.scores([t])[0] for t in (text, text[:700], b"")], rtol=1e-5)


def plain_score(train: list[bytes], text: bytes) -> float:
    """The model of op4 bit by bit in plain Python, contexts told apart by what they are (no slots)."""
    space = b" \t\n\x0b\x0c\r"

    def contexts(t: bytes, i: int):
        back = lambda k: bytes(t[i - j] if i >= j else 0 for j in range(1, k + 1))
        first = i
        while first and t[first - 1] not in space:
            first -= 1
        return [(0, back(1)), (1, back(2)), (2, back(3)), (3, back(5)), (4, t[first:i])]

    seen: Counter = Counter()  # how often a node's bit was one or zero
    for t in train:
        t += lm.LAST_BYTE
        for i, byte in enumerate(t):
            for c in contexts(t, i):
                for b in range(8):
                    seen[c, b, byte >> 8 - b, byte >> 7 - b & 1] += 1
    t = text + lm.LAST_BYTE
    weight = [[lm.START / 16] * 8 for _ in range(5)]
    bias: Counter = Counter()
    squash = lambda z: 1 / (1 + math.exp(-max(-math.log(4095), min(math.log(4095), z))))
    cost = 0.0
    for start in range(0, len(t), lm.TOGETHER):
        steps, moved = [], {}
        for i in range(start, min(start + lm.TOGETHER, len(t))):
            for b in range(8):
                bit, sign = t[i] >> 7 - b & 1, 1 if t[i] >> 7 - b & 1 else -1
                x = []
                for c in contexts(t, i):
                    one, zero = (seen[c, b, t[i] >> 8 - b, v] for v in (1, 0))
                    x.append(max(-127, min(127, round(math.log((one + 0.4) / (zero + 0.4)) * 16))))
                z = sum(a * weight[k][b] for k, a in enumerate(x))
                cell = b, math.floor(max(-12, min(11, 2 * z)))
                p = squash((z + bias[cell]) * sign)
                cost += math.log10(p)
                moved[cell] = bias[cell] + (1 - p) * sign * lm.BIAS_RATE
                steps.append((b, x, (1 - p) * sign * lm.RATE / 256))
        bias.update({k: v - bias[k] for k, v in moved.items()})
        for b, x, e in steps:
            for k, a in enumerate(x):
                weight[k][b] += a * e
    return cost


def test_lm_score_agrees_with_plain_python():
    rng = random.Random(12)
    vocabulary = ["one", "two", "three", "é", "Four", "five\n"]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n)).encode()
    train, texts = [make(40) for _ in range(6)], [make(30), make(1), b"", b"unseen words \x00 here", make(5)]
    tables = lm.Tables(20)
    tables.add(train)
    m = lm.Mixer(20, np.stack([lm.log_odds(x).ravel() for x in tables.counts]))
    assert np.allclose(m.scores(texts), [plain_score(train, t) for t in texts], rtol=1e-4)
