"""The whole pipeline against a plain Python version of its five stages."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
import regex
import xxhash

from driftloom.llm import bpe, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    rng = random.Random(11)
    known = [f"word{i}" for i in range(400)]
    line = lambda n, end=".": " ".join(rng.choices(known, k=n)) + end
    texts = [None, "", "too short.", "same word " * 40]
    for i in range(90):
        own = [line(rng.randint(8, 25)) for _ in range(rng.randint(2, 6))]
        if i % 3 == 0:
            own.insert(1, "Shared By Many.")
        if i % 4 == 0:
            own.append("  shared by MANY.  ")
        if i % 5 == 0:
            own.append(line(15, ""))  # no end of a sentence
        if i % 7 == 0:
            own += ["Home | News | About", "Click here to subscribe to us", "#### $$ ||", "BUY NOW! CHEAP! FAST! HURRY!", ""]
        texts.append("\n".join(own))
    texts += ["\n".join([line(9), *[line(30, "") for _ in range(4)]]) for _ in range(3)]  # lose too much
    base = line(200).split()
    for k in (0, 0, 1, 3, 20, 60):
        t = list(base)
        for p in rng.sample(range(200), k):
            t[p] = "other"
        texts.append(" ".join(t))
    texts += texts[10:20]
    return [(i, t, rng.choice(["en", "en", "de", "fr", None]), rng.choice([f"src{j}" for j in range(20)] + ["src0"] * 10 + [None]), None if t is None else len(t)) for i, t in enumerate(texts)]


def words(t):
    return WORD.findall(t or "")


def good_lines(rows):
    for i, t, lang, source, _ in rows:
        w, lines = words(t), (t or "").split("\n")
        seen = Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
        twice = {p + k for p in range(len(w) - 7) if seen[tuple(w[p : p + 8])] > 1 for k in range(8)}
        kept, lost = [], 0
        for x in lines:
            own = words(x)
            n, sym, nav = len(own), len(re.findall(r"[#*$%&|<>]", x)), len(re.findall("[|»›•·]", x))
            bad = n > 0 and (
                (sym > 0 and 4 * sym >= n)
                or (nav >= 2 and 5 * nav >= n)
                or (n >= 4 and not regex.search(r"\p{Ll}", x) and bool(regex.search(r"\p{Lu}", x)) and x.count("!") >= n)
                or (n >= 12 and not re.search(quality.ENDS, x))
                or (n <= 15 and bool(re.search(quality.BOILERPLATE, x)))
            )
            if bad:
                lost += sum(map(len, own))
            else:
                kept.append(x)
        if len(w) >= 20 and 100 * len(twice) <= 30 * len(w) and 2 * lost <= sum(map(len, w)):
            clean = "\n".join(kept)
            yield i, clean, lang, source, len(clean)


def rare_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    often = Counter(k for r in rows for k in {key(x) for x in r[1].split("\n")})
    for i, t, lang, source, n in rows:
        own = t.split("\n")
        kept = [x for x in own if not key(x) or often[key(x)] < 10]
        yield i, "\n".join(kept), lang, source, n if len(kept) == len(own) else len("\n".join(kept))


def distinct(rows):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} or {tuple(w)} - {()})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return [r for g, r in zip(group, rows, strict=True) if rows[g] is r]


def leaf_budgets(tree, budget, level):
    """tree: nested dicts down to whole numbers of tokens; the budget of each path, by the level at which all are filled."""
    if isinstance(tree, int):
        return {(): budget}
    room = lambda t: t if isinstance(t, int) else sum(map(room, t.values()))
    names = sorted(tree, key=lambda x: (x is None, x))
    cap = {x: mixing.EPOCHS * room(tree[x]) for x in names}
    weight = {x: Fraction(mixing.WEIGHTS[level].get(x, 1)) for x in names}
    left, given, open_ = min(budget, sum(cap.values())), dict.fromkeys(names, 0), [x for x in names if cap[x]]
    while open_:
        unit = Fraction(left) / sum(weight[x] for x in open_)
        full = [x for x in open_ if unit * weight[x] >= cap[x]]
        if not full:
            marks = [0, *[int(unit * sum(weight[x] for x in open_[: k + 1])) for k in range(len(open_))]]
            given |= {x: marks[k + 1] - marks[k] for k, x in enumerate(open_)}
            break
        given |= {x: cap[x] for x in full}
        left -= sum(cap[x] for x in full)
        open_ = [x for x in open_ if x not in full]
    return {(x, *path): b for x in names for path, b in leaf_budgets(tree[x], given[x], level + 1).items()}


def mixture(rows):
    leaf = lambda r: (mixing.DOMAINS.get(r[3], "other"), r[2], r[3])
    size = Counter()
    for r in rows:
        size[leaf(r)] += len(words(r[1]))
    tree: dict = {}
    for (a, b, c), n in size.items():
        tree.setdefault(a, {}).setdefault(b, {})[c] = n
    for path, b in leaf_budgets(tree, int(sum(size.values()) * mixing.SHARE), 0).items():
        if not size[path]:
            continue
        epochs, rest = divmod(b, size[path])

        def order(r, epochs=epochs):
            mark = xxhash.xxh64_intdigest(r[1].encode(), 42)
            return hashlib.md5(f"{mixing.SEED}:{epochs}:{r[0]}:{mark - (mark >> 63 << 64)}".encode()).hexdigest()

        used, whole = 0, rest > 0
        for r in sorted((r for r in rows if leaf(r) == path), key=order):
            used += len(words(r[1]))
            whole = whole and used <= rest
            yield from [r] * (epochs + whole)


def test_run_agrees_with_plain_python(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    passed = list(good_lines(rows))
    trimmed = list(rare_lines(passed))
    single = distinct(trimmed)
    mixed = list(mixture(single))
    assert len(rows) > len(passed) > len(single) and any(a != b for a, b in zip(passed, trimmed, strict=True)) and set(mixed) < set(single)
    t = Tokenizer.from_file(bpe.default_path())
    t.no_padding()
    t.no_truncation()
    expected = Counter((*r, tuple(t.encode(r[1], add_special_tokens=False).ids)) for r in mixed)
    got = Counter((*r[:5], tuple(r[5])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == expected
