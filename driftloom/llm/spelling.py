"""Spelling variants: words at edit distance one, found by joining tries of the vocabulary with themselves.

Words are counted in every text, partly in each task. The vocabulary is partitioned by prefixes: each part is a trie, and every
node on a walk through it carries its active nodes, which are the nodes whose strings are at distance one at most. A step down
makes them from those of the parent: the parent itself (a letter deleted), the brothers (a letter replaced), the children
(a letter inserted), and those active nodes that can take the same letter. Where a word ends, the active nodes at distance
one at which words end are its near words. A walk ends early where a word has no company left.

Two words at distance one share all letters before the edit and all after it, so they begin or end alike for half of their
letters. Words of at least m letters are therefore put in two parts each: that of their first m // 2 letters, and that of
their last m // 2, whose trie stands on what comes before these. The second kind passes over pairs that share their first
m // 2 letters, as the first kind has them. A part of more than ``most`` words is split in the same manner, by the next letter and by the last
but those, until none is left; words that have one letter or none between what they share stay together, and there
are no more of these than letters. So no task holds more than a bounded part, and no pair is lost.

Defined results: a null text has no words; a null key stands as the empty string in the checksum; a word left with no letters
is none; repeated rows count as often as they stand; texts and words of any length are read whole; an empty table gives an
empty table. Only the vocabulary is returned, so columns of df can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import map_rows, named, stored

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
#: A run loses a letter if this divides its checksum.
NOISE = 199
MIN_CHARS, MIN_COUNT = 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5
#: Words of a part, beyond which it is split.
MOST = 20_000
#: Distinct words that a task counts before it hands them on.
HELD = 300_000


def lowered(text: str) -> str:
    """A-Z alone in lower case."""
    return text.encode().lower().decode()


def words_of(text: str | None, key: object, min_chars: int) -> dict[str, int]:
    """The words of a text with their counts, runs that the checksum picks less a letter."""
    out: Counter[str] = Counter()
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    for run, n in Counter(RUNS.findall(lowered(text))).items() if text else ():
        h = zlib.crc32(run.encode(), start)
        if h % NOISE == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        if len(run) >= min_chars:
            out[run] += n
    return out


def vocabulary(df: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough in all texts together."""

    def run(batches):
        seen: Counter[str] = Counter()
        for texts, keys in batches:
            for t, k in zip(texts, keys, strict=True):
                for w, n in words_of(t, k, min_chars).items():
                    seen[w] += n
                if len(seen) >= HELD:
                    yield [list(seen), list(seen.values())]
                    seen.clear()
        if seen:
            yield [list(seen), list(seen.values())]

    counted = map_rows(df, [named(text), named(key)], run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Trie:
    """A trie over sorted strings: a node is the range of strings that begin alike, and how many letters these share."""

    def __init__(self, words: list[str]):
        self.words, self.known = words, {}

    def children(self, node: tuple[int, int, int]) -> dict[str, tuple[int, int, int]]:
        lo, hi, depth = node
        if hi - lo == 1:
            own = self.words[lo]
            return {own[depth]: (lo, hi, depth + 1)} if depth < len(own) else {}
        if (out := self.known.get(node)) is None:
            out, i = {}, lo
            while i < hi:
                own = self.words[i]
                if depth >= len(own):
                    i += 1
                    continue
                c, first, step = own[depth], i, 1
                while i + step < hi and self.words[i + step][depth] == c:  # ever longer steps, then shorter ones
                    i, step = i + step, step * 2
                while step:
                    if i + step < hi and self.words[i + step][depth] == c:
                        i += step
                    step //= 2
                i += 1
                out[c] = (first, i, depth + 1)
            self.known[node] = out
        return out

    def ends(self, node: tuple[int, int, int]) -> int | None:
        """The string that ends at node."""
        return node[0] if len(self.words[node[0]]) == node[2] else None

    def near(self, apart: int = 0) -> Iterator[tuple[int, int]]:
        """(i, j) of all strings at distance one, both ways; if apart > 0, edits after so many letters may be left out."""
        root = (0, len(self.words), 0)
        todo = [(root, frozenset(self.children(root).values()))]
        while todo:
            node, active = todo.pop()
            own = self.ends(node)
            if own is not None:
                for v in active:
                    if (j := self.ends(v)) is not None:
                        yield own, j
            fresh = not apart or node[2] < apart  # may the edit be here
            for c, child in self.children(node).items():
                now = {v[c] for a in active if c in (v := self.children(a))}
                if fresh:
                    now.add(node)
                    now.update(self.children(node).values())
                    if not apart or child[2] < apart:
                        now.update(self.children(child).values())
                    now.discard(child)
                if child[1] - child[0] > 1 or any(v[1] - v[0] > 1 or v[0] != child[0] for v in now):
                    todo.append((child, now))


KEYS = ["a", "b", "apart", "short", "head", "tail"]


def parts(words: DataFrame, min_chars: int, most: int) -> DataFrame:
    """words, each in the parts it has near words in: a letters before and b after are shared, pairs differ in the first apart.

    core: what lies between. Each round splits the parts of over most words; it is stored, as the next one reads it twice.
    """
    size = min_chars // 2
    n = F.length("word")

    def shared(df: DataFrame) -> DataFrame:
        a, b = F.col("a"), F.col("b")
        return df.select(
            "word", "n", "a", "b", "apart", "short",
            F.substr("word", F.lit(1), a).alias("head"), F.substr("word", n - b + 1, b).alias("tail"), F.substr("word", a + 1, n - a - b).alias("core"),
        )

    def kinds(*of: tuple) -> Column:
        return F.inline(F.array(*[F.struct(*[F.lit(x).cast(t).alias(k) for x, k, t in zip(v, ("a", "b", "apart", "short"), ("int", "int", "int", "boolean"), strict=True)]) for v in of]))

    if size:
        now = shared(words.select("word", "n", kinds((size, 0, 0, False), (0, size, size, False))))
    else:
        now = shared(words.select("word", "n", kinds((0, 0, 0, False))))
    done = None
    while True:
        now = stored(now)
        first, last = F.substr("core", F.lit(1), F.lit(1)), F.substr("core", F.length("core"), F.lit(1))
        sizes = now.groupBy(*KEYS).agg(F.count("*").alias("size"), F.min(first).alias("f0"), F.max(first).alias("f1"), F.min(last).alias("l0"), F.max(last).alias("l1"))
        large = sizes.filter((F.col("size") > most) & ~F.col("short"))
        if large.isEmpty():
            return now if done is None else done.union(now)
        rest = now.join(large.select(*KEYS), KEYS, "left_anti").select(*now.columns)
        done = rest if done is None else done.union(rest)
        split = now.join(large, KEYS)
        # all begin or all end alike: nothing is told apart, so the words stay one part, with more of them shared
        alike = (F.col("f0") == F.col("f1")) & (F.col("f0") != "")
        alike_end = (F.col("l0") == F.col("l1")) & (F.col("l0") != "") & ~alike
        some = F.length("core") > 0
        a, b, apart = F.col("a"), F.col("b"), F.col("apart")

        def kind(a: Column, b: Column, apart: Column, short: bool, when: Column) -> Column:
            return F.when(when, F.struct(a.alias("a"), b.alias("b"), apart.cast("int").alias("apart"), F.lit(short).alias("short")))

        branches = F.array_compact(F.array(
            kind(a + 1, b, apart, False, some & ~alike_end & ((apart == 0) | (a + 1 < apart))),
            kind(a, b + 1, F.when(alike_end, apart).when(apart == 0, a + 1).otherwise(F.least(apart, a + 1)), False, some & ~alike),
            kind(a, b, apart, True, (F.length("core") <= 1) & ~alike & ~alike_end),
        ))
        now = shared(split.select("word", "n", F.explode(branches).alias("k")).select("word", "n", "k.*"))


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n) of all words at distance one, both ways; words(word, n) has at least min_chars letters a word."""
    dealt = parts(words, min_chars, most).repartition(*KEYS).sortWithinPartitions(*KEYS, "core")

    def found(cores: list[str], rows: list[tuple], a: int, apart: int) -> Iterator[tuple]:
        if len(rows) > 1:
            for i, j in Trie(cores).near(max(apart - a, 0)):
                if not apart or rows[i][0][:apart] != rows[j][0][:apart]:
                    yield *rows[i], *rows[j]

    def run(batches):
        at, cores, rows = None, [], []
        for batch in batches:
            made: list[tuple] = []
            for *key, core, word, n in zip(*batch, strict=True):
                if key != at:
                    if at:
                        made.extend(found(cores, rows, at[0], at[2]))
                    at, cores, rows = key, [], []
                cores.append(core)
                rows.append((word, n))
            if made:
                yield list(zip(*made, strict=True))
        if at and (made := list(found(cores, rows, at[0], at[2]))):
            yield list(zip(*made, strict=True))

    return map_rows(dealt, [F.col(c) for c in (*KEYS, "core", "word", "n")], run, "word string, n long, near string, near_n long")


def forms(words: DataFrame, min_chars: int = MIN_CHARS, times: int = TIMES, most: int = MOST) -> DataFrame:
    """words(word, n) with n_near, form, form_n and root."""
    near = near_words(words, min_chars, most)
    first = F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near").alias("near")))
    known = near.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    chosen = -F.col("first.down") >= F.col("n") * times
    all_words = stored(
        words.join(known, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(chosen, F.col("first.near")).alias("form"), F.when(chosen, -F.col("first.down")).alias("form_n"),
        )
    )
    # forms of forms, twice as far in each round; counts grow along the way, so there is no circle
    up = all_words.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return all_words.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def digest(df: DataFrame) -> DataFrame:
    """The columns of op11."""
    words = stored(vocabulary(df))
    return forms(words).select("word", "form", "root", "n", "n_near", "form_n")
