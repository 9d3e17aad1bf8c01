"""Language identification by words first, shorter and shorter character n-grams for the rest.

A word of the model scores its log frequency in each language. A word that the model doesn't hold scores the mean over
its known character n-grams of the longest order that has any, less a penalty for each order given up. A text's language
has the largest sum; ties go to the language that sorts first.

The model is fitted on a bounded, documented sample of the labelled rows: at most about ``fit_docs`` texts a language,
those with the smallest hash of key and text. It holds every word and n-gram of these texts, as the languages that have
it and their logs, so its size is bounded by the sample, and it is broadcast. Every text is predicted whole.

Defined results: ``und`` with score 0 for a text that is null or has no letter, or if nothing could be learned; rows that
repeat get one prediction each; an empty table gives an empty table; clashing column names are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.common import in_batches, map_rows, named, small_batches, stored, without

#: The numerals that are no decimal digits, which \w takes in although they are no letters.
NUMERALS = [c for c in range(0x110000) if unicodedata.category(chr(c)) in ("Nl", "No")]
BLANKED = dict.fromkeys(NUMERALS, " ")
#: Finds those in the basic plane, or any code point beyond it: a class that is one bit map is fast.
MAY_HOLD_NUMERALS = re.compile("[" + "".join(chr(c) for c in NUMERALS if c < 0x10000) + "\U00010000-\U0010ffff]")
#: Runs of letters (Unicode category L), once numerals are blanked.
LETTERS = re.compile(r"[^\W\d_]+")
ORDER = 4
#: What a word loses in natural log for each shorter order that it falls back to.
PENALTY = 1.0
#: Numbers that a worker keeps of words already looked up.
CACHED = 1 << 22
#: Distinct words that a task counts before it hands them on.
HELD = 300_000


def words_of(text: str) -> list[str]:
    text = text.lower()
    return LETTERS.findall(text.translate(BLANKED) if MAY_HOLD_NUMERALS.search(text) else text)


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Logs:
    """Log frequencies of names by language: those of the languages that have a name, a common one for each of the others."""

    def __init__(self, names: list[str], bounds: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int):
        """Name i has the entries bounds[i] to bounds[i + 1] of langs and counts, one for each language that has it."""
        under = np.bincount(langs, counts, n_langs) + 0.1 * max(1, len(names))
        self.none = np.log(0.1 / under)
        self.names, self.bounds, self.langs = names, bounds, langs
        self.more = np.log((counts + 0.1) / under[langs]) - self.none[langs]

    def __getstate__(self) -> dict:
        """Names hold letters and spaces alone, so that one string carries them all."""
        return self.__dict__ | {"names": "\n".join(self.names), "at": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.names = self.names.split("\n") if self.names else []

    def known(self) -> dict[str, int]:
        if (at := self.__dict__.get("at")) is None:
            self.at = at = dict(zip(self.names, range(len(self.names)), strict=True))
        return at

    def means(self, groups: list[list[int]]) -> np.ndarray:
        """For each group of names, the mean of their logs by language."""
        n = np.array([len(g) for g in groups])
        own = np.array([x for g in groups for x in g], np.int64)
        first, size = self.bounds[own], self.bounds[own + 1] - self.bounds[own]
        entry = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        at = np.repeat(np.repeat(np.arange(len(groups)), n), size) * len(self.none) + self.langs[entry]
        more = np.bincount(at, self.more[entry], len(groups) * len(self.none)).reshape(len(groups), -1)
        return self.none + more / n[:, None]


class LanguageModel:
    def __init__(self, langs: list[str], orders: list[Logs]):
        """orders: of words, then of n-grams of 1 to ORDER letters."""
        self.langs, self.orders = langs, orders
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))

    def scored(self, words: list[str]) -> np.ndarray:
        """What each word adds to each language."""
        out = np.zeros((len(words), len(self.langs)))
        at = self.orders[0].known()
        known = [(i, k) for i, w in enumerate(words) if (k := at.get(w)) is not None]
        if known:
            out[[i for i, _ in known]] = self.orders[0].means([[k] for _, k in known])
        left = [i for i, w in enumerate(words) if w not in at]
        for n in range(ORDER, 0, -1):
            at = self.orders[n].known()
            groups = [[k for g in grams_of(words[i], n) if (k := at.get(g)) is not None] for i in left]
            if found := [i for i, g in zip(left, groups, strict=True) if g]:
                out[found] = self.orders[n].means([g for g in groups if g]) - PENALTY * (ORDER - n + 1)
            left = [i for i, g in zip(left, groups, strict=True) if not g]
        return out

    def learn(self, counts: list[Counter]) -> None:
        """Looks up the words that aren't at hand; all are forgotten first where there are too many."""
        new = list({w: None for c in counts for w in c if w not in self.place})
        if (len(self.place) + len(new)) * len(self.langs) > CACHED:
            self.place.clear()
            self.rows = self.rows[:0]
            new = list({w: None for c in counts for w in c})
        if new:
            self.rows = np.concatenate([self.rows, *(self.scored(new[i : i + 50_000]) for i in range(0, len(new), 50_000))])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts = [Counter(words_of(t)) if t and self.langs else Counter() for t in texts]
        self.learn(counts)
        out = []
        for c in counts:
            if not c:
                out.append(("und", 0.0))
                continue
            at = np.fromiter(map(self.place.__getitem__, c), np.int64, len(c))
            total = np.fromiter(c.values(), np.float64, len(c)) @ self.rows[at]
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def fit(df: DataFrame, text: str, lang: str, key: str, fit_docs: int = 3000) -> LanguageModel:
    """The model of the labelled rows of df; key and text decide whether a row is of the sample."""
    df = df.filter(named(text).isNotNull() & named(lang).isNotNull())
    sizes = {r[0]: r[1] for r in df.groupBy(named(lang).alias("lang")).count().collect()}  # one row a language
    if not sizes:
        return LanguageModel([], [])
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, fit_docs / n)))])
    unit = F.pmod(F.xxhash64(named(key), named(text)), F.lit(1 << 30)) / float(1 << 30)
    langs = sorted(sizes)
    number = {x: i for i, x in enumerate(langs)}
    # the sample is small, whatever files it comes from, so it is dealt out before it is counted
    sample = df.filter(unit < F.element_at(share, named(lang))).select(named(lang).alias("lang"), named(text).alias("text")).repartition(F.xxhash64("text"))

    def count_words(batches):
        seen: dict[int, Counter] = {}
        for labels, texts in batches:
            for own, t in zip(labels, texts, strict=True):
                seen.setdefault(number[own], Counter()).update(words_of(t))
            if sum(map(len, seen.values())) > HELD:
                yield from counted_rows(seen)
                seen = {}
        yield from counted_rows(seen)

    def counted_rows(seen: dict[int, Counter]):
        for own, c in seen.items():
            yield [[own] * len(c), list(c), list(c.values())]

    def count_grams(batches):
        for own, words, times in batches:
            seen: Counter = Counter()
            for g, w, k in zip(own, words, times, strict=True):
                for n in range(1, ORDER + 1):
                    for x in grams_of(w, n):
                        seen[g, n, x] += k
            yield [[k[0] for k in seen], [k[1] for k in seen], [k[2] for k in seen], list(seen.values())]

    words = map_rows(sample, [F.col("lang"), F.col("text")], count_words, "lang int, name string, n long").groupBy("name", "lang").agg(F.sum("n").alias("n"))
    words = stored(words)
    grams = map_rows(words, [F.col("lang"), F.col("name"), F.col("n")], count_grams, "lang int, size int, name string, n long")
    entries = stored(words.withColumn("size", F.lit(0)).unionByName(grams).groupBy("size", "name", "lang").agg(F.sum("n").alias("n")))

    def order(size: int) -> Logs:
        own = entries.filter(F.col("size") == size).select("name", "lang", "n").toArrow()  # bounded by the sample
        coded = own.column("name").combine_chunks().dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        by = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[by], np.arange(len(names) + 1))
        return Logs(names, bounds, own.column("lang").to_numpy()[by].astype(np.int32), own.column("n").to_numpy()[by].astype(np.float64), len(langs))

    return LanguageModel(langs, [order(n) for n in range(ORDER + 1)])


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """df with lang_pred and score; nothing but the text is looked at."""
    small_batches(df.sparkSession)
    df = without(df, "lang_pred", "score")
    place = df.columns.index(text)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            made = sent.value.predict(b.column(place).to_pylist())
            cols = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "lang_pred", "score"])

    return in_batches(df, run, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(fold: int, of: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(False))


def digest(df: DataFrame) -> DataFrame:
    """The columns of op6."""
    model = fit(df.filter(~held_out(2, 4)), "text", "lang", "doc_id")
    rows = df.select("doc_id", held_out(2, 4).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
