"""Quality rules, line first.

Each line is held against punctuation, decoration, navigation, shouting and boilerplate rules; lines that fail are
removed; a document goes if it fails the base rules or loses more than ``max_loss`` of its characters.

Everything is a DataFrame expression over one row at a time: no shuffle, no Python, memory bounded by the longest text.

Defined results: a null text counts as an empty one (no words, base_failed); an empty table gives an empty table;
repeated rows are judged alike; the added struct replaces an input column of the same name, other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import SPACE, columns_of, without

#: Phrases of lines that say nothing of a document's subject; such a line fails if it has at most BOILERPLATE_WORDS words.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy|"
    r"we use cookies|enable javascript|click here|sign (in|up)|log ?in|subscribe to|powered by|follow us|share this)\b"
)
BOILERPLATE_WORDS = 15
SYMBOLS = "[#*$%&|<>]"
ENDS = r"[.!?;:…。！？؟।]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for the row however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def count_of(pattern: str, text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeat_words(words: Column, width: int = 8) -> Column:
    """How many words stand in windows of width words that the text holds twice or more.

    Windows are compared by 64-bit hash within the one text. The sort runs only for texts that hold such a window.
    """

    def covered(places: Column) -> Column:
        def step(p, i):
            return F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - p, F.lit(width)))

        return F.aggregate(F.transform(places, step), F.lit(0), lambda a, x: a + x).cast("long")

    def repeated(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            near = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            same = F.filter(s, lambda x, j: near(x, j - 1) | near(x, j + 1))
            return let(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

        return let(pairs, twice)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated(h)))

    return let(words, lambda w: F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(windows(w)))


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails a rule."""
    n = F.size(words_of(line))
    symbols = count_of(SYMBOLS, line)
    decorated = symbols * 4 >= n
    navigation = (count_of(r"[|»›•·]", line) >= 2) & (count_of(r"[|»›•·]", line) * 5 >= n)
    shouting = (n >= 4) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (count_of("!", line) >= n)
    unpunctuated = (n >= 12) & ~line.rlike(ENDS)
    boilerplate = (n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    return ((symbols > 0) & decorated) | navigation | shouting | unpunctuated | boilerplate


def judge(df: DataFrame, text: str = "text", out: str = "quality", max_loss: float = 0.5, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """df with a struct ``out``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, clean, kept."""
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    lines = F.split(t, "\n")
    full = F.filter(lines, has_word)
    df = without(df, out)
    df = df.withColumns({
        "__words": words_of(t),
        "__chars": F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
        "__symbols": count_of(SYMBOLS, t),
        "__dups": let(full, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")),
        "__marked": F.transform(lines, lambda x: F.struct(x.alias("line"), (has_word(x) & line_fails(x)).alias("bad"))),
    })
    df = df.withColumns({
        "__n": F.size("__words").cast("long"),
        "__repeat": repeat_words(F.col("__words")),
        "__lost": F.aggregate(F.col("__marked"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["bad"], F.length(F.regexp_replace(x["line"], SPACE + "+", ""))).otherwise(0).cast("long")),
        "__clean": F.array_join(F.transform(F.filter("__marked", lambda x: ~x["bad"]), lambda x: x["line"]), "\n"),
    })
    failed = (F.col("__n") < min_words) | (F.col("__repeat") * 100 > F.col("__n") * max_repeat)
    made = F.struct(
        F.col("__n").alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"), F.col("__dups").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"), failed.alias("base_failed"), F.col("__lost").alias("lost_chars"), F.col("__clean").alias("clean"),
        (~failed & (F.col("__lost") <= F.col("__chars") * max_loss)).alias("kept"),
    )
    return df.withColumn(out, made).drop("__words", "__chars", "__symbols", "__dups", "__marked", "__n", "__repeat", "__lost", "__clean")


def digest(df: DataFrame) -> DataFrame:
    """The columns of op7."""
    q = judge(df.select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return q.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


def clean(df: DataFrame) -> DataFrame:
    """The rows of documents that pass, with their failing lines removed; columns as they came."""
    q = judge(df, out="__quality").filter("__quality.kept")
    made = {"text": F.col("__quality.clean")}
    if "n_chars" in df.columns:
        made["n_chars"] = F.length("__quality.clean").cast(df.schema["n_chars"].dataType)
    return q.withColumns(made).select(*columns_of(df))
