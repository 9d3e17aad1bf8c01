"""Persistent ids of clusters over ordered periods, with splits, reborn lineages, demotions and a seed.

All scores are joins over clusters and members (operators.lineage, operators.splits). Ids are handed on from period to
period: each period is a step of joins and windows by corpus and cluster, over the pairs of clusters that may match and the
lineages of a few periods before. So corpora, and the clusters of one, are dealt out, and no task holds a corpus.

1. Splits first: two children or more that score WEAK and together hold SPLIT of a parent's members all take its id.
2. One to one: each other child takes its best parent that did not split, each parent its best child. STRONG makes a
   continuation, less a weak one.
3. Reborn: a child still without an id takes that of the nearest cluster of up to ``lookback`` periods before the last, if
   its lineage was not alive in the last.
4. An id that two children hold goes to the one of the higher score; the other becomes new. Split children are exempt.
Ties go to the smaller cluster number, and to the shorter gap.

What a later step needs is a State: lineages of the last 1 + lookback periods, and the next number of each corpus. ``advance``
takes it on by new periods, at once or in another run; ``save`` and ``load`` keep it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions.vectors import dot
from driftloom.operators import lineage, splits
from driftloom.operators.lineage import STRONG, WEAK
from driftloom.sources import versions
from driftloom.storage import stored

COLUMNS = ["corpus", "period", "c", "lineage", "match_type", "parent", "score", "gap"]


@dataclass
class State:
    """ids: corpus, period, c, lineage of the last periods; numbers: corpus, next (the number of its next new lineage)."""

    ids: DataFrame
    numbers: DataFrame


def empty(spark: SparkSession) -> State:
    return State(spark.createDataFrame([], "corpus string, period long, c long, lineage string"), spark.createDataFrame([], "corpus string, next long"))


def save(state: State, path: str) -> None:
    """Stores the state as one version: a reader sees all of it or the one before."""
    versions.commit(path, {"ids": state.ids, "numbers": state.numbers})


def load(spark: SparkSession, path: str) -> State:
    tables = versions.current(spark, path)
    return State(tables["ids"], tables["numbers"])


def seeded(seed: DataFrame, corpus: str) -> State:
    """A state of given lineages: period, c, lineage. New ones are numbered on from the largest that is a number."""
    ids = seed.select(F.lit(corpus).alias("corpus"), F.col("period").cast("long").alias("period"), F.col("c").cast("long").alias("c"), "lineage")
    digits = F.when(F.col("lineage").rlike("^[0-9]+$"), F.col("lineage").cast("long"))
    return State(ids, ids.groupBy("corpus").agg((F.coalesce(F.max(digits), F.lit(-1)) + 1).alias("next")))


def first(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy("corpus", *by).orderBy(*order))).filter("k = 1").drop("k")


def step(p: int, own: DataFrame, pair: DataFrame, parted: DataFrame, back: DataFrame, state: State) -> tuple[DataFrame, State]:
    """(rows of period p, state after it); own: corpus, c; pair, parted: corpus, c, parent, score; back: these and gap."""
    names = ["corpus", "c", "lineage", "match_type", "parent", "score", "gap"]
    last = state.ids.filter(F.col("period") == p - 1).select("corpus", F.col("c").alias("parent"), "lineage")
    child = ["corpus", "c"]
    split = first(parted.join(last, ["corpus", "parent"]), ["c"], F.desc("score"), "parent")
    split = split.select("corpus", "c", "lineage", F.lit("split_child").alias("match_type"), "parent", "score", F.lit(1).alias("gap"))
    one = pair.join(split.select(*child), child, "left_anti").join(parted.select("corpus", "parent").distinct(), ["corpus", "parent"], "left_anti").join(last, ["corpus", "parent"])
    one = first(first(one, ["c"], F.desc("score"), "parent"), ["parent"], F.desc("score"), "c")
    kept_on = F.when(F.col("score") >= STRONG, "continuation").otherwise("weak")
    one = one.select("corpus", "c", "lineage", kept_on.alias("match_type"), "parent", "score", F.lit(1).alias("gap"))
    before = state.ids.select("corpus", (F.lit(p) - F.col("period")).cast("int").alias("gap"), F.col("c").alias("parent"), "lineage")
    again = back.join(split.select(*child), child, "left_anti").join(one.select(*child), child, "left_anti").join(before, ["corpus", "gap", "parent"])
    again = again.join(last.select("corpus", "lineage").distinct(), ["corpus", "lineage"], "left_anti")
    again = first(again, ["c"], F.desc("score"), "gap", "parent").select("corpus", "c", "lineage", F.lit("reborn").alias("match_type"), "parent", "score", "gap")
    claims = first(one.unionByName(again), ["lineage"], F.desc("score"), "c")
    done = own.join(split.unionByName(claims).select(*names), child, "left")
    place = F.sum(F.col("lineage").isNull().cast("long")).over(Window.partitionBy("corpus").orderBy("c"))  # one row a cluster of the period
    number = F.coalesce("next", F.lit(0)) + place - 1
    done = done.join(state.numbers, "corpus", "left").withColumn("number", F.when(F.col("lineage").isNull(), number))
    rows = stored(done.select(
        "corpus", F.lit(p).cast("long").alias("period"), "c", F.coalesce("lineage", F.format_string("%06d", "number")).alias("lineage"),
        F.coalesce("match_type", F.lit("new")).alias("match_type"), "parent", "score", F.col("gap").cast("int").alias("gap"), "number",
    ))
    used = rows.groupBy("corpus").agg((F.max("number") + 1).alias("up_to"))
    numbers = state.numbers.join(used, "corpus", "full").select("corpus", F.coalesce("up_to", "next", F.lit(0)).alias("next"))
    return rows.select(*COLUMNS), State(state.ids.unionByName(rows.select("corpus", "period", "c", "lineage")), numbers)


def advance(state: State, pairs: DataFrame, parted: DataFrame, back: DataFrame, own: DataFrame, lookback: int) -> tuple[DataFrame, State]:
    """(rows of the periods of own, state after the last); pairs, parted: corpus, period, c, parent, score; back: these and gap; own: corpus, period, c."""
    pairs, parted, back, own = (stored(x) for x in (pairs, parted, back, own))
    at, out = F.col("period"), None
    for p in [r.period for r in own.select("period").distinct().orderBy("period").collect()]:  # one row a period
        now = [x.filter(at == p).drop("period") for x in (own, pairs, parted, back)]
        rows, state = step(p, *now, state)
        out = rows if out is None else out.unionByName(rows)
        state = State(stored(state.ids.filter(at >= p - lookback)), stored(state.numbers))
    if out is None:
        rows, state = step(0, *[x.filter("false").drop("period") for x in (own, pairs, parted, back)], state)
        out = rows
    return out, state


def backwards(cents: DataFrame, lookback: int, weak: float) -> DataFrame:
    """(period, c, parent, gap, score): clusters of 2 to 1 + lookback periods before that are WEAK or nearer."""
    old = cents.select("period", F.col("c").alias("parent"), F.col("u").alias("pu"), F.explode(F.array(*[F.lit(g) for g in range(2, 2 + lookback)]).cast("array<int>")).alias("gap"))
    old = old.withColumn("period", F.col("period") + F.col("gap"))
    both = cents.select("period", "c", "u").join(old, "period")
    return both.select("period", "c", "parent", "gap", F.round(dot(F.col("u"), F.col("pu")), 6).alias("score")).filter(F.col("score") >= weak)


def pairs_of(cents: DataFrame, members: DataFrame, weak: float = WEAK) -> tuple[DataFrame, DataFrame]:
    """(candidates with a composite of weak or better, the children of splits)."""
    scored = splits.composite(lineage.candidates(cents, weak), members).filter(F.col("composite") >= weak)
    return scored, splits.split_children(scored, members)


def scores(cents: DataFrame, members: DataFrame, lookback: int, weak: float, corpus: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What advance() needs of the clusters of one corpus: pairs, parted and back."""
    scored, parted = pairs_of(cents, members, weak)
    names = ["corpus", "period", "c", "parent", "score"]
    kinds = [F.col("corpus"), *[F.col(n).cast("long").alias(n) for n in ("period", "c", "parent")], F.col("score")]
    pair = scored.select(F.lit(corpus), "period", "child", "parent", "composite").toDF(*names).select(*kinds)
    split = parted.join(scored, ["period", "child", "parent"]).select(F.lit(corpus), "period", "child", "parent", "composite").toDF(*names).select(*kinds)
    back = backwards(cents, lookback, weak).withColumn("corpus", F.lit(corpus)).select(*kinds, F.col("gap").cast("int").alias("gap"))
    return pair, split, back


def increment(cents: DataFrame, members: DataFrame, state: State, lookback: int = 2, weak: float = WEAK, corpus: str = "all") -> tuple[DataFrame, State]:
    """(rows, state after them) of the clusters that the state doesn't have yet; cents and members reach back as far as the state."""
    known = state.ids.filter(F.col("corpus") == corpus).select("period", "c")
    own = cents.join(known, ["period", "c"], "left_anti").select(F.lit(corpus).alias("corpus"), F.col("period").cast("long").alias("period"), F.col("c").cast("long").alias("c"))
    return advance(state, *scores(cents, members, lookback, weak, corpus), own, lookback)


def match(cents: DataFrame, members: DataFrame, seed: DataFrame | None = None, lookback: int = 2, weak: float = WEAK, corpus: str = "all") -> DataFrame:
    """corpus, period, c, lineage, match_type, parent, score, gap.

    cents: period, c, u of one corpus; members: period, c, chunk, w. seed: period, c, lineage of the period before the
    first to be matched, whose clusters are in cents and members too but not in the result.
    """
    state = empty(cents.sparkSession) if seed is None else seeded(seed, corpus)
    return increment(cents, members, state, lookback, weak, corpus)[0]


def match_corpora(corpora: dict[str, tuple[DataFrame, DataFrame]], state: State, lookback: int = 2, weak: float = WEAK) -> tuple[DataFrame, State]:
    """As increment(), for (cents, members) of several corpora, whose periods are gone through together."""
    parts = [[*scores(c, m, lookback, weak, k), c.select(F.lit(k).alias("corpus"), F.col("period").cast("long").alias("period"), F.col("c").cast("long").alias("c"))] for k, (c, m) in corpora.items()]
    pairs, parted, back, own = (union(list(x)) for x in zip(*parts, strict=True))
    own = own.join(state.ids.select("corpus", "period", "c"), ["corpus", "period", "c"], "left_anti")
    return advance(state, pairs, parted, back, own, lookback)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def summary(matched: DataFrame) -> DataFrame:
    """One row a corpus: clusters, each kind of match, the rates of splits and reborn ones, and their gaps."""
    kinds = ("continuation", "weak", "new", "split_child", "reborn")
    total = F.greatest(F.count("*"), F.lit(1))
    return matched.groupBy("corpus").agg(
        F.count("*").alias("n_clusters"), *[F.count_if(F.col("match_type") == k).alias(f"n_{k}") for k in kinds],
        (F.count_if(F.col("match_type") == "split_child") / total).alias("split_rate"), (F.count_if(F.col("match_type") == "reborn") / total).alias("reborn_rate"),
        F.max(F.when(F.col("match_type") == "reborn", F.col("gap") - 1)).alias("max_gap"),
    )
