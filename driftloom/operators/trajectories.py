"""What becomes of lineages: fingerprints of their last periods, ends by archetype, survival rows, and rules that hold in several corpora.

Null lineages, and for rules null corpora, are left out; repeated rows of a lineage and period count as rows of their own,
their order within the period being that of size and then of the other columns taken. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.storage import stored

# The columns of a fingerprint, and which of them are taken from one to three periods before.
NOW = (
    "size cohesion drift_magnitude jerk acceleration velocity boundary_pressure_rate convergence_score mean_betweenness persistence_score age_periods "
    "elongation_ratio death_probability n_attractors mean_pagerank mean_belief_persistence void_count_adjacent growth_rate"
).split()
BEFORE = {
    1: {"size": "size", "cohesion": "cohesion", "drift": "drift_magnitude", "jerk": "jerk", "bpr": "boundary_pressure_rate", "is_dead": "is_dead", "pagerank": "mean_pagerank", "belief": "mean_belief_persistence"},
    2: {"size": "size", "cohesion": "cohesion", "drift": "drift_magnitude", "jerk": "jerk", "bpr": "boundary_pressure_rate", "is_dead": "is_dead"},
    3: {"size": "size", "drift": "drift_magnitude", "jerk": "jerk", "is_dead": "is_dead"},
}


def fingerprint(
    df: DataFrame, now: Sequence[str] = tuple(NOW), before: Mapping[int, Mapping[str, str]] = BEFORE, keys: Sequence[str] = ("corpus", "lineage"), period: str = "period", least: int = 3
) -> DataFrame:
    """keys, now, and <alias>_t<n> for each column of before: the last row of each lineage that has one as far back as before goes.

    Rows under least members and rows that begin a lineage (is_new) are passed over, so that a period before is the one
    before among the rest. Nulls are 0, in the size of the farthest row too where that row exists.
    """
    w = Window.partitionBy(*keys).orderBy(period, "size", *[c for c in now if c != "size"])
    rows = df.filter((F.col("size") >= least) & ~F.coalesce(F.col("is_new"), F.lit(False))).dropna(subset=list(keys))
    far = max(before)
    rows = rows.select(
        *keys, period, F.lag(F.lit(True), far).over(w).alias("__far"), F.row_number().over(w).alias("__at"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in now],
        *[F.coalesce(F.lag(F.col(c).cast("double"), n).over(w), F.lit(0.0)).alias(f"{a}_t{n}") for n, cols in before.items() for a, c in cols.items()],
    )
    back = Window.partitionBy(*keys).orderBy(F.desc("__at"))
    return rows.filter("__far").withColumn("__k", F.row_number().over(back)).filter("__k = 1").drop("__far", "__at", "__k", period)


def terminal_rates(assigned: DataFrame, df: DataFrame, keys: Sequence[str] = ("corpus", "lineage"), period: str = "period", least: int = 3, examples: int = 3) -> DataFrame:
    """archetype, n, death_rate, reborn_rate, survival_rate, mean_drift, mean_cohesion, mean_age_dead (null if none died), examples.

    assigned: keys, archetype. A lineage ends in its last row of least members; one without such a row counts as alive,
    with drift and cohesion 0. Of ties in the last period, a dead row goes first. examples are the first lineages by key.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(period), F.desc_nulls_last("is_dead"))
    ends = df.filter(F.col("size") >= least).withColumn("__k", F.row_number().over(w)).filter("__k = 1")
    ends = ends.select(*keys, F.coalesce("is_dead", F.lit(False)).alias("d"), F.coalesce(F.col("reborn_after_periods") > 0, F.lit(False)).alias("r"), "drift_magnitude", "cohesion", "age_periods")
    rows = assigned.join(ends, list(keys), "left")
    share = lambda c: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    got = rows.groupBy("archetype").agg(
        F.count("*").alias("n"), share("d").alias("death_rate"), share("r").alias("reborn_rate"), (F.count_if(~F.coalesce("d", F.lit(False))) / F.count("*")).alias("survival_rate"),
        share("drift_magnitude").alias("mean_drift"), share("cohesion").alias("mean_cohesion"), F.avg(F.when(F.col("d"), F.coalesce("age_periods", F.lit(0)).cast("double"))).alias("mean_age_dead"),
    )
    first = assigned.withColumn("__k", F.row_number().over(Window.partitionBy("archetype").orderBy(*keys))).filter(F.col("__k") <= examples)
    shown = first.groupBy("archetype").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", keys[-1]))), lambda x: x[keys[-1]]).alias("examples"))
    return got.join(shown, got.archetype.eqNullSafe(shown.archetype)).drop(shown.archetype)


def survival_rows(df: DataFrame, entry: Sequence[str], lineage: str = "lineage", period: str = "period", dead: str = "is_dead") -> DataFrame:
    """lineage, duration (rows, so at least 1), observed_death (0 or 1), and <column>_at_entry: its value in the first period.

    A null at entry is the median of the other lineages' values, or 0 if there is none. Of repeated first rows the one of
    the lowest values counts, nulls last.
    """
    order = [F.col(period), *[F.asc_nulls_last(c) for c in entry]]
    rows = df.dropna(subset=[lineage]).withColumn("__k", F.row_number().over(Window.partitionBy(lineage).orderBy(*order)))
    first = lambda c: F.max(F.when(F.col("__k") == 1, F.col(c).cast("double"))).alias(f"{c}_at_entry")
    own = rows.groupBy(lineage).agg(F.count("*").alias("duration"), F.max(F.coalesce(F.col(dead), F.lit(False)).cast("int")).alias("observed_death"), *[first(c) for c in entry])
    own = stored(own)
    mid = own.agg(*[F.median(f"{c}_at_entry").alias(f"__{c}") for c in entry])  # one row
    filled = [F.coalesce(f"{c}_at_entry", f"__{c}", F.lit(0.0)).alias(f"{c}_at_entry") for c in entry]
    return own.join(F.broadcast(mid)).select(lineage, "duration", "observed_death", *filled)


def kaplan_meier(rows: DataFrame, duration: str = "duration", dead: str = "observed_death") -> DataFrame:
    """t, dead, at_risk, survival: the estimate after each duration. Its windows run over one row a duration, not over lineages."""
    e = rows.dropna(subset=[duration]).groupBy(F.col(duration).alias("t")).agg(F.sum(F.coalesce(F.col(dead).cast("long"), F.lit(0))).alias("dead"), F.count("*").alias("leaving"))
    e = e.withColumn("at_risk", F.sum("leaving").over(Window.orderBy(F.desc("t"))))
    kept = F.when(F.col("dead") == F.col("at_risk"), 0.0).otherwise(1 - F.col("dead") / F.col("at_risk"))
    up = Window.orderBy("t")
    lost = F.max(kept == 0).over(up)
    return e.select("t", "dead", "at_risk", F.when(lost, 0.0).otherwise(F.exp(F.sum(F.when(kept > 0, F.ln(kept)).otherwise(0.0)).over(up))).alias("survival"))


def rules_by_corpus(items: DataFrame, outcomes: DataFrame, key: str, corpus: str = "corpus", support: float = 0.03, confidence: float = 0.6, lift: float = 2.0, most: int = 2) -> DataFrame:
    """corpus, antecedent, consequent, support, confidence, lift, score of each corpus's own rules, all corpora in one run.

    items: corpus, key, item; outcomes: corpus, key, outcome. Keys belong to one corpus. A set grows only from frequent ones.
    """
    items, outcomes = stored(items.dropna().distinct()), stored(outcomes.dropna().distinct())
    n = stored(items.select(corpus, key).union(outcomes.select(corpus, key)).distinct().groupBy(corpus).agg(F.count("*").alias("n")))

    def frequent(rows: DataFrame) -> DataFrame:
        good = rows.groupBy(corpus, "items").agg(F.count("*").alias("k")).join(n, corpus).filter(F.col("k") >= support * F.col("n"))
        return rows.join(good.select(corpus, "items"), [corpus, "items"], "left_semi")

    single = stored(frequent(items.select(corpus, key, F.col("item").alias("items"), F.col("item").alias("last"))))
    sets = now = single
    for _ in range(most - 1):
        wider = now.join(single.select(corpus, key, F.col("items").alias("next")), [corpus, key]).filter("next > last")
        now = stored(frequent(wider.select(corpus, key, F.concat_ws("+", "items", "next").alias("items"), F.col("next").alias("last"))))
        sets = sets.union(now)
    size = sets.groupBy(corpus, "items").agg(F.count("*").alias("k"))
    base = outcomes.groupBy(corpus, "outcome").agg(F.count("*").alias("m"))
    both = sets.join(outcomes, [corpus, key]).groupBy(corpus, "items", "outcome").agg(F.count("*").alias("hit"))
    r = both.join(size, [corpus, "items"]).join(base, [corpus, "outcome"]).join(n, corpus).filter(F.col("hit") >= support * F.col("n"))
    conf, rise = F.col("hit") / F.col("k"), F.col("hit") / F.col("k") / (F.col("m") / F.col("n"))
    r = r.select(corpus, F.col("items").alias("antecedent"), F.col("outcome").alias("consequent"), (F.col("hit") / F.col("n")).alias("support"), conf.alias("confidence"), rise.alias("lift"))
    return r.filter((F.round("confidence", 9) >= confidence) & (F.round("lift", 9) >= lift)).withColumn("score", F.col("lift") * F.col("confidence"))


def rule_overlap(rules: DataFrame, least: int = 2, corpus: str = "corpus") -> DataFrame:
    """antecedent, consequent, n_corpora, mean_lift, mean_confidence, corpora of the rules that at least so many corpora share."""
    got = rules.groupBy("antecedent", "consequent").agg(F.count_distinct(corpus).alias("n_corpora"), F.avg("lift").alias("mean_lift"), F.avg("confidence").alias("mean_confidence"), F.array_sort(F.collect_set(corpus)).alias("corpora"))
    return got.filter(F.col("n_corpora") >= least)


# Bounds in the order in which they are tried, and how many rules one can look through.
BOUNDS = [("lift", 5.0), ("lift", 3.0), ("score", 5.0), ("score", 3.0), ("lift", 2.0)]
WANTED = (50, 200)


def threshold_advice(rules: DataFrame, bounds: Sequence[tuple[str, float]] = tuple(BOUNDS), wanted: tuple[int, int] = WANTED) -> DataFrame:
    """total, one count a bound (lift_5, ...), advice: the first bound that leaves as many rules as wanted.

    Failing that: all rules if they are few enough, else lift>3 if any rule passes it, else none. One row, also without rules.
    """

    def named(b: tuple[str, float]) -> str:
        return f"{b[0]}_{b[1]:g}"

    tried = dict.fromkeys([*bounds, ("lift", 3.0)])
    counts = rules.agg(F.count("*").alias("total"), *[F.count_if(F.col(c) > v).alias(named((c, v))) for c, v in tried])
    advice: Column = F.when(F.col("total") <= wanted[1], "all rules").when(F.col("lift_3") > 0, "lift>3").otherwise("none")
    for b in reversed(bounds):
        advice = F.when(F.col(named(b)).between(*wanted), f"{b[0]}>{b[1]:g}").otherwise(advice)
    return counts.withColumn("advice", advice)
