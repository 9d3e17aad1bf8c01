"""Association rules, laws and their backtests, attributions and scores over a panel. Everything is joins and sums over its rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.functions.vectors import cosine
from driftloom.storage import stored


def divided(a: Column, b: Column) -> Column:
    """a over b as in IEEE arithmetic and SQL's doubles: over 0 it is infinite, and of 0 over 0 not a number, never an error."""
    over_zero = F.when(a == 0, float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, F.when(F.isnan(a), a).otherwise(over_zero)).otherwise(F.try_divide(a, b))


def levels(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key, item: a tercile item such as size_high for each column."""
    cuts = df.agg(*[F.percentile(c, F.array(F.lit(0.33), F.lit(0.67))).alias(f"__{c}") for c in columns])  # one row
    df = df.join(F.broadcast(cuts))
    level = lambda c: F.when(F.col(c) <= F.col(f"__{c}")[0], "low").when(F.col(c) <= F.col(f"__{c}")[1], "mid").otherwise("high")
    df = df.withColumns({f"{c}_level": level(c) for c in columns})
    items = F.array(*[F.concat(F.lit(f"{c}_"), F.col(f"{c}_level")) for c in columns])
    return df.select(key, F.explode(items).alias("item")).filter("item is not null")


def itemsets(items: DataFrame, n: int, key: str, support: float, most: int = 3) -> DataFrame:
    """key, items (joined by +), of the sets of up to most items that hold for a share of support of n keys.

    A set is made only of a frequent one and a later frequent item, as none other can be frequent.
    """

    def frequent(rows: DataFrame) -> DataFrame:
        good = rows.groupBy("items").count().filter(F.col("count") >= support * n).select("items")
        return rows.join(good, "items", "left_semi")

    single = stored(frequent(items.select(key, F.col("item").alias("items"), F.col("item").alias("last"))))
    out = now = single
    for _ in range(most - 1):
        pairs = now.join(single.select(key, F.col("items").alias("next")), key).filter("next > last")
        now = stored(frequent(stored(pairs.select(key, F.concat_ws("+", "items", "next").alias("items"), F.col("next").alias("last")))))
        out = out.union(now)
    return out.select(key, "items")


def rules(items: DataFrame, outcomes: DataFrame, key: str, support: float = 0.03, confidence: float = 0.6, lift: float = 2.0, most: int = 3) -> DataFrame:
    """antecedent, consequent, support, confidence, lift, score (lift * confidence). outcomes: key, outcome; keys without one have none."""
    items, outcomes = stored(items), stored(outcomes)
    n = items.select(key).union(outcomes.select(key)).distinct().count()
    sets = itemsets(items, n, key, support, most)
    size = sets.groupBy("items").agg(F.count("*").alias("k"))
    base = outcomes.groupBy("outcome").agg(F.count("*").alias("m"))
    both = sets.join(outcomes, key).groupBy("items", "outcome").agg(F.count("*").alias("hit")).filter(F.col("hit") >= support * n)
    r = both.join(size, "items").join(base, "outcome")
    r = r.select(F.col("items").alias("antecedent"), F.col("outcome").alias("consequent"), (F.col("hit") / n).alias("support"), (F.col("hit") / F.col("k")).alias("confidence"), (F.col("hit") / F.col("k") / (F.col("m") / n)).alias("lift"))
    r = r.filter((F.round("confidence", 9) >= confidence) & (F.round("lift", 9) >= lift))
    return r.withColumn("score", F.col("lift") * F.col("confidence"))


@dataclass(frozen=True)
class Law:
    """name; conditions (column, side, quantile): the column lies over or under that quantile of its corpus."""

    name: str
    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def holds(self) -> Column:
        out = F.lit(True)
        for c, side, q in self.conditions:
            cut = F.col(quantile_name(c, q))
            out = out & ((F.col(c) > cut) if side == "over" else (F.col(c) < cut))
        return F.coalesce(out, F.lit(False))


def quantile_name(column: str, q: float) -> str:
    return f"{column}_p{round(100 * q)}"


#: Of clusters that die, and of periods in which the phase changes; columns are those of the panel.
DEATH_LAWS = [
    Law("pressure", [("pressure", "over", 0.75)]), Law("large_loose", [("size", "over", 0.75), ("cohesion", "under", 0.25)]), Law("low_persistence", [("persistence", "under", 0.25)]),
    Law("small_drifting", [("drift", "over", 0.75), ("size", "under", 0.25)]), Law("small_dense", [("cohesion", "over", 0.75), ("size", "under", 0.25)]),
]
PHASE_LAWS = [Law("connectivity_drop", [("connectivity", "under", 0.25)]), Law("entropy_ceiling", [("entropy", "over", 0.75)])]


def with_thresholds(df: DataFrame, columns: dict[str, list[float]], corpus: str) -> DataFrame:
    """df with the exact quantiles of each column within its corpus."""
    cuts = df.groupBy(corpus).agg(*[F.percentile(c, F.lit(q)).alias(quantile_name(c, q)) for c, own in columns.items() for q in own])
    return df.join(cuts, corpus)


def backtest(df: DataFrame, laws: list[Law], target: str, corpus: str, period: str = "period") -> DataFrame:
    """corpus, period, law, n_predicted, n_confirming, n_refuting, status, accuracy: one row where a law finds something.

    df has the laws' thresholds and target, whether the prediction came true.
    """
    names = F.array_compact(F.array(*[F.when(law.holds(), F.lit(law.name)) for law in laws]))
    g = df.filter(F.col(target).isNotNull()).select(corpus, period, target, F.explode(names).alias("law")).groupBy(corpus, period, "law")
    out = g.agg(F.count("*").alias("n_predicted"), F.count_if(F.col(target)).alias("n_confirming"), F.count_if(~F.col(target)).alias("n_refuting"))
    return out.withColumns({
        "status": F.when(F.col("n_confirming") > F.col("n_refuting"), "confirmed").otherwise("refuted"), "accuracy": F.round(F.col("n_confirming") / F.col("n_predicted"), 3),
    })


def accuracy(results: DataFrame) -> DataFrame:
    """law, n_periods, n_confirmed, rate, hits: how often a law's periods were confirmed, and its predictions in all."""
    return results.groupBy("law").agg(
        F.count("*").alias("n_periods"), F.count_if(F.col("status") == "confirmed").alias("n_confirmed"), F.round(F.count_if(F.col("status") == "confirmed") / F.count("*"), 4).alias("rate"),
        F.round(F.sum("n_confirming") / F.sum("n_predicted"), 4).alias("hits"),
    )


def neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each node: 18 aggregates over its neighbours. edges: a, b, weight, is_new, is_lost; nodes: c, risk, size, cohesion, betweenness, triangles, drift, stage.

    Both directions of an edge are one table, so the join is by key and not by either end.
    """
    both = edges.select(F.col("a").alias("c"), F.col("b").alias("o"), "weight", "is_new", "is_lost").unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias("o"), "weight", "is_new", "is_lost"))
    n = both.join(nodes.withColumnRenamed("c", "o"), "o")
    mean = lambda c, out: F.avg(c).alias(out)
    return n.groupBy("c").agg(
        mean("risk", "neighbor_avg_risk"), F.max("risk").alias("neighbor_max_risk"), F.min("risk").alias("neighbor_min_risk"), mean("size", "neighbor_avg_size"), mean("cohesion", "neighbor_avg_cohesion"),
        mean("betweenness", "neighbor_avg_betweenness"), F.max("betweenness").alias("neighbor_max_betweenness"), mean("triangles", "neighbor_avg_triangles"), mean("drift", "neighbor_avg_drift"),
        F.max("drift").alias("neighbor_max_drift"), mean("weight", "avg_edge_weight"), F.max("weight").alias("max_edge_weight"), F.count("*").alias("n_neighbors"),
        F.count_if("is_new").alias("n_new_edges"), F.count_if("is_lost").alias("n_lost_edges"), F.sum(F.col("weight") * F.coalesce("risk", F.lit(0.0))).alias("weighted_dying_pressure"),
        F.max((F.col("stage") == 4).cast("int")).alias("has_crystallizing_neighbor"), F.count_if(F.col("risk") > 0.7).alias("n_dying_neighbors"),
    )


def rolled_up(rows: DataFrame, keys: list[str], means: list[str], flags: list[str]) -> DataFrame:
    """keys with avg_ of each measure and n_ of each flag."""
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(f"avg_{c}") for c in means], *[F.sum(F.col(c).cast("long")).alias(f"n_{c}") for c in flags])


def edges_rolled_up(edges: DataFrame) -> DataFrame:
    """Of each end of an edge: means of weight, its change and overlap, and counts of new and lost edges."""
    cols = ["weight", "weight_change", "overlap", "is_new", "is_lost"]
    both = edges.select(F.col("a").alias("c"), *cols).unionByName(edges.select(F.col("b").alias("c"), *cols))
    return both.groupBy("c").agg(
        F.avg("weight").alias("avg_weight"), F.avg("weight_change").alias("avg_weight_change"), F.count_if("is_new").alias("n_new"), F.count_if("is_lost").alias("n_lost"), F.avg("overlap").alias("avg_overlap")
    )


def linear_attribution(df: DataFrame, coefficients: dict[str, float], keys: list[str]) -> DataFrame:
    """keys, feature, attribution, rank: of a linear score, what each feature adds against the mean row; exact, and sums to the score's difference."""
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in coefficients])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(w) * (F.col(c) - F.col(f"__{c}"))).alias("attribution")) for c, w in coefficients.items()])
    rows = df.join(F.broadcast(means)).select(*keys, F.explode(parts).alias("p")).select(*keys, "p.feature", "p.attribution")  # one row
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(F.abs("attribution"), 9)), "feature")))


def zero_ablation(df: DataFrame, coefficients: dict[str, float], target: str) -> DataFrame:
    """feature, rise: how much the mean squared error of a linear score rises with the feature at zero."""
    score = sum((F.lit(w) * F.col(c) for c, w in coefficients.items()), F.lit(0.0))
    error = lambda s: F.avg(F.pow(F.col(target) - s, F.lit(2)))
    one = df.agg(error(score).alias("whole"), *[error(score - F.lit(w) * F.col(c)).alias(c) for c, w in coefficients.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) - F.col("whole")).alias("rise")) for c in coefficients])).alias("x")).select("x.*")


def ranked_by_impact(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """feature, impact, place: coefficient times the feature's deviation."""
    one = df.agg(*[(F.abs(F.lit(w)) * F.stddev_samp(c)).alias(c) for c, w in coefficients.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("impact")) for c in coefficients])).alias("x")).select("x.*")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("impact"), "feature")))


def written(scores: DataFrame, new: DataFrame, version: str, keys: list[str]) -> DataFrame:
    """scores with all rows of this version replaced by the new ones; of a key that repeats, the highest risk stays."""
    one = new.groupBy(*keys).agg(F.max("risk").alias("risk")).withColumn("version", F.lit(version))
    return scores.filter(F.col("version") != version).select(*keys, "risk", "version").unionByName(one)


def verified(scores: DataFrame, keys: list[str]) -> DataFrame:
    """version, n, n_keys, mean, least, most, n_high: what a check of written scores shows."""
    return scores.groupBy("version").agg(
        F.count("*").alias("n"), F.countDistinct(F.struct(*keys)).alias("n_keys"), F.avg("risk").alias("mean"), F.min("risk").alias("least"), F.max("risk").alias("most"), F.count_if(F.col("risk") > 0.7).alias("n_high")
    )


def high_risk(scores: DataFrame, least: float = 0.7, period: str = "period") -> DataFrame:
    """Rows of the last period with a risk of least or more, the highest first."""
    last = F.broadcast(scores.agg(F.max(period).alias(period)))  # one row
    return scores.join(last, period).filter(F.col("risk") >= least).orderBy(F.desc("risk"))


def history(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Score history: new rows whose key is not there yet are added, none is changed."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def training_corpus(wanted: DataFrame, corpora: DataFrame, fallback: str) -> DataFrame:
    """corpus, train: its parent if it has one, else itself; the fallback for one that is not known."""
    known = corpora.select("corpus", F.lit(True).alias("__known"), "parent")
    return wanted.join(known, "corpus", "left").select("corpus", F.when(F.col("__known").isNull(), F.lit(fallback)).otherwise(F.coalesce("parent", "corpus")).alias("train"))


def archetype_name(death: Column, reborn: Column, survival: Column, drift: Column) -> Column:
    return (
        F.when(death > 0.6, "death_precursor").when(reborn > 0.3, "cyclical_reborn").when((survival > 0.85) & (drift < 0.1), "stable_persistent")
        .when((survival > 0.75) & (drift > 0.2), "active_drifter").when(death > 0.3, "at_risk").otherwise("mixed")
    )


def alike(archetypes: DataFrame, least: float = 0.85) -> DataFrame:
    """corpus, name, best, similarity, universal: each archetype's most similar one of another corpus. archetypes: corpus, name, v (few rows)."""
    other = archetypes.select(F.col("corpus").alias("c2"), F.concat("corpus", F.lit("/"), "name").alias("best"), F.col("v").alias("v2"))
    pairs = archetypes.join(other, F.col("corpus") != F.col("c2")).withColumn("similarity", F.round(cosine(F.col("v"), F.col("v2")), 6))
    k = F.row_number().over(Window.partitionBy("corpus", "name").orderBy(F.desc("similarity"), "best"))
    return pairs.withColumn("k", k).filter("k = 1").select("corpus", "name", "best", "similarity", (F.col("similarity") >= least).alias("universal"))


def in_every(found: DataFrame, corpus: str, feature: str) -> DataFrame:
    """feature, n_corpora: features that are found in every corpus."""
    n = found.agg(F.countDistinct(corpus).alias("__n"))
    g = found.groupBy(feature).agg(F.countDistinct(corpus).alias("n_corpora"))
    return g.join(F.broadcast(n)).filter("n_corpora = __n").drop("__n")  # one row


def measured(df: DataFrame, label: str, score: str, by: str | None = None, cut: float = 0.5) -> DataFrame:
    """auc (mean ranks), f1, rmse and r2 of a score against a 0/1 label, of all rows or of each value of by.

    Ranks come from a table of distinct scores, so equal scores meet before they are put in order.
    """
    keys = [by] if by else []
    rows = df.select(*keys, F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("s"))
    ties = rows.groupBy(*keys, "s").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy("s")) - F.col("n")
    ranks = ties.withColumn("rank", below + (F.col("n") + 1) / 2)
    g = ranks.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("all"))
    auc = g.select(*keys, F.when((F.col("p") > 0) & (F.col("p") < F.col("all")), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("all") - F.col("p")))).alias("auc"))
    hit, said, true = F.sum(F.when((F.col("s") >= cut) & (F.col("y") == 1), 1).otherwise(0)), F.count_if(F.col("s") >= cut), F.sum("y")
    error = F.sum(F.pow(F.col("y") - F.col("s"), F.lit(2)))
    other = rows.groupBy(*keys).agg((2 * hit / F.nullif(said + true, F.lit(0.0))).alias("f1"), F.sqrt(error / F.count("*")).alias("rmse"), (1 - error / F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0))).alias("r2"))
    return auc.join(other, by) if by else auc.join(F.broadcast(other))


def triples(series: DataFrame, period: str = "period", columns: tuple[str, ...] = ("x",)) -> DataFrame:
    """series (one row a period) joined with the two before: column_0, column_1, column_2 for T, T-1, T-2; whole triples alone."""
    w = Window.orderBy(period)
    out = series.select(period, *[F.lag(c, n).over(w).alias(f"{c}_{n}") if n else F.col(c).alias(f"{c}_0") for c in columns for n in (0, 1, 2)], F.row_number().over(w).alias("__i"))
    return out.filter("__i > 2").drop("__i")


def sample_edges(nodes: DataFrame, edges: DataFrame, period: str = "period") -> DataFrame:
    """period, a, b, weight, complete: a period's edges; for one that has none, all pairs of its nodes with weight 1."""
    have = edges.select(period).distinct()
    bare = nodes.join(have, period, "left_anti")
    pairs = bare.select(period, F.col("c").alias("a")).join(bare.select(period, F.col("c").alias("b")), period).filter("a < b")
    return edges.select(period, "a", "b", "weight", F.lit(False).alias("complete")).unionByName(pairs.select(period, "a", "b", F.lit(1.0).alias("weight"), F.lit(True).alias("complete")))


def findings(metrics: DataFrame, name: str, value: str, least: float) -> DataFrame:
    """place, finding: a line of text for each metric of least or more, the strongest first."""
    good = metrics.filter(F.abs(F.col(value)) >= least).withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round(F.abs(F.col(value)), 9)), name)))
    return good.select("place", F.concat(F.col("place"), F.lit(". "), F.col(name), F.lit(" = "), F.format_string("%.3f", F.col(value).cast("double"))).alias("finding"))
