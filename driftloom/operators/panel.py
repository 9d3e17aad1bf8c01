"""The cluster panel: one row a lineage and period. Every operator takes the frame and the names of its columns.

Windows are partitioned by lineage or by period; what has one row a period is put in order in a table of periods, which is
joined back, so no window runs over all rows of the panel.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def along(lineage: str = "lineage", period: str = "period") -> WindowSpec:
    return Window.partitionBy(lineage).orderBy(period)


def lags(df: DataFrame, columns: Mapping[str, list[int]], fill: float | int | None = 0, lineage: str = "lineage", period: str = "period") -> DataFrame:
    """df with column_n for each n of columns: the value n rows before. fill stands for null values, not for missing rows."""
    w = along(lineage, period)
    value = lambda c: F.col(c) if fill is None else F.coalesce(c, F.lit(fill))
    return df.select("*", *[F.lag(value(c), n).over(w).alias(f"{c}_{n}") for c, own in columns.items() for n in own])


def leads(df: DataFrame, columns: list[str], lineage: str = "lineage", period: str = "period") -> DataFrame:
    """df with column_next, and is_last for rows without a next one."""
    w = along(lineage, period)
    return df.select("*", *[F.lead(c).over(w).alias(f"{c}_next") for c in columns], F.lead(period).over(w).isNull().alias("is_last"))


def within(df: DataFrame, flag: str, first: int, last: int, out: str, lineage: str = "lineage", period: str = "period") -> DataFrame:
    """df with the largest flag of the rows first..last from here (negative ones lie before)."""
    return df.withColumn(out, F.max(flag).over(along(lineage, period).rowsBetween(first, last)))


def dies_within(df: DataFrame, flag: str = "is_dead", periods: int = 4, out: str = "dies_within_4") -> DataFrame:
    """Ahead of each row, which is what the name says."""
    return within(df, flag, 1, periods, out)


def die_window(df: DataFrame, flag: str = "is_dead", out: str = "die_window") -> DataFrame:
    """A shifted trailing frame of four: two rows before to one row after."""
    return within(df, flag, -2, 1, out)


def ranks(df: DataFrame, columns: list[str], period: str = "period", suffix: str = "_percentile") -> DataFrame:
    """df with the fractional rank of each column within its period."""
    return df.select("*", *[F.percent_rank().over(Window.partitionBy(period).orderBy(c)).alias(f"{c}{suffix}") for c in columns])


def change(value: Column, w: WindowSpec) -> Column:
    return value - F.lag(value).over(w)


def kinematics(df: DataFrame, column: str, lineage: str = "lineage", period: str = "period") -> DataFrame:
    """df with velocity, acceleration and jerk: first to third differences."""
    w = along(lineage, period)
    for out, of in (("velocity", column), ("acceleration", "velocity"), ("jerk", "acceleration")):
        df = df.withColumn(out, change(F.col(of), w))
    return df


def entropy(share: Column) -> Column:
    return -F.sum(share * F.log2(share + 1e-12))


def shares(df: DataFrame, column: str, period: str = "period", out: str = "p") -> DataFrame:
    return df.withColumn(out, F.col(column) * F.lit(1.0) / F.sum(column).over(Window.partitionBy(period)))


def entropy_series(df: DataFrame, column: str = "size", period: str = "period") -> DataFrame:
    """period, entropy of the shares of column, n_clusters."""
    return shares(df, column, period).groupBy(period).agg(entropy(F.col("p")).alias("entropy"), F.count("*").alias("n_clusters"))


def numbered(periods: DataFrame, period: str = "period", out: str = "k") -> DataFrame:
    """A table of one row a period, numbered in order."""
    return periods.withColumn(out, F.row_number().over(Window.orderBy(period)))


def slope_series(series: DataFrame, column: str, back: int = 3, period: str = "period", out: str = "slope") -> DataFrame:
    """series (one row a period) with the slope of column over this and the back periods before; null at the first."""
    k = F.col("k").cast("double")
    w = Window.orderBy("k").rowsBetween(-back, 0)
    return numbered(series, period).withColumn(out, F.when(k > 1, F.regr_slope(F.col(column), k).over(w))).drop("k")


def series_features(df: DataFrame, column: str, lineage: str = "lineage", period: str = "period") -> DataFrame:
    """One row a lineage: first, last, range, trend, the last difference, and mean, deviation, least and most of the last three."""
    w = along(lineage, period)
    back = F.row_number().over(Window.partitionBy(lineage).orderBy(F.desc(period)))
    rows = df.select(lineage, period, F.col(column).alias("x"), F.row_number().over(w).cast("double").alias("k"), back.alias("back"), change(F.col(column), w).alias("d"))
    last = lambda f: f(F.when(F.col("back") <= 3, F.col("x")))
    return rows.groupBy(lineage).agg(
        F.min_by("x", period).alias(f"first_{column}"), F.max_by("x", period).alias(f"last_{column}"), (F.max("x") - F.min("x")).alias(f"{column}_range"),
        F.regr_slope(F.col("x").cast("double"), F.col("k")).alias("trend"), F.max_by("d", period).alias("last_diff"), last(F.avg).alias("last3_mean"), last(F.stddev_pop).alias("last3_sd"),
        last(F.min).alias("last3_min"), last(F.max).alias("last3_max"), F.count("*").alias("n"),
    )


def terciles(df: DataFrame, column: str, low: float = 0.33, high: float = 0.67, out: str | None = None) -> DataFrame:
    """df with low, mid or high, by the exact percentiles of the whole column (one row, broadcast)."""
    cut = df.agg(F.percentile(column, F.lit(low)).alias("__lo"), F.percentile(column, F.lit(high)).alias("__hi"))
    level = F.when(F.col(column) <= F.col("__lo"), "low").when(F.col(column) <= F.col("__hi"), "mid").otherwise("high")
    return df.join(F.broadcast(cut)).withColumn(out or f"{column}_level", level).drop("__lo", "__hi")


def chrono_split(df: DataFrame, share: float = 0.8, period: str = "period", out: str = "is_train") -> DataFrame:
    """df with is_train: the first share of its distinct periods, one at least."""
    periods = df.select(period).distinct()
    cut = periods.agg(F.greatest(F.lit(1), F.floor(F.lit(share) * F.count("*"))).alias("__cut"))
    table = numbered(periods, period).join(F.broadcast(cut)).select(period, (F.col("k") <= F.col("__cut")).alias(out))
    return df.join(table, period)


def fresh_cutoff(df: DataFrame, months: int = 6, corpus: str = "lineage", period: str = "period") -> DataFrame:
    """Rows at least so many months older than their corpus' last period."""
    last = F.max(period).over(Window.partitionBy(corpus))
    return df.withColumn("last_period", last).filter(F.col(period) <= F.add_months("last_period", -months))


def concentration(df: DataFrame, group: str, owner: str, value: str) -> DataFrame:
    """One row a group: hhi, top_share, n_owners, and owners a unit of value's rows."""
    per = df.groupBy(group, owner).agg(F.sum(value).alias("v"), F.count("*").alias("m"))
    share = per.withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy(group)))
    return share.groupBy(group).agg(
        F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("top_share"), F.count("*").alias("n_owners"), (F.count("*") / F.sum("m")).alias("owner_ratio")
    )


def running_state(df: DataFrame, key: str, order: list[str], kind: str, value: str) -> DataFrame:
    """df with, up to and including each row: rows of the key of this kind value, rows of the key, and rows of its own kind."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(key, kind).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", F.sum(F.when(F.col(kind) == value, 1).otherwise(0)).over(w).alias(f"{value}s_so_far"), F.count("*").over(w).alias("seen"), F.count("*").over(own).alias("seen_in_type"))


def moments(df: DataFrame, group: str, column: str) -> DataFrame:
    """One row a group: biased skewness, excess kurtosis, population deviation and coefficient of variation."""
    centred = df.select(group, F.col(column).alias("x"), (F.col(column) - F.avg(column).over(Window.partitionBy(group))).alias("d"))
    m = centred.groupBy(group).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), *[F.avg(F.pow("d", F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)])
    return m.select(
        group, "n", (F.col("m3") / F.pow("m2", F.lit(1.5))).alias("skewness"), (F.col("m4") / (F.col("m2") * F.col("m2")) - 3).alias("kurtosis"),
        F.sqrt("m2").alias("sd"), (F.sqrt("m2") / F.col("mean")).alias("cv"),
    )


def minmax(df: DataFrame, column: str, group: str, out: str = "scaled") -> DataFrame:
    w = Window.partitionBy(group)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(out, (F.col(column) - low) / F.when(high == low, 1).otherwise(high - low))


def period_deltas(series: DataFrame, column: str, period: str = "period") -> DataFrame:
    """series (one row a period) with its changes to one and two periods before, and the mean size of the last four changes."""
    w = Window.orderBy(period)
    d1 = change(F.col(column), w)
    out = series.withColumns({"d1": d1, "d2": F.col(column) - F.lag(column, 2).over(w)})
    return out.withColumn("mean_abs", F.avg(F.abs("d1")).over(w.rowsBetween(-3, 0)))


def backtest_bounds(df: DataFrame, least: int = 10, skip: float = 0.2, last: int = 2, period: str = "period") -> DataFrame:
    """period and its number i: the periods of a backtest, without the first fifth and the last two; none of fewer than least."""
    table = numbered(df.select(period).distinct(), period, "i").withColumn("n", F.count("*").over(Window.partitionBy()))
    return table.filter((F.col("n") >= least) & (F.col("i") > F.floor(F.col("n") * skip)) & (F.col("i") <= F.col("n") - last)).select(period, "i")


def z_scores(df: DataFrame, column: str, period: str = "period", out: str = "z") -> DataFrame:
    w = Window.partitionBy(period)
    sd = F.stddev_samp(column).over(w)
    return df.withColumn(out, F.when(sd != 0, (F.col(column) - F.avg(column).over(w)) / sd))


def ages(df: DataFrame, lineage: str = "lineage", period: str = "period", out: str = "age") -> DataFrame:
    """df with the number of periods without a gap up to each row; periods are numbered in a table of their own."""
    at = numbered(df.select(period).distinct(), period, "__i")
    island = F.col("__i") - F.row_number().over(along(lineage, period))
    out_w = Window.partitionBy(lineage, "__island").orderBy(period)
    return df.join(at, period).withColumn("__island", island).withColumn(out, F.row_number().over(out_w)).drop("__i", "__island")


def marginal_entropy(df: DataFrame, column: str = "size", period: str = "period", out: str = "impact") -> DataFrame:
    """df with the loss of entropy of the period if the row's cluster were not there, in closed form."""
    w = Window.partitionBy(period)
    s = F.col(column).cast("double")
    n, log = F.sum(column).over(w).cast("double"), F.sum(F.col(column) * F.log2(column)).over(w)
    rest = F.when(n > s, F.log2(n - s) - (log - s * F.log2(s)) / (n - s)).otherwise(0)
    return df.withColumn(out, F.log2(n) - log / n - rest)


def recovery(df: DataFrame, column: str, drop: float = 0.8, lineage: str = "lineage", period: str = "period") -> DataFrame:
    """Rows below drop times their lineage's mean, with recovery: rows until the mean is reached again."""
    w = along(lineage, period)
    rows = df.withColumns({"__mu": F.avg(column).over(Window.partitionBy(lineage)), "__i": F.row_number().over(w)})
    ahead = Window.partitionBy(lineage).orderBy("__i").rowsBetween(1, Window.unboundedFollowing)
    back = F.min(F.when(F.col(column) >= F.col("__mu"), F.col("__i"))).over(ahead)
    return rows.withColumn("recovery", back - F.col("__i")).filter(F.col(column) < drop * F.col("__mu")).drop("__mu", "__i")


def cross_resolution(series: DataFrame, column: str, coarse: str = "year", period: str = "period") -> DataFrame:
    """series (one row a period) with parent, parent_ of column and share: its place in the period of the coarser calendar."""
    rows = series.withColumn("parent", F.trunc(period, coarse))
    parents = rows.groupBy("parent").agg(F.sum(column).alias(f"parent_{column}"))
    return rows.join(parents, "parent").withColumn("share", F.col(column) * F.lit(1.0) / F.col(f"parent_{column}"))


def phase_scores(df: DataFrame, column: str = "size", lineage: str = "lineage", period: str = "period") -> DataFrame:
    """period, phase_transition_score: .35 turnover + .30 change of connectivity (top share) + .20 of entropy + .15 of count, each capped at 1.

    Null where a previous value is.
    """
    x, before = F.col(column), F.col("__before")
    rows = shares(df, column, period).withColumn("__before", F.lag(column).over(along(lineage, period)))
    turn = F.when(before.isNull(), 1.0).otherwise(F.abs(x - before) * F.lit(1.0) / F.greatest(x, before))
    per = rows.groupBy(period).agg(F.count("*").alias("n"), entropy(F.col("p")).alias("h"), F.avg(turn).alias("turnover"), F.max("p").alias("top"))
    w = Window.orderBy(period)
    old = {c: F.lag(c).over(w) for c in ("h", "top", "n")}
    moved = lambda c, least: F.when(old[c].isNotNull(), F.least(F.lit(1.0), F.abs(F.col(c) - old[c]) / F.greatest(old[c], F.lit(least))))
    score = 0.35 * F.least(F.lit(1.0), F.col("turnover")) + 0.30 * moved("top", 1e-9) + 0.20 * moved("h", 1e-9) + 0.15 * moved("n", 1)
    return per.select(period, score.alias("phase_transition_score"))


def pressure_rate(df: DataFrame, column: str, out: str = "boundary_pressure_rate", lineage: str = "lineage", period: str = "period") -> DataFrame:
    """df with the change of column since the lineage's row before."""
    return df.withColumn(out, change(F.col(column), along(lineage, period)))


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """df with a_x_b for each pair: products of features."""
    return df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in pairs])


def imputed(df: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """df with null features at their defaults."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in defaults.items()})


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Booleans as whole numbers, numbers as doubles, null as 0."""
    kind = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c).cast("int" if kind[c] == "boolean" else "double"), F.lit(0)) for c in columns})
