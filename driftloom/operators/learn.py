"""Models over the cluster panel, with MLlib; the matrix stays on the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.operators import tree_shares
from driftloom.storage import stored

FEATURES = ["size", "value", "size_1", "growth", "age"]


def panel_features(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """lineage, period, FEATURES, label (the next period is smaller), train (first 80 % of periods)."""
    p = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.concat_ws(":", "c_mktsegment", "c_nationkey").alias("lineage"), F.trunc("o_orderdate", "quarter").alias("period"))
    p = p.agg(F.count("*").cast("double").alias("size"), F.round(F.avg("o_totalprice"), 2).alias("value"))
    w = Window.partitionBy("lineage").orderBy("period")
    p = p.withColumns({"size_1": F.lag("size").over(w), "age": F.row_number().over(w).cast("double"), "next": F.lead("size").over(w)})
    p = p.withColumn("growth", F.col("size") - F.col("size_1")).filter("size_1 is not null and next is not null")
    periods = [r[0] for r in p.select("period").distinct().orderBy("period").collect()]  # one row a period
    last = periods[max(1, int(0.8 * len(periods))) - 1] if periods else None
    return p.withColumns({"label": (F.col("next") < F.col("size")).cast("double"), "train": F.col("period") <= F.lit(last)})


def vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(df)


def scaled(df: DataFrame, kind: str = "standard") -> DataFrame:
    from pyspark.ml.feature import MinMaxScaler, StandardScaler

    df = vectors(df)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True) if kind == "standard" else MinMaxScaler(inputCol="raw", outputCol="features")
    return scaler.fit(df.filter("train")).transform(df)


def auc(df: DataFrame) -> float:
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    return BinaryClassificationEvaluator(rawPredictionCol="rawPrediction").evaluate(df)


def fit_for(df: DataFrame, least_class: int = 10, least_train: int = 20, least_test: int = 5) -> bool:
    """Whether there is enough to learn from: rows of each class, of training and of later periods."""
    r = df.agg(F.count_if("train").alias("n"), F.count_if(~F.col("train")).alias("m"), F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q")).first()
    return (r.n or 0) >= least_train and (r.m or 0) >= least_test and min(r.p or 0, r.q or 0) >= least_class


def varying(df: DataFrame) -> list[str]:
    """FEATURES that are not constant."""
    r = df.agg(*[(F.max(f) - F.min(f)).alias(f) for f in FEATURES]).first()
    return [f for f in FEATURES if r[f]]


def l1_logistic(df: DataFrame, strengths: tuple[float, ...] = (0.001, 0.01, 0.1), folds: int = 3) -> DataFrame:
    """feature, coefficient, impact (of a deviation of the feature), place, strength, and the model's AUC on later periods.

    The strength of the penalty is chosen by cross-validation; nothing is returned where there is too little to learn from.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    schema = "feature string, coefficient double, impact double, place int, strength double, auc double"
    if not fit_for(df):
        return df.sparkSession.createDataFrame([], schema)
    names, df = varying(df), scaled(df).select("features", "label", "train").cache()
    base = LogisticRegression(elasticNetParam=1.0, maxIter=50)
    grid = ParamGridBuilder().addGrid(base.regParam, list(strengths)).build()
    model = CrossValidator(estimator=base, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=42, parallelism=2).fit(df.filter("train")).bestModel
    a = auc(model.transform(df.filter("not train")))
    df.unpersist()
    own = sorted(((f, float(c)) for f, c in zip(FEATURES, model.coefficients.toArray(), strict=True) if f in names), key=lambda x: (-abs(x[1]), x[0]))
    rows = [(f, round(c, 6), round(abs(c), 6), i, float(model.getRegParam()), round(a, 4)) for i, (f, c) in enumerate(own, 1)]  # features are scaled to a deviation of 1
    return df.sparkSession.createDataFrame(rows, schema)


def weighed(df: DataFrame) -> DataFrame:
    """df with w: of rows of class 1, how many there are of the other for each."""
    r = df.filter("train").agg(F.sum(1 - F.col("label")).alias("n"), F.sum("label").alias("p")).first()
    return df.withColumn("w", F.when(F.col("label") == 1, F.lit(float((r.n or 0) / (r.p or 1)))).otherwise(1.0))


def gbt(df: DataFrame, folds: int = 5, rounds: int = 10) -> DataFrame:
    """lineage, period, risk of the later periods, by boosted trees with classes weighed; cv_auc: their mean AUC over folds of the training rows.

    Folds are dealt by a hash within each class, so that each holds its share of both.
    """
    from pyspark.ml.functions import vector_to_array

    df = weighed(vectors(df).withColumnRenamed("raw", "features")).withColumn("fold", F.pmod(F.xxhash64("lineage", "period"), F.lit(folds))).cache()
    train = df.filter("train")
    found = [auc(boosted(train.filter(F.col("fold") != k), rounds).transform(train.filter(F.col("fold") == k))) for k in range(folds)]
    model = boosted(train, rounds)
    later = stored(model.transform(df.filter("not train")).select("lineage", "period", F.round(vector_to_array("probability")[1], 6).alias("risk"), "label", F.lit(round(float(np.mean(found)), 4)).alias("cv_auc")))
    df.unpersist()
    return later


def boosted(rows: DataFrame, rounds: int = 10):
    """The classifier of gbt() over rows with features, label and w."""
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(weightCol="w", maxDepth=4, maxIter=rounds, stepSize=0.1, subsamplingRate=0.8, seed=42).fit(rows)


def gbt_attributions(df: DataFrame, rounds: int = 10) -> DataFrame:
    """lineage, period, feature, attribution, place: what each feature adds to the classifier's margin for the rows of the later periods."""
    model = boosted(weighed(vectors(df).withColumnRenamed("raw", "features")).filter("train"), rounds)
    return tree_shares.attributions(df.filter("not train"), model, FEATURES, ["lineage", "period"])


def phase_regressor(series: DataFrame, features: list[str], target: str, rounds: int = 20) -> DataFrame:
    """period, predicted, actual: target of the next period by boosted trees, fitted on the first 80 % of periods."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from driftloom.operators.panel import chrono_split

    rows = series.withColumn("actual", F.lead(target).over(Window.orderBy("period"))).filter("actual is not null").dropna(subset=features)
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(chrono_split(rows))
    model = GBTRegressor(labelCol="actual", maxDepth=3, maxIter=rounds, stepSize=0.1, seed=42).fit(rows.filter("is_train"))
    return model.transform(rows.filter("not is_train")).select("period", F.round("prediction", 6).alias("predicted"), F.round("actual", 6).alias("actual"))


def archetypes(df: DataFrame, low: int = 3, high: int = 12) -> DataFrame:
    """lineage, archetype: k-means of each lineage's mean features, k by silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    own = df.groupBy("lineage").agg(*[F.avg(f).alias(f) for f in FEATURES]).withColumn("train", F.lit(True))
    own = scaled(own, "minmax").select("lineage", "features").cache()
    best = None
    for k in range(low, high + 1):
        got = KMeans(k=k, seed=42, maxIter=20).fit(own).transform(own)
        s = ClusteringEvaluator().evaluate(got)
        if best is None or s > best[0]:
            best = (s, got)
    out = stored(best[1].select("lineage", F.col("prediction").alias("archetype"), F.lit(round(best[0], 4)).alias("silhouette")))
    own.unpersist()
    return out


def cox(df: DataFrame, ridge: float = 1.0, horizons: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """feature, coefficient, concordance, and the mean lineage's survival at each horizon, of proportional hazards: Newton steps (Breslow ties) over one row a lineage.

    Risk sets are sums over durations, so a step gathers one row for each distinct duration and no lineage.
    """
    own = df.groupBy("lineage").agg(
        F.count("*").alias("t"), F.max_by("label", "period").alias("d"), *[F.min_by(f, "period").alias(f) for f in FEATURES[:3]]
    )
    names = FEATURES[:3]
    stats = own.agg(*[F.avg(f).alias(f"m_{f}") for f in names], *[F.stddev_samp(f).alias(f"s_{f}") for f in names]).first()
    z = own.select("t", "d", *[((F.col(f) - (stats[f"m_{f}"] or 0.0)) / (stats[f"s_{f}"] or 1.0)).alias(f) for f in names])
    beta = np.zeros(len(names))
    for _ in range(8):
        e = F.exp(sum((F.col(f) * float(b) for f, b in zip(names, beta, strict=True)), F.lit(0.0)))
        aggs = [F.sum(e).alias("s0"), F.sum("d").alias("dead"), *[F.sum(F.col("d") * F.col(f)).alias(f"x_{f}") for f in names], *[F.sum(e * F.col(f)).alias(f"s1_{f}") for f in names]]
        aggs += [F.sum(e * F.col(f) * F.col(g)).alias(f"s2_{f}_{g}") for f in names for g in names]
        rows = z.groupBy("t").agg(*aggs).orderBy(F.desc("t")).collect()  # one row a duration
        s0, s1, s2 = 0.0, np.zeros(len(names)), np.zeros((len(names), len(names)))
        grad, hess = -ridge * beta, ridge * np.eye(len(names))
        for r in rows:
            s0 += r["s0"]
            s1 = s1 + np.array([r[f"s1_{f}"] for f in names])
            s2 = s2 + np.array([[r[f"s2_{f}_{g}"] for g in names] for f in names])
            m = s1 / s0
            grad = grad + np.array([r[f"x_{f}"] for f in names]) - r["dead"] * m
            hess = hess + r["dead"] * (s2 / s0 - np.outer(m, m))
        beta = beta + np.linalg.solve(hess, grad)
    e = F.exp(sum((F.col(f) * float(b) for f, b in zip(names, beta, strict=True)), F.lit(0.0)))
    steps = z.groupBy("t").agg(F.sum(e).alias("s0"), F.sum("d").alias("dead")).orderBy(F.desc("t")).collect()  # one row a duration
    at_risk, hazard = 0.0, {}
    for r in steps:
        at_risk += r["s0"]
        hazard[r["t"]] = r["dead"] / at_risk
    base = [float(np.exp(-sum(h for t, h in hazard.items() if t <= k))) for k in horizons]
    rows = [(f, round(float(b), 6), concordance(z, e), *[round(x, 6) for x in base]) for f, b in zip(names, beta, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, concordance double, " + ", ".join(f"survival_{k} double" for k in horizons))


def concordance(rows: DataFrame, risk: Column) -> float:
    """The share of comparable pairs (a death before another's end) in which the earlier one has the higher risk; ties count half.

    Risks meet as a table of durations and rounded risks, not row by row.
    """
    t = rows.select("t", "d", F.round(risk, 3).alias("r")).groupBy("t", "d", "r").agg(F.count("*").alias("n"))
    later = t.groupBy(F.col("t").alias("t2"), F.col("r").alias("r2")).agg(F.sum("n").alias("m"))
    pairs = t.filter("d = 1").join(later, F.col("t2") > F.col("t")).select((F.col("n") * F.col("m")).alias("w"), F.when(F.col("r") > F.col("r2"), 1.0).when(F.col("r") == F.col("r2"), 0.5).otherwise(0.0).alias("c"))
    got = pairs.agg((F.sum(F.col("w") * F.col("c")) / F.sum("w")).alias("c")).first()[0]
    return round(float(got), 4) if got is not None else 0.5
