"""Attributions of tree ensembles against all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from driftloom.operators import tree_shares

NAMES = ["a", "b", "c", "d", "e"]


def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.2).astype(float)
    df = spark.createDataFrame([(i, *map(float, v), float(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, d double, e double, label double")
    return x, VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)


def expected(node, x, known):
    """The output of a tree if some features are known: both children by their rows where one is not."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    f, at = node.split().featureIndex(), node.split().threshold()
    left, right = node.leftChild(), node.rightChild()
    if f in known:
        return expected(left if x[f] <= at else right, x, known)
    whole = node.impurityStats().count()
    return sum(c.impurityStats().count() / whole * expected(c, x, known) for c in (left, right))


def test_one_tree_against_all_subsets(spark):
    x, df = rows(spark)
    model = DecisionTreeRegressor(maxDepth=5, seed=1).fit(df)
    got = tree_shares.shares(tree_shares.leaves(model), x[:6])
    root = model._java_obj.rootNode()
    for r in range(6):
        value = {s: expected(root, x[r], s) for k in range(6) for s in combinations(range(5), k)}
        for f in range(5):
            rest = [g for g in range(5) if g != f]
            exp = sum(factorial(k) * factorial(4 - k) / factorial(5) * (value[tuple(sorted((*s, f)))] - value[s]) for k in range(5) for s in combinations(rest, k))
            assert abs(got[r, f] - exp) < 1e-9


def test_shares_sum_to_the_margin(spark):
    x, df = rows(spark)
    model = GBTClassifier(maxDepth=4, maxIter=8, seed=2).fit(df)
    margin = {r.id: r.m for r in model.transform(df).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    made = tree_shares.attributions(df, model, NAMES, ["id"])
    base = tree_shares.mean_output(tree_shares.leaves(model))
    sums = {r.id: r.s for r in made.groupBy("id").agg(F.sum("attribution").alias("s")).collect()}
    assert len(sums) == 300 and all(abs(sums[i] + base - m) < 1e-9 for i, m in margin.items())
    one = sorted(made.filter("id = 7").collect(), key=lambda r: r.place)
    assert [r.place for r in one] == [1, 2, 3, 4, 5] and [abs(r.attribution) for r in one] == sorted((abs(r.attribution) for r in one), reverse=True)
    top = {r.feature: r.mean_abs for r in tree_shares.ranking(made).collect()}
    assert max(top["d"], top["e"]) < min(top["a"], top["b"], top["c"])
    assert tree_shares.attributions(df.limit(0), model, NAMES, ["id"]).count() == 0
