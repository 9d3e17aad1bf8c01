"""Formula search: planted laws, moments against numpy, any partitioning, and tables with little in them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import formulas


def points(spark, law, n=400, parts=4):
    r = random.Random(1)
    rows = [(x := r.uniform(1, 9), y := r.uniform(1, 9), z := r.uniform(1, 9), law(x, y, z), 7.0) for _ in range(n)]
    return spark.createDataFrame(rows, "a double, `b c` double, z double, y double, same double").repartition(parts)


@pytest.mark.parametrize(("law", "most"), [(lambda x, y, z: 3 * x * y - 2, 3), (lambda x, y, z: 0.5 * math.sqrt(x) * y + 4, 4), (lambda x, y, z: x * y / z + 1, 5)])
def test_planted_laws(spark, law, most):
    df = points(spark, law)
    got = formulas.search(df, ["a", "b c", "z", "same"], "y").collect()
    assert [r.size for r in got] == sorted(r.size for r in got) and [r.r2 for r in got] == sorted(r.r2 for r in got)
    assert got[-1].r2 > 1 - 1e-9 and got[-1].size <= most and "same" not in got[-1].formula
    err = df.select(F.max(F.abs(F.expr(got[-1].formula) * got[-1].slope + got[-1].intercept - F.col("y")))).first()[0]
    assert err < 1e-6


def test_same_for_any_partitioning(spark):
    law = lambda x, y, z: math.sin(x) + y / z
    one = formulas.search(points(spark, law, parts=1), ["a", "b c", "z"], "y", generations=3).collect()
    many = formulas.search(points(spark, law, parts=9), ["a", "b c", "z"], "y", generations=3).collect()
    assert [(r.size, r.formula) for r in one] == [(r.size, r.formula) for r in many]


def test_moments(spark):
    df = points(spark, lambda x, y, z: x + z * z)
    rows = df.select(F.col("a").alias("f0"), F.col("z").alias("f1"), "y")
    trees = formulas.simple(["f0", "f1"]) + [("ln", ("-", ("x", "f0"), ("x", "f1")))]
    got = formulas.measured(rows, trees, ["f0", "f1"], "y")
    local = np.array([tuple(r) for r in rows.collect()])
    for t, (r2, slope, start) in zip(trees[:-1], got, strict=False):
        v = formulas.values(t, {"f0": local[:, 0], "f1": local[:, 1]})
        assert r2 == pytest.approx(np.corrcoef(v, local[:, 2])[0, 1] ** 2, abs=1e-8)
        assert (slope, start) == pytest.approx(tuple(np.polyfit(v, local[:, 2], 1)), rel=1e-6, abs=1e-6)
    assert got[-1] == (-1.0, 0.0, 0.0)  # not finite on every row


def test_little_or_nothing(spark):
    schema = "a double, y double"
    for rows in ([], [(1.0, None)], [(1.0, 2.0)], [(None, 1.0), (2.0, 1.0)], [(float("nan"), float("inf")), (1.0, float("nan"))]):
        assert formulas.search(spark.createDataFrame(rows, schema), ["a"], "y").count() == 0
    got = formulas.search(spark.createDataFrame([(None, 1.0), (2.0, 5.0), (float("nan"), 1.0), (2.0, None)], schema), ["a"], "y").collect()
    assert [(r.size, r.formula, r.r2) for r in got] == [(1, "a", 1.0)] and (got[0].slope, got[0].intercept) == pytest.approx((2.0, 1.0))
