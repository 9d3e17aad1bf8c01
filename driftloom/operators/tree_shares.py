"""What each feature adds to the output of a tree ensemble for a row: Shapley values that follow the trees' own paths.

A leaf counts for a row with its value times a factor for each feature on its path: whether the row passes the feature's
splits if the feature is known, or the share of training rows that do if it isn't. Over all orders in which features
become known, a leaf's factors are a product, so its Shapley values come from the coefficients of a polynomial of as many
degrees as the path has features; no subset is tried. The driver reads the trees once, as tasks get the leaves alone;
rows are worked on by Arrow batches, all of a batch at once, and stay where they are.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: value, then for each feature of the path: its number, bounds (low, high] and the share of training rows within them.
Leaf = tuple[float, list[tuple[int, float, float, float]]]


def leaves(model) -> list[Leaf]:
    """The leaves of an MLlib ensemble or tree, values times the tree's weight; continuous splits only."""
    trees = list(zip(model.trees, model.treeWeights, strict=True)) if hasattr(model, "trees") else [(model, 1.0)]
    out: list[Leaf] = []
    for tree, weight in trees:
        todo = [(tree._java_obj.rootNode(), {})]
        while todo:
            node, path = todo.pop()
            if node.subtreeDepth() == 0:
                out.append((weight * node.prediction(), [(f, *own) for f, own in sorted(path.items())]))
                continue
            split = node.split()
            if "ContinuousSplit" not in split.getClass().getName():
                raise ValueError("a tree with categorical splits")
            f, at, whole = split.featureIndex(), split.threshold(), node.impurityStats().count()
            for child, low, high in ((node.leftChild(), -np.inf, at), (node.rightChild(), at, np.inf)):
                lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
                todo.append((child, path | {f: (max(lo, low), min(hi, high), share * child.impurityStats().count() / whole)}))
    return out


def mean_output(all_leaves: list[Leaf]) -> float:
    """The output if no feature is known."""
    return float(sum(v * np.prod([z for *_, z in path]) for v, path in all_leaves))


def shares(all_leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """The values of all features for each row of x; they sum to the row's output less mean_output."""
    out = np.zeros(x.shape)
    for value, path in all_leaves:
        m = len(path)
        if not m:
            continue
        known = np.array([(x[:, f] > lo) & (x[:, f] <= hi) for f, lo, hi, _ in path], np.float64)
        unknown = np.array([z for *_, z in path])
        weight = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
        for i, (f, *_) in enumerate(path):
            sums = np.zeros((m, len(x)))  # by how many of the other features are known
            sums[0] = 1
            for j in range(m):
                if j != i:
                    more = sums * known[j]
                    sums *= unknown[j]
                    sums[1:] += more[:-1]
            out[:, f] += value * (known[i] - unknown[i]) * (weight @ sums)
    return out


def attributions(df: DataFrame, model, features: list[str], keys: list[str]) -> DataFrame:
    """keys, feature, attribution, place (1 for the largest by size; ties by name): a row for each row of df and feature."""
    own = leaves(model)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("shares", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            x = np.column_stack([np.array(b.column(f), np.float64) for f in features]) if b.num_rows else np.zeros((0, len(features)))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(list(shares(own, x)), pa.list_(pa.float64()))], names=[*keys, "shares"])

    made = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).mapInArrow(run, schema)
    parts = F.transform("shares", lambda v, i: F.struct((-F.abs(F.round(v, 9))).alias("down"), F.array(*map(F.lit, features))[i].alias("feature"), v.alias("v")))
    return made.select(*keys, F.posexplode(F.array_sort(parts)).alias("i", "x")).select(*keys, "x.feature", F.col("x.v").alias("attribution"), (F.col("i") + 1).alias("place"))


def ranking(made: DataFrame) -> DataFrame:
    """feature, mean_abs, sd over all rows of attributions()."""
    return made.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"), F.stddev_samp("attribution").alias("sd"))
