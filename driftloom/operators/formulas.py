"""Search for formulas: a population of expression trees, each generation measured in one pass over the rows.

A pass takes Arrow batches of the columns used. Each task returns one row of moments a formula, which Spark adds up, so the
driver gets one row a formula whatever the number of rows. The search itself (which trees come next) is a few hundred small
tuples on the driver, seeded and free of any order of rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.storage import stored

UNARY = ("ln", "sqrt", "square")
BINARY = ("+", "-", "*", "/")
Tree = tuple  # ("x", column), (unary, tree) or (binary, tree, tree)


def size(t: Tree) -> int:
    """Its columns and operators."""
    return 1 if t[0] == "x" else 1 + sum(map(size, t[1:]))


def text(t: Tree) -> str:
    """The tree as SQL."""
    if t[0] == "x":
        return t[1] if t[1].isidentifier() else "`" + t[1].replace("`", "``") + "`"
    if t[0] == "square":
        return f"power({text(t[1])}, 2)"
    return f"{t[0]}({text(t[1])})" if t[0] in UNARY else f"({text(t[1])} {t[0]} {text(t[2])})"


def values(t: Tree, columns: dict[str, np.ndarray]) -> np.ndarray:
    if t[0] == "x":
        return columns[t[1]]
    a = values(t[1], columns)
    if t[0] in UNARY:
        return {"ln": np.log, "sqrt": np.sqrt, "square": np.square}[t[0]](a)
    return {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide}[t[0]](a, values(t[2], columns))


def measured(rows: DataFrame, trees: Sequence[Tree], features: Sequence[str], target: str) -> list[tuple[float, float, float]]:
    """(r2, slope, intercept) of the line through each formula's values and the target; (-1, 0, 0) if it isn't finite on every row or constant."""
    features = list(features)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(features)}
            y = batch.column(len(features)).to_numpy(zero_copy_only=False).astype(float)
            if not len(y):
                continue
            out = np.zeros((len(trees), 6))
            with np.errstate(all="ignore"):
                for i, t in enumerate(trees):
                    v = values(t, cols)
                    m, k = v.mean(), y.mean()
                    out[i] = len(y), m, k, ((v - m) ** 2).sum(), ((y - k) ** 2).sum(), ((v - m) * (y - k)).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trees)))] + [pa.array(out[:, j]) for j in range(6)], names=["i", "n", "m", "k", "vv", "yy", "vy"])

    part = rows.select(*features, target).mapInArrow(moments, "i long, n double, m double, k double, vv double, yy double, vy double")
    n, m, k = F.col("n"), F.col("m"), F.col("k")
    own = part.groupBy("i").agg(
        F.sum(n).alias("n"), F.sum(n * m).alias("m"), F.sum(n * k).alias("k"), F.sum(F.col("vv") + n * m * m).alias("vv"), F.sum(F.col("yy") + n * k * k).alias("yy"), F.sum(F.col("vy") + n * m * k).alias("vy")
    )
    out = [(-1.0, 0.0, 0.0)] * len(trees)
    for r in own.collect():  # one row a formula
        m, k = r.m / r.n, r.k / r.n
        vv, yy, vy = r.vv - r.n * m * m, r.yy - r.n * k * k, r.vy - r.n * m * k
        if np.isfinite([vv, yy, vy]).all() and vv > 1e-12 * max(r.vv, 1e-300) and yy > 0:
            out[r.i] = (round(min(1.0, vy * vy / (vv * yy)), 9), vy / vv, k - m * vy / vv)
    return out


def grown(r: random.Random, features: Sequence[str], depth: int) -> Tree:
    if depth == 0 or r.random() < 0.3:
        return ("x", r.choice(features))
    if r.random() < 0.25:
        return (r.choice(UNARY), grown(r, features, depth - 1))
    return (r.choice(BINARY), grown(r, features, depth - 1), grown(r, features, depth - 1))


def places(t: Tree, at: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
    return [at] + [p for i, x in enumerate(t[1:], 1) if t[0] != "x" for p in places(x, (*at, i))]


def part(t: Tree, at: tuple[int, ...]) -> Tree:
    return part(t[at[0]], at[1:]) if at else t


def put(t: Tree, at: tuple[int, ...], new: Tree) -> Tree:
    return (*t[: at[0]], put(t[at[0]], at[1:], new), *t[at[0] + 1 :]) if at else new


def simple(features: Sequence[str]) -> list[Tree]:
    """Every formula of one operator at most."""
    x = [("x", f) for f in features]
    two = [(op, a, b) for op in BINARY for i, a in enumerate(x) for j, b in enumerate(x) if i < j or (i != j and op == "/")]
    return x + [(op, a) for op in UNARY for a in x] + two


def front(known: dict[Tree, tuple[float, float, float]]) -> list[Tree]:
    """The trees that none of their size or smaller beats, smallest first; of equals the first by text."""
    out, best = [], 0.0
    for t in sorted(known, key=lambda t: (size(t), -known[t][0], text(t))):
        if known[t][0] > best:
            out.append(t)
            best = known[t][0]
    return out


def search(df: DataFrame, features: Sequence[str], target: str, generations: int = 12, population: int = 80, most: int = 15, seed: int = 42) -> DataFrame:
    """size, formula, r2, slope, intercept, smallest first: the formulas that no smaller one beats; target ~ slope * formula + intercept.

    formula is SQL over features, of + - * / ln sqrt and squares, with most nodes at most. All rows count; null or NaN
    features are 0, rows of a null, NaN or infinite target are left out. A formula must be finite on all rows. Constant
    features take no part. Nothing comes back of an empty table, or if the target is constant. The same rows and seed give
    the same formulas, however the rows are cut into partitions (r2 counts to nine places).
    """
    clean = lambda c: F.when(F.isnan(F.col(c).cast("double")), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    y = F.col(target).cast("double")
    names = [f"f{i}" for i in range(len(features))]
    rows = stored(df.filter(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))).select(*[clean(f).alias(n) for f, n in zip(features, names, strict=True)], y.alias("y")))
    r = rows.agg(*[(F.max(n) > F.min(n)).alias(n) for n in names]).first()
    kept = [n for n in names if r[n]]
    known: dict[Tree, tuple[float, float, float]] = {}

    def measure(trees: list[Tree]) -> None:
        new = [t for t in dict.fromkeys(trees) if t not in known and size(t) <= most]
        if new:
            known.update(zip(new, measured(rows, new, kept, "y"), strict=True))

    if kept:
        rng = random.Random(seed)
        measure(simple(kept))
        for _ in range(generations):
            best = front(known)
            if best and known[best[-1]][0] >= 1 - 1e-9:
                break
            # A node costs a thousandth of R2, so that trees don't grow for nothing.
            parents = sorted(known, key=lambda t: (-(known[t][0] - 0.001 * size(t)), size(t), text(t)))[:population]
            parents = list(dict.fromkeys(best + parents))
            made = []
            for _ in range(population):
                a, b = (min(rng.sample(range(len(parents)), min(3, len(parents)))) for _ in range(2))
                at = rng.choice(places(parents[a]))
                kind = rng.random()
                if kind < 0.4:
                    new = part(parents[b], rng.choice(places(parents[b])))
                elif kind < 0.6:
                    new = grown(rng, kept, 2)
                elif kind < 0.8:
                    new = (rng.choice(BINARY), part(parents[a], at), ("x", rng.choice(kept)))
                else:
                    new = (rng.choice(UNARY), part(parents[a], at))
                made.append(put(parents[a], at, new))
            measure(made)
    own = dict(zip(names, features, strict=True))

    def named(t: Tree) -> Tree:
        return ("x", own[t[1]]) if t[0] == "x" else (t[0], *map(named, t[1:]))

    out = [(size(t), text(named(t)), *known[t]) for t in front(known)]
    return df.sparkSession.createDataFrame(out, "size int, formula string, r2 double, slope double, intercept double")
