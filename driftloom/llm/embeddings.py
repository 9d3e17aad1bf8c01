"""Near-duplicate embeddings by tiled comparison in the order of principal components.

Equal vectors of a label become one class first, so a group of copies costs one vector. Classes are dealt, label by
label, along the first principal component into tiles of bounded size, by a histogram of BINS places. Two tiles are
compared only if the boxes around their rotated unit vectors come near enough; boxes are met in blocks of about BLOCK, so
that no task holds all of a label. In a comparison the leading dimensions are summed first; what the rest can
add is at most the product of the two suffix norms, and pairs that can't reach the threshold so are left. Each pair is
met in exactly one pair of tiles: the tile pair returns sums of links and a spanning forest, never the pairs.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or whose label is null,
links with nothing and is its own component; vectors of different lengths don't link; rows that repeat are vectors of
their own; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftloom.llm.common import stored
from driftloom.llm.components import components

TILE = 1024
#: Places along the first component on each side of 0, and tiles of a block of boxes.
BINS, BLOCK = 4096, 512
#: Leading dimensions of the first step, then so many more a step.
STEP = 16
#: Nearer to the threshold than this, the cosine is taken again from the vectors as they came.
CLOSE = 1e-9


def scaled(rows: np.ndarray) -> np.ndarray:
    """The rows in double precision times a power of two each, so that no square of theirs runs over or under."""
    rows = rows.astype(np.float64)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of corresponding rows, in double precision."""
    a, b = scaled(a), scaled(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def number_type(vectors: DataFrame, column: str) -> str:
    """Of stored components: float for vectors of floats, else double."""
    return "float" if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else "double"


def near_pairs(a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with cosine >= threshold; for one tile with itself, those with i < j."""
    x, y = unit(a) @ turn, unit(b) @ turn
    dims = x.shape[1]
    rest = lambda z, k: np.sqrt(np.maximum(0.0, (z[:, k:] ** 2).sum(1)))
    k = min(STEP, dims)
    part = x[:, :k] @ y[:, :k].T
    may = part + np.outer(rest(x, k), rest(y, k)) >= threshold - CLOSE
    if same:
        may = np.triu(may, 1)
    i, j = np.nonzero(may)
    s = part[i, j]
    while k < dims and len(i):
        to = min(k + STEP, dims)
        s = s + np.einsum("ij,ij->i", x[i, k:to], y[j, k:to])
        k = to
        live = s + rest(x, k)[i] * rest(y, k)[j] >= threshold - CLOSE
        i, j, s = i[live], j[live], s[live]
    doubt = np.abs(s - threshold) < CLOSE
    if doubt.any():
        s[doubt] = cosine(a[i[doubt]], b[j[doubt]])
    return i[s >= threshold], j[s >= threshold]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges among i, j that span their components."""
    up, kept = list(range(n)), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for u, v in zip(i.tolist(), j.tolist(), strict=True):
        p, q = root(u), root(v)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append((u, v))
            n -= 1
    return kept


def principal(classes: DataFrame, dims: int) -> np.ndarray:
    """The rotation to principal axes of the unit vectors of this length, largest first. A task sends dims rows."""

    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            x = unit(np.array(b.column(0).to_pylist()))
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    sums = classes.select("vec").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    m = np.zeros((dims, dims))
    for r in sums.collect():  # dims * dims numbers
        m[r.i, r.j] = r.x
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return vectors[:, np.argsort(-values)]


def tiles_of(classes: DataFrame, turn: np.ndarray) -> DataFrame:
    """(label, tile, ids, copies, vecs, low, high): each label's classes in tiles of at most about TILE."""
    top = F.array_max(F.transform("vec", lambda x: F.abs(x))).cast("double")
    first = F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(v)) for v in turn[:, 0]]), lambda a, b: a / F.col("top") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top"))))
    placed = stored(classes.withColumn("top", top).withColumn("bin", F.floor(first / norm * BINS).cast("int")).drop("top"))
    counted = placed.groupBy("label", "bin").count()
    before = F.sum("count").over(Window.partitionBy("label").orderBy("bin")) - F.col("count")  # 2 * BINS rows a label at most
    ranges = stored(counted.withColumn("range", F.floor(before / TILE).cast("int")))
    # many classes at one place of the axis: such a range is split by hash
    sizes = ranges.groupBy("label", "range").agg(F.ceil(F.sum("count") / (2 * TILE)).cast("int").alias("pieces"))
    ranges = stored(ranges.join(sizes, ["label", "range"]).select("label", "bin", "range", "pieces"))
    placed = placed.join(ranges, ["label", "bin"]).withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    number = np.dtype(number_type(classes, "vec"))
    spin = classes.sparkSession.sparkContext.broadcast(turn)

    def one(t: pa.Table) -> pa.Table:
        raw = np.array(t.column("vec").to_pylist(), number)
        x = unit(raw) @ spin.value
        key = f"{t.column('range')[0].as_py():09d}-{t.column('piece')[0].as_py():06d}"
        return pa.table({
            "label": pa.array(t.column("label")[:1].to_pylist(), pa.string()), "tile": [key], "ids": [t.column("rep").to_pylist()], "copies": [t.column("copies").to_pylist()],
            "vecs": pa.array([raw.tobytes()], pa.binary()), "low": [x.min(0).tolist()], "high": [x.max(0).tolist()],
        })

    rows = placed.select("label", "range", "piece", "rep", "copies", "vec").groupBy("label", "range", "piece")
    return stored(rows.applyInArrow(one, "label string, tile string, ids array<long>, copies array<long>, vecs binary, low array<double>, high array<double>"))


def compared(tiles: DataFrame, turn: np.ndarray, threshold: float, number: str) -> DataFrame:
    """(u, v, n): u and v are linked if v is set; else n of u's links were found."""
    groups = -(-tiles.count() // BLOCK)
    boxes = tiles.select("label", "tile", "low", "high", F.pmod(F.xxhash64("label", "tile"), F.lit(groups)).alias("g"))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    other = boxes.toDF("label", "tile2", "low2", "high2", "g2").withColumn("g", every)
    boxes = boxes.withColumn("g2", every)
    gap = F.zip_with(F.zip_with("low", "high2", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.zip_with("low2", "high", lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda a, b: F.greatest(a, b))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    pairs = boxes.join(other, ["label", "g", "g2"]).filter((F.col("tile") <= F.col("tile2")) & (apart <= 2 - 2 * threshold + CLOSE)).select("label", "tile", "tile2")
    left = tiles.select("label", "tile", "ids", "copies", "vecs")
    right = left.toDF("label", "tile2", "ids2", "copies2", "vecs2")
    spin = tiles.sparkSession.sparkContext.broadcast(turn)
    dims = len(turn)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                same = r["tile"] == r["tile2"]
                x, y = (np.frombuffer(r[c], number).reshape(-1, dims) for c in ("vecs", "vecs2"))
                i, j = near_pairs(x, y, spin.value, threshold, same)
                ids, ids2 = np.array(r["ids"], np.int64), np.array(r["ids2"], np.int64)
                n = np.bincount(i, np.array(r["copies2"], np.float64)[j], len(ids)), np.bincount(j, np.array(r["copies"], np.float64)[i], len(ids2))
                tree = forest(i, j if same else j + len(ids), len(ids) + len(ids2))
                both = ids if same else np.concatenate([ids, ids2])
                a, c = np.flatnonzero(n[0]), np.flatnonzero(n[1])
                u = [*ids[a].tolist(), *ids2[c].tolist(), *[int(both[p]) for p, _ in tree]]
                v = [None] * (len(a) + len(c)) + [int(both[q]) for _, q in tree]
                m = [*n[0][a].astype(int).tolist(), *n[1][c].astype(int).tolist(), *[0] * len(tree)]
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(m, pa.int64())})

    # few rows of about a megabyte each: batches of one, or memory goes with the number of pairs
    rows = pairs.join(left, ["label", "tile"]).join(right, ["label", "tile2"]).repartition(max(12, tiles.sparkSession.sparkContext.defaultParallelism * 4), "label", "tile", "tile2")
    return rows.mapInArrow(run, "u long, v long, n long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per row of df: key, n_links, component_id, kept."""
    size = F.size(vec)
    good = F.col(label).isNotNull() & F.col(vec).isNotNull() & (size > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    v = F.col(vec).cast(f"array<{number_type(df, vec)}>")
    rows = df.select(
        F.col(key).alias("id"), F.when(F.coalesce(good, F.lit(False)), v).alias("vec"), F.concat_ws(":", F.col(label).cast("string"), size).alias("label"),
    ).withColumns({"h1": F.xxhash64("label", "vec"), "h2": F.xxhash64("vec", F.lit(1), "label")})
    grouped = rows.filter("vec is not null and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = stored(grouped.withColumn("dims", F.size("vec")))
    found = None
    for (dims,) in classes.select("dims").distinct().collect():  # the lengths of vectors, as a rule one
        own = classes.filter(F.col("dims") == dims)
        turn = principal(own, dims)
        one = compared(tiles_of(own, turn), turn, threshold, number_type(classes, "vec"))
        found = one if found is None else found.union(one)
    if found is None:
        return df.select(F.col(key), F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found)
    links = found.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("found"))
    whole = components(found.filter("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    known = classes.select("h1", "h2", "rep", "copies").join(links, "rep", "left").join(whole, "rep", "left")
    known = known.select("h1", "h2", "copies", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.select("id", F.when(F.col("vec").isNotNull() & F.col("id").isNotNull(), F.col("h1")).alias("h1"), "h2").join(known, ["h1", "h2"], "left")
    own = F.coalesce("c", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))


def digest(df: DataFrame) -> DataFrame:
    """The columns of op9."""
    return near_duplicates(df)
