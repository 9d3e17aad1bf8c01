"""N-gram Jaccard join by chosen paths.

A text's set holds its runs of five words (a shorter text that has words: the one run of all of them). Equal sets are one
class first, so groups of copies cost one set. A class is named by two hashes of its set, never by a doc_id.

1. Chosen paths. Each set is written as COORDINATES minhashes. From the root of each of RUNS independent trees a set goes
   down along tokens (coordinate, value) that the node's seeded hash samples with rate 1 / (threshold * COORDINATES), so
   sets that share a path have shared every token on it, and a pair at the threshold keeps one path a level on average.
2. Buckets. A bucket of at most BUCKET sets goes no deeper: all its pairs are compared by their minhashes, and those that
   agree on NEAR of 64 are tied. A larger bucket of which a share of DENSE or more agrees with its smallest member can't be
   split, as it holds copies of one text: all of it is tied to that member, and the next step tells who is near whom.
   Other large buckets are split along the next level; what is still large at DEPTH is tied to its smallest member too.
3. Brute force. Ties make groups of texts that are near by estimate; within each group all pairs are compared by exact
   Jaccard, in tiles of bounded size, which return sums of links and a spanning forest.

Trees are added until a pair at the threshold is found with the recall RECALL even where it has to go all the way down
(``runs_for``), and NEAR is the most minhashes on which such a pair agrees but for UNLIKE of all cases (``near_for``). At 0.8
these are 24 trees and 36 of 64 minhashes: 0.0014 of the pairs are missed at DEPTH, 1e-10 where buckets are small. All
trees share the minhashes; the figures have the variance of these in.

Defined results: a null text, or one without words, links with nothing; rows that repeat are copies, linked to each
other; a doc_id of several texts has a class for each; a null key links with nothing; texts of any length are read whole, in
pieces; an empty table gives an empty table. near_duplicates returns its own columns alone, distinct_documents those of df.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftloom.llm.common import columns_of, map_rows, named, shared_folder, small_batches, stored, without
from driftloom.llm.components import components
from driftloom.llm.embeddings import forest
from driftloom.llm.wordhash import blocks, grams, mix

SHINGLE = 5
COORDINATES, DEPTH = 64, 5
#: Sets of a bucket that is not split.
BUCKET = 32
#: Of pairs at the threshold: the share that trees must find, and the share that may agree on too few minhashes.
RECALL, UNLIKE = 0.9985, 5e-6
#: Share of a large bucket that is near its smallest member, from which on it is one group.
DENSE = 0.5
#: Sets of a tile, and shingles compared at a time.
TILE, COLUMNS = 512, 8192
#: Odd multipliers, one a coordinate: shingle hashes are random, so their products order them at random.
TURNS = mix(np.arange(COORDINATES, dtype=np.uint64), 1000) | np.uint64(1)
#: Shingles multiplied at a time, and bytes of text hashed at a time.
PIECE, BLOCK = 512, 1 << 19


def chances(jaccard: float) -> list[float]:
    """The chance of each number of equal minhashes."""
    return [math.comb(COORDINATES, m) * jaccard**m * (1 - jaccard) ** (COORDINATES - m) for m in range(COORDINATES + 1)]


def missed(jaccard: float, depth: int, runs: int, threshold: float = 0.8) -> float:
    """The chance that none of so many trees keeps a pair of this similarity together for depth levels."""
    out = 0.0
    for m, chance in enumerate(chances(jaccard)):
        alive = 1.0
        for _ in range(depth):
            alive = 1 - (1 - alive / rated(threshold)) ** m
        out += chance * (1 - alive) ** runs
    return out


def rated(threshold: float) -> float:
    """Minhashes that a pair at the threshold shares, of which it should keep one path a level."""
    return max(threshold * COORDINATES, 1.0)


def runs_for(threshold: float) -> int:
    """As many trees as RECALL takes."""
    return next(r for r in range(1, 10_000) if missed(threshold, DEPTH, r, threshold) <= 1 - RECALL)


def near_for(threshold: float) -> int:
    """Minhashes on which a pair must agree to be tied."""
    below, m = 0.0, 0
    for chance in chances(threshold):
        below += chance
        if below > UNLIKE:
            break
        m += 1
    return max(m, 1)


def sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    out: list[np.ndarray] = []
    for places, off, words in blocks(texts, BLOCK):
        g = grams(words, k)
        for i in range(len(places)):
            a, b = int(off[i]), int(off[i + 1])
            out.append(np.unique(g[a : b - k + 1]) if b - a >= k else grams(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def minhashes(s: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for a in range(0, len(s), PIECE):
        np.minimum(low, (s[a : a + PIECE, None] * TURNS).min(0), out=low)
    return mix(low).astype(np.uint32)


def names(s: np.ndarray) -> tuple[int | None, int | None]:
    """Two independent sums, which name the set; none for an empty one."""
    if not len(s):
        return None, None
    h1, h2 = (int(mix(s, seed).sum(dtype=np.uint64).astype(np.int64)) for seed in (1, 2))
    return h1, h2


def signatures(df: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """(id, row, h1, h2, sig): row tells rows of one key apart."""

    def run(batches):
        for ids, rows, texts in batches:
            made = sets(texts, k)
            h = [names(s) for s in made]
            yield [ids, rows, [x for x, _ in h], [x for _, x in h], [minhashes(s).tobytes() if len(s) else None for s in made]]

    return map_rows(df, [named(key).cast("long"), row_hash(df), named(text)], run, "id long, row long, h1 long, h2 long, sig binary")


def row_hash(df: DataFrame):
    """Of all columns that Spark can hash."""
    whole = [named(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*whole)


def grown(path: np.ndarray, sig: np.ndarray, level: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(place, new path): each path of a set followed along the tokens that its node samples."""
    rate = np.uint64(min(int(2**64 / rated(threshold)), 2**64 - 1))
    coordinate = mix(np.arange(COORDINATES, dtype=np.uint64), 77)
    i, c = np.nonzero(mix(path[:, None] ^ coordinate[None, :], level) < rate)
    return i, mix(path[i] + mix(sig[i, c].astype(np.uint64) + (c.astype(np.uint64) << np.uint64(32)), 9), level)


def matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, COORDINATES)


def first_level(reps: DataFrame, threshold: float) -> DataFrame:
    """(path, node): of all trees."""
    roots = mix(np.arange(runs_for(threshold), dtype=np.uint64), 5)

    def run(batches):
        for nodes, sigs in batches:
            sig, nodes = matrix(sigs), np.array(nodes, np.int64)
            for r in roots:
                i, path = grown(np.full(len(nodes), r), sig, 1, threshold)
                yield [path.astype(np.int64), nodes[i]]

    return map_rows(reps, [F.col("node"), F.col("sig")], run, "path long, node long")


def next_level(rows: DataFrame, level: int, threshold: float) -> DataFrame:
    """(path, node) one level down from rows (path, node, sig)."""

    def run(batches):
        for paths, nodes, sigs in batches:
            i, path = grown(np.array(paths, np.int64).view(np.uint64), matrix(sigs), level, threshold)
            yield [path.astype(np.int64), np.array(nodes, np.int64)[i]]

    return map_rows(rows, [F.col("path"), F.col("node"), F.col("sig")], run, "path long, node long")


def tied_in_buckets(rows: DataFrame, least: int) -> DataFrame:
    """(u, v) of the pairs of buckets with least equal minhashes, as spanning forests; rows: path, node, sig."""

    def pairs(path: np.ndarray, node: np.ndarray, sig: np.ndarray):
        first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        size = np.diff(np.append(first, len(path)))
        u, v = [], []
        for m in np.unique(size[size > 1]).tolist():
            i, j = np.triu_indices(m, 1)
            start = first[size == m]
            at_once = max(1, 40_000 // len(i))
            for a in range(0, len(start), at_once):
                own = start[a : a + at_once, None]
                near = (sig[own + i] == sig[own + j]).sum(-1) >= least
                if m == 2:
                    at = own[near[:, 0], 0]
                    u.append(node[at])
                    v.append(node[at + 1])
                    continue
                for k in np.flatnonzero(near.any(1)).tolist():
                    edges = forest(i[near[k]], j[near[k]], m)
                    own_nodes = node[int(start[a + k]) :][:m]
                    u.append(own_nodes[[p for p, _ in edges]])
                    v.append(own_nodes[[q for _, q in edges]])
        return [np.concatenate(u), np.concatenate(v)] if u else None

    def run(batches):
        left: list[np.ndarray] | None = None  # of the bucket that may go on
        for paths, nodes, sigs in batches:
            now = [np.array(paths, np.int64), np.array(nodes, np.int64), matrix(sigs).astype(np.uint8)]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            left = [x[cut:] for x in now]
            if cut and (made := pairs(*[x[:cut] for x in now])):
                yield made
        if left is not None and (made := pairs(*left)):
            yield made

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "path").sortWithinPartitions("path")
    return map_rows(dealt, [F.col("path"), F.col("node"), F.col("sig")], run, "u long, v long")


def against_lowest(large: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """(path, node, low, sig, near): whether each set of a bucket agrees with its smallest member on least minhashes."""
    lowest = large.select("path", F.col("low").alias("node")).distinct().join(sigs, "node").select("path", F.col("sig").alias("low_sig"))  # one row a bucket

    def run(batches):
        for paths, nodes, low, own, other in batches:
            near = (matrix(own).astype(np.uint8) == matrix(other).astype(np.uint8)).sum(1) >= least
            yield [paths, nodes, low, own, near]

    rows = large.select("path", "node", "low").join(sigs, "node").join(lowest, "path")
    return map_rows(rows, [F.col(c) for c in ("path", "node", "low", "sig", "low_sig")], run, "path long, node long, low long, sig binary, near boolean")


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """(u, v): ties whose components hold each pair of near sets; reps: node, sig."""
    sigs, out, least = reps.select("node", "sig"), None, near_for(threshold)
    rows = stored(first_level(reps, threshold))  # or paths would be made anew for the sizes and for the join
    for level in range(1, DEPTH + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("m"), F.min("node").alias("low")).filter("m > 1")
        shared = stored(rows.join(sizes, "path"))
        small, large = shared.filter(F.col("m") <= BUCKET), shared.filter(F.col("m") > BUCKET)
        made = tied_in_buckets(small.select("path", "node").join(sigs, "node"), least)
        out = made if out is None else out.union(made)
        if large.isEmpty():
            break
        star = large
        if level < DEPTH:
            held = stored(against_lowest(large, sigs, least))
            dense = held.groupBy("path").agg(F.avg(F.col("near").cast("int")).alias("share")).filter(F.col("share") >= DENSE).select("path")
            star = held.join(dense, "path", "left_semi")
            rows = stored(next_level(held.join(dense, "path", "left_anti"), level + 1, threshold))
        out = out.union(star.filter("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")))
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of sets of a and of b."""
    ia, ib = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    token, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ta, tb = at[: len(ia)], at[len(ia) :]
    shared = (np.bincount(ta, minlength=len(token)) > 0) & (np.bincount(tb, minlength=len(token)) > 0)
    column = np.cumsum(shared) - 1
    ka, kb = shared[ta], shared[tb]
    ia, ib, ta, tb = ia[ka], ib[kb], column[ta[ka]], column[tb[kb]]
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        x, y = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        for m, i, t in ((x, ia, ta), (y, ib, tb)):
            now = (t >= first) & (t < first + COLUMNS)
            m[i[now], t[now] - first] = 1
        out += x @ y.T
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with Jaccard >= threshold."""
    both = overlaps(a, b).astype(np.float64)
    union = np.array([len(s) for s in a], np.float64)[:, None] + np.array([len(s) for s in b], np.float64)[None, :] - both
    hit = both >= threshold * union - 1e-9
    return np.nonzero(np.triu(hit, 1) if same else hit)


def compared(members: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n) as in the comparison of embeddings; members: group, tile, pair of tiles, node, copies, set."""

    def one(t: pa.Table) -> pa.Table:
        u, v, n = [], [], []
        rows = t.to_pylist()
        of: dict = {}
        for r in rows:
            of.setdefault((r["grp"], r["t1"], r["t2"]), []).append(r)
        for (_, t1, t2), own in of.items():
            own.sort(key=lambda r: (r["tile"] != t1, r["node"]))
            same = t1 == t2
            x = [r for r in own if r["tile"] == t1]
            y = x if same else [r for r in own if r["tile"] == t2]
            sx, sy = ([np.frombuffer(r["tokens"], np.uint64) for r in z] for z in (x, y))
            if len(x) == 2 and same:  # most groups
                m = len(np.intersect1d(sx[0], sx[1], assume_unique=True))
                hit = m >= threshold * (len(sx[0]) + len(sx[1]) - m) - 1e-9
                i, j = (np.array([0]), np.array([1])) if hit else (np.zeros(0, int), np.zeros(0, int))
            else:
                i, j = linked(sx, sy, threshold, same)
            ids, ids2 = [r["node"] for r in x], [r["node"] for r in y]
            nx = np.bincount(i, np.array([r["copies"] for r in y], np.float64)[j], len(x))
            ny = np.bincount(j, np.array([r["copies"] for r in x], np.float64)[i], len(y))
            for own_ids, m in ((ids, nx), (ids2, ny)):
                for p in np.flatnonzero(m):
                    u.append(own_ids[p])
                    v.append(None)
                    n.append(int(m[p]))
            both = ids if same else ids + ids2
            for p, q in forest(i, j if same else j + len(x), len(both)):
                u.append(both[p])
                v.append(both[q])
                n.append(0)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return members.groupBy("bin").applyInArrow(one, "u long, v long, n long")


def decided(df: DataFrame, text: str, key: str, k: int, threshold: float) -> DataFrame:
    """One row per row of df: id, row, links, c (smallest key of the component), class (null for a row that links with nothing), chosen (its class holds c)."""
    shared_folder(df.sparkSession)
    small_batches(df.sparkSession)
    rows = stored(signatures(df, text, key, k))
    has = rows.filter("h1 is not null and id is not null")
    grouped = has.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = stored(grouped.withColumn("node", F.xxhash64("h1", "h2")))
    groups = components(candidates(reps, threshold))
    sizes = groups.groupBy("component").count()
    bins = max(1, groups.count() // 200)
    # tiles by hash; a group of up to one tile is one pair of tiles, a larger one has all pairs of its tiles
    dealt = (
        groups.join(sizes, "component")
        .join(reps.select("node", "rep", "h1", "h2", "copies"), "node")
        .withColumn("tiles", F.ceil(F.col("count") / TILE).cast("int"))
        .select(F.col("component").alias("grp"), "node", "rep", "h1", "h2", "copies", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))
    )

    # a key that stands for several texts: the set of the class is told by its names
    def told(batches):
        for ids, texts in batches:
            made = sets(texts, k)
            h = [names(s) for s in made]
            yield [ids, [x for x, _ in h], [x for _, x in h], [s.tobytes() for s in made]]

    wanted = stored(dealt)
    texts = df.select(named(key).cast("long").alias("rep"), named(text).alias("t")).join(wanted.select("rep").distinct(), "rep", "left_semi")
    tokens = map_rows(texts, [F.col("rep"), F.col("t")], told, "rep long, h1 long, h2 long, tokens binary").dropDuplicates(["rep", "h1", "h2"])
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least("tile", j).alias("t1"), F.greatest("tile", j).alias("t2")))
    members = wanted.join(tokens, ["rep", "h1", "h2"]).withColumn("p", F.explode(others)).select(
        "grp", "tile", F.col("p.t1").alias("t1"), F.col("p.t2").alias("t2"), "node", "copies", "tokens",
        F.when(F.col("tiles") > 1, F.xxhash64("grp", "p.t1", "p.t2")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(bins))).alias("bin"),
    )
    found = stored(compared(members, threshold))
    links = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("found"))
    whole = stored(components(found.filter("v is not null").select("u", "v")))
    heads = whole.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min(F.struct("rep", "node")).alias("head"))
    known = reps.select("h1", "h2", "node", "rep", "copies").join(links, "node", "left").join(whole.join(heads, "component").select("node", "head"), "node", "left")
    known = known.select(
        "h1", "h2", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("links"), F.coalesce("head.rep", "rep").alias("c"),
        F.coalesce(F.col("head.node") == F.col("node"), F.lit(True)).alias("chosen"), F.col("node").alias("class"),
    )
    out = rows.select("id", "row", F.when(F.col("id").isNotNull(), F.col("h1")).alias("h1"), "h2").join(known, ["h1", "h2"], "left")
    return out.select("id", "row", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("c", "id").alias("c"), "class", F.coalesce("chosen", F.lit(True)).alias("chosen"))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = SHINGLE, threshold: float = 0.8) -> DataFrame:
    """One row per row of df: key, n_links (other rows linked directly), component_id, kept (the row has the component's smallest key)."""
    out = decided(df, text, key, k, threshold)
    return out.select(F.col("id").alias(key), F.col("links").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept"))


def digest(df: DataFrame) -> DataFrame:
    """The columns of op3."""
    return near_duplicates(df.select("doc_id", "text"))


def distinct_documents(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with one row of each group, that of the smallest key (then of the smallest row hash); columns as they came.

    Rows are told apart by key and row hash, so a key may have several texts. Rows that link with nothing all stay.
    """
    df = without(df, "__id", "__row", "__n")
    rows = stored(decided(df, text, key, SHINGLE, 0.8).filter("class is not null"))
    top = rows.filter("chosen and id = c")
    stay = stored(top.groupBy("class", "id").agg(F.min("row").alias("row")))
    gone = rows.join(stay, ["class", "id", "row"], "left_anti").select(F.col("id").alias("__id"), F.col("row").alias("__row")).distinct()
    marked = df.withColumns({"__id": named(key).cast("long"), "__row": row_hash(df)})
    kept = marked.join(gone, ["__id", "__row"], "left_anti")
    again = top.groupBy("id", "row").count().filter("count > 1").select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.lit(True).alias("__n"))
    if not again.isEmpty():  # a row that repeats in full: one stays
        nth = F.row_number().over(Window.partitionBy("__id", "__row").orderBy("__row"))
        kept = kept.join(again, ["__id", "__row"], "left").withColumn("__nth", nth).filter("__n is null or __nth = 1")
    return kept.select(*columns_of(df))
