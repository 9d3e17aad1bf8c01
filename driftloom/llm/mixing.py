"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a tree of columns (domain, language, source). At each node it is shared by the children's
weights, as far as their texts reach (``max_epochs`` times over); what a child can't use goes to its siblings by their
weights, and only what no sibling can use is left to the level above. A leaf of T tokens and budget b gives every
document b // T times, and once more the longest prefix, in the seeded order of the next epoch, of b % T tokens at most.

Budgets are worked out level by level in tables: a task holds the children of one node, and nothing comes to the driver.
The prefix is found without sorting a leaf: tokens are summed by leaf and hash range, the range in which the budget ends
is looked up digit by digit (256 sums a leaf at a time), and only its rows are put in order. What each leaf gets is
joined to the rows; it is broadcast if it has at most ``most_leaves`` rows, and joined as tables are otherwise.

Defined results: null columns form leaves of their own; texts without words take no budget and go along with their leaf;
rows of the same key and text stand or fall together; a leaf without tokens gives nothing; an empty table gives an empty
table; clashing column names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.llm.common import SPACE, columns_of, named, stored, without

#: Rows of a hash range, at most about so many in the largest leaf, and hex digits that are looked up at a time.
RANGE_ROWS, DIGITS = 2000, 2


def shares(budget: int, children: list[tuple[float, int]]) -> list[int]:
    """budget among (weight, capacity) children: in proportion to weights, none over its capacity, all of it if they have room."""
    out, open_ = [0] * len(children), [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = min(budget, sum(children[i][1] for i in open_))
    while open_ and left > 0:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if left * children[i][0] / total >= children[i][1]]
        if not full:
            at, before, done = 0.0, 0, 0
            for i in open_:  # whole numbers that add up
                at += left * children[i][0] / total
                done = left if i == open_[-1] else min(left, int(at + 1e-9))
                out[i], before = min(children[i][1], done - before), done
            break
        for i in full:
            out[i] = children[i][1]
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


def budgets(sizes: Mapping[tuple, int], weights: list[Mapping], budget: int, max_epochs: int) -> dict[tuple, int]:
    """The budget of each leaf (a path of values); weights: one mapping a level, 1 for values it doesn't name."""

    def down(leaves: dict[tuple, int], level: int, own: int) -> dict[tuple, int]:
        if level == len(weights):
            return dict.fromkeys(leaves, own)
        parts: dict = {}
        for path, n in leaves.items():
            parts.setdefault(path[level], {})[path] = n
        names = sorted(parts, key=lambda x: (x is None, x))
        got = shares(own, [(float(weights[level].get(x, 1.0)), max_epochs * sum(parts[x].values())) for x in names])
        return {k: v for x, n in zip(names, got, strict=True) for k, v in down(parts[x], level + 1, n).items()}

    return down(dict(sizes), 0, budget)


def tokens_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")).cast("long")


def planned(leaves: DataFrame, weights: list[Mapping], share: float, max_epochs: int) -> DataFrame:
    """leaves (path array, t tokens) with the budget of each; as budgets(), one level after another."""
    total = leaves.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    nodes = leaves.select(F.slice("path", 1, 0).alias("at")).distinct().withColumn("budget", F.lit(int(total * share)).cast("long"))

    def among(own: Mapping) -> Callable[[pa.Table], pa.Table]:
        weight = {k: float(w) for k, w in own.items()}

        def one(t: pa.Table) -> pa.Table:
            rows = sorted(t.to_pylist(), key=lambda r: (r["name"] is None, r["name"]))
            got = shares(rows[0]["budget"], [(weight.get(r["name"], 1.0), max_epochs * r["t"]) for r in rows])
            return pa.table({"at": pa.array([r["child"] for r in rows], pa.list_(pa.string())), "budget": pa.array(got, pa.int64())})

        return one

    for level, own in enumerate(weights):
        children = leaves.groupBy(F.slice("path", 1, level).alias("at"), F.get("path", F.lit(level)).alias("name"), F.slice("path", 1, level + 1).alias("child")).agg(F.sum("t").alias("t"))
        nodes = stored(children.join(nodes, "at").groupBy("at").applyInArrow(among(own), "at array<string>, budget long"))
    return leaves.join(nodes.withColumnRenamed("at", "path"), "path")


def ends(ranges: DataFrame, digits: int) -> DataFrame:
    """(leaf, rest, range, before): the hash range of each leaf in which its rest of tokens ends, and the tokens before it.

    ranges: leaf, rest, range (of so many digits), n tokens.
    """
    found = None
    for upto in [*range(DIGITS, digits, DIGITS), digits]:
        now = ranges
        if found is not None:
            now = now.join(found.select("leaf", F.col("range").alias("head"), "before"), "leaf").filter(F.col("range").startswith(F.col("head")))
        else:
            now = now.withColumn("before", F.lit(0).cast("long"))
        sums = now.groupBy("leaf", "rest", "before", F.substring("range", 1, upto).alias("range")).agg(F.sum("n").alias("n"))
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = sums.withColumn("before", F.col("before") + earlier).filter("before <= rest and before + n > rest").select("leaf", "rest", "range", "before")
        found = stored(found)
    return found


def mix(df: DataFrame, levels: list[str], weights: list[Mapping], share: float, max_epochs: int = 3, seed: int = 0, text: str = "text", key: str = "doc_id", most_leaves: int = 100_000) -> DataFrame:
    """df with n_tokens and n_copies, how often the mixture holds the row; share: the budget as a part of df's tokens."""
    df = without(df, "n_tokens", "n_copies", "__leaf", "__mark", "__epochs", "__rest", "__stop")
    path = F.array(*[named(c).cast("string") for c in levels])
    mark = F.concat_ws(":", F.coalesce(named(key).cast("string"), F.lit("")), F.xxhash64(named(text)).cast("string"))
    rows = stored(df.select(F.to_json(path).alias("leaf"), path.alias("path"), mark.alias("mark"), tokens_of(named(text)).alias("n")))
    sizes = stored(rows.groupBy("leaf", "path").agg(F.sum("n").alias("t"), F.count("*").alias("rows")))
    n_leaves, largest = sizes.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    small = F.broadcast if n_leaves <= most_leaves else lambda table: table
    plan = planned(sizes, weights, share, max_epochs)
    plan = stored(plan.select("leaf", F.when(F.col("t") > 0, F.expr("budget div t")).otherwise(0).alias("epochs"), F.when(F.col("t") > 0, F.expr("budget % t")).otherwise(0).alias("rest")))
    digits = 1
    while largest / 16**digits > RANGE_ROWS:
        digits += 1
    order = lambda epochs, m: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epochs).cast("string"), m))
    ordered = rows.join(small(plan), "leaf").filter("rest > 0").select("leaf", "rest", "n", order("epochs", F.col("mark")).alias("at"))
    ranges = stored(ordered.groupBy("leaf", "rest", F.substring("at", 1, digits).alias("range")).agg(F.sum("n").alias("n")))
    ended = ends(ranges, digits)  # one row a leaf at most
    last = ordered.withColumn("range", F.substring("at", 1, digits)).join(small(ended.drop("rest")), ["leaf", "range"]).groupBy("leaf", "rest", "before", "at").agg(F.sum("n").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    over = last.withColumn("upto", upto).filter("upto > rest").groupBy("leaf").agg(F.min("at").alias("stop"))  # the first that is too much
    stops = stored(plan.join(over, "leaf", "left").select(F.col("leaf").alias("__leaf"), F.col("epochs").alias("__epochs"), F.col("rest").alias("__rest"), F.col("stop").alias("__stop")))
    kept = df.withColumns({"__leaf": F.to_json(path), "n_tokens": tokens_of(named(text)), "__mark": mark}).join(small(stops), "__leaf", "left")
    once = F.when((F.col("__rest") > 0) & F.coalesce(order("__epochs", F.col("__mark")) < F.col("__stop"), F.lit(True)), 1).otherwise(0)
    copies = (F.coalesce(F.col("__epochs"), F.lit(0)) + once).cast("long")
    return kept.withColumn("n_copies", copies).select(*columns_of(df), "n_tokens", "n_copies")


#: What production mixes: sources belong to domains; unnamed ones to "other". All are parameters of mix().
DOMAINS = {f"src{i}": d for d, own in (("web", range(5)), ("books", range(5, 10)), ("code", range(10, 15)), ("forum", range(15, 20))) for i in own}
WEIGHTS = [{"web": 3.0, "books": 2.0, "code": 2.0, "forum": 1.0}, {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, {}]
SHARE, EPOCHS, SEED = 0.6, 3, 17


def with_domain(df: DataFrame, name: str = "domain") -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])
    return without(df, name).withColumn(name, F.coalesce(F.element_at(pairs, F.col("source")), F.lit("other")))


def digest(df: DataFrame) -> DataFrame:
    """The columns of op10."""
    out = mix(with_domain(df.select("doc_id", "text", "lang", "source")), ["domain", "lang", "source"], WEIGHTS, SHARE, EPOCHS, SEED)
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "n_copies")


def mixed(df: DataFrame) -> DataFrame:
    """The mixture of documents: each row as often as the mixture holds it; columns as they came."""
    out = mix(with_domain(df, "__domain"), ["__domain", "lang", "source"], WEIGHTS, SHARE, EPOCHS, SEED)
    return out.filter("n_copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select(*columns_of(df))



