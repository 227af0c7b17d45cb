"""Mixing sources to target weights: budgets through a tree of levels, then a token-prefix of seeded epochs for each leaf."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovel.llm.common import cut

#: Rows of a leaf's order that a window reads; while the range in which a budget ends holds more, it is split by 256.
RANGE_ROWS = 256
#: Leaves up to which their cuts, about 100 bytes each, are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LEAVES = 100_000


def share(total: int, capacity: dict, weight: dict) -> dict:
    """total dealt by weight, none above its capacity: what some cannot take goes to the others by their weights, until it
    is dealt or all are full. Whole tokens; the remainder of a division goes to the largest fractions, then the first keys."""
    given, left, open_to = dict.fromkeys(capacity, 0), min(total, sum(capacity.values())), sorted(k for k in capacity if weight[k] > 0 and capacity[k] > 0)
    while left and open_to:
        whole = sum(weight[k] for k in open_to)
        full = [k for k in open_to if given[k] + left * weight[k] / whole >= capacity[k]]
        if full:  # those that are full at this rate take their all, and the rest is dealt anew
            for k in full:
                left -= capacity[k] - given[k]
                given[k] = capacity[k]
            open_to = [k for k in open_to if k not in set(full)]
            left = max(left, 0)
            continue
        exact = {k: left * weight[k] / whole for k in open_to}
        for k in open_to:
            given[k] += int(exact[k])
        over = left - sum(int(v) for v in exact.values())
        for k in sorted(open_to, key=lambda k: (int(exact[k]) - exact[k], k))[:over]:
            given[k] += 1
        left = 0
    return given


def budgets(totals: DataFrame, depth: int, weights: Mapping[tuple, float], total: int, epochs: int) -> DataFrame:
    """mix_leaf, n, tokens for leaves (mix_leaf, an array of depth names) with n tokens available. weights: of nodes by path, 1
    where none is given. A node's tokens are dealt among its children, which hold at most epochs times what they have; so a
    child's shortage goes to its siblings first, and to its parent's siblings only if they are all full.

    Level by level from the root; a node's children meet in one task, as a name and two numbers each, so the tree may be of
    any size and none of it passes the driver.
    """
    at = lambda d: F.to_json(F.slice("mix_leaf", 1, d)) if d else F.lit("[]")

    def deal(children: pd.DataFrame) -> pd.DataFrame:
        hold = dict(zip(children.path, (int(x) for x in children.hold), strict=True))
        weight = {k: float(weights.get(tuple(json.loads(k)), 1.0)) for k in hold}
        given = share(int(children.given.iloc[0]), hold, weight)
        return pd.DataFrame({"parent": list(given), "given": list(given.values())}, columns=["parent", "given"])

    spark = totals.sparkSession
    given = spark.createDataFrame([("[]", total)], "parent string, given long")
    for d in range(1, depth + 1):
        nodes = totals.groupBy(at(d).alias("path"), at(d - 1).alias("parent")).agg((F.sum("n") * epochs).cast("long").alias("hold"))
        given = nodes.join(given, "parent").groupBy("parent").applyInPandas(deal, "parent string, given long")
    return totals.withColumn("parent", at(depth)).join(given, "parent").select("mix_leaf", "n", F.col("given").alias("tokens"))


def _order(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), "mix_key"))


def _beside(rows: DataFrame, per_leaf: DataFrame, leaves: int) -> DataFrame:
    """rows with what stands for their leaf: no shuffle, so a leaf with a third of all rows is no hot key, while leaves are few."""
    return rows.join(F.broadcast(per_leaf) if leaves <= BROADCAST_LEAVES else per_leaf, "mix_leaf")


def cuts(rows: DataFrame, depth: int, *, total: int | float, weights: Mapping[tuple, float], epochs: int, seed: int) -> DataFrame:
    """mix_leaf, full, last: of each leaf of rows (mix_leaf, mix_key, mix_tokens), the epochs it gives whole, and up to which
    place of the order of the epoch after it gives rows (null: none)."""
    totals = cut(rows.groupBy("mix_leaf").agg(F.sum("mix_tokens").alias("n")))
    there = totals.agg(F.sum("n")).first()[0] or 0
    plan = budgets(totals, depth, weights, int(total * there) if isinstance(total, float) else total, epochs)
    plan = cut(plan.select("mix_leaf", F.expr("if(n > 0, tokens div n, 0)").cast("int").alias("full"), F.expr("if(n > 0, tokens % n, 0)").alias("rest")))
    leaves = plan.count()
    ordered = _beside(rows, plan.where("rest > 0"), leaves).select("mix_leaf", "rest", "mix_tokens", _order(seed, F.col("full")).alias("mix_order"))
    ends = plan.where("rest > 0").select("mix_leaf", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for digits in range(2, 33, 2):
        inside = _beside(ordered, ends, leaves).where("startswith(mix_order, prefix)")
        sums = inside.groupBy("mix_leaf", "rest", "before", F.substring("mix_order", 1, digits).alias("prefix")).agg(F.sum("mix_tokens").alias("n"), F.count("*").alias("rows"))
        upto = sums.withColumn("upto", F.expr("before + sum(n) OVER (PARTITION BY mix_leaf ORDER BY prefix)")).where("upto > rest")  # at most 256 rows a leaf
        ends = cut(upto.groupBy("mix_leaf").agg(F.min(F.struct("prefix", (F.col("upto") - F.col("n")).alias("before"), "rows")).alias("end")).select("mix_leaf", "end.*"))
        if (ends.agg(F.max("rows")).first()[0] or 0) <= RANGE_ROWS:
            break
    single = _beside(ordered, ends, leaves).where("startswith(mix_order, prefix)").groupBy("mix_leaf", "rest", "before", "mix_order").agg(F.sum("mix_tokens").alias("n"))
    fits = single.withColumn("upto", F.expr("before + sum(n) OVER (PARTITION BY mix_leaf ORDER BY mix_order)")).where("upto <= rest").groupBy("mix_leaf").agg(F.max("mix_order").alias("best"))
    last = ends.join(fits, "mix_leaf", "left").select("mix_leaf", F.coalesce("best", "prefix").alias("last"))
    return cut(plan.join(last, "mix_leaf", "left").select("mix_leaf", "full", "last"))


def tree_leaf(levels: list[Column]) -> Column:
    return F.array(*[F.coalesce(x.cast("string"), F.lit("")) for x in levels])


def tree_rows(docs: DataFrame, levels: list[Column], tokens: Column, key: Column) -> DataFrame:
    """mix_leaf, mix_key, mix_tokens of docs: what cuts() reads, without their other columns."""
    n = F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)).cast("long")
    return docs.select(tree_leaf(levels).alias("mix_leaf"), F.coalesce(key.cast("string"), F.lit("")).alias("mix_key"), n.alias("mix_tokens"))


def apply(docs: DataFrame, found: DataFrame, *, levels: list[Column], key: Column, seed: int = 17) -> DataFrame:
    """docs with mix_epoch (from 0) and mix_leaf added: the rows that the cuts found choose, once an epoch. Each row is judged
    alone, by its leaf's cut; texts are neither counted again nor shuffled while the leaves are few enough to be broadcast."""
    known = [F.col(f"`{c}`") for c in docs.columns if not c.startswith("mix_")]
    rows = docs.select(*known, tree_leaf(levels).alias("mix_leaf"), F.coalesce(key.cast("string"), F.lit("")).alias("mix_key"))
    rows = _beside(rows, found, found.count()).withColumn("mix_upto", F.col("full") + F.coalesce((_order(seed, F.col("full")) <= F.col("last")).cast("int"), F.lit(0)))
    rows = rows.where("mix_upto > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_upto") - 1)))
    return rows.select(*known, "mix_epoch", "mix_leaf")


def mix(docs: DataFrame, *, levels: list[Column], tokens: Column, key: Column, total: int | float, weights: Mapping[tuple, float] | None = None, epochs: int = 2, seed: int = 17) -> DataFrame:
    """docs, all their columns, with mix_epoch (from 0) and mix_leaf added: the chosen rows, once an epoch.

    levels: the tree's levels from the root, as text, null as ''. tokens: a row's tokens; null and negative count as 0.
    key: a text that tells rows apart; rows of one key are chosen or left together. total: tokens to choose, or the share of
    all there are if a fraction (float). In each epoch a leaf's order is that of md5(seed, epoch, key), and the last, partial,
    epoch ends before the first key that would pass its budget. Rows of 0 tokens come with whatever they stand beside; a leaf
    of no tokens gives none. No rows yield none. Columns named mix_* are replaced.

    Ordering costs no global sort: a leaf, its key and its tokens are written once; from them the place where a leaf's budget
    ends is found by sums over 256 ranges of the order, then 256 of the one range in which it ends, and so on.
    """
    rows = cut(tree_rows(docs, levels, tokens, key))
    return apply(docs, cuts(rows, len(levels), total=total, weights=weights or {}, epochs=epochs, seed=seed), levels=levels, key=key, seed=seed)
