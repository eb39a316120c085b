"""Trees as tables (node, left, right, length): average linkage in rounds of joins, and leaf sets by pointer doubling.

A leaf is (node, node, -1, length), as in functions.trees.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.lineage import BROADCAST_ROWS, checkpointed, stored
from weft.operators.pairs import tree_parents

#: Bits of a cluster's number in the key of a merge; the round is above them.
_NUMBER_BITS = 40
#: Clusters that one task merges one after another.
TASK_NODES = 1024
_STEP = "i long, j long, key long, left long, right long, height double, size long"


def in_order(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """rows with their place in an order, from 0: sorted over all partitions, whose sizes alone are added up."""
    sorted_ = checkpointed(rows.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = checkpointed(sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")))
    placed = sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row", "_part", "_start")


def linked_pairs(distances: DataFrame) -> DataFrame:
    """i, j: the pairs of distances(i, j, d), i < j, of which each is the other's nearest; of equal ones the smallest (i, j) counts as nearest."""
    best = F.min(F.struct("d", "i", "j")).alias("best")
    ends = distances.select(F.explode(F.array("i", "j")).alias("node"), "d", "i", "j")
    nearest = ends.groupBy("node").agg(best)
    return nearest.groupBy(F.col("best.i").alias("i"), F.col("best.j").alias("j")).agg(F.count("*").alias("n"), F.first("best.d").alias("d")).where("n = 2").drop("n")


def _linked_in_task(round_: int):
    """The function that merges few clusters one after another: the closest pair, of equal ones the smallest (i, j)."""

    def run(pairs: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        # No pairs: one cluster is left.
        nodes = nodes.sort_values("rep")
        reps = nodes["rep"].to_numpy()
        key, size = nodes["key"].tolist(), nodes["size"].tolist()
        total, count = np.zeros((len(reps), len(reps))), np.ones((len(reps), len(reps)))
        a, b = (np.searchsorted(reps, pairs[end].to_numpy()) for end in "ij")
        for x, y in ((a, b), (b, a)):
            total[x, y], count[x, y] = pairs["total"], pairs["n"]
        live, steps = np.arange(len(reps)), []
        while len(live) > 1:
            d = total[np.ix_(live, live)] / count[np.ix_(live, live)]
            np.fill_diagonal(d, np.inf)
            x, y = sorted(live[k] for k in divmod(int(d.argmin()), len(live)))
            size[x] += size[y]
            steps.append((reps[x], reps[y], int(reps[x]) + ((round_ + len(steps)) << _NUMBER_BITS), key[x], key[y], d.min() / 2, size[x]))
            key[x] = steps[-1][2]
            for m in (total, count):
                m[x] += m[y]
                m[:, x] += m[:, y]
            live = live[live != y]
        return pd.DataFrame(steps, columns=["i", "j", "key", "left", "right", "height", "size"])

    return run


def average_linkage(distances: DataFrame, leaves: DataFrame) -> DataFrame:
    """node, left, right, length: the UPGMA tree of leaves(node) by distances(i, j, d) of all pairs i < j.

    Average linkage never brings a merged cluster nearer than its parts were,
    so all pairs that are nearest to each other are merged in one round, and
    the tree is the same as of one merge after another: inner nodes count on
    from the largest leaf by height (equal heights by size, then by the
    smallest leaf). The last TASK_NODES clusters are merged in one task. A pair of clusters holds the sum and number of its leaves'
    distances, which merges add up. left has the smaller leaf. A branch is the
    parent's height less the node's own, the root's is 0. A round is a few
    aggregations and joins with the merged pairs; rounds are logarithmic in the
    leaves where clusters grow alike, and at most as many as merges.
    """
    pairs = stored(distances.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("d").cast("double").alias("total"), F.lit(1).cast("long").alias("n")))
    nodes = stored(leaves.select(F.col("node").cast("long").alias("rep"), F.col("node").cast("long").alias("key"), F.lit(0.0).alias("height"), F.lit(1).cast("long").alias("size")))
    rounds = []
    while True:
        if nodes.count() <= TASK_NODES:
            one = lambda df: df.withColumn("all", F.lit(0)).groupBy("all")
            rest = one(pairs).cogroup(one(nodes)).applyInPandas(_linked_in_task(len(rounds) + 1), _STEP)
            rounds.append(stored(rest))
            break
        linked = linked_pairs(pairs.select("i", "j", (F.col("total") / F.col("n")).alias("d")))
        side = lambda s: nodes.select(F.col("rep").alias(s), F.col("key").alias(f"{s}_key"), F.col("size").alias(f"{s}_size"))
        key = F.col("i") + F.lit((len(rounds) + 1) << _NUMBER_BITS)
        merged = stored(
            linked.join(side("i"), "i").join(side("j"), "j")
            .select("i", "j", key.alias("key"), F.col("i_key").alias("left"), F.col("j_key").alias("right"), (F.col("d") / 2).alias("height"), (F.col("i_size") + F.col("j_size")).alias("size"))
        )
        count = merged.count()
        if not count:
            break
        rounds.append(merged)
        small = F.broadcast if 2 * count <= BROADCAST_ROWS else (lambda df: df)
        renamed = small(merged.select(F.explode(F.array("i", "j")).alias("rep")))
        nodes = stored(nodes.join(renamed, "rep", "left_anti").unionByName(merged.select(F.col("i").alias("rep"), "key", "height", "size")))
        into = small(merged.select(F.col("j").alias("old"), F.col("i").alias("new")))
        for end in "ij":
            pairs = pairs.join(into, pairs[end] == F.col("old"), "left").withColumn(end, F.coalesce("new", end)).drop("old", "new")
        low, high = F.least("i", "j"), F.greatest("i", "j")
        pairs = stored(pairs.where("i <> j").groupBy(low.alias("i"), high.alias("j")).agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    first = leaves.select(F.col("node").cast("long").alias("key"), F.col("node").cast("long").alias("node"), F.lit(0.0).alias("height"))
    if not any(merged.limit(1).count() for merged in rounds):
        return first.select("node", F.col("node").alias("left"), F.lit(-1).cast("long").alias("right"), F.lit(0.0).alias("length"))
    steps = rounds[0]
    for merged in rounds[1:]:
        steps = steps.unionByName(merged)
    most = leaves.agg((F.max("node") + 1).cast("long").alias("most"))
    steps = checkpointed(in_order(steps, "step", "height", "size", "i").join(F.broadcast(most)).withColumn("node", F.col("step") + F.col("most")))
    known = checkpointed(first.unionByName(steps.select("key", "node", "height")))
    number = lambda name: known.select(F.col("key").alias(name), F.col("node").alias(f"{name}_node"))
    inner = steps.join(number("left"), "left").join(number("right"), "right").select("node", F.col("left_node").alias("left"), F.col("right_node").alias("right"), "height")
    links = inner.select(F.explode(F.array("left", "right")).alias("node"), F.col("height").alias("above"))
    whole = inner.unionByName(first.select("node", F.col("node").alias("left"), F.lit(-1).cast("long").alias("right"), "height"))
    return whole.join(links, "node", "left").select("node", "left", "right", F.coalesce(F.col("above") - F.col("height"), F.lit(0.0)).alias("length"))


def leaf_sets(tree: DataFrame) -> DataFrame:
    """node, leaf: all leaves below each node of tree(node, left, right), a leaf below itself too.

    Round k adds to each leaf's ancestors those 2^k further up, so a tree of
    depth h takes log2(h) + 1 rounds of two joins.
    """
    jump = stored(tree_parents(tree).where("parent >= 0").select("node", F.col("parent").alias("up")))
    found = stored(tree.where("right < 0").select(F.col("node").alias("leaf"), "node"))
    while jump.limit(1).count():
        found = stored(found.unionByName(found.join(jump, "node").select("leaf", F.col("up").alias("node"))))
        further = jump.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jump = stored(jump.join(further, "up").select("node", F.col("next").alias("up")))
    return found.select("node", "leaf")
