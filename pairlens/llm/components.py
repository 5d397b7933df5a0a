"""Connected components of a link table that never leaves the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import saved


def connected_components(links: DataFrame) -> DataFrame:
    """(node, rep) for every node of ``links`` (a long, b long); nodes of a component share their rep.

    Contraction: each round a node moves to the neighbour (or itself) with the smallest
    hash, links are rewritten, and loops and repeats dropped.  Hashes change with the
    round, so a constant share of the nodes goes each time, whatever the shape.  A hub's
    neighbours are reduced before the shuffle; joins have plain shuffled sides, which
    Spark can split when a node is hot.
    """
    links = saved(links.where("a <> b").distinct(), "links")
    both = links.select("a").union(links.select("b"))
    labels = saved(both.distinct().select(F.col("a").alias("node"), F.col("a").alias("rep")), "labels")
    step = 0
    while not links.isEmpty():
        order = F.xxhash64(F.lit(step), F.col("b"))
        near = links.union(links.select("b", "a")).groupBy("a").agg(F.min(F.struct(order.alias("h"), "b")).alias("least"))
        own = F.struct(F.xxhash64(F.lit(step), F.col("a")).alias("h"), F.col("a").alias("b"))
        moves = saved(near.select("a", F.least("least", own)["b"].alias("to")), "moves")
        a, b = moves.select("a", F.col("to").alias("x")), moves.select(F.col("a").alias("b"), F.col("to").alias("y"))
        moved = links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links = saved(moved.where("a <> b").distinct(), "links")
        now = moves.select(F.col("a").alias("rep"), "to")
        labels = saved(labels.join(now, "rep", "left").select("node", F.coalesce("to", "rep").alias("rep")), "labels")
        step += 1
    return labels


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links a - b: the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, further := label[label]):
            label = further
    return label


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The links of a minimum spanning forest over nodes 0 to n - 1, by index."""
    order = np.lexsort((np.arange(len(a)), weight))
    a, b = a[order], b[order]
    label, chosen, alive = np.arange(n), [], np.arange(len(a))
    while True:
        x, y = label[a[alive]], label[b[alive]]
        alive = alive[x != y]
        if not len(alive):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        x, y = label[a[alive]], label[b[alive]]
        # The lightest link of each tree; ranks are distinct, so these close no cycle.
        best = np.full(n, len(a))
        np.minimum.at(best, x, alive)
        np.minimum.at(best, y, alive)
        picked = np.unique(best[best < len(a)])
        chosen.append(picked)
        label = local_components(n, label[a[picked]], label[b[picked]])[label]
