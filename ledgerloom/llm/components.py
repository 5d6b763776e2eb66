"""Connected components of a distributed graph by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import durable


def _stars(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's neighbours linked to the least of the node and its neighbours: (a, b) with a above b.

    ``larger_only`` moves only the neighbours above the node; else pairs (a, b) have a above b already, and the node moves
    along. The minima are written first: the join is then one of two plain exchanges, whose hot nodes can be split.
    """
    least = durable(pairs.groupBy("a").agg(F.min(F.least("a", "b")).alias("least")), "star")
    if larger_only:
        found = pairs.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        found = moved.unionByName(least.select("a", F.col("least").alias("b")))
    return found.filter("a > b").distinct()


#: Pairs that one task finishes.
LOCAL = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not the least of its component; root is that least node.

    Rounds alternate between linking larger neighbours to the least one and smaller neighbours to it, which takes a number of
    rounds logarithmic in the component's size. Each round is a written table. No more than ``LOCAL`` pairs are one task's.
    """
    pairs = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    mark = None
    while True:
        seen = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if seen[0] <= LOCAL:
            return pairs.coalesce(1).mapInPandas(_finished, "node long, root long")
        mark = seen
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = durable(_stars(durable(_stars(both, True), "edges"), False), "edges")


def _finished(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pairs = np.concatenate([np.empty((0, 2), np.int64), *[f[["a", "b"]].to_numpy(np.int64) for f in frames]])
    names, at = np.unique(pairs, return_inverse=True)  # sorted, so the least node has the least place
    at = at.reshape(-1, 2)
    label = forest(len(names), iter([(at[:, 0], at[:, 1])]))
    moved = np.flatnonzero(label != np.arange(len(names)))
    yield pd.DataFrame({"node": names[moved], "root": names[label[moved]]})


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least node that each of n nodes is linked to, directly or not."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            low = np.minimum(x, y)[apart]
            np.minimum.at(label, x[apart], low)
            np.minimum.at(label, y[apart], low)
            while (label != label[label]).any():
                label = label[label]
    return label
