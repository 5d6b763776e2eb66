"""Exact top-k inner products by best-first search of M-trees.

Inner products become distances by one more coordinate: with R the largest norm, a vector x gets sqrt(R^2 - |x|^2) and a query
0, so that distance^2 = |q|^2 + R^2 - 2 q.x and the nearest vectors are those of the highest score.

The index is a table of pages. Vectors go to the nearest of at most ``MAX_CELLS`` routing objects; a cell's vectors are dealt
to trees of bounded size, so identical vectors or one dense cell never meet in one task. Each tree's nodes are pages with a
routing object, its covering radius and the distance to the parent's; leaf pages have the entries with theirs.

Queries walk a tree in blocks. The page with the best bound of any query is read first; the stored distances bound each
entry's and child's distance by the triangle inequality before any is computed, and only queries whose k-th best score still
allows a page take part in it. A first k-th score comes from a bounded sample, so pruning starts at once. Scores are exact
integers; distances only decide what is skipped, with a margin for rounding.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import durable

TREE, LEAF, FAN = 4096, 256, 8  # vectors of a tree, entries of a leaf, children of a node
MAX_CELLS = 256
SAMPLE = 2048  # vectors whose scores give the first bound; they are broadcast
BLOCK, BLOCKS_A_GROUP = 1024, 16  # queries walked together, blocks that a task holds at once
PAGES = "tree long, node int, parent int, center binary, radius double, parent_distance double, ids binary, vectors binary, distances binary"


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * component) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null, and without null, NaN or infinite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def matrix(rows: list | pd.Series, width: int) -> np.ndarray:
    """Integer rows as one array, shorter ones ended with zeros."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


@dataclass
class Space:
    width: int
    radius2: float  # R^2
    exact: bool  # whether doubles hold every score

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with their additional coordinate."""
        f = x.astype(np.float64)
        return np.column_stack([f, np.sqrt(np.maximum(0.0, self.radius2 - (f * f).sum(axis=1)))])

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return q.astype(np.float64) @ x.astype(np.float64).T
        whole = q.astype(object) @ x.astype(object).T
        return np.clip(whole, -(2**63), 2**63 - 1)

    @property
    def slack(self) -> float:
        """Rounding of a distance, at most."""
        return 1e-6 * (1.0 + math.sqrt(self.radius2))


def build(tree: int, ids: np.ndarray, vectors: np.ndarray, space: Space) -> list[tuple]:
    """The pages of one tree."""
    lifted, pages = space.lift(vectors), []
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(ids)), 0, -1)]  # members, the routing object among them, parent page
    while todo:
        members, center, parent = todo.pop()
        far = np.linalg.norm(lifted[members] - lifted[center], axis=1)
        up = pages[parent][3] if parent >= 0 else None
        node = len(pages)
        leaf = len(members) <= LEAF
        pages.append(
            (
                tree,
                node,
                parent,
                lifted[center],
                float(far.max()),
                float(np.linalg.norm(lifted[center] - up)) if up is not None else 0.0,
                ids[members].tobytes() if leaf else None,
                vectors[members].tobytes() if leaf else None,
                far.tobytes() if leaf else None,
            )
        )
        if leaf:
            continue
        # routing objects: each the farthest from those before
        chosen, near = [center], far.copy()
        while len(chosen) < FAN and near.max() > 0:
            chosen.append(int(members[near.argmax()]))
            near = np.minimum(near, np.linalg.norm(lifted[members] - lifted[chosen[-1]], axis=1))
        if len(chosen) < 2:  # all in one place
            parts = np.array_split(members, math.ceil(len(members) / LEAF))
            todo += [(p, int(p[0]), node) for p in parts]
            continue
        all_far = np.stack([np.linalg.norm(lifted[members] - lifted[c], axis=1) for c in chosen])
        nearest = all_far.argmin(axis=0)
        todo += [(members[nearest == i], c, node) for i, c in enumerate(chosen) if (nearest == i).any()]
    return [(*p[:3], p[3].tobytes(), *p[4:]) for p in pages]


class Best:
    """The k best (score, id) of each query of a block, ties to the smaller id."""

    def __init__(self, queries: int, k: int, first: np.ndarray):
        self.k, self.first = k, first
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.bar = first.copy()  # a score that the k-th best reaches at least

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        row, score, id_ = np.concatenate([self.row, rows]), np.concatenate([self.score, scores]), np.concatenate([self.id, ids])
        order = np.lexsort((id_, -score, row))
        row = row[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        keep = order[place < self.k]
        full = order[place == self.k - 1]
        self.bar = self.first.copy()
        owner = np.concatenate([self.row, rows])
        self.bar[owner[full]] = np.maximum(self.bar[owner[full]], score[full])
        self.row, self.score, self.id = owner[keep], score[keep], id_[keep]


def walk(pages: pd.DataFrame, ids: np.ndarray, queries: np.ndarray, first: np.ndarray, k: int, space: Space) -> Best:
    """Best-first search of one tree for a block of queries."""
    rows = list(pages.sort_values("node").itertuples(index=False))
    centers = np.stack([np.frombuffer(r.center) for r in rows])[:, :-1]
    radius, up = np.array([r.radius for r in rows]), np.array([r.parent_distance for r in rows])
    children: list[list[int]] = [[] for _ in rows]
    for r in rows:
        if r.parent >= 0:
            children[r.parent].append(r.node)
    flat = queries.astype(np.float64)
    reach = (flat * flat).sum(axis=1) + space.radius2  # distance^2 = reach - 2 * score
    best, slack = Best(len(ids), k, first), space.slack
    distance = lambda q, c: np.sqrt(np.maximum(0.0, reach[q][:, None] - 2.0 * (flat[q] @ centers[c].T)))
    limit = lambda q: np.sqrt(np.maximum(0.0, reach[q] - 2.0 * best.bar[q])) + slack  # noqa: E731  farther entries are too far
    everyone = np.arange(len(ids))
    from_root = distance(everyone, [0])[:, 0]
    heap = [(float((from_root - radius[0]).min()), 0, everyone, from_root)]
    while heap:
        _, node, own, far = heapq.heappop(heap)
        live = far - radius[node] <= limit(own)
        own, far = own[live], far[live]
        if not len(own):
            continue
        bound = limit(own)
        if children[node]:
            below = np.array(children[node])
            possible = np.abs(far[:, None] - up[below]) - radius[below] <= bound[:, None]  # before any distance is computed
            own_any = possible.any(axis=1)
            below, own, far, possible = below[possible.any(axis=0)], own[own_any], far[own_any], possible[own_any][:, possible.any(axis=0)]
            if not len(own):
                continue
            exact = distance(own, below)
            for i, child in enumerate(below):
                mine = possible[:, i]
                heapq.heappush(heap, (float((exact[mine, i] - radius[child]).min()), int(child), own[mine], exact[mine, i]))
            continue
        r = rows[node]
        stored = np.frombuffer(r.distances)
        possible = np.abs(far[:, None] - stored) <= bound[:, None]
        entries, takes = np.flatnonzero(possible.any(axis=0)), possible.any(axis=1)
        own = own[takes]
        if not len(own):
            continue
        names = np.frombuffer(r.ids, dtype=np.int64)[entries]
        scores = space.scores(queries[own], np.frombuffer(r.vectors, dtype=np.int64).reshape(-1, space.width)[entries])
        good = (scores >= best.bar[own][:, None]) & (names[None, :] != ids[own][:, None])
        i, j = np.nonzero(good)
        if len(i):
            best.add(own[i], scores[i, j], names[j])
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """Each query's k vectors of the highest inner product: query_id, rank, vec_id, score.

    Both relations have an id and an array of longs (see :func:`quantised`; shorter arrays count as ended with zeros); rows
    without either take no part. A vector with the query's own id is not its candidate. Ties go to the smaller id; a query with
    fewer candidates has them all. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    named = [F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")]
    own = durable(vectors.select(*named).filter("id IS NOT NULL AND v IS NOT NULL"), "mtree-vectors")
    asked = durable(queries.select(*named).filter("id IS NOT NULL AND v IS NOT NULL"), "mtree-queries")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    both = own.unionByName(asked)
    facts = both.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    n, norm2 = own.agg(F.count(F.lit(1)), F.max(square)).first()
    width, largest = max(1, facts[0] or 0), facts[1] or 0.0
    space = Space(width, norm2 or 0.0, width * largest * largest < 2.0**52)
    cells, asked_n = min(MAX_CELLS, max(1, math.ceil(n / TREE))), asked.count()
    sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # bounded; also the cells' routing objects
    sample_ids, sample_v = np.array([r["id"] for r in sample], dtype=np.int64), matrix([r["v"] for r in sample], width)
    shipped = spark.sparkContext.broadcast((sample_ids, sample_v, space.lift(sample_v[:cells])))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, routing = shipped.value
        for frame in frames:
            lifted = space.lift(matrix(frame["v"], width))
            cell = ((routing * routing).sum(axis=1) - 2.0 * lifted @ routing.T).argmin(axis=1)
            yield frame.assign(cell=cell)

    placed = own.mapInPandas(place, "id long, v array<bigint>, cell long")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(TREE)).alias("trees"))  # at most MAX_CELLS rows
    dealt = placed.join(F.broadcast(sizes), "cell").select("id", "v", (F.col("cell") + MAX_CELLS * F.pmod(F.xxhash64("id"), "trees")).alias("tree"))

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = build(int(key[0]), frame["id"].to_numpy(np.int64), matrix(frame["v"], width), space)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])

    pages = durable(dealt.groupBy("tree").applyInPandas(grow, PAGES), "mtree-pages")
    blocks = max(1, math.ceil(asked_n / BLOCK))
    groups = math.ceil(blocks / BLOCKS_A_GROUP)

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """A block of queries with a first bound of each one's k-th score."""
        ids, v = frame["id"].to_numpy(np.int64), matrix(frame["v"], width)
        names, seen, _ = shipped.value
        scores = space.scores(v, seen).astype(np.float64)
        scores[names[None, :] == ids[:, None]] = -np.inf
        first = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
        return pd.DataFrame([(int(key[0]), ids.tobytes(), v.tobytes(), first.tobytes())], columns=["block", "ids", "queries", "first"])

    packed = durable(
        asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).applyInPandas(pack, "block long, ids binary, queries binary, first binary"),
        "mtree-blocks",
    )
    trees = pages.filter("node = 0").select(F.col("tree").alias("asked_tree"))
    # the stated queries against all rows: each tree with each group of blocks
    left = pages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asks = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).join(packed, "block")
    right = asks.withColumn("asked_part", (F.col("block") % groups).cast("int"))

    def search(pages: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = []
        for block in blocks.itertuples(index=False) if len(pages) else ():
            ids = np.frombuffer(block.ids, dtype=np.int64)
            best = walk(pages, ids, np.frombuffer(block.queries, dtype=np.int64).reshape(-1, width), np.frombuffer(block.first), k, space)
            found.append(pd.DataFrame({"query_id": ids[best.row], "vec_id": best.id, "score": best.score.astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})

    met = left.groupBy("tree", "part").cogroup(right.groupBy("asked_tree", "asked_part")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # cut to k in each task before the exchange
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
