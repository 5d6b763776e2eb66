"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints are the leaves of a binary trie, bits from the top. The join walks pairs of nodes of the same depth together and
keeps the number of bits in which their paths differ; a pair is dropped once that exceeds the error budget. The upper levels
are walked by Spark: nodes of a depth fixed by the number of distinct fingerprints are cut into pages of bounded size, and an
equi-join on the node's path with up to ``budget`` bits turned pairs the pages. Below, each pair of pages is walked level by
level in one task with arrays of node pairs, in pieces of bounded number.

Copies share a fingerprint and are one leaf. Each pair of pages yields a spanning forest of its links, not the links
themselves, so a dense group gives as many rows as it has fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import jaccard_join
from ledgerloom.llm.common import row_key, without
from ledgerloom.llm.components import components, forest
from ledgerloom.session import durable

BITS, SEED, WIDTH, BUDGET = 64, 42, 3, 2
PAGE = 4096
MAX_DEPTH = 20
FRONTIER = 1 << 18  # node pairs walked at a time
LEAF = 8  # a pair of nodes with so few pairs of fingerprints is compared directly
SHINGLES = 1 << 16  # hashes counted at a time


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bit i is set when over half of the shingles' hashes have it; a text without words has 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks count
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    if n == 1:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts, (e - 1 for e in ends[width - 1 :]), strict=True)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    hashes = [digest(joined[s:e], SEED) for s, e in spans]
    for at in range(0, n, SHINGLES):
        part = np.array(hashes[at : at + SHINGLES], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def walk(left: np.ndarray, right: np.ndarray, same: bool, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked fingerprints of two sorted pages whose paths from the top to ``depth`` are each one node.

    ``same``: both are one page, and each pair is given once.
    """
    if not len(left) or not len(right):
        return
    shift = np.uint64(BITS - depth)
    begun = int(np.bitwise_count((left[0] ^ right[0]) >> shift)) if depth else 0
    if begun > budget:
        return
    todo = [(depth, *(np.array([x]) for x in (0, len(left), 0, len(right), begun)))]
    while todo:
        level, a0, a1, b0, b1, diff = todo.pop()
        small = (a1 - a0) * (b1 - b0) <= LEAF
        if level == BITS:
            small[:] = True
        if small.any():
            na, nb = (a1 - a0)[small], (b1 - b0)[small]
            n = na * nb
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(a0[small], n) + place // np.repeat(nb, n), np.repeat(b0[small], n) + place % np.repeat(nb, n)
            linked = np.bitwise_count(left[i] ^ right[j]) <= budget
            if same:
                linked &= i < j
            if linked.any():
                yield i[linked], j[linked]
            a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        bit = np.uint64(BITS - 1 - level)
        one = np.uint64(1)
        set_a, set_b = (np.concatenate([[0], np.cumsum((x >> bit) & one)]).astype(np.int64) for x in (left, right))
        am, bm = a1 - (set_a[a1] - set_a[a0]), b1 - (set_b[b1] - set_b[b0])  # where each node's upper child starts
        pairs = [
            (x0, x1, y0, y1, diff + more)
            for x0, x1, y0, y1, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1))
        ]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*pairs, strict=True))
        live = (a1 > a0) & (b1 > b0) & (diff <= budget)
        if same:
            live &= a0 <= b0
        a0, a1, b0, b1, diff = (x[live] for x in (a0, a1, b0, b1, diff))
        for at in range(0, len(a0), FRONTIER):
            todo.append((level + 1, *(x[at : at + FRONTIER] for x in (a0, a1, b0, b1, diff))))


def links(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``nodes.fp`` (distinct longs) within ``budget`` bits."""
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(nodes.count(), 1) / PAGE))))
    path = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    placed = nodes.select("fp", path.alias("path"))
    # at most 2 ** MAX_DEPTH rows, one per node of that depth
    sizes = F.broadcast(placed.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / F.lit(PAGE)).alias("pages")))
    pages = durable(
        placed.join(sizes, "path")
        .groupBy("path", F.pmod(F.xxhash64("fp"), "pages").alias("page"))
        .agg(F.collect_list("fp").alias("fps")),  # about PAGE fingerprints
        "simhash-pages",
    )
    masks = [sum(1 << b for b in c) for k in range(min(budget, depth) + 1) for c in combinations(range(depth), k)]
    turned = pages.select(
        "path", "page", "fps", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")
    ).select((F.col("path").bitwiseXOR(F.col("mask"))).alias("to"), F.struct("path", "page").alias("left"), F.col("fps").alias("own"))
    others = pages.select(F.col("path").alias("to"), F.struct("path", "page").alias("right"), F.col("fps").alias("other"))
    met = turned.join(others, "to").filter("left <= right").select("own", "other", (F.col("left") == F.col("right")).alias("same"))

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, other, same in frame.itertuples(index=False):
                a, b = (np.sort(np.asarray(x, dtype=np.int64).view(np.uint64)) for x in (own, other))
                both, shift = (a, 0) if same else (np.concatenate([a, b]), len(a))
                label = forest(len(both), ((i, j + shift) for i, j in walk(a, b, bool(same), depth, budget)))
                moved = np.flatnonzero(label != np.arange(len(both)))
                yield pd.DataFrame({"a": both[moved].view(np.int64), "b": both[label[moved]].view(np.int64)})

    return met.mapInPandas(join, "a long, b long")


def _classes(docs: DataFrame, doc_id: str, text: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (doc_id, _key, fp) and for each fingerprint its class's first row, both written."""
    rows = durable(
        docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("_key"), fingerprints(F.col(text)).alias("fp")), "simhash-rows"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")).alias("first")
    nodes = durable(rows.groupBy("fp").agg(first), "simhash-nodes")
    roots = durable(components(links(nodes, budget)), "simhash-roots")
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = labelled.groupBy("root").agg(F.min("first").alias("class_first"))
    return rows, durable(labelled.select("fp", "root").join(firsts, "root").drop("root"), "simhash-classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of the texts' 3-word shingles (A-Z lower-cased, split at ASCII blanks, repeats counted; fewer words: the
    whole text; none or null: zero) link at ``budget`` or fewer differing bits; component_id is the smallest id reachable, null only
    if no row of the component has one. An empty table gives an empty result; other columns are not read.
    """
    rows, classes = _classes(docs, doc_id, text, budget)
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("class_first.doc_id").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """``docs`` with one row of each component (smallest id, nulls last), all columns as they were."""
    rows, classes = _classes(docs, doc_id, text, budget)
    found = rows.join(classes, "fp").select("_key", (F.col("_key") == F.col("class_first._key")).alias("stays"))
    keys = durable(found.groupBy("_key").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1 OR NOT stays"), "simhash-keys")
    return without(docs, row_key(doc_id, text), keys.filter("NOT stays").select("_key"), keys.filter("stays").select("_key"))


def _trie_pairs(sets: DataFrame, budget: int) -> DataFrame:
    """Pairs (a, b) of ``sets`` (fp, simhash) whose SimHash fingerprints are equal or linked in the trie."""
    firsts = durable(sets.groupBy("simhash").agg(F.min("fp").alias("first")), "simhash-firsts")
    edges = links(firsts.select(F.col("simhash").alias("fp")), budget)
    one, two = (firsts.select(F.col("simhash").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab")
    between = edges.join(one, "a").join(two, "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return between.unionByName(sets.join(firsts, "simhash").filter("fp > first").select(F.col("first").alias("a"), F.col("fp").alias("b")))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, budget: int = BUDGET) -> DataFrame:
    """``docs`` with one row of each component of texts whose ``width``-word shingle sets have a Jaccard similarity of ``least`` or more.

    The trie's self-join over SimHash fingerprints of those sets comes first: its pairs are verified on the whole sets, so groups
    of close copies are one component at once. Sets as far apart as 0.8 differ in up to a third of the bits, which no error budget
    of a trie reaches; :func:`jaccard_join.drop_similar` finds what is left, exactly, and says what stays for odd rows.
    """
    return jaccard_join.drop_similar(docs, doc_id, text, width, least, likely=lambda sets: _trie_pairs(sets, budget))
