"""Self-join of shingle sets by Jaccard similarity: T-occurrence search over inverted lists.

Two sets of n and m shingles are similar when they share T = least / (1 + least) * (n + m) of them. Shingles have one order for
all texts, rare ones first. Of each set, only the lists of its first shingles in that order are merged; the L shingles after
them have the long lists, which are not merged but probed: a text that occurs fewer than T - L times in the merged lists cannot
reach T (DivideSkip). What remains is decided by probing one set in the other by binary search.

The order comes from a count-min sketch of all texts, of a fixed size: it decides how many texts are looked at, never which are
found. Inverted lists are rows of Spark. Lists of up to ``SHORT`` texts are merged by the texts that ask, each against the earlier
texts of its lists. A list beyond that is not merged either: it is one more probed list, which lowers the bound of a text by one,
so only pairs with many such lists can be missed. Those texts are compared with one text of each long list at a time, and what
that links is one component; between the components that are left, blocks of texts meet and give a spanning forest. A dense group therefore costs as many rows as it has members, and no group is ever in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import marked, row_key, without
from ledgerloom.llm.components import components, forest
from ledgerloom.session import durable

SEED, WIDTH, LEAST = 42, 3, 0.9
SLACK = 1e-9  # of products with ``least``
SKETCH_BITS, CHUNK_BITS = 22, 13
FLUSH = 1 << 20  # shingles a task holds before it counts them
MERGED_AT_ONCE = 64  # parts of a sketch
SHORT = 64  # texts of a list that is merged
BLOCK = 512  # texts of a long list compared at a time
WORTH = 0.1  # share of compared pairs that must link for another round of stars
SET = T.StructType([T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("simhash", T.LongType()), T.StructField("bins", T.BinaryType()), T.StructField("listed", T.ArrayType(T.LongType()))])


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the set of shingles; fewer words: the whole sequence; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks count
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends[: len(words) - width]], ends[width - 1 :], strict=True)
    return np.unique(np.array([digest(joined[s : e - 1], SEED) for s, e in spans], dtype=np.uint64))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets are similar: the smaller is probed in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return not len(b)
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both) - SLACK


def unlisted(n: np.ndarray, least: float) -> np.ndarray:
    """How many shingles of a set of n come after those whose lists are merged."""
    return np.ceil(least * n - SLACK).astype(np.int64) - 1


def occurrences(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """T - L: in how many merged lists two similar sets of n and m shingles occur together at least."""
    total = np.ceil(least / (1 + least) * (n + m) - SLACK).astype(np.int64)
    return total - np.maximum(unlisted(n, least), unlisted(m, least))


def _occurrences(n: Column, m: Column, least: float) -> Column:
    """:func:`occurrences` as a column."""
    return F.ceil(F.lit(least / (1 + least)) * (n + m) - SLACK) - F.ceil(F.lit(least) * F.greatest(n, m) - SLACK) + 1


def binned(own: np.ndarray) -> bytes:
    """How many shingles fall into each of 2 ** k equal ranges of hashes, about four to eight in each."""
    k = max(0, (len(own) // 4).bit_length() - 1)
    return np.minimum(np.bincount((own >> np.uint64(63 - k) >> np.uint64(1)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8).tobytes()


def may_be_similar(a: bytes, b: bytes, n: int, m: int, least: float) -> bool:
    """False only for sets of n and m shingles whose bins rule out a similarity of ``least``."""
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (a, b))
    if x.max() == 255 or y.max() == 255:
        return True
    bins = min(len(x), len(y))
    both = int(np.minimum(x.reshape(bins, -1).sum(axis=1), y.reshape(bins, -1).sum(axis=1)).sum())
    return both >= least * (n + m - both) - SLACK


def simhash(own: np.ndarray) -> int:
    """Bit i is set when over half of the hashes have it."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(own), 1 << 16):
        ones += np.unpackbits(own[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def _slots(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """In how many texts the shingles of each slot are: 2 ** SKETCH_BITS counters, summed over all texts in Spark."""
    chunk = 1 << CHUNK_BITS

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, held, n = np.zeros(1 << SKETCH_BITS, dtype=np.uint32), [], 0

        def flush() -> None:
            slots, times = np.unique(np.concatenate(held), return_counts=True)
            whole[slots] += times.astype(np.uint32)

        for frame in frames:
            for t in frame["t"]:
                held.append(_slots(shingles(t, width)))
                n += len(held[-1])
                if n >= FLUSH:
                    flush()
                    held, n = [], 0
        if held:
            flush()
        part = TaskContext.get().partitionId() // MERGED_AT_ONCE
        for at, own in enumerate(whole.reshape(-1, chunk)):
            if own.any():
                yield pd.DataFrame({"at": [at], "part": [part], "counts": [narrow(own)]})

    def narrow(own: np.ndarray) -> bytes:
        return own.astype(np.uint8 if own.max() < 1 << 8 else np.uint16 if own.max() < 1 << 16 else np.uint32).tobytes()

    def wide(own: bytes) -> np.ndarray:
        return np.frombuffer(own, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(own) // chunk]).astype(np.int64)

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(chunk, dtype=np.int64)
        for own in frame["counts"]:
            whole += wide(own)
        return pd.DataFrame({"at": [key[0]], "part": [0], "counts": [narrow(np.minimum(whole, 2**32 - 1).astype(np.uint32))]})

    schema = "at long, part long, counts binary"
    parts = docs.select(F.col(text).alias("t")).mapInPandas(count, schema).groupBy("at", "part").applyInPandas(add, schema)
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for r in parts.groupBy("at").applyInPandas(add, schema).toLocalIterator():
        out[r["at"] * chunk : (r["at"] + 1) * chunk] = wide(bytes(r["counts"]))
    return out


def listed(docs: DataFrame, text: Column, sketch: np.ndarray, width: int, least: float) -> Column:
    """A struct column: fingerprint, size, SimHash and bins of the set, and its shingles whose lists are merged."""
    shipped = docs.sparkSession.sparkContext.broadcast(sketch)

    @F.pandas_udf(SET)
    def cut(texts: pd.Series) -> pd.DataFrame:
        counts, out = shipped.value, []
        for t in texts:
            own = shingles(t, width)
            first = len(own) - int(unlisted(np.array(len(own)), least)) if len(own) else 0
            out.append((xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own), simhash(own), binned(own), own[np.lexsort((own, counts[_slots(own)]))[:first]].view(np.int64)))
        fps = np.array([x[0] for x in out], dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"fp": fps, "n": np.array([x[1] for x in out], dtype=np.int32), "simhash": [x[2] for x in out], "bins": [x[3] for x in out], "listed": [x[4] for x in out]})

    return cut(text)


def _runs(of: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, dtype=np.int64)


def _earlier(short: DataFrame, least: float) -> DataFrame:
    """(fp, n, fps, ns): each posting of the short lists with the earlier texts of its list, by size and fingerprint, that are
    large enough."""
    lists = short.groupBy("sh").agg(F.collect_list(F.struct("n", "fp")).alias("texts")).select("texts")  # up to SHORT texts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            flat = texts.flatten()
            n, fp = flat.field("n").to_numpy().astype(np.int64), flat.field("fp").to_numpy()
            sizes = np.diff(texts.offsets.to_numpy())
            of = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((fp, n, of))
            n, fp = n[order], fp[order]
            # sizes ascend inside a list, so the first one large enough is found by a search over (list, size)
            low = np.ceil(least * n - SLACK).astype(np.int64)
            top = int(n.max()) + 1 if len(n) else 1
            start = np.searchsorted(of * top + n, of * top + low)
            count = np.arange(len(n)) - start
            asks = np.flatnonzero(count > 0)
            count = count[asks]
            ends = np.cumsum(count)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - start[asks], count)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            columns = [pa.array(fp[asks]), pa.array(n[asks]), pa.ListArray.from_arrays(offsets, pa.array(fp[at])), pa.ListArray.from_arrays(offsets, pa.array(n[at]))]
            yield pa.RecordBatch.from_arrays(columns, names=["fp", "n", "fps", "ns"])

    return lists.mapInArrow(cut, "fp long, n long, fps array<long>, ns array<long>")


def _merged(asking: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of a text b and a text that occurs often enough in the lists it asks. A row without texts is a long list."""

    def search(fp: np.ndarray, n: np.ndarray, sizes: np.ndarray, fps: np.ndarray, ns: np.ndarray) -> pa.RecordBatch:
        starts = _runs(fp)
        asker = np.repeat(np.arange(len(starts)), np.diff([*starts, len(fp)]))
        longs = np.bincount(asker[sizes == 0], minlength=len(starts))
        of = np.repeat(asker, sizes)
        order = np.lexsort((fps, of))  # each asker's lists as one, equal texts side by side
        of, fps, ns = of[order], fps[order], ns[order]
        firsts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (fps[1:] != fps[:-1])])) if len(of) else np.empty(0, dtype=np.int64)
        times = np.diff([*firsts, len(of)])
        who, cand, m = of[firsts], fps[firsts], ns[firsts]
        enough = times >= occurrences(n[starts][who], m, least) - longs[who]
        return pa.RecordBatch.from_arrays([pa.array(cand[enough]), pa.array(fp[starts][who][enough])], names=["a", "b"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            parts = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.diff(batch.column(2).offsets.to_numpy()), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy())
            held = parts if held is None else tuple(np.concatenate(x) for x in zip(held, parts, strict=True))
            starts = _runs(held[0])
            if len(starts) < 2:
                continue
            rows = starts[-1]  # the last text may go on in the next batch
            values = held[2][:rows].sum()
            yield search(*(x[:rows] for x in held[:3]), *(x[:values] for x in held[3:]))
            held = (*(x[rows:] for x in held[:3]), *(x[values:] for x in held[3:]))
        if held is not None:
            yield search(*held)

    return asking.repartition("fp").sortWithinPartitions("fp").mapInArrow(merge, "a long, b long")


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, key: Column, text: str, width: int) -> DataFrame:
    """(fp, own): the whole sets of the fingerprints in ``wanted``, made again from one text each."""
    rows = durable(nodes.join(wanted.distinct(), "fp").select("fp", F.col("first._key").alias("_key")), "jaccard-wanted")

    @F.pandas_udf(T.BinaryType())
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width).tobytes() for t in texts])

    # written in between: with both functions in one task, each would have a Python worker of its own
    found = durable(docs.select(key.alias("_key"), F.col(text).alias("t")).filter(marked(rows)(key)), "jaccard-texts").select("_key", whole("t").alias("own"))
    # rows equal in id and text have one key and one set
    return durable(found.join(rows.hint("merge"), "_key").groupBy("fp").agg(F.first("own").alias("own")), "jaccard-sets")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that the bins of their sets leave."""

    def rule_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            left = [may_be_similar(*x, least) for x in frame[["bins_a", "bins_b", "n_a", "n_b"]].itertuples(index=False)]
            yield frame.loc[np.array(left, dtype=bool), ["a", "b"]]

    a, b = (nodes.select(F.col("fp").alias(x), F.col("bins").alias(f"bins_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    return durable(pairs.join(a, "a").join(b, "b").mapInPandas(rule_out, "a long, b long"), "jaccard-likely")


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("own").alias("left")), "a").join(sets.select(F.col("fp").alias("b"), F.col("own").alias("right")), "b")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(frame["left"], frame["right"], strict=True)]
            yield frame.loc[np.array(found, dtype=bool), ["a", "b"]]

    return durable(both.mapInPandas(compare, "a long, b long"), "jaccard-links")


def _rooted(rows: DataFrame, roots: DataFrame, fp: str, name: str) -> DataFrame:
    found = roots.select(F.col("node").alias(fp), F.col("root").alias(name))
    return rows.join(found, fp, "left").withColumn(name, F.coalesce(name, fp))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are in different components."""
    return _rooted(_rooted(pairs, roots, "a", "ra"), roots, "b", "rb").filter("ra <> rb").select("a", "b")


def _resolved(pairs: DataFrame, sets: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """``found`` with those links of ``pairs`` that matter to components: one pair of each text first, then what is still apart."""
    one = durable(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "jaccard-one")
    found = found.unionByName(_linked(one, sets, least))
    rest = durable(_apart(pairs, durable(components(found), "jaccard-roots")).join(one, ["a", "b"], "left_anti"), "jaccard-rest")
    return found.unionByName(_linked(rest, sets, least))


def _stars(hot: DataFrame, roots: DataFrame, least: float, turn: int) -> DataFrame:
    """Pairs of each long list's head of this turn with the texts of other components that it may be similar to."""
    parts = durable(_rooted(hot, roots, "fp", "root"), "jaccard-parts")
    head = F.min(F.struct(F.xxhash64(F.lit(turn), "fp"), "fp", "n", "h", "root")).alias("head")
    heads = durable(parts.groupBy("sh").agg(head, F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("sh", "head"), "jaccard-heads")
    n, m = F.col("n"), F.col("head.n")
    meets = (F.least(n, m) >= F.lit(least) * F.greatest(n, m) - SLACK) & (F.least(F.col("h"), F.col("head.h")) >= _occurrences(n, m, least))
    met = parts.join(heads, "sh").filter((F.col("root") != F.col("head.root")) & meets)
    return met.select(F.least("fp", "head.fp").alias("a"), F.greatest("fp", "head.fp").alias("b")).distinct()


def _blocks(hot: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links between components of the long lists, each list's largest component being compared with the others only."""
    parts = durable(_rooted(hot, roots, "fp", "root"), "jaccard-parts")
    shares = parts.groupBy("sh", "root").agg(F.count(F.lit(1)).alias("n"))
    main = shares.groupBy("sh").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("roots"))
    main = durable(main.filter("roots > 1").select("sh", F.col("main.root").alias("main"), F.col("main.n").alias("settled"), "all"), "jaccard-main")
    texts = durable(parts.join(main, "sh").join(sets, "fp"), "jaccard-apart")
    member = F.struct("fp", "n", "h", "pos", "root", "own")
    cut = lambda rows, of, name: rows.groupBy("sh", F.pmod(F.xxhash64("fp"), F.ceil(of / F.lit(BLOCK))).alias("block")).agg(F.collect_list(member).alias(name))
    ours = cut(texts.filter("root <> main"), F.col("all") - F.col("settled"), "ours").select("sh", "ours")
    theirs = cut(texts, F.col("all"), "theirs").select("sh", "theirs")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ours, theirs in frame.itertuples(index=False):
                yield pd.DataFrame(_met(ours, theirs, least), columns=["a", "b"])

    return durable(ours.join(theirs, "sh").select("ours", "theirs").mapInPandas(meet, "a long, b long").distinct(), "jaccard-blocks")


def _met(ours: list, theirs: list, least: float) -> np.ndarray:
    """A spanning forest (a, b) of the links between two blocks of a list, where components, sizes and places leave any.

    A pair whose first common shingle this is shares none of those before it; any other pair is met in an earlier list. The lists
    of the block's own shingles are merged for each text that is left.
    """
    (fp, n, h, pos, root), (gp, m, g, qos, soot) = ([np.array([x[c] for x in side], dtype=np.int64) for c in ("fp", "n", "h", "pos", "root")] for side in (ours, theirs))
    n, m = n[:, None], m[None, :]
    total = np.ceil(least / (1 + least) * (n + m) - SLACK)
    live = (root[:, None] != soot[None, :]) & (np.minimum(n, m) >= least * np.maximum(n, m) - SLACK)
    live &= (np.minimum(h[:, None], g[None, :]) >= occurrences(n, m, least)) & (pos[:, None] <= n - total) & (qos[None, :] <= m - total)
    asked = np.flatnonzero(live.any(axis=0))
    found = [np.empty((0, 2), dtype=np.int64)]
    if len(asked):
        sets = [np.frombuffer(theirs[j]["own"], np.uint64) for j in asked]
        tokens, of = np.concatenate(sets), np.repeat(np.arange(len(asked)), [len(x) for x in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, of = tokens[order], of[order]
        for i in np.flatnonzero(live.any(axis=1)):
            own = np.frombuffer(ours[i]["own"], np.uint64)
            low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
            size = high - low
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)
            both = np.bincount(of[at], minlength=len(asked))
            good = asked[live[i, asked] & (both >= least * (n[i] + m[0, asked] - both) - SLACK)]
            found.append(np.stack([np.full(len(good), fp[i]), gp[good]], axis=1))
    pairs = np.concatenate(found)
    names, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    label = forest(len(names), iter([(at[:, 0], at[:, 1])]))
    moved = np.flatnonzero(label != np.arange(len(names)))
    return np.stack([names[label[moved]], names[moved]], axis=1)


def links(nodes: DataFrame, docs: DataFrame, key: Column, text: str, width: int, least: float, likely: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of sets of similarity ``least`` or more.

    ``nodes`` (fp, n, bins, listed, first) are distinct sets. Pairs (a, b) that are ``likely`` similar are verified first.
    """
    postings = nodes.select(F.posexplode("listed").alias("pos", "sh"), "fp", F.col("n").cast("long").alias("n"))
    lists = durable(postings.groupBy("sh").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "jaccard-lists")
    shared = durable(postings.join(lists, "sh"), "jaccard-postings")
    long = shared.filter(F.col("texts") > SHORT).select("sh", "fp", "n", "pos")
    none = F.array().cast("array<long>")
    asking = _earlier(shared.filter(F.col("texts") <= SHORT), least).unionByName(long.select("fp", "n", none.alias("fps"), none.alias("ns")))
    pairs = _likely(_merged(asking, least), nodes, least)
    hot = durable(long.join(long.groupBy("fp").agg(F.count(F.lit(1)).alias("h")), "fp"), "jaccard-hot")
    ends = pairs if likely is None else pairs.unionByName(likely)
    wanted = ends.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(hot.select("fp"))
    sets = _sets_of(wanted, nodes, docs, key, text, width)

    found = pairs.limit(0) if likely is None else _linked(likely, sets, least)
    found = _resolved(pairs, sets, found, least)
    tried, turn, linked, n = found.limit(0), 0, 1, 0
    while hot.limit(1).count() and linked > WORTH * n:
        stars = _stars(hot, durable(components(found), "jaccard-roots"), least, turn).join(tried, ["a", "b"], "left_anti")
        stars = durable(stars, "jaccard-stars")
        new = _linked(stars, sets, least)
        tried, found, turn = tried.unionByName(stars), found.unionByName(new), turn + 1
        n, linked = stars.count(), new.count()
    if turn:
        found = found.unionByName(_blocks(hot, durable(components(found), "jaccard-roots"), sets, least))
    return found


def _classes(docs: DataFrame, doc_id: str, text: str, width: int, least: float, likely=None) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (doc_id, _key, fp, n) and for each fingerprint its class's first row, both written."""
    key = row_key(doc_id, text)
    cut = docs.select(F.col(doc_id).alias("doc_id"), key.alias("_key"), listed(docs, F.col(text), frequency_sketch(docs, text, width), width, least).alias("s"))
    rows = durable(cut.select("doc_id", "_key", "s.*"), "jaccard-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")).alias("first")
    nodes = durable(rows.groupBy("fp").agg(first, *[F.first(c).alias(c) for c in ("n", "simhash", "bins", "listed")]), "jaccard-nodes")
    more = None if likely is None else durable(likely(nodes.filter("n > 0").select("fp", "simhash")), "jaccard-more")
    roots = durable(components(links(nodes.filter("n > 0"), docs, key, text, width, least, more)), "jaccard-roots")
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = labelled.groupBy("root").agg(F.min("first").alias("class_first"))
    classes = durable(labelled.select("fp", "root").join(firsts, "root").drop("root"), "jaccard-classes")
    return rows.select("doc_id", "_key", "fp", "n"), classes


def near_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (size of its set), component_id (smallest id reachable by links).

    A text's set are its distinct ``width``-word shingles (A-Z lower-cased, split at ASCII blanks; fewer words: the whole
    sequence); texts link at a Jaccard similarity of ``least`` or more. Null texts and texts without words have an empty set and
    link with nothing, so their component is their own id. Null ids are the component's id only where no other row of it has one.
    Rows equal in id and text are of one component each. Other columns are not read; an empty table gives an empty result.
    Shingles and sets are told apart by 64-bit hashes.
    """
    rows, classes = _classes(docs, doc_id, text, width, least)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_first.doc_id"))
    return rows.join(classes, "fp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, likely=None) -> DataFrame:
    """``docs`` with one row of each component (smallest id, nulls last), all columns as they were.

    Links are those of :func:`near_sets`, except that texts without words are equal: one of them stays. Of rows equal in id and
    text one stays. ``likely`` may give pairs of sets to look at first, from the table of distinct sets (fp, simhash): it saves
    work and changes no result. An empty table gives an empty result; names of columns cannot clash.
    """
    rows, classes = _classes(docs, doc_id, text, width, least, likely)
    found = rows.join(classes, "fp").select("_key", (F.col("_key") == F.col("class_first._key")).alias("stays"))
    keys = durable(found.groupBy("_key").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1 OR NOT stays"), "jaccard-keys")
    return without(docs, row_key(doc_id, text), keys.filter("NOT stays").select("_key"), keys.filter("stays").select("_key"))
