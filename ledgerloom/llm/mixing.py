"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets are shares of the mix by source weight, filled like water up to a cap of ``max_repeat`` times a source's own size. The
mix is made of blocks of equally many tokens, and blocks go one by one to the source with the highest quotient
target / (2 * blocks so far + 1); the awards in order, cut into equal runs, are the shards, so every shard has integer quotas
and the whole mix has those of the apportionment. A source's documents are laid out in a seeded order as one line of tokens
cut into blocks; its quota takes every block as often as it goes in whole, and a run of blocks from a seeded place for the
rest. So whole documents are taken but for the two at the ends of a run.

The order is by hash: documents fall into buckets by their hash, a bucket's start is the sum of those before it, and only
bucket-sized groups are sorted, so a source of any size is spread over tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORDS, held
from ledgerloom.session import durable

#: Sources of one mix: their table (name, size, quota) goes through the driver and is broadcast; more are an error.
MAX_SOURCES = 200_000
CYCLE = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
BLOCKS_OF_LEAST = 1000  # a block is this part of the least target, so that each source's quota comes near its target
MAX_BLOCK = 4096
ROWS_A_BUCKET = 2000


def fill(sizes: np.ndarray, weights: np.ndarray, cap: float) -> np.ndarray:
    """Shares of sum(sizes) by weight, none above ``cap`` times its own size; the excess is shared again by weight."""
    total, target, open_ = float(sizes.sum()), np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool)
    while open_.any():
        target[~open_] = cap * sizes[~open_]
        target[open_] = (total - target[~open_].sum()) * weights[open_] / weights[open_].sum()
        above = open_ & (target > cap * sizes)
        if not above.any():
            break
        open_ &= ~above
    return target


def apportion(targets: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë seats: the ``seats`` highest of all quotients target / (2 i + 1); ties go to the earlier source."""
    given = np.zeros(len(targets), dtype=np.int64)
    if seats <= 0 or targets.sum() <= 0:
        return given
    won = lambda bar: np.floor((targets / bar + 1) / 2).astype(np.int64)  # noqa: E731  quotients of at least bar
    low, high = targets.sum() / (2.0 * seats + 2.0 * len(targets) + 2.0) / 2.0, 2.0 * targets.max() + 1.0
    for _ in range(200):  # bar between a value that gives too many and one that gives too few
        bar = (low + high) / 2
        if bar in (low, high):
            break
        low, high = (bar, high) if won(bar).sum() > seats else (low, bar)
    given = won(high)
    while (left := seats - int(given.sum())) > 0:
        quotients = targets / (2 * given + 1)
        given[np.argsort(-quotients, kind="stable")[:left]] += 1
    return given


def source_table(sizes: list[tuple], weights: tuple[float, ...] = CYCLE, seed: int = 0) -> list[dict]:
    """Target, block count, quota and the seeded start of each source; ``sizes``: (source, tokens), null source last."""
    if not sizes:
        return []
    own = np.array([n for _, n in sizes], dtype=np.float64)
    target = fill(own, np.array([weights[i % len(weights)] for i in range(len(sizes))]), MAX_REPEAT)
    least = target[target > 0].min() if (target > 0).any() else 1.0
    block = int(min(MAX_BLOCK, max(1, least // BLOCKS_OF_LEAST)))
    blocks = np.ceil(own / block).astype(np.int64)
    quota = np.minimum(apportion(target, round(target.sum() / block)), MAX_REPEAT * blocks)
    return [
        {
            "source": s,
            "source_size": int(n),
            "target": float(target[i]),
            "block": block,
            "blocks": int(blocks[i]),
            "quota": int(quota[i]),
            "start": int.from_bytes(hashlib.sha256(f"{seed}:{s}".encode()).digest()[:7], "big") % max(1, int(blocks[i])),
        }
        for i, (s, n) in enumerate(sizes)
    ]


def shard_quotas(sources: list[dict], shards: int) -> list[dict]:
    """Blocks of each source in each shard: the awards in order, cut into ``shards`` runs (Sainte-Laguë is house-monotone)."""
    target, total = np.array([s["target"] for s in sources]), sum(s["quota"] for s in sources)
    rows, before = [], np.zeros(len(sources), dtype=np.int64)
    for k in range(shards):
        upto = np.array([s["quota"] for s in sources]) if k == shards - 1 else apportion(target, total * (k + 1) // shards)
        rows += [{"shard": k, "source": s["source"], "blocks": int(n)} for s, n in zip(sources, upto - before, strict=True)]
        before = upto
    return rows


def words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORDS)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = CYCLE, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words; null text 0), source_size, target, taken.

    Sources in code-point order, null last, have the ``weights`` in turn. ``taken`` counts the words the mix takes of the
    document, repeats included, ``MAX_REPEAT`` times its size at most. The order depends on id, text and seed alone, so
    reruns agree. Sources without words have target 0; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    rows = durable(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), order.alias("_at")), "mix-rows")
    totals = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources")
    named = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    plan = source_table([(r["source"], r["n"]) for r in named], weights, seed)
    schema = pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), *[(c, pa.int64()) for c in ("block", "blocks", "quota", "start")]])
    # as Arrow: rows of Python would go through Python workers of their own, which stay beside those of the operators
    sources = F.broadcast(spark.createDataFrame(pa.Table.from_pylist(plan, schema)))

    bucket_bits = max(4, int(sum(r["rows"] for r in totals) / ROWS_A_BUCKET).bit_length())
    placed = rows.withColumn("_bucket", F.shiftrightunsigned("_at", 64 - bucket_bits))
    sums = placed.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = durable(sums.select("source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")), "mix-starts")
    inside = Window.partitionBy("source", "_bucket").orderBy("_at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    line = placed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    line = line.alias("l").join(
        starts.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source")) & (F.col("l._bucket") == F.col("s._bucket"))
    ).select("l.*", (F.col("_first") + F.col("_in")).alias("_from"))

    joined = line.alias("l").join(sources.alias("p"), F.col("l.source").eqNullSafe(F.col("p.source")), "left")
    whole = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0)
    rest = F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0)
    # the run of blocks [start, start + rest) goes on at the line's beginning when it meets its end
    first, last = F.col("start"), F.col("start") + rest
    over = F.greatest(last - F.col("blocks"), F.lit(0))

    def within(a: Column, b: Column) -> Column:
        """Words of the document in the blocks from a to b."""
        upto = F.least(F.col("_from") + F.col("size"), b * F.col("block"))
        return F.greatest(upto - F.greatest(F.col("_from"), a * F.col("block")), F.lit(0))

    taken = whole * F.col("size") + within(first, F.least(last, F.col("blocks"))) + within(F.lit(0), over)
    return joined.select("doc_id", F.col("l.source").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"), "_at")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = CYCLE, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mix has them: each as many times as it is taken, a part counting as once from a half on."""
    plan = mix(docs, weights, seed, doc_id, text, source)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    copies = durable(plan.select("doc_id", F.col("_at").alias("mark"), times.alias("times")), "mix-copies")
    # rows equal in id and text have one mark; each gets the mean of their copies
    per_row = copies.groupBy("doc_id", "mark").agg(F.round(F.avg("times")).cast("int").alias("times")).filter("times > 0")
    marked = held(docs, own_mark=F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), own_id=F.col(doc_id))
    met = marked.join(per_row, (F.col("own_mark") == F.col("mark")) & F.col("own_id").eqNullSafe(F.col("doc_id")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
