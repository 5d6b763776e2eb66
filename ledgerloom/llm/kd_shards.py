"""Shards of equal bytes by a K-d tree over metadata.

A point is a row's place in three dimensions: a hash of its source, a hash of its language, and the logarithm of its size.
Every node of the tree is split at the weighted median (bytes are the weights) along its widest dimension, one level of the
tree at a time for all nodes together, until a node holds the target bytes. A node of an odd number of leaves is split at the
matching fraction instead of one half.

Medians are found in Spark: bytes are added up in bins of a node's range, the bin that holds the median becomes the next range,
and a few such rounds end at one key or at a bin too light to matter. Keys break ties of the dimension by text and row, so
points that agree in every dimension can still be split. Rows of equal texts share one point and stay together unless they
weigh more than a twenty-fifth of a shard.

Only the tree goes through the driver: its size is the number of leaves, at most ``MAX_LEAVES``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import durable

MAX_LEAVES = 1 << 16
BINS = 1024
TIE = 40  # bits of a key below the dimension's 22: 20 of the text's hash, 20 of the row's
FINE = 500  # a bin lighter than this part of a shard is not divided further
WHOLE = 25  # equal texts lighter than this part of a shard stay together
ROWS_A_BUCKET = 2000
DIMS = ("k0", "k1", "k2")


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small relation given by the driver, made by the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _hashed(value: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 42)  # 22 bits; null has a place of its own


def points(docs: DataFrame, shards: int | None, target_bytes: int | None, doc_id: str, text: str, source: str, lang: str) -> tuple[DataFrame, int, int]:
    """(rows with size, text_crc32 and a key for each dimension; number of leaves; rows)."""
    value = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(value) + 8).cast("long")
    rows = durable(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            size.alias("size"),
            F.crc32(F.encode(value, "UTF-8")).alias("text_crc32"),
            F.xxhash64(value).alias("_text"),
            _hashed(F.col(source)).alias("_s"),
            _hashed(F.col(lang)).alias("_l"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "kd-rows",
    )
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    leaves = shards or max(1, math.ceil(total / target_bytes))
    if leaves > MAX_LEAVES:
        raise ValueError(f"a tree has at most {MAX_LEAVES} leaves")
    copies = durable(
        rows.groupBy("_text", "text_crc32", "size")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_s0"), F.min("_l").alias("_l0"))
        .filter("_n > 1")
        .withColumn("_split", F.col("_n") * F.col("size") > F.lit(total / leaves / WHOLE)),
        "kd-copies",
    )
    tie = F.shiftleft(F.shiftrightunsigned("_text", 44), 20).bitwiseOR(
        F.when(F.coalesce("_split", F.lit(False)), F.shiftrightunsigned(F.xxhash64("_row"), 44)).otherwise(0)
    )
    length = F.floor(F.log("size") / F.lit(math.log(2.0**31 + 8)) * F.lit((1 << 22) - 1))
    joined = rows.join(copies, ["_text", "text_crc32", "size"], "left")
    keys = [F.shiftleft(v.cast("long"), TIE).bitwiseOR(tie) for v in (F.coalesce("_s0", "_s"), F.coalesce("_l0", "_l"), length)]
    return durable(joined.select("doc_id", "size", "text_crc32", "_row", *[k.alias(d) for k, d in zip(keys, DIMS, strict=True)]), "kd-points"), leaves, n


def _cuts(assigned: DataFrame, nodes: dict[int, dict], slack: float) -> dict[int, int]:
    """The key at which each node is split; nodes whose rows share one key are left out.

    ``nodes``: by number the dimension, its least and greatest key (lo, hi) and the bytes wanted below the cut.
    """
    spark, found = assigned.sparkSession, {}
    open_ = {k: {**v, "least": v["lo"], "most": v["hi"]} for k, v in nodes.items() if v["lo"] < v["hi"]}
    while open_:
        rows = [{"node": k, "dim": v["dim"], "lo": v["lo"], "hi": v["hi"], "width": (v["hi"] - v["lo"]) // BINS + 1, "want": v["want"]} for k, v in open_.items()]
        ranges = F.broadcast(literal_table(spark, rows, "node:int,dim:int,lo:bigint,hi:bigint,width:bigint,want:double"))
        key = F.element_at(F.array(*DIMS), F.col("dim") + 1)
        bins = (
            assigned.join(ranges, "node")
            .withColumn("_key", key)
            .filter((F.col("_key") >= F.col("lo")) & (F.col("_key") <= F.col("hi")))
            .groupBy("node", "want", F.expr("(_key - lo) div width").alias("bin"))
            .agg(F.sum("size").alias("w"), F.min("_key").alias("lo"), F.max("_key").alias("hi"))
        )
        line = Window.partitionBy("node").orderBy("bin")  # at most BINS rows
        crossed = (
            bins.withColumn("_upto", F.sum("w").over(line))
            .filter(F.col("_upto") >= F.col("want"))
            .groupBy("node")
            .agg(F.min_by(F.struct("lo", "hi", "w", "_upto"), "bin").alias("at"))
        )
        hits = {r["node"]: r["at"] for r in crossed.collect()}
        for k, v in list(open_.items()):
            at = hits[k]
            before = at["_upto"] - at["w"]
            if at["lo"] == at["hi"] or at["w"] <= slack:
                # the two ends of the bin that leave rows on both sides, the one nearer to the wish
                ends = [(abs(v["want"] - before), at["lo"])] * (at["lo"] > v["least"]) + [(abs(at["_upto"] - v["want"]), at["hi"] + 1)] * (at["hi"] < v["most"])
                found[k] = min(ends)[1] if ends else v["most"]
                del open_[k]
            else:
                open_[k] = {**v, "lo": at["lo"], "hi": at["hi"], "want": v["want"] - before}
    return found


def assign(rows: DataFrame, leaves: int) -> DataFrame:
    """``rows`` with the column node: the number of the leaf, from 0."""
    spark = rows.sparkSession
    assigned, shares, ranges, slack = rows.withColumn("node", F.lit(0)), {0: leaves}, None, 0.0
    while any(n > 1 for n in shares.values()):
        ends = [f(d).alias(f"{w}{d}") for d in DIMS for w, f in (("lo_", F.min), ("hi_", F.max))]
        active = F.broadcast(literal_table(spark, [{"node": k} for k, n in shares.items() if n > 1], "node:int"))
        stats = {r["node"]: r for r in assigned.join(active, "node").groupBy("node").agg(F.sum("size").alias("w"), *ends).collect()}
        if not stats:
            break
        if ranges is None:
            ranges = [max(1, (stats[0][f"hi_{d}"] >> TIE) - (stats[0][f"lo_{d}"] >> TIE)) for d in DIMS]
            slack = stats[0]["w"] / leaves / FINE
        nodes = {}
        for k, r in stats.items():
            spread = [((r[f"hi_{d}"] >> TIE) - (r[f"lo_{d}"] >> TIE)) / ranges[i] for i, d in enumerate(DIMS)]
            widest = max(range(len(DIMS)), key=lambda i: spread[i])
            nodes[k] = {"dim": widest, "lo": r[f"lo_{DIMS[widest]}"], "hi": r[f"hi_{DIMS[widest]}"], "want": r["w"] * (shares[k] // 2) / shares[k]}
        cuts = _cuts(assigned, nodes, slack)
        splits = [{"split": k, "dim": nodes[k]["dim"], "cut": c, "left": shares[k] // 2} for k, c in cuts.items()]
        if splits:
            table = F.broadcast(literal_table(spark, splits, "split:int,dim:int,cut:bigint,left:int"))
            above = F.element_at(F.array(*DIMS), F.col("dim") + 1) >= F.col("cut")
            assigned = (
                assigned.join(table, F.col("node") == F.col("split"), "left")
                .withColumn("node", F.when(above, F.col("node") + F.col("left")).otherwise(F.col("node")))
                .select(*rows.columns, "node")
            )
        # a node without rows or with one key only is a leaf, whatever its share
        shares = {x: n for k in cuts for x, n in ((k, shares[k] // 2), (k + shares[k] // 2, shares[k] - shares[k] // 2))}
    return assigned


def shard(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Give the number of shards or the bytes of one. ``size`` is the text's UTF-8 bytes and 8 for the row; a null text is empty.
    Sizes of shards are near equal (law ``bytes``), as near as single rows allow; slots number a shard's rows from 0 without
    a gap. Null sources and languages have a place of their own; an empty table gives an empty result; rows that are equal
    in every column are told apart by their place in the input.
    """
    rows, leaves, n = points(docs, shards, target_bytes, doc_id, text, source, lang)
    placed = durable(assign(rows, leaves).select("doc_id", "size", "text_crc32", "_row", F.col("node").alias("shard")), "kd-placed")
    bits = max(2, (n // leaves // ROWS_A_BUCKET).bit_length())
    placed = placed.withColumn("_at", F.xxhash64("_row")).withColumn("_bucket", F.shiftrightunsigned("_at", 64 - bits))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = durable(
        placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")),
        "kd-starts",
    )
    inside = Window.partitionBy("shard", "_bucket").orderBy("_at")
    return placed.withColumn("_in", F.row_number().over(inside) - 1).join(starts, ["shard", "_bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_first") + F.col("_in")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
