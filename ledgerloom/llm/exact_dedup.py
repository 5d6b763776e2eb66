"""Exact duplicates by counting quotient filters.

A fingerprint's high bits (the quotient) are the place, its low bits (the remainder) the value stored there. Each task
builds one filter per block of quotients over its own rows: a bitmap of occupied quotients, the length of each run, the
sorted remainders, and counters for those met more than once. Filters of the same block merge without loss by merging
their sorted remainders and adding counts. Only fingerprints with a count above one go on: their texts are compared byte
for byte by grouping on the text itself, which combines copies before the exchange. Two texts that share a fingerprint
part there.

A fingerprint met by a third of all rows is one entry with a counter in each task's filter, so no block grows with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import one_spaced, row_key, without
from ledgerloom.session import durable

SLOT_BITS = 15  # quotients of a block
ROWS_A_BLOCK = 1 << 14
FLUSH = 1 << 20  # fingerprints a task holds before it emits its filters
FILTER = "block long, occupied binary, runs binary, remainders binary, counted binary, counters binary"


def layout(rows: int) -> tuple[int, int]:
    """Bits of the block number and of the remainder for so many rows."""
    block = min(32, max(6, math.ceil(math.log2(max(rows, 1) / ROWS_A_BLOCK)))) if rows > ROWS_A_BLOCK else 6
    return block, min(32, 64 - block - SLOT_BITS)


def packed(block: int, slots: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> tuple:
    """A filter's parts from entries sorted by (slot, remainder)."""
    occupied = np.zeros(1 << SLOT_BITS, dtype=bool)
    present, runs = np.unique(slots, return_counts=True)
    occupied[present] = True
    many = counts > 1
    return (
        block,
        np.packbits(occupied).tobytes(),
        runs.astype("<u4").tobytes(),
        remainders.astype("<u4").tobytes(),
        np.packbits(many).tobytes(),
        counts[many].astype("<i8").tobytes(),
    )


def unpacked(occupied: bytes, runs: bytes, remainders: bytes, counted: bytes, counters: bytes) -> tuple:
    """(slots, remainders, counts) of a filter."""
    present = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8)))
    rest = np.frombuffer(remainders, "<u4").astype(np.uint64)
    counts = np.ones(len(rest), dtype=np.int64)
    counts[np.unpackbits(np.frombuffer(counted, np.uint8), count=len(rest)).astype(bool)] = np.frombuffer(counters, "<i8")
    return np.repeat(present, np.frombuffer(runs, "<u4")).astype(np.uint64), rest, counts


def filters(fingerprints: DataFrame, remainder_bits: int) -> DataFrame:
    """One counting quotient filter per block over the column ``fp`` (block, slot and remainder bits, from the top)."""
    r, cut = np.uint64(remainder_bits), np.uint64(SLOT_BITS)

    def build(values: np.ndarray) -> pd.DataFrame:
        keys, counts = np.unique(values, return_counts=True)  # sorted: by block, slot, remainder
        blocks = (keys >> (r + cut)).astype(np.int64)
        starts = np.flatnonzero(np.diff(blocks, prepend=-1))
        rows = []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            own = keys[a:b]
            slots = (own >> r) & np.uint64((1 << SLOT_BITS) - 1)
            rows.append(packed(int(blocks[a]), slots, own & np.uint64((1 << remainder_bits) - 1), counts[a:b]))
        return pd.DataFrame(rows, columns=["block", "occupied", "runs", "remainders", "counted", "counters"])

    def per_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame["fp"].to_numpy(np.int64).view(np.uint64))
            n += len(frame)
            if n >= FLUSH:
                yield build(np.concatenate(held))
                held, n = [], 0
        if n:
            yield build(np.concatenate(held))

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(*row) for row in frame[["occupied", "runs", "remainders", "counted", "counters"]].itertuples(index=False)]
        entries = np.concatenate([(s << r) | m for s, m, _ in parts])
        counts = np.concatenate([c for _, _, c in parts])
        order = np.argsort(entries, kind="stable")  # runs that are sorted already merge in linear time
        entries, counts = entries[order], counts[order]
        firsts = np.flatnonzero(np.concatenate([[True], entries[1:] != entries[:-1]]))
        whole = np.add.reduceat(counts, firsts)
        slots, rest = entries[firsts] >> r, entries[firsts] & np.uint64((1 << remainder_bits) - 1)
        return pd.DataFrame([packed(key[0], slots, rest, whole)], columns=list(frame.columns))

    return fingerprints.select("fp").mapInPandas(per_task, FILTER).groupBy("block").applyInPandas(merge, FILTER)


def repeated(merged: DataFrame, remainder_bits: int) -> DataFrame:
    """Fingerprints that the filters count more than once: (fp, n)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, *parts in frame.itertuples(index=False):
                slots, rest, counts = unpacked(*parts)
                many = counts > 1
                fps = (np.uint64(block) << np.uint64(SLOT_BITS) | slots[many]) << np.uint64(remainder_bits) | rest[many]
                yield pd.DataFrame({"fp": fps.view(np.int64), "n": counts[many]})

    return merged.mapInPandas(read, "fp long, n long")


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's class of equal texts, texts being equal when equal after white-space runs become one space.

    Returns doc_id, _key (identity of the row by id and text), keep_id, group_size, kept, text_sha256, one row per row of
    ``docs``. The row with the smallest id stays; null ids come last, and of rows equal in id and text one stays. Null
    texts count as empty. Other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    block_bits, remainder_bits = layout(docs.count())
    spare = 64 - (block_bits + SLOT_BITS + remainder_bits)
    fingerprint: Column = F.shiftrightunsigned(F.xxhash64("_text"), spare)
    texts = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("_key"), one_spaced(text).alias("_text"))
    rows = durable(
        texts.select(
            "doc_id",
            "_key",
            fingerprint.alias("fp"),
            F.sha2("_text", 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "exact-rows",
    )
    suspects = durable(repeated(filters(rows, remainder_bits), remainder_bits), "exact-suspects").select("fp")
    verified = (
        texts.select(fingerprint.alias("fp"), "_text")
        .join(suspects, "fp", "left_semi")
        .groupBy("fp", "_text")
        .agg(F.count(F.lit(1)).alias("group_size"))
        .select("fp", F.sha2("_text", 256).alias("text_sha256"), "group_size")
        .filter("group_size > 1")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("first")
    firsts = rows.join(suspects, "fp", "left_semi").groupBy("fp", "text_sha256").agg(first)
    # as a table, so that the join below is one of two plain exchanges, whose hot keys adaptive execution can split
    groups = durable(firsts.join(verified, ["fp", "text_sha256"]), "exact-groups")
    return rows.join(groups, ["fp", "text_sha256"], "left").select(
        "doc_id",
        "_key",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("first").isNull() | (F.col("_row") == F.col("first._row"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of equal texts, all columns as they were."""
    found = durable(duplicates(docs, doc_id, text).filter("group_size > 1").select("_key", "kept"), "exact-found")
    stay = found.filter("kept").select("_key")
    dropped = found.filter(~F.col("kept")).select("_key").distinct()
    return without(
        docs,
        row_key(doc_id, text),
        durable(dropped.join(stay, "_key", "left_anti"), "exact-dropped"),
        dropped.join(stay, "_key", "left_semi"),  # keys of which one row stays and others go: rows equal in id and text
    )
