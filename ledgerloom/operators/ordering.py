"""Positions in a total order without a single-task window.

A plain ``row_number()`` over an unpartitioned (or hot) window sorts everything in one task. Here the rows are
range-partitioned on the whole order (keys first), so a hot key spreads over many tasks; only one count per
task is combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import durable

_ROW_BITS = 33  # monotonically_increasing_id keeps the in-partition row number in its low 33 bits


def range_sorted(df: DataFrame, *order: Column | str) -> DataFrame:
    """Globally sorted pieces of similar size; equal keys may span pieces, the order columns keep them apart.

    The number of pieces is left to adaptive execution, which only ever merges neighbouring ranges.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def global_index(df: DataFrame, order: list[Column | str], name: str = "idx") -> DataFrame:
    """Zero-based position of every row in ``order``, which must be total (ends with a unique column)."""
    placed = durable(range_sorted(df, *order).withColumn("_at", F.monotonically_increasing_id()))
    piece = F.shiftright("_at", _ROW_BITS)
    starts = (
        placed.groupBy(piece.alias("_piece"))
        .agg(F.count(F.lit(1)).alias("_n"))
        # one row per task of the range exchange, so this window and the broadcast stay small
        .withColumn(
            "_before",
            F.coalesce(F.sum("_n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("_n")
    )
    return (
        placed.withColumn("_piece", piece)
        .join(F.broadcast(starts), "_piece")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_piece", "_before", "_at")
    )


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """One-based position in a total order over the whole relation."""
    return global_index(df, order, name).withColumn(name, F.col(name) + 1)


def rank_within(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """One-based position inside each key group; groups of any size are spread over tasks."""
    placed = global_index(df, [*keys, *order], "_g")
    firsts = placed.groupBy(*keys).agg(F.min("_g").alias("_first"))
    return placed.join(firsts, keys).withColumn(name, F.col("_g") - F.col("_first") + 1).drop("_g", "_first")


PIECE_ROWS = 20_000


def _pieced(df: DataFrame, keys: list[str], order: list[Column | str], rows: int, number: Column | None) -> DataFrame:
    """Rows numbered by (keys, order) with the piece, of a fixed number of rows, that each is in."""
    placed = global_index(df, [*keys, *order], "_no") if number is None else df.withColumn("_no", number)
    return placed.withColumn("_piece", F.floor(F.col("_no") / rows))


def latest_before(
    df: DataFrame, keys: list[str], order: list[Column | str], value: Column, name: str, rows: int = PIECE_ROWS, number: Column | None = None
) -> DataFrame:
    """The last non-null ``value`` among the earlier rows of a key, in an order that is total within it.

    Looks inside fixed-size pieces first and then at one value per key and piece, so a key of any size is spread. Rows that are
    numbered in this order already, keys first, need no sort: ``number`` is that column, or its negative for the reverse.
    """
    placed = _pieced(df.withColumn("_value", value), keys, order, rows, number)
    here = Window.partitionBy("_piece", *keys).orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_no")))
    ends = placed.groupBy(*keys, "_piece").agg(last.alias("_end"))
    before = durable(ends.select(*keys, "_piece", F.last("_end", ignorenulls=True).over(earlier).alias("_before")), "latest")
    return (
        placed.withColumn("_within", F.last("_value", ignorenulls=True).over(here))
        .join(before, [*keys, "_piece"])
        .withColumn(name, F.coalesce("_within", "_before"))
        .drop("_no", "_piece", "_value", "_within", "_before")
    )


def running_sum(
    df: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str, rows: int = PIECE_ROWS, number: Column | None = None
) -> DataFrame:
    """Sum of ``value`` over a key's rows up to and with each, in an order that is total within the key; ``number`` as above."""
    placed = _pieced(df, keys, order, rows, number)
    here = Window.partitionBy("_piece", *keys).orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_piece").agg(F.sum(value).alias("_sum"))
    before = durable(sums.select(*keys, "_piece", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")), "sums")
    return (
        placed.withColumn("_within", F.sum(value).over(here))
        .join(before, [*keys, "_piece"])
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_no", "_piece", "_within", "_before")
    )
