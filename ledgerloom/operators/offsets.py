"""Clamped running offsets over a stored step log.

The clamp applies at every step, so this is not a running sum. A run of steps is still one clamped addition
(x -> min(hi, max(lo, x + total))), and two runs compose into another. The log is numbered once by (symbol, order); chunks of
consecutive numbers, all of one size, reduce to one such addition per symbol, and so do chunks of chunks, until a symbol's
few reductions are folded from zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import global_index

LIMIT_MICRO = 60_000  # offset limit in millionths
CHUNK = 4096

_RUN = ("total", "lo", "hi")


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(-LIMIT_MICRO), F.least(F.lit(LIMIT_MICRO), x))


def _apply(run: Column, x: Column) -> Column:
    """A clamped addition of x."""
    return F.least(run["hi"], F.greatest(run["lo"], x + run["total"]))


def _compose(first: Column, then: Column) -> Column:
    """One clamped addition for two in turn."""
    return F.struct(
        (first["total"] + then["total"]).alias("total"), _apply(then, first["lo"]).alias("lo"), _apply(then, first["hi"]).alias("hi")
    )


def _reduced(runs: DataFrame, size: int) -> DataFrame:
    """Runs (sym, no, run, before, n) of ``size`` consecutive numbers of a symbol as one; ``before`` is without its last step."""
    parts = F.array_sort(F.collect_list(F.struct("no", "run", "before", "n")))  # at most ``size`` entries
    nothing = F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip(_RUN, (0, -LIMIT_MICRO, LIMIT_MICRO), strict=True)])
    start = F.struct(nothing.alias("run"), nothing.alias("before"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(
            _compose(acc["run"], x["run"]).alias("run"), _compose(acc["run"], x["before"]).alias("before"), (acc["n"] + x["n"]).alias("n")
        )

    grouped = runs.groupBy("sym", F.floor(F.col("no") / size).alias("no")).agg(parts.alias("parts"))
    return grouped.select("sym", "no", F.aggregate("parts", start, step).alias("r")).select("sym", "no", "r.*")


def clamped_offsets(steps: DataFrame, size: int = CHUNK) -> DataFrame:
    """Latest offset per symbol from (sym, ord, step in millionths); up only when the last step raised it."""
    numbered = global_index(steps.select("sym", "ord", "step"), ["sym", "ord"], "no")
    step = F.col("step").cast("bigint")
    one = F.struct(step.alias("total"), _clamp(F.lit(-LIMIT_MICRO) + step).alias("lo"), _clamp(F.lit(LIMIT_MICRO) + step).alias("hi"))
    none = F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip(_RUN, (0, -LIMIT_MICRO, LIMIT_MICRO), strict=True)])
    runs = numbered.select("sym", "no", one.alias("run"), none.alias("before"), F.lit(1).cast("bigint").alias("n"))
    # after how many reductions every symbol is one run: the chunks of its first and last number meet
    ends = numbered.groupBy("sym").agg(F.min("no").alias("first"), F.max("no").alias("last"))
    apart = [F.coalesce(F.max(F.floor(F.col("first") / size**r) != F.floor(F.col("last") / size**r)), F.lit(False)) for r in range(1, 62 // size.bit_length() + 1)]
    for _ in range(1 + sum(ends.agg(*[c.alias(f"r{i}") for i, c in enumerate(apart)]).first())):
        runs = _reduced(runs, size)
    x = lambda run: _apply(F.col(run), F.lit(0).cast("bigint"))
    return runs.select("sym", x("run").alias("offset_micro"), F.when(x("run") > x("before"), "up").otherwise("down").alias("dir"), F.col("n").alias("ticks"))
