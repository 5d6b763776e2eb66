"""Positions, totals and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import ratio


def positions(holdings: DataFrame, quotes: DataFrame, key: str = "sym") -> DataFrame:
    """Holding values; a holding without a quote is kept and flagged instead of failing the job."""
    q = quotes.select(key, "price", "prev_close")
    mv = F.col("price") * F.col("shares")
    basis = F.col("cost") * F.col("shares")
    return holdings.join(q, key, "left").select(
        "account",
        "ord",
        "sym",
        "shares",
        "cost",
        "price",
        mv.alias("mv"),
        basis.alias("cost_basis"),
        (mv - basis).alias("pl"),
        (ratio(mv - basis, basis) * 100).alias("pl_pct"),
        ((F.col("price") - F.col("prev_close")) * F.col("shares")).alias("day_pl"),
        F.col("price").isNull().alias("missing_quote"),
    )


def exact(c: str):
    """Eight-decimal amounts, so totals do not depend on summing order."""
    return F.sum(F.col(c).cast("decimal(28,8)"))


def totals(pos: DataFrame) -> DataFrame:
    """Per-account and overall totals in one pass (overall row has a NULL account)."""
    agg = pos.rollup("account").agg(
        exact("mv").alias("mv"), exact("cost_basis").alias("cost"), exact("day_pl").alias("day")
    )
    pl = F.col("mv") - F.col("cost")
    return agg.select(
        "account",
        F.col("mv").cast("double").alias("tot_mv"),
        F.col("cost").cast("double").alias("tot_cost"),
        pl.cast("double").alias("tot_pl"),
        F.col("day").cast("double").alias("tot_day"),
        (ratio(pl, F.col("cost")) * 100).alias("tot_pl_pct"),
    )


def weights(pos: DataFrame) -> DataFrame:
    """Share of the account's value. Sum and join back rather than a window: one huge account stays splittable."""
    total = pos.groupBy("account").agg(exact("mv").cast("double").alias("total"))
    return pos.join(total, "account").select(
        "account", "sym", (ratio(F.col("mv"), F.col("total")) * 100).alias("weight_pct")
    )
