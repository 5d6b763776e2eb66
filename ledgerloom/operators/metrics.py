"""Metric definitions. Unknown inputs give unknown results, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import finite, normal_cdf, ratio, round_scaled, to_fixed

MIN_ARM = 100  # smallest sample per experiment arm


def conversion_rate(orders: Column, sessions: Column) -> Column:
    return ratio(orders, sessions)


def add_to_cart_rate(with_cart: Column, sessions: Column) -> Column:
    return ratio(with_cart, sessions)


def checkout_rate(reached: Column, sessions: Column) -> Column:
    return ratio(reached, sessions)


def aov(revenue: Column, orders: Column) -> Column:
    return ratio(revenue, orders)


def ctr(clicks: Column, impressions: Column) -> Column:
    return ratio(clicks, impressions)


def cpc(spend: Column, clicks: Column) -> Column:
    return ratio(spend, clicks)


def cpm(spend: Column, impressions: Column) -> Column:
    return ratio(spend, impressions) * 1000


def cpa(spend: Column, conversions: Column) -> Column:
    return ratio(spend, conversions)


def roas(attributed: Column, spend: Column) -> Column:
    return ratio(attributed, spend)


def refund_rate(refunded: Column, revenue: Column) -> Column:
    return ratio(refunded, revenue)


def _known(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & finite(c).isNotNull()
    return out


def unit_contribution(
    price: Column,
    cogs: Column,
    shipping_cost: Column,
    fee_pct: Column,
    fee_fixed: Column,
    shipping_charged: Column | None = None,
    refund_rate: Column | None = None,
    discount: Column | None = None,
) -> Column:
    """Contribution per unit before ads as a struct; NULL unless all five required inputs are known."""
    optional = lambda c: F.lit(0.0) if c is None else F.coalesce(c.cast("double"), F.lit(0.0))
    revenue = price + optional(shipping_charged) - optional(discount)
    fees = revenue * fee_pct + fee_fixed
    contribution = revenue - cogs - shipping_cost - fees - revenue * optional(refund_rate)
    return F.when(
        _known(price, cogs, shipping_cost, fee_pct, fee_fixed),
        F.struct(
            revenue.alias("revenue"),
            contribution.alias("contribution"),
            F.when(revenue > 0, contribution / revenue).alias("margin_pct"),
            F.when(contribution > 0, revenue / contribution).alias("break_even_roas"),
            F.greatest(contribution, F.lit(0.0)).alias("max_cpa"),
        ),
    )


def unit_contribution_range(low: Column, high: Column) -> Column:
    """Both scenarios of one unit side by side."""
    return F.struct(low.alias("low"), high.alias("high"))


def period_summary(t: DataFrame, *keys: str) -> DataFrame:
    """Period report from totals. ``revenue`` is gross of refunds, which are subtracted here."""
    parts = ["revenue", "cogs", "shipping_cost", "fees", "refunds", "ad_spend"]
    col = F.col
    left = col("revenue")
    for p in parts[1:]:
        left = left - col(p)
    return t.select(
        *keys,
        finite(col("revenue")).alias("revenue"),
        finite(col("orders")).alias("orders"),
        aov(col("revenue"), col("orders")).alias("aov"),
        conversion_rate(col("orders"), col("sessions")).alias("conversion_rate"),
        roas(col("attributed_revenue"), col("ad_spend")).alias("roas"),
        cpa(col("ad_spend"), col("new_customers")).alias("cac"),
        refund_rate(col("refunds"), col("revenue")).alias("refund_rate"),
        F.when(_known(*[col(p) for p in parts]), left).alias("contribution"),
    )


def two_proportion_test(conv_a: Column, n_a: Column, conv_b: Column, n_b: Column, min_n: int = MIN_ARM) -> Column:
    """Pooled two-sided z-test as a struct; NULL for unknown inputs, small arms or no variance."""
    ca, na, cb, nb = (finite(c) for c in (conv_a, n_a, conv_b, n_b))
    enough = _known(conv_a, n_a, conv_b, n_b) & (na >= min_n) & (nb >= min_n)
    pa, pb = F.try_divide(ca, na), F.try_divide(cb, nb)
    pooled = F.try_divide(ca + cb, na + nb)
    variance = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb))
    se = F.when(variance > 0, F.sqrt(variance))
    z = (pb - pa) / se
    return F.when(
        enough & se.isNotNull(),
        F.struct(
            F.try_divide(pb - pa, pa).alias("lift"),
            z.alias("z"),
            (2 * (1 - normal_cdf(F.abs(z)))).alias("p_value"),
        ),
    )


def arm_test(rows: DataFrame, keys: list[str], arm: str, converted: Column, size: Column) -> DataFrame:
    """Test per experiment; ``arm`` holds 0 for control and 1 for the variant."""
    side = lambda v, c: F.coalesce(F.sum(F.when(F.col(arm) == v, c)), F.lit(0))
    sums = rows.groupBy(*keys).agg(
        side(0, converted).alias("conv_a"),
        side(0, size).alias("n_a"),
        side(1, converted).alias("conv_b"),
        side(1, size).alias("n_b"),
    )
    test = two_proportion_test(F.col("conv_a"), F.col("n_a"), F.col("conv_b"), F.col("n_b"))
    return sums.withColumn("t", test).select(
        *keys,
        "conv_a",
        "n_a",
        "conv_b",
        "n_b",
        round_scaled(F.col("t.lift"), 9).alias("lift"),
        round_scaled(F.col("t.z"), 9).alias("z"),
        round_scaled(F.col("t.p_value"), 9).alias("p_value"),
    )


def stop_loss(read: DataFrame, floor: float, min_n: int = MIN_ARM) -> DataFrame:
    """``stopped``: whether the variant's lift is at or under ``floor``; unknown for small arms or without a base rate."""
    lift = round_scaled(F.try_divide(F.try_divide("conv_b", "n_b") - F.try_divide("conv_a", "n_a"), F.try_divide("conv_a", "n_a")), 9)
    known = (F.col("n_a") >= min_n) & (F.col("n_b") >= min_n)
    return read.withColumn("stopped", F.when(known, lift <= floor))


def labelled(df: DataFrame, keys: list[str], measured: dict[str, str], estimated: dict[str, str], value: str) -> DataFrame:
    """Long metric rows with label and source; an unknown value is spelled out, never blank."""
    sources = {**measured, **estimated}
    long = df.unpivot(keys, list(sources), "metric", value)
    pairs = F.create_map(*[F.lit(x) for kv in sources.items() for x in kv])
    return long.select(
        *keys,
        "metric",
        F.when(F.col(value).isNull(), "UNKNOWN").otherwise(to_fixed(F.col(value), 4)).alias("shown"),
        F.when(F.col("metric").isin(list(estimated)), "ESTIMATED").otherwise("MEASURED").alias("label"),
        pairs[F.col("metric")].alias("source"),
    )


def week_over_week(df: DataFrame, week: str, metrics: list[str]) -> DataFrame:
    """This week, the week before and the change, one row per metric. Input is one row per week, dated by its first day
    (a date or its text); a week that is missing is unknown, not replaced by an earlier one."""
    long = df.select(week, *[F.col(m).cast("double") for m in metrics]).unpivot([week], metrics, "metric", "this_week")
    line = Window.partitionBy("metric").orderBy(week)
    next_to = F.date_add(F.lag(week).over(line).cast("date"), 7) == F.col(week).cast("date")
    prev = F.when(next_to, F.lag("this_week").over(line))
    return long.withColumn("last_week", prev).withColumn("delta", F.col("this_week") - F.col("last_week"))


def top_bottom(df: DataFrame, measure: str, tie: str, k: int) -> DataFrame:
    """The k best and k weakest rows. Each side is a top-k, so only k rows per task leave the scan."""

    def side(name: str, order: Column) -> DataFrame:
        head = df.orderBy(order, tie).limit(k)
        place = F.row_number().over(Window.orderBy(order, tie)).cast("bigint")  # over the k rows kept
        return head.withColumn("place", place).withColumn("side", F.lit(name))

    return side("best", F.desc(measure)).unionByName(side("weakest", F.asc(measure)))
