"""Commerce relations derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import cents
from ledgerloom.sources.tables import table

SHOP_CURRENCY = ("USD", "USD", "JPY", "EUR", "AED")  # by region key
ANGLES = ("fit", "price", "proof", "gift")
MEDIUMS = ("paid", "organic", "email")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def orders_fact(spark: SparkSession, sf_dir: str, with_customer: bool = False) -> DataFrame:
    """One row per order; amounts are whole ten-thousandths, so discounts stay exact. An order without lines has zero amounts.

    Lines are combined per order before the join, and that exchange is the one the join uses.
    """
    ext, disc = cents(F.col("l_extendedprice")), cents(F.col("l_discount"))
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            (F.sum(ext) * 100).alias("subtotal"),
            F.sum(ext * disc).alias("discount"),
            F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", ext * (100 - disc))), F.lit(0)).alias("refund"),
        )
    )
    fact = (
        table(spark, sf_dir, "orders")
        .join(lines, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer"),
            F.to_date("o_orderdate").alias("dt"),
            F.date_format("o_orderdate", "yyyy-MM").alias("month"),
            F.col("o_orderpriority").alias("source"),
            F.col("o_orderstatus").alias("medium"),
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("subtotal", "discount", "refund")],
        )
    )
    if not with_customer:
        return fact
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    home = F.element_at(F.array(*[F.lit(c) for c in SHOP_CURRENCY]), F.col("n_regionkey") + 1)
    buyers = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("customer"),
            F.col("c_mktsegment").alias("campaign"),
            F.concat(F.lit("shop-"), F.col("n_regionkey").cast("string")).alias("shop"),
            home.alias("shop_currency"),
            F.when(F.col("n_nationkey") % 6 == 5, "GBP").otherwise(home).alias("currency"),
        )
    )
    return fact.join(buyers, "customer")


def amount_sum(c: str) -> Column:
    """Exact total of whole ten-thousandths, wide enough for any number of orders."""
    return F.sum(F.col(c).cast("decimal(20,0)"))


def as_amount(total: Column) -> Column:
    return total.cast("double") / 10000


def period_totals(ev: DataFrame, key: Column, name: str) -> DataFrame:
    """Totals per period in the shape the period summary takes."""
    kind = F.col("event_type")
    value = cents(F.col("value"))
    tagged = F.get_json_object("props", "$.k").cast("int") >= 50

    def amount(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)) / 100

    return (
        ev.groupBy(key.alias(name))
        .agg(
            amount(kind == "purchase").alias("revenue"),
            F.count_if(kind == "purchase").alias("orders"),
            F.count_if(kind == "view").alias("sessions"),
            F.count_if(kind == "click").alias("clicks"),
            amount(kind == "error").alias("refunds"),
            F.when(F.count_if(kind == "click") > 0, amount(kind == "click")).alias("ad_spend"),
            F.when(F.count_if((kind == "purchase") & tagged) > 0, amount((kind == "purchase") & tagged)).alias(
                "attributed_revenue"
            ),
            F.count_if(kind == "signup").alias("new_customers"),
        )
        .withColumn("cogs", F.col("revenue") * 0.4)
        .withColumn("shipping_cost", F.col("orders") * 0.5)
        .withColumn("fees", F.col("revenue") * 0.029 + F.col("orders") * 0.3)
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the tagged landing address they came through."""
    pick = lambda items, by: F.element_at(F.array(*[F.lit(x) for x in items]), (by % len(items) + 1).cast("int"))
    url = F.concat(
        F.lit("https://shop.example.com/land?utm_source="),
        F.col("event_type"),
        F.lit("&utm_medium="),
        pick(MEDIUMS, F.col("event_id")),
        F.lit("&utm_campaign="),
        F.format_string("EXP-%03d_", F.col("user_id") % 9),
        pick(ANGLES, F.col("user_id")),
        F.lit("&utm_content=c"),
        (F.col("event_id") % 13).cast("string"),
    )
    return events(spark, sf_dir).withColumn("url", url)
