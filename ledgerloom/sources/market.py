"""Market relations derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import clamp, cents
from ledgerloom.sources.tables import table

OFFSET_LIMIT = 0.06


def symbol(key: Column) -> Column:
    return F.concat(F.lit("P"), key.cast("string"))


def unit_price(cents_col: str, qty_col: str) -> Column:
    """Amount over quantity to four decimals, in whole numbers so the result never depends on summing order."""
    return F.expr(f"(200 * {cents_col} + {qty_col}) div (2 * {qty_col})") / 10000.0


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily volume-weighted price per part.

    The pre-aggregation runs map-side, so a part never has more rows here than there are trading days:
    every per-symbol window downstream is bounded by the calendar, however hot the symbol.
    """
    li = table(spark, sf_dir, "lineitem")
    return (
        li.groupBy(F.col("l_partkey").alias("pk"), F.to_date("l_shipdate").alias("dt"))
        .agg(
            F.sum(cents(F.col("l_extendedprice"))).alias("ext"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
            F.sum(cents(F.col("l_tax")) - cents(F.col("l_discount"))).alias("lean"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "pk",
            symbol(F.col("pk")).alias("sym"),
            "dt",
            unit_price("ext", "qty").alias("price"),
            "qty",
            "lean",
            (F.col("lean") / (F.col("n") * 100)).alias("drift"),
        )
    )


def price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with the explicit point index ``i`` and series length ``n``."""
    by_sym = Window.partitionBy("pk")
    return (
        prices(spark, sf_dir)
        .withColumn("i", (F.row_number().over(by_sym.orderBy("dt")) - 1).cast("bigint"))
        .withColumn("n", F.count(F.lit(1)).over(by_sym))
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: identity, sector, base price and P/E text."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        symbol(F.col("p_partkey")).alias("sym"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("sector"),
        F.col("p_retailprice").alias("base"),
        F.when(F.col("p_size") % 7 == 0, F.lit("—")).otherwise(F.col("p_size").cast("string")).alias("pe"),
        (F.col("p_brand") == "Brand#1").alias("curated"),
    )


def last_two(px: DataFrame) -> DataFrame:
    """Latest and previous price, last day and traded volume per part.

    A part's daily rows, bounded by the calendar, are ordered and combined in one exchange on the part.
    """
    recent = px.withColumn("rn", F.row_number().over(Window.partitionBy("pk").orderBy(F.desc("dt"))))
    return recent.groupBy("pk").agg(
        F.max(F.when(F.col("rn") == 1, F.col("price"))).alias("last_px"),
        F.max(F.when(F.col("rn") == 1, F.col("drift"))).alias("drift"),
        F.max(F.when(F.col("rn") == 1, F.col("dt"))).alias("last_dt"),
        F.max(F.when(F.col("rn") == 2, F.col("price"))).alias("prior_px"),
        F.sum("qty").alias("volume"),
    )


def quote_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with market cap, prev_close, day_move and a bounded live offset, from one scan of the trades.

    A part without a trade stands at its base price, unmoved and without a market cap.
    """
    before = F.coalesce("prior_px", "last_px")
    two = last_two(prices(spark, sf_dir)).select(
        F.col("pk").alias("ord"),
        before.alias("prev_close"),
        (F.col("last_px") / before - 1).alias("day_move"),
        clamp(F.col("drift"), -OFFSET_LIMIT, OFFSET_LIMIT).alias("offset"),
        "volume",
    )
    rows = listing(spark, sf_dir).join(two, "ord", "left")
    return rows.select(
        "ord",
        "sym",
        "name",
        "sector",
        "base",
        (F.col("base") * F.col("volume")).alias("mcap_num"),
        "pe",
        "curated",
        F.coalesce("prev_close", "base").alias("prev_close"),
        F.coalesce("day_move", F.lit(0.0)).alias("day_move"),
        F.coalesce("offset", F.lit(0.0)).alias("offset"),
    )


def account_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the account that placed them."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    od = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("account"))
    return li.join(od, li.l_orderkey == od.o_orderkey)


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares and per-share cost for each (account, part)."""
    return (
        account_lines(spark, sf_dir)
        .groupBy("account", F.col("l_partkey").alias("ord"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.sum(cents(F.col("l_extendedprice"))).alias("x"))
        .select(
            "account",
            "ord",
            symbol(F.col("ord")).alias("sym"),
            F.col("q").cast("double").alias("shares"),
            unit_price("x", "q").alias("cost"),
        )
    )


def watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's watchlist: the parts of its orders, in the order of their keys."""
    pairs = account_lines(spark, sf_dir).select("account", F.col("l_partkey").alias("pk")).distinct()
    return pairs.select("account", "pk", symbol(F.col("pk")).alias("sym"))


def watch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log's edits of watchlists: (user_id, ord, adds, sym). Clicks add the symbol that the event names, views remove it."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    part = F.get_json_object("props", "$.k").cast("bigint") + F.col("user_id") * 100
    edits = ev.select("user_id", F.col("event_id").alias("ord"), (F.col("event_type") == "click").alias("adds"), symbol(part).alias("sym"))
    return edits.where("sym IS NOT NULL")
