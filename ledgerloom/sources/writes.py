"""Catalog, stock and request relations for the write-planning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.governance import LIMIT_KINDS
from ledgerloom.sources.tables import table

SAFETY_STOCK = 600


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog row per part; some lack search texts or stock."""
    stock = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    )
    pk = F.col("p_partkey")
    return (
        table(spark, sf_dir, "part")
        .join(stock, "p_partkey", "left")
        .select(
            pk.alias("pk"),
            F.concat(F.lit("p-"), pk.cast("string")).alias("handle"),
            F.col("p_name").alias("title"),
            F.element_at(F.array(F.lit("ACTIVE"), F.lit("DRAFT"), F.lit("ARCHIVED")), F.col("p_size") % 3 + 1).alias("status"),
            (F.coalesce("q", F.lit(0)) - SAFETY_STOCK).alias("total_inventory"),
            F.when(pk % 5 != 0, F.concat("p_name", F.lit(" | shop"))).alias("seo_title"),
            F.when(pk % 4 == 0, None)
            .when(pk % 4 == 1, " ")
            .otherwise(F.concat_ws(" ", "p_brand", "p_name"))
            .alias("seo_description"),
            F.col("p_retailprice").alias("price"),
            F.col("p_size").alias("size"),
        )
    )


def limits(spark: SparkSession) -> DataFrame:
    """Five configured limits, one unset."""
    values = ("0", "100000", "250000.5", "400000", "NULL")
    rows = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in zip(LIMIT_KINDS, values))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(kind, limit)")


def read_limits(spark: SparkSession, path: str) -> DataFrame:
    """Limit document as (kind, limit, currency) rows."""
    schema = "currency string, " + ", ".join(f"{k} double" for k in LIMIT_KINDS)
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.unpivot(["currency"], list(LIMIT_KINDS), "kind", "limit").select("kind", "limit", "currency")


def spend_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spend request per order; some kinds are unknown, some amounts negative or not a number."""
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(x) for x in (*LIMIT_KINDS, "MAX_COFFEE")])
    amount = F.when(k % 13 == 0, F.lit(float("nan"))).when(k % 11 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(
        k.alias("request"), F.element_at(kinds, (k % 6 + 1).cast("int")).alias("kind"), amount.alias("amount")
    )


def limit_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One limit set per store (supplier), with the usual mistakes."""
    s = F.col("s_suppkey")
    kinds = F.array(*[F.lit(x) for x in (*LIMIT_KINDS, "note")])
    values = F.expr(
        f"transform(sequence(0, {len(LIMIT_KINDS)}), i -> CASE WHEN (s_suppkey + i) % 8 = 0 THEN NULL "
        "WHEN (s_suppkey + i) % 10 = 3 THEN -5.0D ELSE double((s_suppkey * (i + 1)) % 4 * 100) END)"
    )
    extra = F.when(s % 9 == 0, F.create_map(F.lit("MAX_COFFEE"), F.lit(5.0))).otherwise(
        F.create_map().cast("map<string,double>")
    )
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("store"),
        F.when(s % 6 == 0, "usd").otherwise("USD").alias("currency"),
        F.map_concat(F.map_from_arrays(kinds, values), extra).alias("limits"),
    )


def store_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write requests with their store and mode, one per supplier."""
    s = F.col("s_suppkey")
    modes = F.array(F.lit("LIVE"), F.lit("live"), F.lit("dry-run"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "supplier").select(
        s.alias("request"), F.col("s_name").alias("store"), F.element_at(modes, (s % 4 + 1).cast("int")).alias("mode")
    )


def allowed_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow-list entries as people type them: padded, upper-cased, some blank."""
    s = F.col("s_suppkey")
    entry = F.when(F.col("s_nationkey") % 5 == 0, " ").otherwise(F.concat(F.lit("  "), F.upper("s_name"), F.lit(" ")))
    return table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0).select(entry.alias("store"), s.alias("listed_by"))


def watch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watchlist edit log: clicks add, views remove."""
    return edits_of(table(spark, sf_dir, "events"))


def edits_of(events: DataFrame) -> DataFrame:
    """Watchlist edits of events, stored or streamed."""
    return (
        events
        .where(F.col("event_type").isin("click", "view"))
        .select(
            "user_id",
            F.col("event_id").alias("ord"),
            (F.col("event_type") == "click").alias("adds"),
            F.concat(F.lit("P"), (F.col("event_id") % 20).cast("string")).alias("sym"),
        )
    )


def price_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New prices for some products, plus products the catalog does not have yet."""
    part = table(spark, sf_dir, "part")
    handle = lambda prefix: F.concat(F.lit(prefix), F.col("p_partkey").cast("string")).alias("handle")
    known = part.where(F.col("p_size") % 3 == 0).select(handle("p-"), F.col("p_name").alias("title"), (F.col("p_retailprice") * 1.1).alias("price"))
    fresh = part.where(F.col("p_brand") == "Brand#2").select(handle("new-"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    return known.unionByName(fresh)


def stock_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stock on hand, and quantity sets from order lines of which some expect an outdated quantity."""
    li = table(spark, sf_dir, "lineitem")
    stock = li.groupBy(F.col("l_partkey").alias("item")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("current"))
    asked = li.select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("item"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
    ).join(stock, "item")
    expected = F.col("current") + F.when(F.col("key") % 3 == 0, 1).otherwise(0)
    return stock, asked.select("key", "line", "item", expected.alias("expected"), "quantity")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API attempts, one per event."""
    e = F.col("event_id")
    codes = F.array(*[F.lit(x) for x in (200, 200, 200, 429, 500, 404, 200)])
    return table(spark, sf_dir, "events").select(
        e.alias("request"),
        F.col("event_type").alias("operation"),
        F.date_format("ts", "yyyy-MM-dd HH").alias("hour"),
        (e % 5).alias("attempt"),
        (F.col("user_id") % 2 == 1).alias("is_mutation"),
        (e % 29 == 0).alias("network_error"),
        F.element_at(codes, (e % 7 + 1).cast("int")).alias("status"),
        (e % 17 == 0).alias("throttled"),
        (e % 19 == 0).alias("has_errors"),
        F.col("value").alias("requested"),
        F.when(e % 23 != 0, (e * 7 % 200).cast("double")).alias("available"),
        F.when(e % 31 == 0, 0.0).otherwise(50.0).alias("restore_rate"),
    )
