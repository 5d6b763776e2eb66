"""Cursor pages of nested order and product documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import global_index
from ledgerloom.sources import commerce
from ledgerloom.sources.writes import products

# Page sizes.
ORDER_PAGE, PRODUCT_PAGE = 100, 50

_MONEY = "struct<shopMoney:struct<amount:string>>"
# The fields an order carries. No customer names, e-mails or addresses are selected.
ORDER_NODE = (
    "struct<id:string,createdAt:string,displayFinancialStatus:string,"
    "subtotalPriceSet:struct<shopMoney:struct<amount:string,currencyCode:string>>,"
    f"totalShippingPriceSet:{_MONEY},totalDiscountsSet:{_MONEY},totalRefundedSet:{_MONEY},currentTotalPriceSet:{_MONEY},"
    "customerJourneySummary:struct<firstVisit:struct<source:string,utmParameters:struct<source:string,medium:string,campaign:string>>>>"
)
PRODUCT_NODE = (
    "struct<id:string,handle:string,title:string,status:string,totalInventory:int,updatedAt:string,"
    "seo:struct<title:string,description:string>>"
)


def page_schema(field: str, node: str) -> str:
    info = "struct<hasNextPage:boolean,endCursor:string>"
    return f"after string, data struct<{field}:struct<pageInfo:{info},nodes:array<{node}>>>"


ORDER_PAGE_SCHEMA = page_schema("orders", ORDER_NODE)
PRODUCT_PAGE_SCHEMA = page_schema("products", PRODUCT_NODE)


def order_rows(pages: DataFrame) -> DataFrame:
    """A row per order and landing of the pages, stored or streamed."""
    n = pages.select(landing(pages), F.explode("data.orders.nodes").alias("n"))
    amount = lambda c: F.col(f"n.{c}.shopMoney.amount").cast("decimal(18,2)")
    visit = "n.customerJourneySummary.firstVisit"
    return n.select(
        "landed",
        F.col("n.id").alias("order_id"),
        F.to_timestamp("n.createdAt").alias("created_at"),
        F.col("n.displayFinancialStatus").alias("status"),
        amount("subtotalPriceSet").alias("subtotal"),
        F.col("n.subtotalPriceSet.shopMoney.currencyCode").alias("currency"),
        amount("totalShippingPriceSet").alias("shipping"),
        amount("totalDiscountsSet").alias("discounts"),
        amount("totalRefundedSet").alias("refunded"),
        amount("currentTotalPriceSet").alias("current_total"),
        F.col(f"{visit}.source").alias("first_source"),
        F.col(f"{visit}.utmParameters.source").alias("utm_source"),
        F.col(f"{visit}.utmParameters.medium").alias("utm_medium"),
        F.col(f"{visit}.utmParameters.campaign").alias("utm_campaign"),
    )


def flatten_orders(pages: DataFrame, since: str | None = None) -> DataFrame:
    """One row per order of the landed pages; pages landed twice do not repeat orders."""
    newest = newest_landing(order_rows(pages), "order_id")
    return newest if since is None else newest.where(F.col("created_at") >= F.lit(since).cast("timestamp"))


def product_rows(pages: DataFrame) -> DataFrame:
    """A row per product and landing of the pages, stored or streamed."""
    n = pages.select(landing(pages), F.explode("data.products.nodes").alias("n"))
    return n.select(
        "landed", "n.id", "n.handle", "n.title", "n.status", F.col("n.totalInventory").cast("bigint").alias("total_inventory"),
        F.to_timestamp("n.updatedAt").alias("updated_at"), F.col("n.seo.title").alias("seo_title"),
        F.col("n.seo.description").alias("seo_description"),
    )


def flatten_products(pages: DataFrame) -> DataFrame:
    return newest_landing(product_rows(pages), "id")


def landing(pages: DataFrame) -> Column:
    """Order in which pages landed; pages without one are equal, and then the content settles which copy counts."""
    return F.col("landed").cast("string").alias("landed") if "landed" in pages.columns else F.lit("").alias("landed")


def newest_landing(flat: DataFrame, key: str) -> DataFrame:
    """The copy of each row that landed last, the same on every run (max_by combines map-side)."""
    rest = [c for c in flat.columns if c not in ("landed", key)]
    row = F.struct(*rest)
    newest = flat.groupBy(key).agg(F.max_by(row, F.struct("landed", row.alias("row"))).alias("n"))
    return newest.select(key, *[F.col(f"n.{c}").alias(c) for c in rest])


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Page documents of a folder of files, with the time and the name of each one's file."""
    return spark.read.schema(schema).json(path).withColumn("landed", _file_time())


def page_stream(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """Page documents as their files land in a folder; ``files`` bounds how many make a batch."""
    stream = spark.readStream.schema(schema)
    return (stream if files is None else stream.option("maxFilesPerTrigger", files)).json(path).withColumn("landed", _file_time())


def _file_time() -> Column:
    at = F.date_format("_metadata.file_modification_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.concat_ws(" ", at, F.col("_metadata.file_path"))


def read_order_pages(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Orders of a folder of landed page files."""
    return flatten_orders(read_pages(spark, path, ORDER_PAGE_SCHEMA), since)


def read_product_pages(spark: SparkSession, path: str) -> DataFrame:
    return flatten_products(read_pages(spark, path, PRODUCT_PAGE_SCHEMA))


def cursors(pages: DataFrame, field: str) -> DataFrame:
    """Per cursor whether a page promises that it leads on, and whether a page fetched it; null: no page seen does."""
    info = f"data.{field}.pageInfo"
    ends = pages.where(F.col(f"{info}.hasNextPage")).select(F.col(f"{info}.endCursor").alias("end_cursor"), F.lit(True).alias("promised"), F.lit(None).cast("boolean").alias("fetched"))
    starts = pages.select(F.col("after").alias("end_cursor"), F.lit(None).cast("boolean").alias("promised"), F.lit(True).alias("fetched"))
    both = ends.unionByName(starts).where("end_cursor IS NOT NULL")
    return both.groupBy("end_cursor").agg(F.max("promised").alias("promised"), F.max("fetched").alias("fetched"))


def page_gaps(pages: DataFrame, field: str) -> DataFrame:
    """Cursors that promise a next page nobody fetched."""
    info = f"data.{field}.pageInfo"
    ends = pages.where(F.col(f"{info}.hasNextPage")).select(F.col(f"{info}.endCursor").alias("end_cursor")).distinct()
    starts = pages.select(F.col("after").alias("end_cursor")).where("end_cursor IS NOT NULL")
    return ends.join(starts, "end_cursor", "left_anti")


def _paged(nodes: DataFrame, order: list[str], size: int, field: str, node: Column) -> DataFrame:
    """Nodes packed into page documents of a fixed size, the third page landed twice."""
    placed = global_index(nodes, order, "i").withColumn("page", F.floor(F.col("i") / size))
    last = F.max("page").alias("last")
    packed = placed.groupBy("page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", node.alias("n")))), lambda x: x["n"]).alias("nodes")
    )
    cursor = lambda p: F.concat(F.lit("cursor-"), p.cast("string"))
    doc = F.to_json(
        F.struct(
            F.when(F.col("page") > 0, cursor(F.col("page") - 1)).alias("after"),
            F.struct(
                F.struct(
                    F.struct((F.col("page") < F.col("last")).alias("hasNextPage"), cursor(F.col("page")).alias("endCursor")).alias("pageInfo"),
                    "nodes",
                ).alias(field)
            ).alias("data"),
        )
    )
    docs = packed.withColumn("last", placed.agg(last).scalar()).select("page", doc.alias("doc"))
    return docs.unionByName(docs.where("page = 2"))


def order_page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON page documents."""
    money = lambda c, *more: F.struct(F.struct(c.cast("decimal(18,2)").cast("string").alias("amount"), *more).alias("shopMoney"))
    amt = lambda c: F.col(c) / 10000
    visit = F.struct(
        F.struct(
            F.col("source"),
            F.struct("source", "medium", "campaign").alias("utmParameters"),
        ).alias("firstVisit")
    )
    node = F.struct(
        F.concat(F.lit("order/"), F.col("order_id").cast("string")).alias("id"),
        F.date_format("dt", "yyyy-MM-dd'T'00:00:00'Z'").alias("createdAt"),
        F.when(F.col("refund") > 0, "PARTIALLY_REFUNDED").otherwise("PAID").alias("displayFinancialStatus"),
        money(F.col("subtotal") / 10000, F.col("currency").alias("currencyCode")).alias("subtotalPriceSet"),
        money(F.col("order_id") % 9 + 0.5).alias("totalShippingPriceSet"),
        money(amt("discount")).alias("totalDiscountsSet"),
        money(amt("refund")).alias("totalRefundedSet"),
        money(F.col("subtotal") / 10000).alias("currentTotalPriceSet"),
        visit.alias("customerJourneySummary"),
    )
    rows = commerce.orders_fact(spark, sf_dir, with_customer=True)
    return _paged(rows, ["dt", "order_id"], ORDER_PAGE, "orders", node)


def product_page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.struct(
        F.concat(F.lit("product/"), F.col("pk").cast("string")).alias("id"), "handle", "title", "status",
        F.col("total_inventory").alias("totalInventory"), F.lit("2024-01-01T00:00:00Z").alias("updatedAt"),
        F.struct(F.col("seo_title").alias("title"), F.col("seo_description").alias("description")).alias("seo"),
    )
    return _paged(products(spark, sf_dir), ["pk"], PRODUCT_PAGE, "products", node)


def parse_pages(docs: DataFrame, schema: str) -> DataFrame:
    return docs.select(F.from_json("doc", schema).alias("d")).select("d.*")
