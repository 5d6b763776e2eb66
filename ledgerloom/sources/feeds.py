"""Event feeds: signed deliveries, offset steps and report history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import signing
from ledgerloom.sources.commerce import micros
from ledgerloom.sources.tables import table

TEST_SECRET = "sandbox-signing-key"
REPEATS = 20


def deliveries(spark: SparkSession, sf_dir: str, secret: str = TEST_SECRET) -> DataFrame:
    """Deliveries from events: every id recurs about 20 times, some signatures are broken or missing, some ids absent."""
    ev = table(spark, sf_dir, "events")
    ids = ev.agg(F.greatest(F.floor(F.count(F.lit(1)) / REPEATS), F.lit(1)).alias("ids")).scalar()
    return deliveries_of(ev, ids, secret)


def deliveries_of(ev: DataFrame, ids: Column, secret: str = TEST_SECRET) -> DataFrame:
    """Deliveries of events, stored or streamed, with so many different ids."""
    e = F.col("event_id")
    body = F.encode("props", "UTF-8")
    one = lambda name, value: F.create_map(F.lit(name), F.array(value))
    none = F.create_map().cast("map<string,array<string>>")
    sign = signing.hmac_sha256(body, secret)
    wrong = F.when(e % 11 == 0, F.concat(F.lit("x"), sign)).otherwise(sign)
    claim = F.concat(F.lit("evt-"), (e % ids).cast("string"))
    headers = F.map_concat(
        F.when(e % 37 == 0, none).otherwise(one("x-shopify-hmac-SHA256", wrong)),
        F.when(e % 46 == 0, one(signing.EVENT_ID_HEADER, F.lit(""))).when(e % 23 == 0, none).otherwise(one("X-SHOPIFY-EVENT-ID", claim)),
        F.when(e % 69 == 0, none).otherwise(one(signing.DELIVERY_ID_HEADER, F.concat(F.lit("wh-"), e.cast("string")))),
        one(signing.TOPIC_HEADER, F.col("event_type")),
    )
    return ev.select(
        e.alias("row_id"), micros(F.col("ts")).alias("us"), body.alias("raw_body"), headers.alias("headers")
    )


def offset_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset steps in millionths, up to a fifth of the limit either way."""
    return steps_of(table(spark, sf_dir, "events"))


def steps_of(events: DataFrame) -> DataFrame:
    """Offset steps of events, stored or streamed."""
    step = F.floor(F.col("value") * 100).cast("bigint") * 37 % 24001 - 12000
    return events.select(
        F.concat(F.lit("P"), (F.col("user_id") % 60).cast("string")).alias("sym"), F.col("event_id").alias("ord"), step.alias("step")
    )


def report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report runs per symbol; errors do not replace a good report."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("P"), (F.col("event_id") % 500).cast("string")).alias("sym"),
        F.col("event_id").alias("run"),
        F.when(F.col("event_type") == "error", "error").otherwise("done").alias("status"),
        "ts",
        F.col("value").alias("score"),
    )
