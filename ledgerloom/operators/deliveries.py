"""Signed delivery handling over a stored log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.signing import SIGNATURE_HEADER, TOPIC_HEADER, event_id, header, signature_ok
from ledgerloom.operators.dedupe import TTL_US, ttl_dedupe
from ledgerloom.session import durable


def authenticate(deliveries: DataFrame, secret: str) -> DataFrame:
    """Adds the signature check, the event id and the topic."""
    h = F.col("headers")
    return (
        deliveries.withColumn("valid", signature_ok(F.col("raw_body"), header(h, SIGNATURE_HEADER), secret))
        .withColumn("event", event_id(h))
        .withColumn("topic", header(h, TOPIC_HEADER))
    )


def outcome_columns(valid: Column, event: Column, accepted: Column) -> list[Column]:
    """status, process and reason of a delivery."""
    reason = (
        F.when(~valid, "invalid_hmac").when(event.isNull(), "no_event_id").when(~accepted, "duplicate").otherwise("process")
    )
    return [
        F.when(valid, 200).otherwise(401).alias("status"),
        (valid & (event.isNull() | accepted)).alias("process"),
        reason.alias("reason"),
    ]


def handle(deliveries: DataFrame, secret: str, ttl_us: int = TTL_US) -> DataFrame:
    """Outcome of every delivery; only valid ones with an id reach the dedupe state."""
    checked = durable(authenticate(deliveries, secret).select("row_id", "us", "valid", "event", "topic"))
    claims = checked.where("valid AND event IS NOT NULL").select(F.col("event").alias("id"), "us", "row_id")
    flags = ttl_dedupe(claims, ttl_us)
    return checked.join(flags, "row_id", "left").select(
        "row_id", "us", "topic", "event",
        *outcome_columns(F.col("valid"), F.col("event"), F.coalesce("accepted", F.lit(False))),
    )
