"""Spend limits, limit sets and the write allow-list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import finite

# Spend limit kinds.
LIMIT_KINDS = (
    "MAX_DAILY_AD_SPEND",
    "MAX_CAMPAIGN_TEST_SPEND",
    "MAX_APP_PURCHASE",
    "MAX_REFUND_WITHOUT_APPROVAL",
    "MAX_SUPPLIER_ORDER_WITHOUT_APPROVAL",
)
DEFAULT_MODE = "dry-run"


def limit_check(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Outcome per request: a status column takes the place of exceptions.

    ``limits`` has one row per kind; an absent or non-positive limit always needs approval.
    """
    amount = finite(F.col("amount"))
    status = (
        F.when(~F.coalesce(F.col("kind").isin(*LIMIT_KINDS), F.lit(False)), "UNKNOWN_KIND")
        .when(amount.isNull() | (amount < 0), "INVALID_AMOUNT")
        .when(F.col("limit").isNull() | (F.col("limit") <= 0) | (amount > F.col("limit")), "APPROVAL")
        .otherwise("OK")
    )
    return requests.join(limits.select("kind", "limit"), "kind", "left").withColumn("status", status)


def limit_errors() -> Column:
    """Problems of one limit set: its currency code and every kind's number (the messages are fixed values)."""
    kinds = F.array(*[F.lit(k) for k in LIMIT_KINDS])
    bad = F.filter(
        kinds,
        lambda k: F.coalesce(finite(F.try_element_at("limits", k)) < 0, F.lit(True)),
    )
    currency = F.when(F.col("currency").rlike("^[A-Z]{3}$"), F.array()).otherwise(
        F.array(F.lit("currency must be ISO 4217 code"))
    )
    return F.concat(currency, F.transform(bad, lambda k: F.concat(k, F.lit(" must be a number >= 0"))))


def nonzero_limits() -> Column:
    kinds = F.array(*[F.lit(k) for k in LIMIT_KINDS])
    return F.filter(kinds, lambda k: F.coalesce(F.try_element_at("limits", k) > 0, F.lit(False)))


def unknown_keys(sets: DataFrame, key: str) -> DataFrame:
    """Limit keys outside the known kinds."""
    odd = F.filter(F.map_keys("limits"), lambda k: k.startswith("MAX_") & ~k.isin(*LIMIT_KINDS))
    return sets.select(key, F.explode(odd).alias("unknown_key"))


def write_mode(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Live flag and reason per (store, mode) request; anything short of live on an allowed store is a dry run."""
    listed = (
        allowed.select(F.lower(F.trim("store")).alias("_store"))
        .where(F.col("_store") != "")
        .distinct()
        .withColumn("_listed", F.lit(True))
    )
    mode = F.lower(F.coalesce("mode", F.lit(DEFAULT_MODE)))
    joined = requests.join(listed, F.lower("store") == F.col("_store"), "left")
    reason = (
        F.when(mode != "live", F.concat(F.lit('write mode is "'), mode, F.lit('"')))
        .when(F.col("_listed").isNull(), F.concat(F.lit('store "'), F.coalesce("store", F.lit("")), F.lit('" not in the allow list')))
        .otherwise("live mode and store allow-listed")
    )
    live = (mode == "live") & F.col("_listed").isNotNull()
    return joined.withColumn("live", live).withColumn("reason", reason).drop("_store", "_listed")
