"""Sessions, and last-event lookups, without putting one user's raw events in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import cents
from ledgerloom.operators.ordering import latest_before
from ledgerloom.sources.commerce import micros

GAP_SECONDS = 30 * 60
HOUR_US = 3_600_000_000


def gap_slots(ev: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Events combined into clock slots as wide as the largest divisor of both the session gap and the hour.

    Two events in one slot are less than a gap apart, so they share a session, and lie in one hour: the combine is
    exact, runs map-side, and leaves at most one row per user and slot of the calendar.
    """
    width = math.gcd(gap_seconds, 3600)
    us = micros(F.col("ts"))
    kind = F.col("event_type")
    return ev.groupBy("user_id", F.floor(us / (width * 1_000_000)).alias("slot")).agg(
        F.min(us).alias("first_us"),
        F.max(us).alias("last_us"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(kind == "click").alias("carts"),
        F.count_if(kind == "signup").alias("checkouts"),
        F.count_if(kind == "purchase").alias("orders"),
        F.coalesce(F.sum(F.when(kind == "purchase", cents(F.col("value")))), F.lit(0)).alias("cents"),
    )


def sessions(ev: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """One row per user session; a new one starts after a silence longer than the gap."""
    per_user = Window.partitionBy("user_id").orderBy("slot")
    per_hour = Window.partitionBy("user_id", "hour")
    silence = F.col("first_us") - F.lag("last_us").over(per_user)
    slots = (
        gap_slots(ev, gap_seconds)
        .withColumn("hour", F.floor(F.col("first_us") / HOUR_US))
        .withColumn("starts", F.when(silence <= gap_seconds * 1_000_000, 0).otherwise(1))
        .withColumn("session_no", F.sum("starts").over(per_user))
        .withColumn("in_hour", F.sum("n").over(per_hour))
    )
    return slots.groupBy("user_id", "session_no").agg(
        F.min("first_us").alias("start_us"),
        F.max("last_us").alias("end_us"),
        F.sum("n").alias("events"),
        F.sum("carts").alias("carts"),
        F.sum("checkouts").alias("checkouts"),
        F.sum("orders").alias("orders"),
        F.sum("cents").alias("cents"),
        F.max("in_hour").alias("peak_hour_events"),
    )


def us_text(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def us_day(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def last_marked_before(df: DataFrame, key: str, us: str, tie: str, marked: Column, piece_rows: int = 20_000) -> DataFrame:
    """Time of the latest marked row at or before each row of its key.

    Rows are looked through in pieces of a fixed number of rows, however busy a key or a moment is.
    """
    mark = F.when(marked, F.col(us))
    seen = latest_before(df, [key], [us, tie], mark, "_earlier", piece_rows)
    return seen.withColumn("last_marked_us", F.coalesce(mark, "_earlier")).drop("_earlier")
