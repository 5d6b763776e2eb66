"""Data-quality checks that gate interpretation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROVISIONAL_DAYS = 14
BOT_EVENTS_PER_HOUR = 2  # default threshold; the definition leaves it to the operator


def tracking_coverage(ev: DataFrame, template: str, expected: dict[str, str]) -> DataFrame:
    """Expected event kinds that are missing or fired more than once per template and day.

    Every template is expected on every day between the first and the last of the data, so days on which it fired nothing count as
    well. The grid comes from the templates and the two ends of the calendar; all kinds are counted in one aggregation beside it.
    """
    day = F.to_date("ts")
    counts = ev.groupBy(template, day.alias("day")).agg(*[F.count_if(F.col("event_type") == raw).alias(name) for raw, name in expected.items()])
    first, last = (ev.agg(end(day)).scalar() for end in (F.min, F.max))
    grid = ev.select(template).distinct().select(template, F.explode(F.sequence(first, last)).alias("day"))
    filled = grid.join(counts, [template, "day"], "left").na.fill(0, list(expected.values()))
    status = F.when(F.col("fired") == 0, "missing").when(F.col("fired") > 1, "duplicate")
    unfolded = filled.withColumn("day", F.date_format("day", "yyyy-MM-dd")).unpivot([template, "day"], list(expected.values()), "tag", "fired")
    return unfolded.withColumn("status", status).where("status IS NOT NULL")


def without_bots(sess: DataFrame, threshold: int = BOT_EVENTS_PER_HOUR) -> DataFrame:
    """Sessions that never exceed the event rate."""
    return sess.where(F.col("peak_hour_events") <= threshold)


def currency_consistency(orders: DataFrame) -> DataFrame:
    """One row per shop: fails with more than one currency, or one that is not the shop's own."""
    stray = F.count_if(F.col("currency") != F.col("shop_currency"))
    return orders.groupBy("shop").agg(
        F.count_distinct("currency").alias("currencies"),
        stray.alias("stray_orders"),
        ((F.count_distinct("currency") == 1) & (stray == 0)).alias("ok"),
    )


def flag_provisional(daily: DataFrame, day: str, days: int = PROVISIONAL_DAYS) -> DataFrame:
    """Mark the last days, whose refunds are still arriving."""
    newest = daily.agg(F.max(day)).scalar()
    return daily.withColumn("provisional", F.col(day) > F.date_sub(newest, days))


def catalog_audit(products: DataFrame) -> DataFrame:
    """Issue counts. Grouping by title first keeps duplicates countable without any join."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    per_title = products.groupBy("title", "status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(blank("seo_title")).alias("missing_seo_title"),
        F.count_if(blank("seo_description")).alias("missing_seo_description"),
        F.count_if(F.col("total_inventory") <= 0).alias("no_inventory"),
    )
    titles = per_title.groupBy("title").agg(
        F.sum("n").alias("n"),
        *[F.sum(c).alias(c) for c in ("missing_seo_title", "missing_seo_description", "no_inventory")],
        *[F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)).alias(f"status_{s}") for s in STATUSES],
    )
    counts = ["missing_seo_title", "missing_seo_description", "no_inventory", *[f"status_{s}" for s in STATUSES]]
    total: list[Column] = [F.sum(c).cast("bigint").alias(c) for c in counts]
    total.append(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("bigint").alias("duplicate_title"))
    return titles.agg(*total).unpivot([], [*counts, "duplicate_title"], "issue", "products")


# Product states.
STATUSES = ("ACTIVE", "ARCHIVED", "DRAFT")
