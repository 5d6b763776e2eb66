"""Table write planning: upserts, patches, compare-and-set, change plans, batching and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.governance import write_mode
from ledgerloom.operators.ordering import global_rank, rank_within

WRITE_BATCH = 25
# Retry budget and wait constants in milliseconds.
MAX_RETRIES, BASE_WAIT_MS, MARGIN_MS = 3, 1000, 100


def upsert(target: DataFrame, incoming: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Target with incoming rows applied: incoming values win, untouched rows stay."""
    t = target.select(key, *[F.col(c).alias(f"_t_{c}") for c in cols], F.lit(True).alias("_t"))
    n = incoming.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_n"))
    op = F.when(F.col("_t").isNull(), "insert").when(F.col("_n").isNull(), "keep").otherwise("update")
    merged = [F.when(F.col("_n").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(f"_t_{c}")).alias(c) for c in cols]
    return t.join(n, key, "full").select(key, *merged, op.alias("op"))


def bulk_patch(target: DataFrame, patch: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Overwrite the given columns where a patch row exists; unknown keys in the patch do nothing."""
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in cols])
    joined = target.join(p, key, "left")
    for c in cols:
        joined = joined.withColumn(c, F.coalesce(f"_p_{c}", c))
    return joined.drop(*[f"_p_{c}" for c in cols])


def compare_and_set(stock: DataFrame, requests: DataFrame) -> DataFrame:
    """Absolute quantity sets that apply only when the expected quantity still holds.

    Retries share an idempotency key and count once (earliest line). Of several matching requests for one item
    the lowest key applies, since it changes the quantity the others expect.
    """
    once = requests.groupBy("key").agg(F.min(F.struct("line", "item", "expected", "quantity")).alias("r"))
    checked = (
        once.select("key", "r.*").join(stock.select("item", "current"), "item", "left")
        .withColumn("match", F.coalesce(F.col("expected") == F.col("current"), F.lit(False)))
    )
    winner = checked.groupBy("item").agg(F.min(F.when(F.col("match"), F.col("key"))).alias("winner"))
    status = (
        F.when(~F.col("match"), "mismatch").when(F.col("key") == F.col("winner"), "applied").otherwise("superseded")
    )
    return checked.join(winner, "item").select("key", "item", "expected", "current", "quantity", status.alias("status"))


def change_plan(target: DataFrame, desired: DataFrame, key: str, cols: list[str], allowed: DataFrame) -> DataFrame:
    """Planned operation per desired row, with whether it may run live and why. Nothing is written."""
    current = target.select(key, *[F.col(c).alias(f"_t_{c}") for c in cols], F.lit(True).alias("_t"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    op = F.when(F.col("_t").isNull(), "insert").when(same, "noop").otherwise("update")
    diff = desired.join(current, key, "left").withColumn("op", op)
    return write_mode(diff, allowed).drop("_t", *[f"_t_{c}" for c in cols])


def write_batches(df: DataFrame, owner: str, order: str, size: int = WRITE_BATCH) -> DataFrame:
    """Batch number per row, at most ``size`` rows of one owner in a batch."""
    placed = rank_within(df, [owner], [order], "_rn")
    return placed.withColumn("batch", F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def outcome() -> Column:
    """Class of a logged attempt."""
    return (
        F.when(F.col("network_error"), "network_error")
        .when((F.col("status") == 429) | F.col("throttled"), "throttled")
        .when(~F.col("status").between(200, 299), F.concat(F.lit("http_"), F.col("status").cast("string")))
        .when(F.col("has_errors"), "graphql_errors")
        .otherwise("ok")
    )


def retryable() -> Column:
    """Writes never repeat after a failure that may have executed; throttled calls always may, reads once."""
    read_once = ~F.col("is_mutation") & (F.col("attempt") < 1)
    return (
        F.when(F.col("outcome") == "network_error", read_once)
        .when(F.col("outcome") == "throttled", F.col("attempt") < MAX_RETRIES)
        .when(F.col("outcome").startswith("http_"), read_once & (F.col("status") >= 500))
        .otherwise(False)
    )


def wait_ms() -> Column:
    """Wait before retrying a throttled attempt; exponential fallback when the cost report does not say."""
    fallback = BASE_WAIT_MS * F.pow(F.lit(2.0), F.col("attempt"))
    deficit = F.col("requested") - F.col("available")
    known = (F.col("requested") != 0) & (deficit > 0) & (F.col("restore_rate") != 0)
    exact = F.ceil(F.try_divide(deficit, F.col("restore_rate")) * 1000) + MARGIN_MS
    return F.when(F.coalesce(known, F.lit(False)), exact).otherwise(fallback).cast("bigint")


def next_ids(existing: DataFrame, titles: DataFrame, order: str, template: str, day: str) -> DataFrame:
    """New experiment ids after the highest existing one, with the filled template.

    The id replaces every placeholder, title and date only the first.
    """
    top = existing.agg(F.coalesce(F.max(F.regexp_extract("id", r"EXP-(\d{3,})", 1).cast("bigint")), F.lit(0)).alias("top"))
    numbered = global_rank(titles, [order], "_n")
    new_id = F.format_string("EXP-%03d", top.scalar() + F.col("_n"))
    body = F.replace(F.lit(template), F.lit("EXP-XXX"), F.col("id"))
    for token, value in (("<title>", F.col("title")), ("YYYY-MM-DD", F.lit(day))):
        at = F.locate(token, body)
        filled = F.concat(F.substring(body, F.lit(1), at - 1), value, F.substring(body, at + len(token), F.length(body)))
        body = F.when(at > 0, filled).otherwise(body)
    return numbered.withColumn("id", new_id).withColumn("body", body).select("id", "title", "body")
