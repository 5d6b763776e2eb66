"""Watchlists from a log of edits: adding twice is idempotent, and a list of one refuses removals.

Without refusals a symbol would be on its list exactly when its last edit adds it. A refusal changes that in one way only: the
last symbol's removal does not count, and the symbol is *stuck* on the list until it is added again or is removed while the list
has another. A list never has two stuck symbols, because the next one can only get stuck when the list would be empty again.
So a list is always the symbols that were last added and its stuck symbol, if any.

The removals that would empty a list are known from a running count of each list's length. Those that find the list without a
stuck symbol are a chain: from the first on, each one's successor is the first such removal after it has come unstuck. All of
this is orders, joins and sums over pieces of the log; no list is ever held in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.dedupe import on_chains
from ledgerloom.operators.ordering import global_index, latest_before, rank_within, running_sum
from ledgerloom.session import durable


def apply_watch_edits(edits: DataFrame) -> DataFrame:
    """Final watchlists from a log of (user_id, ord, adds, sym): user_id, sym, ord (place from 0), selected.

    The selected symbol is at first the first one added; when it is removed, the first remaining one follows. New symbols go to
    the end, so it is always the one at the head of the list.
    """
    log = global_index(edits.select("user_id", "ord", "adds", "sym"), ["user_id", "ord"], "no")
    log = global_index(log, ["user_id", "sym", "no"], "by_sym")
    was = latest_before(log, ["user_id", "sym"], ["no"], F.col("adds"), "was_added", number=F.col("by_sym"))
    change = F.when(F.col("adds") & ~F.coalesce("was_added", F.lit(False)), 1).when(~F.col("adds") & F.coalesce("was_added", F.lit(False)), -1).otherwise(0)
    counted = durable(running_sum(was.withColumn("change", change), ["user_id"], ["no"], "change", "left", number=F.col("no")), "edits-counted")

    # a removal that would empty the list, and the edit that would free its symbol afterwards
    frees = F.when(F.col("adds") | (F.col("left") > 0), F.struct("no", "adds"))
    freed = latest_before(counted, ["user_id", "sym"], [F.desc("no")], frees, "freed", number=-F.col("by_sym"))
    emptying = freed.where("change = -1 AND left = 0").select(
        F.col("user_id").alias("id"), F.col("no").alias("us"), F.col("freed.no").alias("due"), "sym", F.col("freed.adds").alias("again")
    )
    placed = durable(global_index(emptying, ["id", "us"], "pos").withColumn("row_id", F.col("us")), "edits-emptying")
    stuck = durable(
        placed.join(on_chains(placed.select("id", "us", "due", "pos", "row_id")).where("accepted"), "row_id").select(
            F.col("id").alias("user_id"), "sym", F.col("due").alias("no"), "again"
        ),
        "edits-stuck",
    )

    # a symbol keeps its place when it is added while it is stuck
    kept = stuck.where("again").select("no", F.lit(True).alias("kept"))
    entered = counted.join(kept, "no", "left").withColumn("fresh", F.when((F.col("change") == 1) & F.col("kept").isNull(), F.col("no")))
    last = entered.groupBy("user_id", "sym").agg(F.max_by("adds", "no").alias("listed"), F.max("fresh").alias("at"))
    still = stuck.where("no IS NULL").select("user_id", "sym", F.lit(True).alias("still"))
    members = last.join(still, ["user_id", "sym"], "left").where("listed OR still")
    ranked = rank_within(members.select("user_id", "sym", "at"), ["user_id"], ["at"], "place")
    return ranked.select("user_id", "sym", (F.col("place") - 1).alias("ord"), (F.col("place") == 1).alias("selected"))
