"""Cross-site boilerplate lines by distinct-site spread.

Every line's hash gets a HyperLogLog sketch of the sites it occurs on; sketches are built in each task and merged by the
aggregation. An estimate far from the threshold decides; lines near it (within several standard errors) get an exact distinct
count of their sites. Lines on at least the threshold's number of sites are removed from every text.

A line on a third of all rows is one sketch per task; only line numbers of removed lines go back to the texts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BLANKS, row_key
from ledgerloom.session import durable

LOG_REGISTERS = 9
ERRORS = 5.0  # standard errors within which an estimate is checked


def boilerplate(lines: DataFrame, min_sites: int, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """Hashes (a, b) of the lines (columns a, b, site) that are on at least ``min_sites`` sites."""
    margin = ERRORS * 1.04 / math.sqrt(2**log_registers)
    sketches = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(log_registers)).alias("sketch"))
    spread = sketches.select("a", "b", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = durable(spread.filter(F.col("sites") >= min_sites * (1 - margin)), "line-likely")
    near = likely.filter(F.col("sites") <= min_sites * (1 + margin)).select("a", "b")
    exact = lines.join(near, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count_distinct("site").alias("sites"))
    sure = likely.filter(F.col("sites") > min_sites * (1 + margin)).select("a", "b")
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("a", "b"))


def clean(docs: DataFrame, min_sites: int, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, text without boilerplate lines, n_lines, removed_lines.

    Lines end at a line feed and are compared after runs of white space become one space and those at the ends go; blank
    lines are never boilerplate. Null sites together are one site. A null text stays null, with no lines; an empty one has one
    (blank) line. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(site).alias("site"))
    plain = F.trim(F.regexp_replace("line", BLANKS, " "))
    lines = durable(
        rows.select(row_key("doc_id", "text").alias("_key"), F.coalesce("site", F.lit("\0")).alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .withColumn("line", plain)
        .filter("line <> ''")
        .select("_key", "site", "at", F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(7)).alias("b")),
        "lines",
    )
    found = durable(boilerplate(lines, min_sites), "line-boilerplate")
    removed = durable(
        lines.join(found, ["a", "b"], "left_semi").groupBy("_key").agg(F.collect_set("at").alias("_gone")),  # of one text
        "line-removed",
    )
    parts = F.split("text", "\n")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    return rows.withColumn("_key", row_key("doc_id", "text")).join(removed, "_key", "left").select(
        "doc_id",
        F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("removed_lines"),
    )
