"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.redaction import redact_rows
from ledgerloom.operators import scoring
from ledgerloom.operators.ordering import range_sorted

# The head of the ranking report.
REPORT_HEAD = (
    "| Rank | ID | Candidate | Score | Confidence | Verdict | Unknowns | Knockouts |",
    "|---|---|---|---|---|---|---|---|",
)


def write_ranking(ranked: DataFrame, path: str) -> None:
    """Ranked candidates as a Markdown table in part files whose names are in rank order; read one after another they are
    the report. The head is on top of the first."""
    spark = ranked.sparkSession
    head = spark.createDataFrame(list(enumerate(REPORT_HEAD, start=-1)), "rank long, line string")
    body = ranked.select(F.col("rank").cast("long").alias("rank"), scoring.report_line().alias("line"))
    range_sorted(head.unionByName(body), "rank").select("line").write.mode("overwrite").text(path)


def write_log(rows: DataFrame, path: str) -> None:
    """Masked log entries appended as JSON lines."""
    redact_rows(rows).write.mode("append").json(path)


def write_daily(daily: DataFrame, path: str, day: str = "dt") -> None:
    """Aggregates partitioned by day; a rerun replaces only the days it carries."""
    daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """Landed unit costs kept by hand as CSV."""
    return spark.read.schema("sku string, landed_cost decimal(18,4), currency string, as_of date").csv(path, header=True)
