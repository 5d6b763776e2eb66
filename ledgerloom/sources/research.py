"""Candidate relations: the document reader, and candidates derived from the supplier table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import global_index
from ledgerloom.operators.scoring import CANDIDATE_SCHEMA, FACTORS, KNOCKOUTS
from ledgerloom.sources.tables import table

DOCUMENT_SCHEMA = f"candidates array<struct<{CANDIDATE_SCHEMA.replace(' string', ':string').replace(' map', ':map')}>>"
BATCH = 50


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of JSON documents that hold them under one key, with their input order: by file name, then place.

    A file is one document (multi-line), so a candidate's place in it is bounded and leaves room below the file's number.
    """
    docs = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    numbered = global_index(docs.select("file").distinct(), ["file"], "no")
    placed = docs.select("file", F.posexplode("candidates").alias("pos", "c"))
    return placed.join(numbered, "file").select((F.shiftleft("no", 32) + F.col("pos")).alias("ord"), "c.*")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per supplier with every kind of gap: unknown and out-of-range scores, unknown knockouts."""
    s = F.col("s_suppkey")
    names = F.array(*[F.lit(f) for f in FACTORS])
    points = F.expr(
        f"transform(sequence(0, {len(FACTORS) - 1}), "
        "o -> int(if(o = 5 AND s_suppkey % 17 = 3, 7, nullif((s_suppkey * (o + 2) + o) % 6, 0))))"
    )
    rules = F.array(*[F.lit(k) for k in (*KNOCKOUTS, "tooTrendy")])
    hits = F.expr(
        f"transform(sequence(0, {len(KNOCKOUTS)}), o -> CASE WHEN o = {len(KNOCKOUTS)} THEN s_suppkey % 19 = 4 "
        "WHEN (s_suppkey + o) % 13 = 0 THEN true WHEN (s_suppkey + o) % 11 <> 0 THEN false END)"
    )
    return table(spark, sf_dir, "supplier").select(
        s.alias("ord"),
        F.concat(F.lit("C-"), s.cast("string")).alias("id"),
        F.col("s_name").alias("name"),
        F.map_from_arrays(names, points).alias("scores"),
        F.map_from_arrays(rules, hits).alias("knockouts"),
        (s % 3 == 0).alias("quantitative"),
        (s % 4 == 0).alias("verified"),
    )


def candidate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same candidates packed into JSON documents of at most BATCH each (keys are unique, so batches are bounded)."""
    rows = candidates(spark, sf_dir)
    batches = rows.groupBy(F.floor(F.col("ord") / BATCH).alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "id", "name", F.map_entries("scores").alias("s"), F.map_entries("knockouts").alias("k")))).alias("c")
    )
    item = lambda c: F.struct(
        c["id"].alias("id"), c["name"].alias("name"), F.map_from_entries(c["s"]).alias("scores"), F.map_from_entries(c["k"]).alias("knockouts")
    )
    document = F.struct(F.transform("c", item).alias("candidates"))
    return batches.select("batch", F.to_json(document, {"ignoreNullFields": "false"}).alias("doc"))


def parse_documents(docs: DataFrame) -> DataFrame:
    return (
        docs.select("batch", F.from_json("doc", DOCUMENT_SCHEMA).alias("d"))
        .select("batch", F.posexplode("d.candidates").alias("pos", "c"))
        .select((F.col("batch") * BATCH + F.col("pos")).alias("ord"), "c.*")
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources behind candidate factors: one per order line, graded by how the line ended."""
    names = F.array(*[F.lit(f) for f in FACTORS])
    grade = F.when(F.col("l_returnflag") == "N", "H").when(F.col("l_returnflag") == "R", "M").otherwise("L")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("C-"), F.col("l_suppkey").cast("string")).alias("id"),
        F.element_at(names, (F.col("l_partkey") % len(FACTORS) + 1).cast("int")).alias("factor"),
        grade.alias("reliability"),
    )


def price_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-case price, landed cost (with freight multiplier), shipping and payment fees per part."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sym"),
        price.alias("price"),
        (price * 0.25 * (1 + (F.col("p_partkey") % 20) / 20)).alias("landed"),
        (price * 0.05 + size * 2).alias("ship"),
        (price * 0.029 + 0.30).alias("fees"),
    )
