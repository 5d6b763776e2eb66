"""Search, ranked screens and pages over the universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import global_rank

PAGE_SIZE = 25

# Relevance points per kind of match, best first.
SCORE_SYMBOL_EQUAL = 100
SCORE_SYMBOL_PREFIX = 80
SCORE_SYMBOL_CONTAINS = 60
SCORE_WORD_PREFIX = 50
SCORE_NAME_CONTAINS = 34
SCORE_SECTOR_PREFIX = 22
SCORE_SECTOR_CONTAINS = 14


def rel_score(q: str) -> Column:
    """Relevance of a row to an already trimmed, lower-cased search text."""
    sym, name, sector = F.lower("sym"), F.lower("name"), F.lower("sector")
    word_hit = F.exists(F.split(name, " "), lambda w: F.startswith(w, F.lit(q)))
    return (
        F.when(sym == q, SCORE_SYMBOL_EQUAL)
        .when(sym.startswith(q), SCORE_SYMBOL_PREFIX)
        .when(sym.contains(q), SCORE_SYMBOL_CONTAINS)
        .when(word_hit, SCORE_WORD_PREFIX)
        .when(name.contains(q), SCORE_NAME_CONTAINS)
        .when(sector.startswith(q), SCORE_SECTOR_PREFIX)
        .when(sector.contains(q), SCORE_SECTOR_CONTAINS)
        .otherwise(0)
    )


def screen(df: DataFrame, q: str = "", sector: str = "All") -> DataFrame:
    """Rows of the chosen sector that match the search, with their score (0 when there is no search)."""
    q = q.strip().lower()
    if sector != "All":
        df = df.where(F.col("sector") == sector)
    if not q:
        return df.withColumn("score", F.lit(0))
    return df.withColumn("score", rel_score(q)).where(F.col("score") > 0)


def alphabetical(col: str) -> Column:
    """As people sort: letters before case and accents, by the root collation; texts it holds equal fall back to code points."""
    return F.asc(F.struct(F.collate(col, "UNICODE"), col))


def sort_columns(sort: str) -> list[Column]:
    """Total order of a screen; the universe ordinal settles every tie."""
    by = {
        "relevance": [F.desc("score"), F.desc_nulls_last("heat")],
        "gainers": [F.desc_nulls_last("chg_pct")],
        "losers": [F.asc_nulls_last("chg_pct")],
        "mcap": [F.desc_nulls_last("mcap_num")],
        "alpha": [alphabetical("sym")],
        "names": [alphabetical("name")],
    }
    return [*by[sort], F.asc("ord")]


def ranked(df: DataFrame, sort: str) -> DataFrame:
    return global_rank(df, sort_columns(sort))


def page(df: DataFrame, sort: str, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Zero-based page of screened rows, clamped to the last one, with rank and page.

    A top-k of everything up to the page: if fewer rows exist, their last page is the clamped one.
    """
    order = sort_columns(sort)
    head = df.orderBy(*order).limit((number + 1) * size)
    placed = head.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # over the rows kept
    at = F.floor((F.col("rank") - 1) / size)
    return placed.withColumn("page", F.max(at).over(Window.partitionBy(F.lit(0)))).where(at == F.col("page"))
