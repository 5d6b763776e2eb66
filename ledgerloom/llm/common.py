"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import tune

BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch. A worker holds a batch several times over, as Arrow, as Python objects and as results.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 22
#: Rows that a Parquet reader holds at a time: its arrays of text double as they fill.
READ_ROWS = 1024
#: Bits of a Bloom filter that one task packs.
PART_BITS = 18


def prepared(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: the library's own, and smaller batches because rows hold whole texts."""
    tune(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def text_of(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def one_spaced(col: str | Column = "text") -> Column:
    """The text with every run of ASCII white space as one space, null as empty."""
    return F.regexp_replace(text_of(col), BLANKS, " ")


def row_key(*cols: str | Column) -> Column:
    """128 bits that tell rows apart by the given columns; never null, so plain equi-joins can use it."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    nulls = [p.isNull() for p in parts]
    return F.struct(F.xxhash64(*parts, *nulls).alias("a"), F.xxhash64(F.lit(7), *nulls, *reversed(parts)).alias("b"))


def held(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each row of ``docs`` as one struct column ``row`` beside ``columns``, so that no name of theirs can clash; the rows come
    back by ``select("row.*")``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def marked(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of a row key (:func:`row_key`) by a Bloom filter of ``keys._key``: true for all of them and few others.

    Its parts are made in Spark. It has 16 to 32 bits a key, two of them set, up to 2 ** 31 bits (256 MB) in all.
    """
    bits = min(31, max(PART_BITS, math.ceil(math.log2(16 * max(keys.count(), 1)))))
    places = lambda key: [F.shiftrightunsigned(key[c], 64 - bits) for c in "ab"]
    spots = keys.select(F.explode(F.array(*places(F.col("_key")))).alias("at")).distinct()

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << PART_BITS, dtype=bool)
        own[frame["at"].to_numpy(np.int64) & ((1 << PART_BITS) - 1)] = True
        return pd.DataFrame({"part": [key[0]], "own": [np.packbits(own, bitorder="little").tobytes()]})

    parts = spots.groupBy(F.shiftrightunsigned("at", PART_BITS).alias("part")).applyInPandas(pack, "part long, own binary")
    filled, size = np.zeros(1 << (bits - 3), dtype=np.uint8), 1 << (PART_BITS - 3)
    for r in parts.toLocalIterator():
        filled[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["own"], np.uint8)
    shipped = keys.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def has(a: pd.Series, b: pd.Series) -> pd.Series:
        found = np.ones(len(a), dtype=bool)
        for at in (a.to_numpy(np.int64), b.to_numpy(np.int64)):
            found &= (shipped.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(found)

    return lambda key: has(*places(key))


def without(docs: DataFrame, key: Column, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``dropped``; of a key in ``repeated`` one row stays.

    Both relations are written and have the one column ``_key``. Rows that a Bloom filter of both passes over stay where they
    are; only the others, few more than those dropped, are exchanged. This is the one path at every size.
    """
    has, rows = marked(dropped.unionByName(repeated)), held(docs, _key=key)
    stay = rows.filter(~has(F.col("_key")))
    kept = rows.filter(has(F.col("_key"))).join(dropped.hint("merge"), "_key", "left_anti")
    one = kept.join(repeated.hint("merge"), "_key", "left_semi").dropDuplicates(["_key"])
    return stay.unionByName(kept.join(repeated.hint("merge"), "_key", "left_anti")).unionByName(one).select("row.*")
