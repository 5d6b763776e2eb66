"""Rows with whole texts go to Python workers and out of Parquet files in small batches."""

import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.llm.common import BATCH_ROWS, prepared


def test_batches_of_long_texts_are_small(spark):
    def sizes(frames):
        for frame in frames:
            yield pd.DataFrame({"mb": [frame["t"].str.len().sum() / 1e6]})

    long = prepared(spark).range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    got = [r.mb for r in long.mapInPandas(sizes, "mb double").collect()]
    assert sum(got) == 24 and max(got) <= 6


def test_parquet_is_read_in_small_batches(spark):
    assert int(prepared(spark).conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 2 * BATCH_ROWS
