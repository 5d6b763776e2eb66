"""Tables stored by key, of which a change rewrites only the buckets it touches.

Rows are dealt to a fixed number of buckets by a hash of the key. Below the table's folder, ``data/version=v/keyed_bucket=b`` has
a bucket's rows as written by version v, and ``versions/v`` names for every bucket the version that holds it. A version counts
once that list is written to its end: readers see the whole change or nothing of it, and a writer lost on the way is repeated
under the same number. One writer at a time. Choose the number of buckets so that one is a few hundred megabytes; only the list
of buckets is ever held by the driver.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators.writes import compare_and_set
from ledgerloom.session import durable

BUCKETS = 64
_BUCKET = "keyed_bucket"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the table's whole versions, oldest first; none: no table is there."""
    path, files = _path(spark, f"{folder}/versions")
    done = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName()) for f in done or [])


def _held(spark: SparkSession, folder: str) -> tuple[int, dict[int, int | None], StructType]:
    """Newest version, the version of each bucket (null: empty), and the columns."""
    newest = versions(spark, folder)[-1]
    listed = spark.read.parquet(f"{folder}/versions/{newest}").collect()  # one row a bucket
    return newest, {r["bucket"]: r["version"] for r in listed}, StructType.fromJson(json.loads(listed[0]["columns"]))


def _publish(spark: SparkSession, folder: str, version: int, held: dict[int, int | None], columns: StructType) -> None:
    rows = [(b, v, columns.json()) for b, v in sorted(held.items())]
    spark.createDataFrame(rows, "bucket int, version int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/{version}")


def _write(rows: DataFrame, folder: str, version: int, keys: list[str], buckets: int) -> None:
    # adaptive execution splits a large bucket into several files
    dealt = rows.withColumn(_BUCKET, _bucket(keys, buckets)).hint("rebalance", _BUCKET)
    dealt.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{folder}/data/version={version}")


def _rows(spark: SparkSession, folder: str, held: dict[int, int | None], columns: StructType, only: list[int] | None = None) -> DataFrame:
    wanted = held if only is None else only
    paths = [f"{folder}/data/version={held[b]}/{_BUCKET}={b}" for b in wanted if held[b] is not None]
    return spark.read.schema(columns).parquet(*paths) if paths else spark.createDataFrame([], columns)


def create(spark: SparkSession, folder: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table of ``rows``, whose keys are unique. A null key is a key like any other."""
    if versions(spark, folder):
        raise ValueError(f"there is a table at {folder}")
    columns = StructType.fromJson(rows.schema.jsonValue())
    for field in columns:
        field.nullable = True
    rows = durable(rows, "stored")
    filled = {r[0] for r in rows.select(_bucket(keys, buckets)).distinct().collect()}
    if filled:
        _write(rows, folder, 0, keys, buckets)
    _publish(spark, folder, 0, {b: 0 if b in filled else None for b in range(buckets)}, columns)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The newest whole version."""
    _, held, columns = _held(spark, folder)
    return _rows(spark, folder, held, columns)


def merge(
    spark: SparkSession, folder: str, incoming: DataFrame, keys: list[str], order: str | None = None, insert: bool = True, fill: bool = False
) -> int:
    """Apply rows to the table and return how many of its rows that changed or added.

    Incoming values win. Columns that ``incoming`` lacks keep their values, columns that the table lacks are ignored. With ``order``,
    a column of both, a row only wins if it is later than the stored one (equal: the greater row), so repeats and rows out of time
    order do no harm. ``insert`` False: unknown keys do nothing. ``fill``: null values do not overwrite. Of several rows of one key
    the last by ``order`` counts, then the greatest. Buckets without a change keep their files, and without any change there is
    no new version, so a rerun changes nothing.
    """
    version, held, columns = _held(spark, folder)
    given = [c for c in columns.names if c not in keys and c in incoming.columns]
    row = F.struct(*([F.col(order).alias("_by")] if order else []), *given)
    once = durable(
        incoming.groupBy(*keys).agg(F.max(row).alias("_new")).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_new"), "incoming"
    )
    at = _bucket([f"_{i}" for i in range(len(keys))], len(held))
    touched = sorted(r[0] for r in once.select(at).distinct().collect())
    stored = _rows(spark, folder, held, columns, touched).withColumn("_old", row)
    same_key = reduce(Column.__and__, [F.col(f"_{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)])
    won = {c: F.coalesce(f"_new.{c}", c) if fill else F.col(f"_new.{c}") for c in given}
    known = F.col("_old").isNotNull()
    differs = reduce(Column.__or__, [~v.eqNullSafe(F.col(c)) for c, v in won.items()], F.lit(False))
    wins = differs & (F.col("_new") > F.col("_old")) if order else differs
    final = [F.col(f"_{keys.index(c)}").alias(c) if c in keys else won.get(c, F.col(c)).alias(c) for c in columns.names]
    changed = durable(once.join(stored, same_key, "left").where(F.when(known, wins).otherwise(F.lit(insert))).select(*final), "changed")
    rewritten = sorted(r[0] for r in changed.select(_bucket(keys, len(held))).distinct().collect())
    if not rewritten:
        return 0
    gone = changed.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
    rest = _rows(spark, folder, held, columns, rewritten).join(gone, same_key, "left_anti")
    _write(rest.unionByName(changed), folder, version + 1, keys, len(held))
    _publish(spark, folder, version + 1, held | dict.fromkeys(rewritten, version + 1), columns)
    return changed.count()


def set_quantities(spark: SparkSession, folder: str, requests: DataFrame) -> DataFrame:
    """Compare-and-set requests (see :func:`~ledgerloom.operators.writes.compare_and_set`) against a stored table (item, current),
    applied; returns their statuses. Retried after it was applied, a request no longer finds what it expects."""
    decided = durable(compare_and_set(read(spark, folder), requests), "quantities")
    merge(spark, folder, decided.where("status = 'applied'").select("item", F.col("quantity").alias("current")), ["item"], insert=False)
    return decided


def purge(spark: SparkSession, folder: str) -> int:
    """Delete what no reader of the newest version needs; the number of buckets' old copies that went."""
    version, held, _ = _held(spark, folder)
    kept, gone = {f"version={v}/{_BUCKET}={b}" for b, v in held.items()}, 0
    path, files = _path(spark, f"{folder}/data")
    for f in files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "version=*/keyed_bucket=*")) or []:
        at = f.getPath()
        if f"{at.getParent().getName()}/{at.getName()}" not in kept:
            gone += bool(files.delete(at, True))
    for v in versions(spark, folder):
        if v < version:
            files.delete(_path(spark, f"{folder}/versions/{v}")[0], True)
    return gone
