"""Streaming versions of the event operators, and their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import cents
from ledgerloom.functions.redaction import redact_rows
from ledgerloom.operators.deliveries import authenticate, outcome_columns
from ledgerloom.operators.dedupe import TTL_US
from ledgerloom.operators.sessions import GAP_SECONDS
from ledgerloom.session import durable
from ledgerloom.sources.pages import cursors
from ledgerloom.sources.stored import create, merge, read, versions
from ledgerloom.streaming.state import claim_stream, timed_claims

REFUND_LAG = "14 days"


def _escaped(path: str) -> str:
    """The path as a pattern: its own signs of patterns stand for themselves."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


def _only(path: str) -> str:
    """A pattern that matches this one path; a stream takes a plain path for a folder."""
    plain = path.rstrip("/")
    return f"{_escaped(plain[:-1])}[{plain[-1]}]"


def table_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Rows of the Parquet files as they land at ``path`` (a folder or one file).

    All files that have landed since the last run are one micro-batch, whatever order their times are in: the watermark
    only moves between batches, so a backlog loses no row. ``files`` bounds a batch where files are known to be in order.
    """
    stream = spark.readStream.schema(spark.read.parquet(_escaped(path.rstrip("/"))).schema)
    return (stream if files is None else stream.option("maxFilesPerTrigger", files)).parquet(_only(path))


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """:func:`table_stream` of events, with a zoned timestamp (watermarks reject zone-less ones)."""
    return table_stream(spark, path, files).withColumn("ts", F.col("ts").cast("timestamp"))


def spread(stream: DataFrame) -> DataFrame:
    """Rows dealt evenly over all tasks, for costly work on each row: a file is read by no more tasks than it has row groups."""
    return stream.repartition(int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def daily_metrics(events: DataFrame) -> DataFrame:
    """Daily aggregates only; rows later than the refund lag are dropped, and :func:`run_to_table` stores their number."""
    kind = F.col("event_type")
    bought = kind == "purchase"
    return (
        events.withWatermark("ts", REFUND_LAG)
        .groupBy(F.window("ts", "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(kind == "view").alias("sessions"),
            F.count_if(bought).alias("orders"),
            F.coalesce(F.sum(F.when(bought, cents(F.col("value")))), F.lit(0)).alias("cents"),
        )
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "events", "sessions", "orders", "cents")
    )


def timely_refunds(orders: DataFrame, refunds: DataFrame, lag: str = REFUND_LAG) -> DataFrame:
    """Refunds that come within ``lag`` of their order: order_id, ordered_at, refunded_at, cents.

    A stream-stream join of orders (order_id, ordered_at) and refunds (order_id, refunded_at, cents), both with a watermark; the
    interval bounds the state on both sides. An order waits for refunds until the watermark is past its lag.
    """
    placed = orders.select("order_id", "ordered_at").withWatermark("ordered_at", lag)
    paid = refunds.select(F.col("order_id").alias("refund_of"), "refunded_at", "cents").withWatermark("refunded_at", lag)
    within = (F.col("refunded_at") >= F.col("ordered_at")) & (F.col("refunded_at") <= F.col("ordered_at") + F.expr(f"INTERVAL {lag}"))
    return placed.join(paid, (F.col("refund_of") == F.col("order_id")) & within).select("order_id", "ordered_at", "refunded_at", "cents")


def settled_refunds(orders: DataFrame, refunds: DataFrame, lag: str = REFUND_LAG) -> DataFrame:
    """Refunds by order day, each day once it is settled: no refund of it can come in time any more, and none on its way is late.

    The join's output has a watermark of its own, which lags behind the inputs' by the interval; the day window closes on it.
    """
    return (
        timely_refunds(orders, refunds, lag)
        .groupBy(F.window("ordered_at", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("refunds"), F.sum("cents").alias("cents"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "refunds", "cents")
    )


def session_stream(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Closed sessions per user, emitted once the watermark passes them."""
    return (
        events.withWatermark("ts", "1 hour")
        .groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("user_id", F.col("w.start").alias("started"), "events")
    )


def delivery_stream(deliveries: DataFrame, secret: str, ttl_us: int = TTL_US) -> tuple[DataFrame, DataFrame]:
    """Outcomes of a delivery stream as two branches: those decided at once, and claims decided by state."""
    checked = authenticate(deliveries, secret)
    claimable = F.col("valid") & F.col("event").isNotNull()
    never: Column = F.lit(False)
    at_once = checked.where(~claimable).select(
        "row_id", "event", *outcome_columns(F.col("valid"), F.col("event"), never)
    )
    claims = claim_stream(checked.where(claimable).select(F.col("event").alias("id"), "us", "row_id"), ttl_us)
    decided = claims.select(
        "row_id", F.col("id").alias("event"), *outcome_columns(F.lit(True), F.col("id"), F.col("accepted"))
    )
    return at_once, decided


def delivery_counts(outcomes: DataFrame, delay: str | None = "1 hour") -> DataFrame:
    """Hourly outcome counts by topic; ``delay`` None: the rows have a watermark already."""
    timed = outcomes if delay is None else outcomes.withWatermark("ts", delay)
    return (
        timed.groupBy(F.window("ts", "1 hour").alias("w"), "topic", "reason")
        .agg(F.count(F.lit(1)).alias("deliveries"))
        .select(F.col("w.start").alias("hour"), "topic", "reason", "deliveries")
    )


def delivery_stats(deliveries: DataFrame, secret: str, ttl_us: int = TTL_US, delay: str = "1 hour") -> DataFrame:
    """Hourly outcome counts of a delivery stream in one query: claims are decided by keyed state, whose rows keep their event time
    for the window after it. An hour comes out once the watermark, ``delay`` behind the newest time, is past it."""
    checked = authenticate(deliveries, secret).select("row_id", "us", "valid", "event", "topic", F.timestamp_micros("us").alias("at")).withWatermark("at", delay)
    claimable = F.col("valid") & F.col("event").isNotNull()
    at_once = checked.where(~claimable).select("topic", "at", outcome_columns(F.col("valid"), F.col("event"), F.lit(False))[2])
    claims = timed_claims(checked.where(claimable).select(F.col("event").alias("id"), "us", "row_id", "topic", "at"), ttl_us)
    decided = claims.select("topic", "at", outcome_columns(F.lit(True), F.col("id"), F.col("accepted"))[2])
    return delivery_counts(at_once.unionByName(decided).withColumnRenamed("at", "ts"), None)


def live_quotes(offsets: DataFrame, quote_inputs: DataFrame) -> DataFrame:
    """Quotes recomputed from streamed offsets (stream-static join; Spark broadcasts the static side by size)."""
    base = quote_inputs.select("sym", "prev_close", "day_move")
    price = F.col("prev_close") * (1 + F.col("day_move") + F.col("offset_micro") / 1e6)
    return (
        offsets.join(base, "sym")
        .withColumn("price", price)
        .withColumn("chg_pct", (F.col("price") - F.col("prev_close")) / F.col("prev_close") * 100)
        .select("sym", "ord", "price", "chg_pct", "dir")
    )


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Drain what has landed into a parquet table, one batch folder per micro-batch, so a replay overwrites itself.

    Beside the rows, ``dropped`` has the number of rows that each batch's watermark cut. It is written with the batch that follows
    and at the end, so neither the length of a run nor the loss of the driver loses more than the last one.
    """
    running = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        if running and (last := running[0].lastProgress):
            _note_dropped(stream.sparkSession, folder, [last], always=False)

    _drain(stream, folder, mode, write, running)
    if running[0].recentProgress:
        _note_dropped(stream.sparkSession, folder, running[0].recentProgress, always=True)


def _drain(stream: DataFrame, folder: str, mode: str, write: Callable[[DataFrame, int], None], running: list | None = None) -> None:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").foreachBatch(write)
    query = writer.trigger(availableNow=True).start()
    if running is not None:
        running.append(query)
    query.awaitTermination()


def _note_dropped(spark: SparkSession, folder: str, progress: list, always: bool) -> None:
    late = [(int(p["batchId"]), sum(int(s["numRowsDroppedByWatermark"]) for s in p["stateOperators"])) for p in progress]
    if always or any(n for _, n in late):
        counts = spark.createDataFrame(late, "batch long, dropped long").groupBy("batch").agg(F.max("dropped").alias("dropped"))
        name = f"{min(b for b, _ in late)}-{max(b for b, _ in late)}"
        counts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/dropped/run={name}")


def run_to_latest(stream: DataFrame, folder: str, keys: list[str], order: str, wanted: Callable[[], DataFrame] | None = None) -> None:
    """Drain what has landed into a table of the newest row (by ``order``) of each key, a version of it per micro-batch.

    A batch is merged into the version before its own number, so a batch that is replayed gives the same version again. Rows
    of keys outside ``wanted``, which is read anew for each batch, are left out; what a key had before stays.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if wanted is None else batch.join(wanted().select(*keys).distinct(), keys, "left_semi")
        before = [v for v in _versions(spark, folder) if v < batch_id]
        if before:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/rows/batch={before[-1]}"))
        rest = [c for c in batch.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*")
        newest.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    _drain(stream, folder, "append", write)


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    """The newest whole version of a table that :func:`run_to_latest` keeps."""
    return spark.read.parquet(f"{folder}/rows/batch={_versions(spark, folder)[-1]}")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that were written to their end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "batch=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found or [])


def run_to_stored(stream: DataFrame, folder: str, keys: list[str], order: str) -> None:
    """Drain what has landed into a table stored by key (see :mod:`ledgerloom.sources.stored`) at ``table``: the row that is latest by
    ``order`` counts, so replayed batches change nothing, and a batch rewrites only the buckets of its keys."""
    spark, stored = stream.sparkSession, f"{folder}/table"
    if not versions(spark, stored):
        create(spark, stored, spark.createDataFrame([], stream.schema), keys)
    _drain(stream, folder, "append", lambda batch, _: merge(spark, stored, batch, keys, order) and None)


def land_pages(stream: DataFrame, folder: str, field: str, rows: Callable[[DataFrame], DataFrame], key: str) -> None:
    """Drain page documents that have landed into two tables stored by key: ``rows``, the newest landing of each row, and ``cursors``,
    what all pages so far tell of each cursor. Only new files are read; they may land in any order and more than once."""
    spark = stream.sparkSession
    for name, df, by in (("rows", rows(stream), key), ("cursors", cursors(stream, field), "end_cursor")):
        if not versions(spark, f"{folder}/{name}"):
            create(spark, f"{folder}/{name}", spark.createDataFrame([], df.schema), [by])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = durable(batch, "landing")  # parsed once for both tables
        merge(spark, f"{folder}/rows", rows(batch), [key], "landed")
        merge(spark, f"{folder}/cursors", cursors(batch, field), ["end_cursor"], fill=True)

    _drain(stream, folder, "append", write)


def landed_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Cursors that lead to a page nobody has landed yet."""
    return read(spark, f"{folder}/cursors").where("promised AND fetched IS NULL").select("end_cursor")


def append_log(entries: DataFrame, folder: str) -> None:
    """Drain log entries that have landed into masked JSON lines. The sink notes the files of each micro-batch when it is whole, so
    after a stop at any place the next run goes on and :func:`log_lines` has each entry once."""
    writer = redact_rows(entries).writeStream.format("json").outputMode("append").option("checkpointLocation", f"{folder}/progress")
    writer.trigger(availableNow=True).start(f"{folder}/lines").awaitTermination()


def log_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Entries of the micro-batches that :func:`append_log` has finished; nested values come as JSON text if declared as strings."""
    return spark.read.schema(schema).json(f"{folder}/lines")


def dropped_rows(spark: SparkSession, folder: str) -> int:
    """Rows that the watermark has cut over all runs into the table."""
    return spark.read.parquet(f"{folder}/dropped").groupBy("batch").agg(F.max("dropped").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def latest_per_key(spark: SparkSession, folder: str, keys: list[str], values: list[str]) -> DataFrame:
    """Final state of an update-mode table: the newest batch wins for each key."""
    rows = spark.read.parquet(f"{folder}/rows")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")
