"""Exact keyed state processors: time-to-live claims, clamped offsets and watchlists.

Claims and watchlists are kept by bucket: a key of the state is a bucket of ids or users, not one of them. Rows of one key arrive
unordered inside a micro-batch, so each handler sorts the key's share of the batch; size it with
``maxFilesPerTrigger``/``maxBytesPerTrigger``. Those with a time keep event time in the state, so replays and the batch
twins agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.dedupe import TTL_US
from ledgerloom.operators.offsets import LIMIT_MICRO

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024  # keys of the state of claims and watchlists
CHUNK = 512  # symbols of a watchlist that one entry of the state has, about


def use_rocksdb(spark: SparkSession) -> None:
    """State lives off-heap and incrementally checkpointed, which these processors require."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable")


class TtlClaims(StatefulProcessor):
    """Accepts an id once per time-to-live; the expiry is not refreshed by duplicates.

    A key is a bucket of ids, so a call and its state are one for many ids. A timer at the bucket's first expiry drops the ids whose
    expiry the watermark has passed, so only ids of the live window are kept.
    """

    def __init__(self, ttl_us: int = TTL_US, columns: tuple[str, ...] = ("id", "us", "row_id", "accepted")):
        self.ttl_us, self.columns = ttl_us, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.live = handle, handle.getValueState("live", "ids array<string>, free array<bigint>, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["us", "row_id"])
        ids, ends, due = self.live.get() or ((), (), None)
        free, flags = dict(zip(ids, ends, strict=True)), []
        for one, us in zip(pdf["id"].tolist(), pdf["us"].tolist(), strict=True):
            end = free.get(one)
            take = end is None or us >= end
            if take:
                free[one] = us + self.ttl_us
            flags.append(take)
        self._keep(free, timerValues.getCurrentWatermarkInMs(), due, True)
        yield pdf.assign(accepted=flags)[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids, ends, due = self.live.get() or ((), (), None)
        # the timer that is due goes by itself
        self._keep(dict(zip(ids, ends, strict=True)), timerValues.getCurrentWatermarkInMs(), due, due != expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def _keep(self, free: dict[str, int], watermark: int, due: int | None, pending: bool) -> None:
        """Store the ids whose expiry is still ahead, and move the timer to the first."""
        free = {one: end for one, end in free.items() if end > watermark * 1000}
        first = -(-min(free.values()) // 1000) if free else None  # milliseconds, at or after the expiry
        if due is not None and pending and first != due:
            self.handle.deleteTimer(due)
        if first is not None and not (pending and first == due):
            self.handle.registerTimer(first)
        if free:
            self.live.update((list(free), list(free.values()), first))
        else:
            self.live.clear()

    def close(self) -> None:
        pass


class ClampedOffset(StatefulProcessor):
    """Running offset per symbol, clamped at every step."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.offset = handle.getValueState("offset", "micro bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["ord"])
        x = self.offset.get()[0] if self.offset.exists() else 0
        offsets, ups = [], []
        for step in pdf["step"].tolist():
            before, x = x, max(-LIMIT_MICRO, min(LIMIT_MICRO, x + step))
            offsets.append(x)
            ups.append("up" if x > before else "down")
        self.offset.update((x,))
        yield pdf[["sym", "ord"]].assign(offset_micro=offsets, dir=ups)

    def close(self) -> None:
        pass


class WatchEdits(StatefulProcessor):
    """Watchlists: adding twice is idempotent, and the last symbol stays.

    A key is a bucket of users. A list is a map from symbol to place, cut into 2 ** bits chunks by a hash of the symbol; it gets
    twice as many once it has over ``CHUNK`` symbols a chunk. So a batch reads and writes the chunks of symbols it names, however
    long the list, and a short list is one entry. Chunk 0 has the list's size as well.
    Yields each symbol whose entry a batch has changed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lists = handle.getMapState(
            "lists", "user string, chunk int", "held bigint, next bigint, bits int, syms array<string>, places array<bigint>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["ord"])
        edits: dict[str | None, list[tuple]] = {}
        for user, *edit in zip(pdf["user_id"].tolist(), pdf["ord"].tolist(), pdf["adds"].tolist(), pdf["sym"].tolist(), strict=True):
            edits.setdefault(user, []).append(edit)
        out = [(user, *change) for user, own in edits.items() for change in self._apply(user, own)]
        users, syms, numbers, places = zip(*out, strict=True) if out else ((), (), (), ())
        ids = pd.array([None if u is None else int(u) for u in users], dtype="Int64")
        yield pd.DataFrame({"user_id": ids, "sym": list(syms), "ord": pd.array(numbers, dtype="Int64"), "place": pd.array(places, dtype="Int64")})

    def _apply(self, user: str | None, edits: list[tuple]) -> Iterator[tuple]:
        """(symbol, number of the last change, place) of the symbols that edits of one user, in order, have changed."""
        head = self.lists.getValue((user, 0))
        held, following, bits = head[:3] if head else (0, 0, 0)
        chunks = {0: dict(zip(head[3], head[4], strict=True)) if head else {}}
        stale, changed = {0}, {}

        def chunk(at: int) -> dict[str, int]:
            if at not in chunks:
                entry = self.lists.getValue((user, at))
                chunks[at] = dict(zip(entry[3], entry[4], strict=True)) if entry else {}
            return chunks[at]

        for no, adds, sym in edits:
            at = _chunk_of(sym, bits)
            own = chunk(at)
            if adds and sym not in own:
                own[sym], held, following, changed[sym] = following, held + 1, following + 1, no
            elif not adds and sym in own and held > 1:
                del own[sym]
                held, changed[sym] = held - 1, no
            else:
                continue
            stale.add(at)
        places = {sym: chunk(_chunk_of(sym, bits)).get(sym) for sym in changed}
        if held > CHUNK << bits:
            whole = {sym: place for at in range(1 << bits) for sym, place in chunk(at).items()}
            bits = (held // CHUNK).bit_length()
            chunks, stale = {at: {} for at in range(1 << bits)}, set(range(1 << bits))
            for sym, place in whole.items():
                chunks[_chunk_of(sym, bits)][sym] = place
        if changed:
            for at in stale:
                own = chunks[at]
                self.lists.updateValue((user, at), (held, following, bits, list(own), list(own.values())))
        return ((sym, no, places[sym]) for sym, no in changed.items())

    def close(self) -> None:
        pass


def _chunk_of(sym: str, bits: int) -> int:
    return zlib.crc32(sym.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def _buckets(key: str, buckets: int) -> Column:
    """Equal keys in one of so many buckets, the key of the state: a call and a round trip then serve many of them."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


def watch_stream(edits: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Changed places of streamed edits (user_id, ord, adds, sym): user_id, sym, ord of the last change, place (null: taken off).

    ``ord`` must rise from batch to batch of a user. Edits without a symbol are left out. The number of ``buckets`` of users is
    fixed for a stream's life."""
    use_rocksdb(edits.sparkSession)
    # as text a missing user does not turn the others into floating numbers
    rows = edits.where("sym IS NOT NULL").select(_buckets("user_id", buckets), F.col("user_id").cast("string").alias("user_id"), "ord", "adds", "sym")
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=WatchEdits(),
        outputStructType="user_id bigint, sym string, ord bigint, place bigint",
        outputMode="append",
        timeMode="none",
    )


def claim_stream(rows: DataFrame, ttl_us: int = TTL_US, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Acceptance flag for each streamed (id, us, row_id). State lasts until the watermark, ``delay`` behind the newest time,
    passes an id's expiry. Rows behind the watermark are cut and counted (see ``flows.dropped_rows``), so ``delay`` has to
    cover how late a delivery can land. The number of ``buckets`` of ids is fixed for a stream's life."""
    use_rocksdb(rows.sparkSession)
    timed = rows.select(_buckets("id", buckets), "id", "us", "row_id", F.timestamp_micros("us").alias("at")).withWatermark("at", delay)
    return timed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=TtlClaims(ttl_us),
        outputStructType="id string, us bigint, row_id bigint, accepted boolean",
        outputMode="append",
        timeMode="eventTime",
    )


def timed_claims(rows: DataFrame, ttl_us: int = TTL_US, buckets: int = BUCKETS) -> DataFrame:
    """:func:`claim_stream` for (id, us, row_id, topic, at), ``at`` having a watermark: its rows keep ``at`` as their event time,
    so a further stateful operator can follow in the same query."""
    use_rocksdb(rows.sparkSession)
    return rows.select(_buckets("id", buckets), "*").groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=TtlClaims(ttl_us, ("id", "topic", "at", "accepted")),
        outputStructType="id string, topic string, at timestamp, accepted boolean",
        outputMode="append",
        timeMode="eventTime",
        eventTimeColumnName="at",
    )


def offset_stream(steps: DataFrame) -> DataFrame:
    """Offset and direction after each streamed (sym, ord, step)."""
    use_rocksdb(steps.sparkSession)
    return steps.select("sym", "ord", "step").groupBy("sym").transformWithStateInPandas(
        statefulProcessor=ClampedOffset(),
        outputStructType="sym string, ord bigint, offset_micro bigint, dir string",
        outputMode="append",
        timeMode="none",
    )
