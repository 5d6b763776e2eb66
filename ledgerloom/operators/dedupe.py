"""Time-to-live deduplication of repeated ids in a stored log.

A row is accepted when its id is new or was last *accepted* at least the time-to-live ago; duplicates do not
extend the period. That is a chain, not a gap test, so a lag filter would be wrong.

One path serves every id, however hot. The log is ordered once by (id, time, row), which numbers its rows. Each row's successor,
the id's first row at or after its expiry, comes from a second ordering of rows and expiries together. Accepted rows are those
on the chain of successors that starts at an id's first row. Chunks of consecutive numbers, all of one size, shorten their
chains to the place where each leaves the chunk; pointer doubling over those exits finds where chains enter each chunk, in
about log2(chunks of the longest id) rounds; and each chunk marks its rows from its entries on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import global_index, range_sorted
from ledgerloom.session import durable

TTL_US = 48 * 3600 * 1_000_000
CHUNK = 1 << 16
_ROW_BITS = 33  # monotonically_increasing_id keeps the in-partition row number in its low 33 bits


def successors(placed: DataFrame) -> DataFrame:
    """(pos, row_id, nxt) of rows (id, us, due, pos, row_id): nxt is the id's first row whose time is ``due`` or later, or
    null (also for a null ``due``). ``pos`` numbers the rows by (id, us)."""
    rows = placed.select("id", F.col("us").alias("at"), F.lit(1).alias("kind"), "pos", "row_id")
    expiries = placed.select("id", F.coalesce("due", F.lit((1 << 63) - 1)).alias("at"), F.lit(0).alias("kind"), "pos", "row_id")
    line = range_sorted(rows.unionByName(expiries), "id", "at", "kind", "pos").withColumn("_at", F.monotonically_increasing_id())
    line = durable(line, "ttl-line").withColumn("piece", F.shiftright("_at", _ROW_BITS))
    row = F.when(F.col("kind") == 1, F.struct("id", "pos"))
    later = Window.partitionBy("piece").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    # one row per task of the range exchange
    firsts = line.groupBy("piece").agg(F.min_by(row, F.when(F.col("kind") == 1, F.col("_at"))).alias("first"))
    beyond = Window.orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    carried = durable(firsts.select("piece", F.last("first", ignorenulls=True).over(beyond).alias("carried")), "ttl-carried")
    found = (
        line.withColumn("inside", F.last(row, ignorenulls=True).over(later))
        .where("kind = 0")
        .join(F.broadcast(carried), "piece")
        .withColumn("next", F.coalesce("inside", "carried"))
    )
    return found.select("pos", "row_id", F.when(F.col("next.id").eqNullSafe(F.col("id")), F.col("next.pos")).alias("nxt"))


def _inside(chunk: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """A chunk by position, and the index of each row's successor, or the row's own where that is outside or none."""
    chunk = chunk.sort_values("pos", ignore_index=True)
    pos, nxt = chunk["pos"].to_numpy(), chunk["nxt"].to_numpy()
    at = np.minimum(np.searchsorted(pos, nxt), len(pos) - 1)
    return chunk, np.where(pos[at] == nxt, at, np.arange(len(pos)))


def _exits(key: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each row of a chunk leaves it; rows whose chain ends inside are left out."""
    chunk, at = _inside(chunk)
    while not np.array_equal(at, at[at]):  # the steps double
        at = at[at]
    exits = chunk["nxt"].to_numpy()[at]
    return pd.DataFrame({"pos": chunk["pos"], "exit": exits})[exits >= 0]


def _marks(key: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
    """Acceptance of a chunk's rows: its entries and what follows them inside."""
    chunk, at = _inside(chunk)
    marked = chunk["entry"].to_numpy(dtype=bool).copy()
    while True:
        # marks are complete up to a number of steps that doubles
        marked[at[marked]] = True
        if np.array_equal(at, at[at]):
            break
        at = at[at]
    return pd.DataFrame({"row_id": chunk["row_id"], "accepted": marked})


def on_chains(placed: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """(row_id, accepted) of rows (id, us, due, pos, row_id): accepted are an id's first row and the successors from it on."""
    chunk = F.floor(F.col("pos") / chunk_rows)
    chain = durable(successors(placed).withColumns({"chunk": chunk, "nxt": F.coalesce("nxt", F.lit(-1))}), "ttl-chain")
    heads = placed.groupBy("id").agg(F.min("pos").alias("pos")).select("pos")
    # with one chunk no chain leaves it; the same steps then run over empty tables
    jumps = durable(chain.groupBy("chunk").applyInPandas(_exits, "pos bigint, exit bigint"), "ttl-exits")
    entries = durable(heads, "ttl-entries")
    while True:
        reached = durable(entries.join(jumps, "pos").select(F.col("exit").alias("pos")).distinct(), "ttl-reached")
        if reached.isEmpty():
            break
        entries = durable(entries.unionByName(reached).distinct(), "ttl-entries")
        twice = jumps.join(jumps.select(F.col("pos").alias("exit"), F.col("exit").alias("beyond")), "exit")
        jumps = durable(twice.select("pos", F.col("beyond").alias("exit")), "ttl-exits")
    started = chain.join(entries.withColumn("entry", F.lit(True)), "pos", "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return started.groupBy("chunk").applyInPandas(_marks, placed.select("row_id").schema.add("accepted", "boolean"))


def ttl_dedupe(rows: DataFrame, ttl_us: int = TTL_US, chunk_rows: int = CHUNK) -> DataFrame:
    """Acceptance flag per row of (id, us, row_id), row_id being unique. Rows without a time are not accepted; a null id is an
    id like any other. Running it writes its steps as tables, so it acts when it is called."""
    rows = rows.select(F.col("id").cast("string").alias("id"), "us", "row_id")
    timed = rows.where(F.col("us").isNotNull()).withColumn("due", F.col("us") + ttl_us)
    placed = durable(global_index(timed, ["id", "us", "row_id"], "pos"), "ttl-placed")
    untimed = rows.where(F.col("us").isNull()).select("row_id", F.lit(False).alias("accepted"))
    return on_chains(placed, chunk_rows).unionByName(untimed)
