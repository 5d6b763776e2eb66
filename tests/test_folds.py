"""Order-dependent operators against plain loops, including keys that hold most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.dedupe import ttl_dedupe
from ledgerloom.operators.edits import apply_watch_edits
from ledgerloom.operators.offsets import LIMIT_MICRO, clamped_offsets
from ledgerloom.operators.ordering import global_rank, latest_before, rank_within, running_sum
from ledgerloom.operators.sessions import last_marked_before, sessions


@pytest.fixture(autouse=True)
def many_pieces(spark):
    """Keep small test data in several pieces, as large data would be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def greedy(rows, ttl):
    free, out = {}, {}
    for i, us, row in sorted(rows, key=lambda r: (r[1], r[2])):
        out[row] = i not in free or us >= free[i]
        if out[row]:
            free[i] = us + ttl
    return out


def claims(spark, rows):
    return spark.createDataFrame(rows, "id string, us long, row_id long")


def accepted(df, *args):
    return {r["row_id"]: r["accepted"] for r in ttl_dedupe(df, *args).collect()}


@pytest.mark.parametrize("chunk", [2, 1 << 16])
def test_ttl_expiry_is_not_refreshed(spark, chunk):
    rows = [("a", 0, 1), ("a", 6, 2), ("a", 12, 3), ("b", 0, 4), ("b", 0, 5), ("b", 11, 6), (None, 0, 7), (None, 3, 8), ("a", None, 9)]
    want = {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False, 9: False}
    assert accepted(claims(spark, rows), 10, chunk) == want


@pytest.mark.parametrize("chunk", [3, 40, 1 << 16])
def test_ttl_matches_loop_with_a_hot_id(spark, chunk):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.4 else f"id{rng.randrange(12)}", rng.randrange(600), n) for n in range(500)]
    assert accepted(claims(spark, rows), 100, chunk) == greedy(rows, 100)


def test_ttl_of_one_id_with_every_row_accepted(spark):
    rows = spark.range(200_000).select(F.lit("one").alias("id"), (F.col("id") * 10).alias("us"), F.col("id").alias("row_id"))
    assert ttl_dedupe(rows, 10, 1 << 14).where("accepted").count() == 200_000
    assert ttl_dedupe(rows.limit(0)).count() == 0


def edit_loop(log):
    lists = {}
    for user, _, adds, sym in sorted(log, key=lambda r: (r[0], r[1])):
        w = lists.setdefault(user, [])
        if adds:
            if sym not in w:
                w.append(sym)
        elif len(w) > 1 and sym in w:
            w.remove(sym)
    return {u: w for u, w in lists.items() if w}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("symbols", [1, 2, 3, 8])
def test_watch_edits_match_loop_across_pieces(spark, seed, symbols):
    """One user owns most of the log, so it spans several tasks; few symbols make refusals common."""
    rng = random.Random(seed * 10 + symbols)
    lean = rng.choice([0.3, 0.5, 0.6])
    log = [(0 if rng.random() < 0.85 else rng.randrange(1, 5), n, rng.random() < lean, f"S{rng.randrange(symbols)}") for n in range(400)]
    df = spark.createDataFrame(log, "user_id long, ord long, adds boolean, sym string")
    got = {}
    for r in apply_watch_edits(df).orderBy("user_id", "ord").collect():
        assert r["selected"] == (r["ord"] == 0)
        got.setdefault(r["user_id"], []).append(r["sym"])
    assert got == edit_loop(log)


def test_selection_follows_removals():
    """The head of the list is what the selection rule gives: first entry, then the first remaining one."""
    rng = random.Random(11)
    for _ in range(200):
        w, selected = [], None
        for _ in range(40):
            sym = f"S{rng.randrange(4)}"
            if rng.random() < 0.5:
                w = w if sym in w else [*w, sym]
                selected = selected or sym
            else:
                remaining = [s for s in w if s != sym]
                if selected == sym:
                    selected = remaining[0] if remaining else selected
                w = w if len(w) <= 1 else remaining
            assert not w or selected == w[0]


def test_one_user_with_very_many_symbols(spark):
    log = spark.range(100_000).select(
        F.lit(1).alias("user_id"), F.col("id").alias("ord"), (F.col("id") % 5 != 4).alias("adds"),
        F.concat(F.lit("S"), F.when(F.col("id") % 5 == 4, F.col("id") - 2).otherwise(F.col("id")).cast("string")).alias("sym"),
    )
    lists = apply_watch_edits(log)
    assert lists.count() == 60_000


@pytest.mark.parametrize("seed,size", [(0, 5), (1, 4096)])
def test_clamped_offsets_match_loop(spark, seed, size):
    rng = random.Random(seed)
    steps = [("hot" if rng.random() < 0.7 else f"s{rng.randrange(5)}", n, rng.randrange(-40000, 40001)) for n in range(600)]
    want = {}
    for sym, _, step in steps:
        x, _, n = want.get(sym, (0, "down", 0))
        y = max(-LIMIT_MICRO, min(LIMIT_MICRO, x + step))
        want[sym] = (y, "up" if y > x else "down", n + 1)
    df = spark.createDataFrame(steps, "sym string, ord long, step long").repartition(5)
    got = {r["sym"]: (r["offset_micro"], r["dir"], r["ticks"]) for r in clamped_offsets(df, size).collect()}
    assert got == want


def test_global_rank_is_the_sorted_position(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), n) for n in range(1000)]
    df = spark.createDataFrame(rows, "v long, ord long").repartition(7)
    got = {r["ord"]: r["rank"] for r in global_rank(df, [F.desc("v"), F.asc("ord")]).collect()}
    want = {r[1]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert got == want


def test_rank_within_a_hot_key(spark):
    rows = [("hot" if n % 3 else f"k{n % 7}", n) for n in range(900)]
    df = spark.createDataFrame(rows, "k string, ord long").repartition(5)
    got = {r["ord"]: r["rank"] for r in rank_within(df, ["k"], ["ord"]).collect()}
    seen, want = {}, {}
    for k, n in rows:
        seen[k] = seen.get(k, 0) + 1
        want[n] = seen[k]
    assert got == want


def test_hot_key_rows_are_spread_over_tasks(spark):
    """A key with two thirds of all rows must not end up in one task of the ranking exchange."""
    from ledgerloom.operators.ordering import range_sorted

    rows = spark.range(6000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("o"))
    sizes = range_sorted(rows, "k", "o").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 6000 / 8 * 2


def events(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    return df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))


def test_sessions_match_gap_loop(spark):
    rng = random.Random(5)
    rows = sorted((n, rng.randrange(200_000), 1 if rng.random() < 0.6 else rng.randrange(2, 9), "view", 1.0) for n in range(700))
    want, last = {}, {}
    for _, s, u, _, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if u not in last or s - last[u] > 1800:
            want[(u, s)] = 0
            start = s
        last[u] = s
        want[(u, start)] += 1
    got = {(r["user_id"], r["start_us"] // 1_000_000): r["events"] for r in sessions(events(spark, rows)).collect()}
    assert got == want


def test_gap_of_exactly_thirty_minutes_stays_together(spark):
    rows = [(1, 100, 1, "view", 1.0), (2, 1900, 1, "click", 1.0), (3, 3701, 1, "view", 1.0)]
    assert sorted(r["events"] for r in sessions(events(spark, rows)).collect()) == [1, 2]


def test_last_marked_matches_loop(spark):
    rng = random.Random(9)
    rows = [(n, rng.randrange(50_000) * 1_000_000, rng.randrange(3), rng.random() < 0.2) for n in range(500)]
    df = spark.createDataFrame(rows, "n long, us long, k long, m boolean")
    got = {r["n"]: r["last_marked_us"] for r in last_marked_before(df, "k", "us", "n", F.col("m"), 7).collect()}
    for n, us, k, _ in rows:
        earlier = [u for i, u, kk, m in rows if kk == k and m and (u, i) <= (us, n)]
        assert got[n] == (max(earlier) if earlier else None)


def test_watch_edits_of_many_users(spark):
    """Thousands of random logs at once, from ones that only add to ones that mostly remove."""
    rng = random.Random(1)
    log = []
    for user in range(2500):
        symbols, lean = rng.randrange(1, 6), rng.choice([0.25, 0.5, 0.7])
        log += [(user, i, rng.random() < lean, f"S{rng.randrange(symbols)}") for i in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(log, "user_id long, ord long, adds boolean, sym string")
    got = {}
    for r in sorted(apply_watch_edits(df).collect(), key=lambda r: (r["user_id"], r["ord"])):
        got.setdefault(r["user_id"], []).append(r["sym"])
    assert got == edit_loop(log)


def test_lookups_over_small_pieces(spark):
    rng = random.Random(2)
    rows = [(n, "hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", rng.randrange(9) if rng.random() < 0.4 else None, rng.randrange(-3, 4)) for n in range(400)]
    df = spark.createDataFrame(rows, "n long, k string, v long, x long")
    before = {r["n"]: r["prev"] for r in latest_before(df, ["k"], ["n"], F.col("v"), "prev", 7).collect()}
    sums = {r["n"]: r["s"] for r in running_sum(df, ["k"], ["n"], "x", "s", 7).collect()}
    last, total = {}, {}
    for n, k, v, x in rows:
        total[k] = total.get(k, 0) + x
        assert (before[n], sums[n]) == (last.get(k), total[k])
        last[k] = last.get(k) if v is None else v
