"""Tables stored by key, what is landed into them, and streamed watchlists."""

import itertools
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import screener
from ledgerloom.sources import pages, stored
from ledgerloom.streaming import flows
from ledgerloom.streaming.state import CHUNK, watch_stream

SF = "/root/testdata/sf0.001"
COLUMNS = "k string, a long, b string"


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def files(folder, version=None):
    at = "*" if version is None else version
    return {str(p.relative_to(folder)) for p in Path(folder).glob(f"data/version={at}/*/*.parquet")}


def make(spark, folder, rows, buckets=8):
    stored.create(spark, folder, spark.createDataFrame(rows, COLUMNS), ["k"], buckets)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = [(f"k{i}", i, "x") for i in range(40)] + [(None, -1, "null key")]
    make(spark, folder, rows)
    change = spark.createDataFrame([("k3", 300, "y"), ("k4", 4, "x"), (None, -2, "z")], COLUMNS)  # k4 is as it was
    assert stored.merge(spark, folder, change, ["k"]) == 2
    want = {r for r in rows if r[0] not in ("k3", None)} | {("k3", 300, "y"), (None, -2, "z")}
    assert rows_of(stored.read(spark, folder)) == want
    buckets = {p.split("/")[2] for p in files(folder, 1)}
    assert 1 <= len(buckets) <= 2 and len({p.split("/")[2] for p in files(folder, 0)}) == 8
    before = files(folder)
    assert stored.merge(spark, folder, change, ["k"]) == 0  # a rerun changes nothing
    assert files(folder) == before and stored.versions(spark, folder) == [0, 1]
    assert stored.purge(spark, folder) == len(buckets) and rows_of(stored.read(spark, folder)) == want


def test_merge_by_order_insert_and_fill(spark, tmp_path):
    folder = str(tmp_path / "t")
    make(spark, folder, [("p", 5, "old"), ("q", 5, None)])
    late = spark.createDataFrame([("p", 4, "late"), ("q", 7, "b"), ("q", 6, "c"), ("q", 7, "a"), ("r", None, "new")], COLUMNS)
    assert stored.merge(spark, folder, late, ["k"], order="a") == 2
    assert rows_of(stored.read(spark, folder)) == {("p", 5, "old"), ("q", 7, "b"), ("r", None, "new")}
    part = spark.createDataFrame([("p", None, 1), ("zz", "n", 1)], "k string, b string, other long")
    assert stored.merge(spark, folder, part, ["k"], insert=False, fill=True) == 0
    assert stored.merge(spark, folder, part, ["k"], insert=False) == 1  # the null overwrites, ``a`` stays
    assert rows_of(stored.read(spark, folder)) == {("p", 5, None), ("q", 7, "b"), ("r", None, "new")}


def test_a_change_that_was_not_finished_does_not_count(spark, tmp_path):
    folder = str(tmp_path / "t")
    make(spark, folder, [("p", 1, "x")])
    stored.merge(spark, folder, spark.createDataFrame([("p", 2, "x"), ("q", 2, "x")], COLUMNS), ["k"])
    (tmp_path / "t/versions/1/_SUCCESS").unlink()
    assert rows_of(stored.read(spark, folder)) == {("p", 1, "x")}
    assert stored.merge(spark, folder, spark.createDataFrame([("q", 3, "y")], COLUMNS), ["k"]) == 1
    assert rows_of(stored.read(spark, folder)) == {("p", 1, "x"), ("q", 3, "y")}


def test_empty_tables(spark, tmp_path):
    folder, none = str(tmp_path / "t"), spark.createDataFrame([], COLUMNS)
    make(spark, folder, [])
    assert stored.read(spark, folder).count() == 0 and stored.merge(spark, folder, none, ["k"]) == 0
    assert stored.merge(spark, folder, spark.createDataFrame([("a", 1, None)] * 3, COLUMNS), ["k"]) == 1
    assert rows_of(stored.read(spark, folder)) == {("a", 1, None)}
    with pytest.raises(ValueError):
        make(spark, folder, [])


def test_stored_quantities_are_set_once(spark, tmp_path):
    folder = str(tmp_path / "stock")
    stored.create(spark, folder, spark.createDataFrame([(1, 10), (2, 20)], "item long, current long"), ["item"])
    asked = spark.createDataFrame([(7, 1, 1, 10, 11), (8, 1, 1, 10, 12), (9, 1, 2, 19, 5)], "key long, line long, item long, expected long, quantity long")
    status = lambda: {r["key"]: r["status"] for r in stored.set_quantities(spark, folder, asked).collect()}
    assert status() == {7: "applied", 8: "superseded", 9: "mismatch"}
    assert rows_of(stored.read(spark, folder)) == {(1, 11), (2, 20)}
    assert set(status().values()) == {"mismatch"} and rows_of(stored.read(spark, folder)) == {(1, 11), (2, 20)}


def test_landings_in_any_order_equal_the_whole_folder(spark, tmp_path):
    docs = [r["doc"] for r in pages.product_page_docs(spark, SF).orderBy("page").collect()]
    newer = docs[1].replace('"title":"', '"title":"NEW ')
    landings = [[docs[0], docs[1]], [newer], docs[2:]]
    for n, order in enumerate(itertools.permutations(range(3))):
        source, folder = tmp_path / f"in{n}", str(tmp_path / f"out{n}")
        source.mkdir()
        for step, i in enumerate(order):
            path = source / f"part-{i}.json"
            path.write_text("\n".join(landings[i]) + "\n")
            stamp = 1_700_000_000 + i  # the second copy of a page is the newer one, whenever it is read
            os.utime(path, (stamp, stamp))
            stream = pages.page_stream(spark, str(source), pages.PRODUCT_PAGE_SCHEMA)
            flows.land_pages(stream, folder, "products", pages.product_rows, "id")
            seen = pages.read_pages(spark, str(source), pages.PRODUCT_PAGE_SCHEMA)
            assert rows_of(flows.landed_gaps(spark, folder)) == rows_of(pages.page_gaps(seen, "products")), (order, step)
        want = rows_of(pages.read_product_pages(spark, str(source)))
        assert rows_of(stored.read(spark, f"{folder}/rows").drop("landed")) == want and any(r[2].startswith("NEW ") for r in want)
        if n == 2:  # half of the orders tell
            break


def test_streamed_watchlists_equal_a_loop(spark, tmp_path):
    rng = random.Random(3)
    log = [(1 if rng.random() < 0.6 else rng.randrange(2, 6), n, rng.random() < 0.5, f"S{rng.randrange(4 if n < 300 else 60)}") for n in range(600)]
    lists = {}
    for user, _, adds, sym in log:
        held = lists.setdefault(user, [])
        if adds and sym not in held:
            held.append(sym)
        elif not adds and sym in held and len(held) > 1:
            held.remove(sym)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(4):
        spark.createDataFrame(log[part * 150 : part * 150 + 150], "user_id long, ord long, adds boolean, sym string").coalesce(1).write.mode("append").parquet(source)
        flows.run_to_stored(watch_stream(flows.table_stream(spark, source)), folder, ["user_id", "sym"], "ord")
    got = {}
    for r in stored.read(spark, f"{folder}/table").where("place IS NOT NULL").orderBy("user_id", "place").collect():
        got.setdefault(r["user_id"], []).append(r["sym"])
    assert got == {u: s for u, s in lists.items() if s}


def test_streamed_watchlists_longer_than_a_chunk(spark, tmp_path):
    rng = random.Random(4)
    log = [(None if n % 50 == 0 else 2**60 + 1 if n % 9 else 7, n, rng.random() < 0.8, f"S{rng.randrange(3000)}") for n in range(6000)]
    lists = {}
    for user, _, adds, sym in log:
        held = lists.setdefault(user, [])
        if adds and sym not in held:
            held.append(sym)
        elif not adds and sym in held and len(held) > 1:
            held.remove(sym)
    assert max(map(len, lists.values())) > 2 * CHUNK
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        spark.createDataFrame(log[part * 2000 : part * 2000 + 2000], "user_id long, ord long, adds boolean, sym string").coalesce(1).write.mode("append").parquet(source)
        flows.run_to_stored(watch_stream(flows.table_stream(spark, source)), folder, ["user_id", "sym"], "ord")
    got = {}
    for r in stored.read(spark, f"{folder}/table").where("place IS NOT NULL").orderBy("user_id", "place").collect():
        got.setdefault(r["user_id"], []).append(r["sym"])
    assert got == lists


def test_state_of_short_watchlists_is_one_entry_a_user(spark, tmp_path):
    edits = spark.range(8000).selectExpr("id % 1000 AS user_id", "id AS ord", "true AS adds", "concat('S', id) AS sym")
    edits.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch_stream(flows.table_stream(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress) < 3000


def test_alphabetical_order(spark):
    names = ["b", "A", "a", "é", "f", "B", "a b", "ab", "a-b", "Z", "éa", "e", None]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord long")
    got = [r["name"] for r in screener.ranked(df, "names").orderBy("rank").collect()]
    assert got == [None, "a", "A", "a b", "a-b", "ab", "b", "B", "e", "é", "éa", "f", "Z"]
