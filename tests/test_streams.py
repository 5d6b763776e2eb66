"""Streams against their batch versions."""

import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import signing
from ledgerloom.operators import deliveries as dlv
from ledgerloom.operators import offsets, sessions
from ledgerloom.operators.dedupe import TTL_US, ttl_dedupe
from ledgerloom.sources import commerce, feeds, market, pages
from ledgerloom.streaming import flows, state

SF = "/root/testdata/sf0.001"


def split_files(df, folder, parts=3, by="row_id"):
    """Land a relation as several files in order, so the stream sees several batches."""
    top = df.agg(F.max(by)).first()[0] + 1
    for n in range(parts):
        piece = df.where((F.col(by) >= top * n // parts) & (F.col(by) < top * (n + 1) // parts))
        piece.coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream_of(spark, df, folder):
    split_files(df, folder, by=df.columns[1] if "ord" in df.columns else "row_id")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("secret", ["k", "s" * 64, "long" * 40])
def test_hmac_matches_the_standard_library(spark, secret):
    bodies = [b"", b"{}", bytes(range(256)) * 3]
    df = spark.createDataFrame([(bytearray(b),) for b in bodies], "b binary")
    got = {bytes(r[0]): r[1] for r in df.select("b", signing.hmac_sha256(F.col("b"), secret)).collect()}
    for b in bodies:
        assert got[b] == base64.b64encode(hmac.new(secret.encode(), b, hashlib.sha256).digest()).decode()


def test_signature_edges(spark, one):
    body = F.lit(bytearray(b"x"))
    good = one(signing.hmac_sha256(body, "k"))
    ok = lambda b, h, s: one(signing.signature_ok(F.lit(bytearray(b)), F.lit(h).cast("string"), s))
    assert ok(b"x", good, "k") and not ok(b"y", good, "k") and not ok(b"x", good, "other") and not ok(b"x", None, "k") and not ok(b"x", "short", "k")
    with pytest.raises(ValueError):
        signing.hmac_sha256(body, "")


def test_header_lookup(one):
    h = F.create_map(F.lit("X-shopify-EVENT-id"), F.array(F.lit(""), F.lit("b")), F.lit(signing.DELIVERY_ID_HEADER), F.array(F.lit("w")))
    assert one(signing.header(h, signing.EVENT_ID_HEADER)) == ""
    assert one(signing.event_id(h)) is None  # empty does not fall back
    only = F.create_map(F.lit(signing.DELIVERY_ID_HEADER), F.array(F.lit("w")))
    assert one(signing.event_id(only)) == "w" and one(signing.header(only, "absent")) is None


def test_delivery_outcomes(spark):
    sign = lambda b: base64.b64encode(hmac.new(b"k", b, hashlib.sha256).digest()).decode()
    row = lambda n, sig: (n, n, bytearray(b"{}"), {signing.SIGNATURE_HEADER.lower(): [sig], signing.EVENT_ID_HEADER: ["e"]})
    df = spark.createDataFrame([row(1, "bad"), row(2, sign(b"{}")), row(3, sign(b"{}"))], "row_id long, us long, raw_body binary, headers map<string,array<string>>")
    got = {r["row_id"]: (r["status"], r["process"], r["reason"]) for r in dlv.handle(df, "k").collect()}
    assert got == {1: (401, False, "invalid_hmac"), 2: (200, True, "process"), 3: (200, False, "duplicate")}


def test_claim_stream_equals_batch(spark, tmp_path):
    rows = feeds.deliveries(spark, SF).select((F.col("row_id") % 50).cast("string").alias("id"), "us", "row_id")
    batch = {tuple(r) for r in ttl_dedupe(rows, TTL_US).select("row_id", "accepted").collect()}
    flows.run_to_table(state.claim_stream(stream_of(spark, rows, str(tmp_path / "in"))), str(tmp_path / "out"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out/rows")).select("row_id", "accepted").collect()}
    assert got == batch and 0 < sum(a for _, a in got) < len(got)


def test_offset_stream_equals_batch_and_feeds_quotes(spark, tmp_path):
    steps = feeds.offset_steps(spark, SF)
    batch = {(r["sym"], r["offset_micro"], r["dir"]) for r in offsets.clamped_offsets(steps).collect()}
    stream = state.offset_stream(stream_of(spark, steps, str(tmp_path / "in")))
    flows.run_to_table(stream, str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out/rows"))
    last = out.groupBy("sym").agg(F.max_by(F.struct("offset_micro", "dir"), "ord").alias("v")).select("sym", "v.*")
    assert {tuple(r) for r in last.collect()} == batch
    live = state.offset_stream(spark.readStream.schema(steps.schema).parquet(str(tmp_path / "in")))
    flows.run_to_table(flows.live_quotes(live, market.quote_inputs(spark, SF)), str(tmp_path / "q"))
    quotes = spark.read.parquet(str(tmp_path / "q/rows"))
    assert quotes.where("price IS NULL").isEmpty() and not quotes.isEmpty()


def test_delivery_stream_equals_batch(spark, tmp_path):
    rows = feeds.deliveries(spark, SF)
    want = {(r["row_id"], r["status"], r["process"], r["reason"]) for r in dlv.handle(rows, feeds.TEST_SECRET).collect()}
    at_once, decided = flows.delivery_stream(stream_of(spark, rows, str(tmp_path / "in")), feeds.TEST_SECRET)
    got = set()
    for name, branch in (("now", at_once), ("claimed", decided)):
        flows.run_to_table(branch, str(tmp_path / name))
        got |= {(r["row_id"], r["status"], r["process"], r["reason"]) for r in spark.read.parquet(str(tmp_path / name / "rows")).collect()}
    assert got == want


def land(spark, folder, rows):
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    df.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(folder)


def test_daily_stream_drops_rows_past_the_lag(spark, tmp_path):
    day, folder = 86_400, str(tmp_path / "in")
    land(spark, folder, [(1, 0, 1, "view", 1.0), (2, 40 * day, 1, "purchase", 2.0)])
    run = lambda: flows.run_to_table(flows.daily_metrics(flows.event_stream(spark, folder)), str(tmp_path / "out"), "update")
    run()
    land(spark, folder, [(3, 10, 1, "view", 1.0), (4, 30 * day, 1, "purchase", 3.5)])
    run()
    days = flows.latest_per_key(spark, str(tmp_path / "out"), ["day"], ["events", "cents"])
    assert {tuple(r) for r in days.collect()} == {("1970-01-01", 1, 0), ("1970-02-10", 1, 200), ("1970-01-31", 1, 350)}
    assert flows.dropped_rows(spark, str(tmp_path / "out")) == 1


def daily(spark, source, out):
    flows.run_to_table(flows.daily_metrics(flows.event_stream(spark, source)), out, "update")
    days = flows.latest_per_key(spark, out, ["day"], ["events", "sessions", "orders", "cents"])
    return {tuple(r) for r in days.collect()}


def test_daily_stream_of_files_out_of_time_order(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder = str(tmp_path / "events.parquet")
    for n in range(4):
        events.where(F.col("user_id") % 4 == n).coalesce(1).write.mode("append").parquet(folder)
    want = daily(spark, f"{SF}/events.parquet", str(tmp_path / "one"))
    got = daily(spark, folder, str(tmp_path / "four"))
    assert got == want and sum(r[1] for r in got) == events.count()
    assert flows.dropped_rows(spark, str(tmp_path / "four")) == 0


def test_claim_state_falls_back_to_the_live_window(spark, tmp_path):
    """Ids that come once each are dropped when the watermark is past their expiry, and the flags stay those of the batch."""
    hour, folder = 3_600_000_000, str(tmp_path / "in")
    rows = spark.range(600).select((F.col("id") % 300).cast("string").alias("id"), ((F.col("id") + 9000) * hour).alias("us"), F.col("id").alias("row_id"))
    split_files(rows, folder, parts=6)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def keep(batch, n):
        batch.write.mode("append").parquet(str(tmp_path / "out"))

    query = state.claim_stream(stream, 20 * hour).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("row_id", "accepted").collect()}
    assert got == {tuple(r) for r in ttl_dedupe(rows, 20 * hour).collect()}
    assert sizes[-1] < 300 and max(sizes) < 1200, sizes


def test_claims_of_many_ids_share_state(spark, tmp_path):
    """The state's entries do not grow with the number of ids."""
    hour, n = 3_600_000_000, 3 * state.BUCKETS
    rows = spark.range(2 * n).select((F.col("id") % n).cast("string").alias("id"), (F.col("id") * 1000 + 9000 * hour).alias("us"), F.col("id").alias("row_id"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.claim_stream(flows.table_stream(spark, str(tmp_path / "in")), 20 * hour)
    query = stream.writeStream.foreachBatch(lambda b, i: b.write.parquet(f"{tmp_path}/out/batch={i}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress) <= 3 * state.BUCKETS
    accepted = spark.read.parquet(str(tmp_path / "out")).where("accepted").agg(F.count(F.lit(1)), F.max("row_id")).first()
    assert tuple(accepted) == (n, n - 1)


def test_rows_of_one_file_are_spread(spark, tmp_path):
    spark.range(800).coalesce(1).write.parquet(str(tmp_path / "in"))
    spread = flows.spread(flows.table_stream(spark, str(tmp_path / "in"))).select("id", F.spark_partition_id().alias("p"))
    flows.run_to_table(spread, str(tmp_path / "out"))
    shares = spark.read.parquet(str(tmp_path / "out/rows")).groupBy("p").count().collect()
    assert len(shares) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in shares) < 200


def test_session_stream_matches_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1, 0, 1, "view", 1.0), (2, 1000, 1, "view", 1.0), (3, 2800, 1, "view", 1.0), (4, 9000, 1, "view", 1.0), (5, 100, 2, "view", 1.0)]
    land(spark, folder, rows)
    land(spark, folder, [(6, 900_000, 9, "view", 1.0)])  # moves the watermark past every session
    flows.run_to_table(flows.session_stream(flows.event_stream(spark, folder)), str(tmp_path / "out"))
    got = {(r["user_id"], r["events"]) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()}
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s"))
    assert got == {(r["user_id"], r["events"]) for r in sessions.sessions(df).collect()} == {(1, 3), (1, 1), (2, 1)}


def test_delivery_counts_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "a", "process"), (2, 20, "a", "process"), (3, 4000, "a", "duplicate"), (4, 90_000, "b", "process")], "row_id long, s long, topic string, reason string")
    rows = rows.withColumn("ts", F.timestamp_seconds("s"))
    flows.run_to_table(flows.delivery_counts(stream_of(spark, rows, str(tmp_path / "in"))), str(tmp_path / "out"))
    got = {(r["topic"], r["reason"], r["deliveries"]) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()}
    assert got == {("a", "process", 2), ("a", "duplicate", 1)}


def test_landed_page_files(spark, tmp_path):
    docs = pages.order_page_docs(spark, SF)
    docs.select("doc").write.text(str(tmp_path / "pages"))
    every = pages.read_order_pages(spark, str(tmp_path / "pages"))
    assert every.count() == commerce.orders_fact(spark, SF).count() < 100 * docs.count()
    some = pages.read_order_pages(spark, str(tmp_path / "pages"), since="1998-01-01 00:00:00")
    assert 0 < some.count() < every.count() and some.where("created_at < '1998-01-01'").isEmpty()
    pages.product_page_docs(spark, SF).select("doc").write.text(str(tmp_path / "products"))
    assert pages.read_product_pages(spark, str(tmp_path / "products")).count() == spark.read.parquet(f"{SF}/part.parquet").count()
    whole = pages.parse_pages(docs, pages.ORDER_PAGE_SCHEMA)
    assert pages.page_gaps(whole, "orders").isEmpty()
    torn = pages.parse_pages(docs.where("page <> 4"), pages.ORDER_PAGE_SCHEMA)
    assert [r[0] for r in pages.page_gaps(torn, "orders").collect()] == ["cursor-3"]


def test_refunds_at_13_and_at_15_days(spark, tmp_path):
    day = 86_400
    orders = spark.createDataFrame([(1, 0), (2, 0), (3, day), (4, 90 * day)], "order_id long, s long").select("order_id", F.timestamp_seconds(F.col("s") + 1000 * day).alias("ordered_at"))
    refunds = spark.createDataFrame([(1, 13 * day, 5), (1, 14 * day, 7), (2, 15 * day, 11), (3, 0, 13), (9, day, 17), (4, 91 * day, 19)], "order_id long, s long, cents long")
    refunds = refunds.select("order_id", F.timestamp_seconds(F.col("s") + 1000 * day).alias("refunded_at"), "cents")
    orders.write.parquet(str(tmp_path / "o"))
    refunds.write.parquet(str(tmp_path / "r"))
    sides = lambda: (flows.table_stream(spark, str(tmp_path / "o")), flows.table_stream(spark, str(tmp_path / "r")))
    flows.run_to_table(flows.timely_refunds(*sides()), str(tmp_path / "joined"))
    assert {(r.order_id, r.cents) for r in spark.read.parquet(str(tmp_path / "joined/rows")).collect()} == {(1, 5), (1, 7), (4, 19)}
    flows.run_to_table(flows.settled_refunds(*sides()), str(tmp_path / "days"))
    # the day of order 4 is still open
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "days/rows")).select("day", "refunds", "cents").collect()] == [("1972-09-27", 2, 12)]


def test_latest_rows_follow_the_list_and_survive_a_replay(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    land_ = lambda rows: spark.createDataFrame(rows, "sym string, ord long, price double").coalesce(1).write.mode("append").parquet(source)
    listed = ["A"]
    wanted = lambda: spark.createDataFrame([(s,) for s in listed], "sym string")
    run = lambda: flows.run_to_latest(flows.table_stream(spark, source), folder, ["sym"], "ord", wanted)
    latest = lambda: {tuple(r) for r in flows.latest_version(spark, folder).select("sym", "ord", "price").collect()}
    land_([("A", 1, 1.0), ("A", 3, 3.0), ("B", 2, 2.0)])
    run()
    assert latest() == {("A", 3, 3.0)}
    listed.append("B")
    land_([("B", 4, 4.0), ("A", 2, 9.0)])
    run()
    assert latest() == {("A", 3, 3.0), ("B", 4, 4.0)}
    (tmp_path / "out/rows/batch=1/_SUCCESS").unlink()  # a version that was not written to its end does not count
    assert latest() == {("A", 3, 3.0)}


def test_a_path_with_signs_of_patterns(spark, tmp_path):
    for name in ("a*b", "a[b]c", "axb", "d/e"):
        land(spark, str(tmp_path / name), [(1, 5, 1, "view", 1.0)] if name == "axb" else [(1, 5, 1, "view", 1.0), (2, 6, 1, "view", 1.0)])
    for i, name in enumerate(("a*b", "a[b]c", "d/e")):
        flows.run_to_table(flows.event_stream(spark, f"{tmp_path}/{name}/").select("event_id"), str(tmp_path / f"out{i}"))
        assert spark.read.parquet(str(tmp_path / f"out{i}/rows")).count() == 2


def test_counted_deliveries_equal_batch(spark, tmp_path):
    rows = feeds.deliveries(spark, SF)
    done = dlv.handle(rows, feeds.TEST_SECRET).collect()
    newest = max(r["us"] for r in done)
    want = {}
    for r in done:
        hour = r["us"] // 3_600_000_000
        if (hour + 1) * 3_600_000_000 <= newest - 3_600_000_000:
            want[hour, r["topic"], r["reason"]] = want.get((hour, r["topic"], r["reason"]), 0) + 1
    streamed = stream_of(spark, rows, str(tmp_path / "in"))  # several batches
    flows.run_to_table(flows.delivery_stats(streamed, feeds.TEST_SECRET), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out/rows")).select(F.unix_micros("hour").alias("us"), "topic", "reason", "deliveries").collect()
    assert len(got) == len(want) and {(r.us // 3_600_000_000, r.topic, r.reason): r.deliveries for r in got} == want


def test_log_sink_has_each_line_once_after_a_failure(spark, tmp_path):
    rows = spark.range(90).selectExpr("id AS row_id", "concat('ask u', id, '@x.com') AS note", "id AS session")
    landed = split_files(rows, f"{tmp_path}/in")
    entries = flows.table_stream(spark, landed, files=1)
    broken = entries.withColumn("note", F.when(F.col("row_id") == 70, F.raise_error(F.lit("lost"))).otherwise(F.col("note")))
    with pytest.raises(Exception, match="lost"):
        flows.append_log(broken, f"{tmp_path}/log")
    schema = "row_id long, note string, session string"
    assert 0 < flows.log_lines(spark, f"{tmp_path}/log", schema).count() < 90
    for _ in range(2):  # the second run finds nothing new
        flows.append_log(entries, f"{tmp_path}/log")
    got = sorted(map(tuple, flows.log_lines(spark, f"{tmp_path}/log", schema).collect()))
    assert got == [(i, "ask [REDACTED]", "[REDACTED]") for i in range(90)]
