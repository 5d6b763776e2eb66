import json
import math

from pyspark.sql import functions as F

from ledgerloom.functions.redaction import redact_json, redact_rows
from ledgerloom.operators import governance, writes
from ledgerloom.sources.writes import read_limits

K = governance.LIMIT_KINDS


def test_limit_boundaries(spark):
    limits = spark.createDataFrame([(K[0], 0.0), (K[1], 25.0), (K[2], None)], "kind string, limit double")
    asked = [(1, K[0], 0.01, "APPROVAL"), (2, K[1], 25.0, "OK"), (3, K[1], 25.01, "APPROVAL"), (4, "MAX_COFFEE", 1.0, "UNKNOWN_KIND"),
             (5, K[1], -5.0, "INVALID_AMOUNT"), (6, K[1], math.nan, "INVALID_AMOUNT"), (7, K[0], 0.0, "APPROVAL"),
             (8, K[1], 0.0, "OK"), (9, K[2], 1.0, "APPROVAL"), (10, K[3], 1.0, "APPROVAL"), (11, K[1], None, "INVALID_AMOUNT")]
    df = spark.createDataFrame(asked, "n long, kind string, amount double, want string")
    assert all(r["status"] == r["want"] for r in governance.limit_check(df, limits).collect())


def test_write_mode(spark):
    allowed = spark.createDataFrame([(" SHOP-1 ",), ("",), ("  ",)], "store string")
    asked = [("shop-1", None, False), ("Shop-1", "LIVE", True), ("shop-2", "live", False), (None, "live", False), ("", "live", False)]
    out = governance.write_mode(spark.createDataFrame(asked, "store string, mode string, want boolean"), allowed).collect()
    assert len(out) == 5 and all(r["live"] == r["want"] for r in out)
    assert {r["reason"] for r in out if r["mode"] is None} == {'write mode is "dry-run"'}


def test_limit_document(spark, tmp_path):
    doc = {"_comment": "x", "currency": "USD", **dict.fromkeys(K, 0), "last_changed_on": "2024-01-01"}
    (tmp_path / "l.json").write_text(json.dumps(doc, indent=2))
    rows = read_limits(spark, str(tmp_path / "l.json")).collect()
    assert {(r["kind"], r["limit"], r["currency"]) for r in rows} == {(k, 0.0, "USD") for k in K}


def test_waits(spark):
    rows = [(150.0, 50.0, 50.0, 0, 2100), (150.0, None, 50.0, 3, 8000), (150.0, 200.0, 50.0, 1, 2000), (150.0, 50.0, 0.0, 0, 1000),
            (0.0, -5.0, 50.0, 0, 1000), (None, 5.0, 50.0, 0, 1000)]
    df = spark.createDataFrame(rows, "requested double, available double, restore_rate double, attempt int, want long")
    assert all(r[0] == r[1] for r in df.select("want", writes.wait_ms()).collect())


def test_retries(spark):
    rows = [(True, 200, False, False, False, 0, "network_error", True), (True, 200, False, False, True, 0, "network_error", False),
            (True, 200, False, False, False, 1, "network_error", False), (False, 429, False, False, True, 2, "throttled", True),
            (False, 200, True, False, True, 3, "throttled", False), (False, 503, False, False, False, 0, "http_503", True),
            (False, 503, False, False, True, 0, "http_503", False), (False, 404, False, False, False, 0, "http_404", False),
            (False, 200, False, True, False, 0, "graphql_errors", False), (False, 200, False, False, False, 0, "ok", False)]
    df = spark.createDataFrame(rows, "network_error boolean, status int, throttled boolean, has_errors boolean, is_mutation boolean, attempt int, want string, again boolean")
    for r in df.withColumn("outcome", writes.outcome()).withColumn("r", writes.retryable()).collect():
        assert (r["outcome"], r["r"]) == (r["want"], r["again"])


def test_next_ids_pass_999(spark):
    have = spark.createDataFrame([("EXP-998",), ("EXP-007",)], "id string")
    titles = spark.createDataFrame([("a",), ("b",)], "title string")
    out = writes.next_ids(have, titles, "title", "EXP-XXX <title> <title> YYYY-MM-DD EXP-XXX", "2024-02-01").orderBy("title").collect()
    assert [r["id"] for r in out] == ["EXP-999", "EXP-1000"]
    assert out[0]["body"] == "EXP-999 a <title> 2024-02-01 EXP-999"
    none = spark.createDataFrame([], "id string")
    assert writes.next_ids(none, titles, "title", "", "d").orderBy("title").first()["id"] == "EXP-001"


def test_write_batches(spark):
    df = spark.range(130).select((F.col("id") % 2).alias("owner"), F.col("id").alias("item"))
    sizes = writes.write_batches(df, "owner", "item").groupBy("owner", "batch").count().collect()
    assert sorted((r["owner"], r["batch"], r["count"]) for r in sizes) == [(o, b, n) for o in (0, 1) for b, n in ((0, 25), (1, 25), (2, 15))]


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    n = spark.createDataFrame([("b", None), ("c", 3)], "k string, v int")
    once = writes.upsert(t, n, "k", ["v"])
    assert {tuple(r) for r in once.collect()} == {("a", 1, "keep"), ("b", None, "update"), ("c", 3, "insert")}
    twice = writes.upsert(once.drop("op"), n, "k", ["v"])
    assert {tuple(r)[:2] for r in twice.collect()} == {tuple(r)[:2] for r in once.collect()}


def test_null_kind_is_unknown(spark):
    requests = spark.createDataFrame([(None, 1.0)], "kind string, amount double")
    limits = spark.createDataFrame([("MAX_DAILY_AD_SPEND", 5.0)], "kind string, limit double")
    assert governance.limit_check(requests, limits).first()["status"] == "UNKNOWN_KIND"


def test_json_of_any_shape_is_masked(spark):
    deep = lambda n, inner: '{"a":' * n + inner + "}" * n
    cases = {
        '{"b":1,"email":{"x":1},"a":["me@x.com",{"apiKey":5,"t":"ok \\"q\\""}],"n":null}': '{"a":["[REDACTED]",{"apiKey":"[REDACTED]","t":"ok \\"q\\""}],"b":1,"email":"[REDACTED]","n":null}',
        "[]": "[]", "{}": "{}", "null": "null", "5": "5", "": '""', "not json a@b.cc": '"not json [REDACTED]"',
        '[true,[[]],{"k":[]}]': '[true,[[]],{"k":[]}]',
        '{"a":1,"a":2}': json.dumps('{"a":1,"a":2}'),  # a repeated name is no JSON object
        deep(7, "1"): deep(7, "1"), deep(8, "1"): deep(8, '"[DEPTH]"'), deep(9, "1"): deep(8, '"[DEPTH]"'),
    }
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "j string")
    got = {r.j: r.m for r in df.select("j", redact_json(F.col("j")).alias("m")).collect()}
    assert got == {**cases, None: None}
    typed = redact_rows(df.where("j LIKE '[true%' OR j LIKE '{\"b%' OR j IS NULL").select(F.parse_json("j").alias("v")))
    assert {r.v for r in typed.select(F.to_json("v").alias("v")).collect()} == {cases[c] for c in cases if c.startswith(("[true", '{"b'))} | {None}
