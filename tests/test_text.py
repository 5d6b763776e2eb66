import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.redaction import redact_rows, redact_text
from ledgerloom.functions.web import link_targets, resolve_path, utm_fields
from ledgerloom.operators import text
from ledgerloom.sources.corpus import read_corpus
from ledgerloom.sources.pages import ORDER_NODE
from ledgerloom.sources.sinks import read_costs, write_daily, write_log

L = F.lit


@pytest.mark.parametrize(
    "raw, clean",
    [("tok shpat_" + "a1" * 10 + " end", "tok [REDACTED] end"), ("sk-ant-abc_DEF-123", "[REDACTED]"), ("ghp_" + "x" * 20, "[REDACTED]"),
     ("ghp_short", "ghp_short"), ("a.b+c@d-e.co and x@y.org", "[REDACTED] and [REDACTED]"), ("nothing", "nothing")],
)
def test_redacted_text(one, raw, clean):
    assert one(redact_text(L(raw))) == clean


def test_redacted_rows(spark):
    row = {"accessToken": "abc", "ok": 1, "user": {"email": "x", "tags": ["a@b.co", "plain"]}, "note": "shpat_" + "z" * 16, "h": {"Api-Key": "1", "a": "b"}}
    df = spark.createDataFrame([row], "accessToken string, ok int, user struct<email:string,tags:array<string>>, note string, h map<string,string>")
    r = redact_rows(df).first().asDict(recursive=True)
    assert r == {"accessToken": "[REDACTED]", "ok": 1, "user": {"email": "[REDACTED]", "tags": ["[REDACTED]", "plain"]}, "note": "[REDACTED]", "h": {"Api-Key": "[REDACTED]", "a": "b"}}


def test_levels(spark):
    logs = spark.createDataFrame([("debug",), ("info",), ("odd",), ("error",)], "level string")
    keep = lambda m: {r[0] for r in text.level_filter(logs, m).collect()}
    assert keep("info") == {"info", "error"} and keep("nonsense") == {"info", "error"} and keep("debug") == {"debug", "info", "error"}


def test_links(one):
    md = "[a](x.md#f) ```[no](z.md)``` [web](https://q.r) [m](mailto:a@b) [f](#top) <a href=\"/p/q\">"
    assert one(link_targets(L(md))) == ["x.md#f", "/p/q"]
    assert one(resolve_path(L("/a/b/c.md"), L("../d.md#x"))) == "/a/d.md"
    assert one(resolve_path(L("/a/b"), L("/x/./y/../z"))) == "/x/z"
    assert one(resolve_path(L("/a"), L("../../up"))) == "/up"


def test_utm(spark):
    df = spark.createDataFrame([("https://a.b/?x=1&utm_source=feed&utm_campaign=EXP-0042_low_price#f",), ("https://a.b/p",)], "url string")
    a, b = df.select(*utm_fields("url")).collect()
    assert tuple(a) == ("feed", None, "EXP-0042_low_price", "EXP-0042", "low_price", None) and set(b) == {None}


def reply(body, fence=True):
    t = f"```json\n{body}\n```" if fence else body
    return json.dumps({"content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": t}]})


def test_stored_replies(spark):
    good = {"summary": "s", "signals": [{"sym": "A", "signal": "BUY", "confidence": 4, "note": "n"}]}
    rows = [(1, 0, reply(json.dumps(good))), (2, 0, reply(json.dumps(good)[:-9])), (3, 0, reply('{"signals": "x"}')), (4, 0, "junk"),
            (5, 0, reply(json.dumps({"signals": good["signals"]}), fence=False)), (6, 0, reply('{"summary": "only"}'))]
    out = text.parse_signals(spark.createDataFrame(rows, "conv_id long, turn long, response string")).collect()
    assert sorted((r["conv_id"], r["summary"], r["sym"]) for r in out) == [(1, "s", "A"), (5, "", "A")]


def test_error_lists(one):
    body = json.dumps({"userErrors": [{"field": ["input", "title"], "message": "blank"}, {"field": None, "message": "taken"}]})
    assert one(text.user_errors(L(body))) == "input.title: blank; : taken"
    assert one(text.user_errors(L("{}"))) == ""


def test_conversation_rows(spark):
    turns = [(1, 0, "user", " "), (1, 1, "user", "hi"), (1, 2, "assistant", "  "), (1, 3, "user", "bye")]
    df = text.assemble(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), L("ctx"))
    got = [(r["pos"], r["role"], r["content"]) for r in df.orderBy("pos").collect()]
    assert got == [(0, "user", "ctx"), (1, "assistant", text.OPENING_REPLY), (2, "user", "hi"), (3, "assistant", text.EMPTY_REPLY), (4, "user", "bye")]


def test_corpus_walk(spark, tmp_path):
    for p in ("a.md", "docs/b.md", "docs/logs/c.md", "node_modules/d.md", ".git/e.md", "docs/f.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("one\ntwo")
    got = {r["path"]: r["text"] for r in read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"/a.md": "one\ntwo", "/docs/b.md": "one\ntwo"}


def test_sinks(spark, tmp_path):
    for _ in range(2):
        write_log(spark.createDataFrame([("info", "a@b.co")], "level string, note string"), str(tmp_path / "log"))
    assert [r["note"] for r in spark.read.json(str(tmp_path / "log")).collect()] == ["[REDACTED]"] * 2
    out = str(tmp_path / "daily")
    write_daily(spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "dt string, n int"), out)
    write_daily(spark.createDataFrame([("2024-01-02", 5)], "dt string, n int"), out)
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [1, 5]
    (tmp_path / "cogs.csv").write_text("sku,landed_cost,currency,as_of\nP1,3.25,USD,2024-01-01\n")
    assert float(read_costs(spark, str(tmp_path / "cogs.csv")).first()["landed_cost"]) == 3.25


def test_order_fields_carry_no_personal_data():
    for word in ("email", "phone", "address", "firstName", "lastName", "customer{"):
        assert word not in ORDER_NODE
