"""Text relations: the file reader, and documents, pages, chats and logs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.web import url_path
from ledgerloom.sources.tables import table

# Folders a corpus walk skips.
SKIPPED_FOLDERS = ("node_modules", "logs", "archive", ".git")


def not_skipped(path: str):
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in SKIPPED_FOLDERS]))


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files below a folder, one row per file, skipping tool folders."""
    files = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
        .select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("text"))
    )
    inside = F.regexp_replace("full", f"^(file:)?/*{root.strip('/')}", "")
    return files.select(inside.alias("path"), "text").where(not_skipped("path"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as files over wanted and skipped folders."""
    folders = F.array(*[F.lit(d) for d in ("docs", "logs", "archive", "node_modules", ".git", "notes")])
    path = F.concat(
        F.lit("/"), "source", F.lit("/"), F.element_at(folders, (F.col("doc_id") % 6 + 1).cast("int")), F.lit("/"),
        F.col("doc_id").cast("string"), F.lit(".md"),
    )
    return table(spark, sf_dir, "documents").select(path.alias("path"), "text").where(not_skipped("path"))


def page_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their path and a Markdown tail that links to neighbours, the root and elsewhere."""
    pid = F.col("page_id")
    tail = F.concat(
        F.lit("\n[next](../en/"), (pid * 7 % 1000).cast("string"), F.lit("#top) ```[skip](../no/where)``` [root](/de/./x/../"),
        (pid * 3 % 1000).cast("string"), F.lit(") [web](https://x.example.com/) [mail](mailto:a@b.example) [here](#x)"),
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", url_path(F.col("url")).alias("path"), F.concat("html", tail).alias("text")
    )


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with citations and evidence tags appended."""
    d = F.col("doc_id")
    tags = F.array(F.lit("[FACT] a [FACT] b"), F.lit("[INFERENCE] c"), F.lit("[ASSUMPTION] d [FACT] e"), F.lit("none"))
    text = F.concat(
        "text", F.lit(" [S-"), "source", F.lit("] [S-x"), (d % 40).cast("string"), F.lit("] [S-z"), "lang", F.lit("] "),
        F.element_at(tags, (d % 4 + 1).cast("int")),
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def source_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged sources with their reliability."""
    s = F.col("s_suppkey")
    grade = F.element_at(F.array(F.lit("H"), F.lit("M"), F.lit("L")), (s % 3 + 1).cast("int"))
    ids = F.explode(F.array(F.concat(F.lit("S-src"), s.cast("string")), F.concat(F.lit("S-x"), (s * 2).cast("string"))))
    return table(spark, sf_dir, "supplier").select(ids.alias("source_id"), grade.alias("reliability"))


def secret_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some with an access token of each family appended."""
    d = F.col("doc_id")
    h = F.md5(d.cast("string"))
    tail = (
        F.when(d % 10 == 0, F.concat(F.lit(" shpat_"), h))
        .when(d % 10 == 1, F.concat(F.lit(" sk-ant-"), h, F.lit("_x")))
        .when(d % 10 == 2, F.concat(F.lit(" ghp_"), h, F.lit(" ghp_short")))
        .otherwise("")
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("text"))


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured log entries, one per event."""
    kind, uid = F.col("event_type"), F.col("user_id").cast("string")
    level = (
        F.when(kind == "view", "debug").when(kind == "click", "info").when(kind == "signup", "warn")
        .when(kind == "purchase", "error").otherwise("trace")
    )
    mail = F.concat(F.lit("u"), uid, F.lit("@shop.example.com"))
    token = F.concat(F.lit("shpat_"), F.md5(uid))
    deep = F.struct(F.col("event_id").alias("a"))
    for _ in range(7):
        deep = F.struct(deep.alias("a"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        level.alias("level"),
        F.concat(kind, F.lit(".request")).alias("operation"),
        F.struct(
            F.col("user_id").alias("id"), mail.alias("email"),
            F.struct(F.lit("Ada").alias("first_name"), F.concat(F.lit("ask "), mail).alias("note")).alias("profile"),
        ).alias("user"),
        token.alias("accessToken"),
        F.concat(F.lit("sent "), token, F.lit(" to "), mail).alias("message"),
        F.create_map(F.lit("X-Api-Key"), uid, F.lit("Accept"), F.lit("json"), F.lit("note"), mail).alias("headers"),
        F.array(mail, kind).alias("tags"),
        deep.alias("deep"),
        "props",
    )


def json_entries(events: DataFrame) -> DataFrame:
    """Log entries of events, stored or streamed, whose payload is JSON of one of two shapes, or no JSON at all."""
    uid, shape = F.col("user_id").cast("string"), F.col("event_id") % 3
    mail, token = F.concat(F.lit("u"), uid, F.lit("@shop.example.com")), F.concat(F.lit("shpat_"), F.md5(uid))
    nested = F.format_string(
        '{"user": {"note": "ask %s", "email": "%s"}, "items": [{"apiKey": 5}, "%s", %d], "props": %s}', mail, mail, token, F.col("event_id"), F.col("props")
    )
    listed = F.format_string('[%s, "%s", {"d": {"phone": [1, 2]}}]', F.col("props"), mail)
    return events.select(
        "event_id",
        F.col("event_type").alias("operation"),
        F.concat(F.lit("sent to "), mail).alias("message"),
        F.when(shape == 0, nested).when(shape == 1, listed).otherwise(F.concat(F.lit("raw "), token)).alias("payload"),
    )


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns, some left blank."""
    blank = (F.col("conv_id") + F.col("turn")) % 9 == 0
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.when(blank, " ").otherwise(F.col("text")).alias("text")
    )


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model responses as JSON text: fenced payload blocks, some cut short, some with unknown signals."""
    n = F.col("conv_id") * 8 + F.col("turn")
    signal = F.element_at(F.array(*[F.lit(x) for x in ("STRONG_BUY", "BUY", "HOLD", "SELL", "BUY")]), (n % 5 + 1).cast("int"))
    call = lambda sym, conf: F.struct(
        F.concat(F.lit(sym), F.col("conv_id").cast("string")).alias("sym"), signal.alias("signal"), conf.alias("confidence"),
        F.col("text").alias("note"),
    )
    payload = F.to_json(
        F.struct(
            F.when(n % 4 != 0, F.col("text")).alias("summary"),
            F.array(call("P", n % 5 + 1), call("Q", n % 3 + 1)).alias("signals"),
        )
    )
    sent = F.when(n % 7 == 0, F.expr("substring(payload, 1, length(payload) - 20)")).otherwise(F.col("payload"))
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    content = F.array(
        block("thinking", F.lit("hidden")), block("text", F.lit("```json")), block("text", sent), block("text", F.lit("```"))
    )
    return (
        table(spark, sf_dir, "conversations")
        .where("role = 'assistant'")
        .withColumn("payload", payload)
        .select("conv_id", "turn", F.to_json(F.struct(content.alias("content"))).alias("response"))
    )


def verdict_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored verdict responses as fenced JSON text: some cut short, some with an unknown verdict or a missing field."""
    n = F.col("conv_id") * 8 + F.col("turn")
    codes = F.array(*[F.lit(v) for v in ("BUY_NOW", "WAIT", "AVOID", "SELL_ALL")])
    payload = F.to_json(
        F.struct(
            F.element_at(codes, (F.col("turn") % 4 + 1).cast("int")).alias("verdict"),
            (n % 5 + 1).alias("confidence"),
            F.concat(F.lit("Call "), F.col("conv_id").cast("string")).alias("headline"),
            F.col("text").alias("reasoning"),
            F.when(n % 3 != 0, F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("watchFor"),
        )
    )
    sent = F.when(n % 7 == 0, F.expr("substring(payload, 1, length(payload) - 1)")).otherwise(F.col("payload"))
    block = lambda text: F.struct(F.lit("text").alias("type"), text.alias("text"))
    content = F.array(block(F.lit("```json")), block(sent), block(F.lit("```")))
    return (
        table(spark, sf_dir, "conversations")
        .where("role = 'assistant'")
        .withColumn("payload", payload)
        .select("conv_id", "turn", F.to_json(F.struct(content.alias("content"))).alias("response"))
    )
