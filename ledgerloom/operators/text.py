"""Text and JSON operators: links, citations, evidence, stored responses, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import to_fixed
from ledgerloom.functions.web import link_targets, resolve_path
from ledgerloom.operators.ordering import rank_within

# Log levels, verdict labels, opening reply and the reply used when none came back.
LEVELS = {"debug": 10, "info": 20, "warn": 30, "error": 40}
VERDICT_LABELS = {"BUY_NOW": "Buy now", "WAIT": "Wait", "AVOID": "Don't buy"}
SIGNALS = ("BUY", "SELL", "HOLD")
OPENING_REPLY = "Understood. I'm on the desk — ask away."
EMPTY_REPLY = "I lost the thread there — try asking again."
# Citation and evidence tags.
CITATION = r"\[(S-[A-Za-z0-9]+)\]"
EVIDENCE = ("FACT", "INFERENCE", "ASSUMPTION")

REPLY_SCHEMA = "content array<struct<type:string,text:string>>"
VERDICT_SCHEMA = "verdict string, confidence bigint, headline string, reasoning string, watchFor string, bad string"
SIGNALS_SCHEMA = "summary string, signals array<struct<sym:string,signal:string,confidence:bigint,note:string>>"
ERRORS_SCHEMA = "userErrors array<struct<field:array<string>,message:string>>"


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def level_filter(logs: DataFrame, minimum: str = "info") -> DataFrame:
    """Entries at or above a level; unknown levels weigh nothing, an unknown minimum means info."""
    floor = LEVELS.get(minimum, LEVELS["info"])
    return logs.where(F.coalesce(F.try_element_at(literal_map(LEVELS), F.col("level")), F.lit(0)) >= floor)


def links(corpus: DataFrame) -> DataFrame:
    return corpus.select("page_id", "path", F.explode(link_targets(F.col("text"))).alias("target"))


def broken_links(corpus: DataFrame, existing: DataFrame) -> DataFrame:
    """Links whose resolved path is not among the existing ones."""
    found = links(corpus).withColumn("resolved", resolve_path(F.col("path"), F.col("target")))
    known = existing.select(F.col("path").alias("resolved")).distinct()
    return found.join(known, "resolved", "left_anti").select("page_id", "target", "resolved")


def cited(docs: DataFrame) -> DataFrame:
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(CITATION), 1))
    return docs.select("doc_id", F.explode(ids).alias("source_id"))


def citation_coverage(docs: DataFrame, log: DataFrame) -> DataFrame:
    """Citing documents per source, and whether the source is logged. Citations are counted before the join."""
    used = cited(docs).groupBy("source_id").agg(F.count(F.lit(1)).alias("docs"))
    known = log.select("source_id").distinct().withColumn("logged", F.lit(True))
    status = F.when(F.col("logged").isNull(), "unlogged").when(F.col("docs").isNull(), "uncited").otherwise("covered")
    return used.join(known, "source_id", "full").select(
        "source_id", status.alias("status"), F.coalesce("docs", F.lit(0)).alias("docs")
    )


def evidence_tags(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[F.regexp_count("text", F.lit(rf"\b{t}\b")).cast("bigint").alias(t.lower()) for t in EVIDENCE])


def weak_support(docs: DataFrame, log: DataFrame) -> DataFrame:
    """Documents whose logged sources are all of low reliability."""
    best = log.groupBy("source_id").agg(F.bool_and(F.col("reliability") == "L").alias("low"))
    return (
        cited(docs)
        .join(best, "source_id")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("sources"), F.bool_and("low").alias("weak"))
        .where("weak")
        .select("doc_id", "sources")
    )


def reply_text(response: Column) -> Column:
    """Text blocks of a stored response, joined by newlines."""
    blocks = F.filter(F.from_json(response, REPLY_SCHEMA)["content"], lambda b: b["type"] == "text")
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")


def parse_signals(replies: DataFrame) -> DataFrame:
    """Signals of responses that parse and carry a signal list; malformed ones drop out here."""
    clean = F.trim(F.regexp_replace(reply_text(F.col("response")), "```json|```", ""))
    return (
        replies.withColumn("p", F.from_json(clean, SIGNALS_SCHEMA))
        .where(F.col("p.signals").isNotNull())
        .select("conv_id", "turn", F.coalesce("p.summary", F.lit("")).alias("summary"), F.inline("p.signals"))
    )


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """Verdict card of each stored response, fences stripped: status, label, confidence, headline, reasoning, watch_for.

    A reply that is no JSON object has status ``error`` and no card; an unknown verdict is shown as waiting.
    """
    clean = F.trim(F.regexp_replace(reply_text(F.col("response")), "```json|```", ""))
    parsed = replies.withColumn("p", F.from_json(clean, VERDICT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    done = F.col("p").isNotNull() & F.col("p.bad").isNull()
    card = lambda c: F.when(done, c)
    return parsed.select(
        "conv_id",
        "turn",
        F.when(done, "done").otherwise("error").alias("status"),
        card(verdict_label(F.col("p.verdict"))).alias("label"),
        card(F.col("p.confidence")).alias("confidence"),
        card(F.col("p.headline")).alias("headline"),
        card(F.col("p.reasoning")).alias("reasoning"),
        card(F.col("p.watchFor")).alias("watch_for"),
    )


def shown_signal(signal: Column) -> Column:
    """Display style of a signal; anything unknown is shown as HOLD."""
    return F.when(signal.isin(*SIGNALS), signal).otherwise("HOLD")


def verdict_label(verdict: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(VERDICT_LABELS), verdict), F.lit(VERDICT_LABELS["WAIT"]))


def user_errors(payload: Column) -> Column:
    """``field.path: message`` entries joined by semicolons; a missing field is an empty path."""
    errors = F.coalesce(F.from_json(payload, ERRORS_SCHEMA)["userErrors"], F.array())
    line = lambda e: F.concat(F.array_join(F.coalesce(e["field"], F.array()), "."), F.lit(": "), e["message"])
    return F.array_join(F.transform(errors, line), "; ")


def json_number(x: Column, d: int = 2) -> Column:
    """Number text as JSON prints it after rounding to d decimals: no trailing zeros, no minus zero."""
    bare = F.regexp_replace(to_fixed(x, d), r"\.?0+$", "") if d else to_fixed(x, 0)
    return F.when(bare == "-0", "0").when(bare == "", "0").otherwise(bare)


def snapshot_json(lists: DataFrame, quotes: DataFrame, owner: str, key: str) -> DataFrame:
    """JSON snapshot of each owner's list of quotes as ordered rows (ord is the key's order in the list).

    Each quote is rendered once, before the join. One row per entry rather than one array per owner, so a long list is
    never one value; joining an owner's rows with commas between brackets gives the whole document.
    """
    head = F.to_json(F.struct(F.col("sym").alias("symbol"), "name", "sector"))
    tail = F.to_json(F.struct(F.col("cap_text").alias("marketCap"), F.col("pe").alias("peRatio")))
    item = F.concat(
        F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"price":'), json_number(F.col("price")), F.lit(',"dayChangePct":'),
        json_number(F.col("chg_pct")), F.lit(","), F.expr("substring(t, 2)"),
    )
    rendered = quotes.withColumn("h", head).withColumn("t", tail).select(key, item.alias("item"))
    return lists.select(owner, key).join(rendered, key).select(owner, F.col(key).alias("ord"), "item")


def assemble(turns: DataFrame, context: Column) -> DataFrame:
    """Message list of every conversation as ordered rows: a two-message opening, then the turns.

    Blank drafts are skipped and an empty reply gets the stock text. Rows rather than one array per conversation,
    so a huge conversation is never one value.
    """
    blank = F.trim("text") == ""
    kept = turns.where(~(blank & (F.col("role") != "assistant"))).withColumn(
        "content", F.when(blank, EMPTY_REPLY).otherwise(F.col("text"))
    )
    body = rank_within(kept, ["conv_id"], ["turn"], "pos").select(
        "conv_id", (F.col("pos") + 1).alias("pos"), "role", "content"
    )
    opening = F.explode(
        F.array(
            F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("user").alias("role"), context.alias("content")),
            F.struct(F.lit(1).cast("bigint").alias("pos"), F.lit("assistant").alias("role"), F.lit(OPENING_REPLY).alias("content")),
        )
    )
    heads = turns.select("conv_id").distinct().select("conv_id", opening.alias("m")).select("conv_id", "m.*")
    return heads.unionByName(body)
