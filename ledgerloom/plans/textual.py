"""Text, JSON and corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.numeric import fmt_cap
from ledgerloom.functions.redaction import SECRET_PATTERNS, redact_json, redact_rows, redact_text, secret_scan
from ledgerloom.operators import text
from ledgerloom.plans.market import quote_rows
from ledgerloom.plans.registry import query
from ledgerloom.plans.sql import cte, fixed, sql
from ledgerloom.session import scratch
from ledgerloom.sources import corpus, market
from ledgerloom.sources.tables import table
from ledgerloom.streaming import flows


def _masked(x: str) -> str:
    for p in SECRET_PATTERNS.values():
        x = f"regexp_replace({x}, '{p}', '[REDACTED]', 'g')"
    return x


cte(
    "secret_docs",
    """SELECT doc_id, text || CASE doc_id % 10 WHEN 0 THEN ' shpat_' || md5(CAST(doc_id AS VARCHAR)) WHEN 1 THEN ' sk-ant-' || md5(CAST(doc_id AS VARCHAR)) || '_x'
         WHEN 2 THEN ' ghp_' || md5(CAST(doc_id AS VARCHAR)) || ' ghp_short' ELSE '' END AS text FROM documents""",
)


@query("redact_values", sql(f"SELECT doc_id, {_masked('text')} AS text FROM secret_docs", "secret_docs"))
def _redact_values(spark, sf_dir):
    return corpus.secret_documents(spark, sf_dir).select("doc_id", redact_text(F.col("text")).alias("text"))


@query(
    "redact_keys",
    f"""SELECT event_id, user_id AS uid, '[REDACTED]' AS email, '[REDACTED]' AS first_name, {_masked("'ask u' || user_id || '@shop.example.com'")} AS note,
         '[REDACTED]' AS access_token, {_masked("'sent shpat_' || md5(CAST(user_id AS VARCHAR)) || ' to u' || user_id || '@shop.example.com'")} AS message,
         '[REDACTED]' AS api_key, 'json' AS accept, '[REDACTED]' AS header_note, '[REDACTED],' || event_type AS tags, '[DEPTH]' AS deep, props FROM events""",
)
def _redact_keys(spark, sf_dir):
    clean = redact_rows(corpus.log_rows(spark, sf_dir))
    return clean.select(
        "event_id",
        F.col("user.id").alias("uid"),
        "user.email",
        "user.profile.first_name",
        "user.profile.note",
        F.col("accessToken").alias("access_token"),
        "message",
        F.col("headers")["X-Api-Key"].alias("api_key"),
        F.col("headers")["Accept"].alias("accept"),
        F.col("headers")["note"].alias("header_note"),
        F.array_join("tags", ",").alias("tags"),
        F.col("deep.a.a.a.a.a.a.a.a").alias("deep"),
        "props",
    )


cte(
    "masked_payloads",
    """SELECT event_id, event_type AS operation, 'sent to [REDACTED]' AS message,
         CASE event_id % 3
           WHEN 0 THEN '{"items":[{"apiKey":"[REDACTED]"},"[REDACTED]",' || event_id || '],"props":' || replace(props, ' ', '')
             || ',"user":{"email":"[REDACTED]","note":"ask [REDACTED]"}}'
           WHEN 1 THEN '[' || replace(props, ' ', '') || ',"[REDACTED]",{"d":{"phone":"[REDACTED]"}}]'
           END AS payload FROM events""",
)


@query("redact_json", sql("SELECT event_id, coalesce(payload, '\"raw [REDACTED]\"') AS payload FROM masked_payloads", "masked_payloads"))
def _redact_json(spark, sf_dir):
    """JSON whose shape differs from row to row, masked without a schema."""
    return corpus.json_entries(table(spark, sf_dir, "events")).select("event_id", redact_json(F.col("payload")).alias("payload"))


@query("stream_log", sql("SELECT event_id, operation, message, payload FROM masked_payloads", "masked_payloads"))
def _stream_log(spark, sf_dir):
    """Log entries streamed into masked JSON lines, then read back. Payloads that are no JSON have no value there."""
    folder = scratch(spark, "stream-log")
    entries = corpus.json_entries(flows.spread(flows.table_stream(spark, f"{sf_dir}/events.parquet")))
    flows.append_log(entries.withColumn("payload", F.try_parse_json("payload")), folder)
    return flows.log_lines(spark, folder, "event_id long, operation string, message string, payload string")


@query(
    "secret_scan",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS pattern, count(*) FILTER (len(regexp_extract_all(text, '{p}')) > 0) AS rows_hit,
                CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS matches FROM secret_docs"""
            for n, p in SECRET_PATTERNS.items()
        ),
        "secret_docs",
    ),
)
def _secret_scan(spark, sf_dir):
    return secret_scan(corpus.secret_documents(spark, sf_dir), "text")


@query(
    "level_filter",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'info' WHEN 'signup' THEN 'warn' ELSE 'error' END AS level FROM events
       WHERE event_type IN ('click', 'signup', 'purchase')""",
)
def _level_filter(spark, sf_dir):
    return text.level_filter(corpus.log_rows(spark, sf_dir), "info").select("event_id", "level")


cte(
    "page_corpus",
    r"""SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path,
         html || chr(10) || '[next](../en/' || (page_id * 7 % 1000) || '#top) ```[skip](../no/where)``` [root](/de/./x/../' || (page_id * 3 % 1000)
         || ') [web](https://x.example.com/) [mail](mailto:a@b.example) [here](#x)' AS text FROM pages""",
)
cte(
    "page_links",
    r"""SELECT page_id, path, target FROM (
         SELECT page_id, path, unnest(regexp_extract_all(body, '\]\(([^)\s]+)\)', 1) || regexp_extract_all(body, 'href="([^"\s]+)"', 1)) AS target
         FROM (SELECT *, regexp_replace(text, '(?s)```.*?```', '', 'g') AS body FROM page_corpus))
       WHERE NOT regexp_matches(target, '^(https?:|mailto:|#)')""",
    "page_corpus",
)


@query("links", sql("SELECT page_id, target FROM page_links", "page_links"))
def _links(spark, sf_dir):
    return text.links(corpus.page_corpus(spark, sf_dir)).select("page_id", "target")


@query(
    "broken_links",
    sql(
        r"""SELECT page_id, target, resolved FROM (
             SELECT *, CASE WHEN r = '' THEN '/' ELSE r END AS resolved FROM (
               SELECT *, list_reduce([''] || string_split(full_path, '/'), lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '')
                   WHEN s IN ('', '.') THEN a ELSE a || '/' || s END) AS r FROM (
                 SELECT *, CASE WHEN starts_with(p, '/') THEN p ELSE regexp_replace(path, '/[^/]*$', '') || '/' || p END AS full_path
                 FROM (SELECT *, split_part(target, '#', 1) AS p FROM page_links))))
           WHERE resolved NOT IN (SELECT path FROM page_corpus)""",
        "page_links",
        "page_corpus",
    ),
)
def _broken_links(spark, sf_dir):
    pages = corpus.page_corpus(spark, sf_dir)
    return text.broken_links(pages, pages.select("path"))


cte(
    "tagged_docs",
    """SELECT doc_id, text || ' [S-' || source || '] [S-x' || (doc_id % 40) || '] [S-z' || lang || '] '
         || ['[FACT] a [FACT] b', '[INFERENCE] c', '[ASSUMPTION] d [FACT] e', 'none'][doc_id % 4 + 1] AS text FROM documents""",
)
cte(
    "source_log",
    """SELECT unnest(['S-src' || s_suppkey, 'S-x' || s_suppkey * 2]) AS source_id, ['H', 'M', 'L'][s_suppkey % 3 + 1] AS reliability FROM supplier""",
)
cte(
    "cited",
    r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\[(S-[A-Za-z0-9]+)\]', 1)) AS source_id FROM tagged_docs",
    "tagged_docs",
)


@query(
    "citations",
    sql(
        """SELECT coalesce(c.source_id, l.source_id) AS source_id,
             CASE WHEN l.source_id IS NULL THEN 'unlogged' WHEN c.source_id IS NULL THEN 'uncited' ELSE 'covered' END AS status,
             coalesce(docs, 0) AS docs
           FROM (SELECT source_id, count(*) AS docs FROM cited GROUP BY 1) c
           FULL JOIN (SELECT DISTINCT source_id FROM source_log) l ON l.source_id = c.source_id""",
        "cited",
        "source_log",
    ),
)
def _citations(spark, sf_dir):
    return text.citation_coverage(corpus.tagged_documents(spark, sf_dir), corpus.source_log(spark, sf_dir))


@query(
    "evidence_tags",
    sql(
        r"""SELECT doc_id, len(regexp_extract_all(text, '\bFACT\b')) AS fact, len(regexp_extract_all(text, '\bINFERENCE\b')) AS inference,
             len(regexp_extract_all(text, '\bASSUMPTION\b')) AS assumption FROM tagged_docs""",
        "tagged_docs",
    ),
)
def _evidence_tags(spark, sf_dir):
    return text.evidence_tags(corpus.tagged_documents(spark, sf_dir))


@query(
    "weak_support",
    sql(
        """SELECT doc_id, count(*) AS sources FROM cited JOIN (SELECT source_id, bool_and(reliability = 'L') AS low FROM source_log GROUP BY 1) USING (source_id)
           GROUP BY 1 HAVING bool_and(low)""",
        "cited",
        "source_log",
    ),
)
def _weak_support(spark, sf_dir):
    return text.weak_support(corpus.tagged_documents(spark, sf_dir), corpus.source_log(spark, sf_dir))


cte(
    "replies",
    """SELECT *, ['STRONG_BUY', 'BUY', 'HOLD', 'SELL', 'BUY'][n % 5 + 1] AS signal FROM (
         SELECT conv_id, turn, text, conv_id * 8 + turn AS n FROM conversations WHERE role = 'assistant') WHERE n % 7 <> 0""",
)


@query(
    "llm_signals",
    sql(
        """SELECT conv_id, turn, CASE WHEN n % 4 <> 0 THEN text ELSE '' END AS summary, s.sym AS sym, signal, s.c AS confidence, text AS note FROM (
             SELECT *, unnest([{'sym': 'P' || conv_id, 'c': n % 5 + 1}, {'sym': 'Q' || conv_id, 'c': n % 3 + 1}]) AS s FROM replies)""",
        "replies",
    ),
)
def _llm_signals(spark, sf_dir):
    return text.parse_signals(corpus.model_replies(spark, sf_dir))


@query(
    "verdict_default",
    sql(
        """SELECT conv_id, turn, s.sym AS sym, signal, CASE WHEN signal IN ('BUY', 'SELL', 'HOLD') THEN signal ELSE 'HOLD' END AS shown
           FROM (SELECT *, unnest([{'sym': 'P' || conv_id}, {'sym': 'Q' || conv_id}]) AS s FROM replies)""",
        "replies",
    ),
)
def _verdict_default(spark, sf_dir):
    """How every signal of the stored replies is shown."""
    rows = text.parse_signals(corpus.model_replies(spark, sf_dir))
    return rows.select("conv_id", "turn", "sym", "signal", text.shown_signal(F.col("signal")).alias("shown"))


@query(
    "verdict_card",
    """SELECT conv_id, turn, status, CASE WHEN status = 'done' THEN ['Buy now', 'Wait', 'Don''t buy', 'Wait'][turn % 4 + 1] END AS label,
         CASE WHEN status = 'done' THEN n % 5 + 1 END AS confidence, CASE WHEN status = 'done' THEN 'Call ' || conv_id END AS headline,
         CASE WHEN status = 'done' THEN text END AS reasoning, CASE WHEN status = 'done' AND n % 3 <> 0 THEN 'turn ' || turn END AS watch_for
       FROM (SELECT *, conv_id * 8 + turn AS n, CASE WHEN (conv_id * 8 + turn) % 7 = 0 THEN 'error' ELSE 'done' END AS status
             FROM conversations WHERE role = 'assistant')""",
)
def _verdict_card(spark, sf_dir):
    """Verdict cards parsed from stored replies; those that do not parse are errors."""
    return text.parse_verdicts(corpus.verdict_replies(spark, sf_dir))


@query(
    "user_errors",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'input.title: ' || p_name || ' is blank' WHEN 1 THEN ': taken; input: bad'
         ELSE '' END AS errors FROM part""",
)
def _user_errors(spark, sf_dir):
    """Error lists of write responses."""
    pk = F.col("p_partkey")
    body = (
        F.when(pk % 5 == 0, F.concat(F.lit('{"userErrors":[{"field":["input","title"],"message":"'), "p_name", F.lit(' is blank"}]}')))
        .when(pk % 5 == 1, '{"userErrors":[{"field":null,"message":"taken"},{"field":["input"],"message":"bad"}]}')
        .when(pk % 5 == 2, '{"userErrors":[]}')
        .otherwise("{}")
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.user_errors(body).alias("errors"))


def _json_num(x: str) -> str:
    bare = f"regexp_replace({fixed(x, 2)}, '\\.?0+$', '')"
    return f"CASE WHEN {bare} IN ('-0', '') THEN '0' ELSE {bare} END"


@query(
    "snapshot_json",
    sql(
        f"""SELECT account, w.pk AS ord, '{{"symbol":"' || q.sym || '","name":"' || name || '","sector":"' || sector || '","price":' || {_json_num('price')}
              || ',"dayChangePct":' || {_json_num('chg_pct')} || ',"marketCap":"' || CASE WHEN mcap_num >= 1e12 THEN {fixed('mcap_num / 1e12', 2)} || 'T'
              WHEN mcap_num >= 1e9 THEN {fixed('mcap_num / 1e9', 1)} || 'B' ELSE {fixed('mcap_num / 1e6', 0)} || 'M' END || '","peRatio":"' || pe || '"}}' AS item FROM watch w JOIN quotes q ON q.ord = w.pk""",
        "watch",
        "quotes",
    ),
)
def _snapshot_json(spark, sf_dir):
    q = quote_rows(spark, sf_dir).withColumn("cap_text", fmt_cap(F.col("mcap_num"))).withColumnRenamed("ord", "pk")
    return text.snapshot_json(market.watch(spark, sf_dir), q, "account", "pk")


@query(
    "conversation",
    f"""WITH kept AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 9 = 0 THEN '{text.EMPTY_REPLY}' ELSE text END AS content
          FROM conversations WHERE (conv_id + turn) % 9 <> 0 OR role = 'assistant')
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS pos, role, content FROM kept
        UNION ALL SELECT DISTINCT conv_id, 0, 'user', 'Desk context for conversation ' || conv_id FROM conversations
        UNION ALL SELECT DISTINCT conv_id, 1, 'assistant', '{text.OPENING_REPLY.replace("'", "''")}' FROM conversations""",
)
def _conversation(spark, sf_dir):
    context = F.concat(F.lit("Desk context for conversation "), F.col("conv_id").cast("string"))
    return text.assemble(corpus.chat_turns(spark, sf_dir), context)


@query(
    "corpus_source",
    """SELECT '/' || source || '/' || ['docs', 'logs', 'archive', 'node_modules', '.git', 'notes'][doc_id % 6 + 1] || '/' || doc_id || '.md' AS path,
         length(text) AS chars FROM documents WHERE doc_id % 6 IN (0, 5)""",
)
def _corpus_source(spark, sf_dir):
    return corpus.corpus_files(spark, sf_dir).select("path", F.length("text").cast("bigint").alias("chars"))
