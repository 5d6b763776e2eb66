"""The registered query of each corpus operator, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, jaccard_join, kd_shards, langid, line_dedup, mixing, mtree, prefix_trie, simhash, spelling, subwords, url_filter, warc
from ledgerloom.llm.common import prepared
from ledgerloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@register(
    "op7_exact_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of equal texts and whether it is the one that stays."""
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).drop("_key")


BLOCK, ALLOW = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]


@register(
    "op10_url_filter",
    r"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
    r(rule, rule_host, rule_path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
      ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
    m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
          FROM q JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN m USING (page_id)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), BLOCK, ALLOW).drop("url")


@register(
    "op9_warc",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
    g AS (SELECT d, n, max(page_id) AS newest FROM p WHERE n >= 1000 GROUP BY d, n)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
      CASE WHEN newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN newest <> page_id THEN newest END AS refers_to
    FROM p LEFT JOIN g USING (d, n)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    return warc.archive(table(spark, sf_dir, "pages"))


@register("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest document reachable over near-equal fingerprints."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op2_source_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, with its source's target."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0)).drop("source", "_at")


@register("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the documents that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


@register("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under the 32k-piece model, and the text they decode to."""
    return subwords.coded(table(spark, sf_dir, "documents"), model=subwords.MODEL)


@register("op1_kd_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    return kd_shards.shard(table(spark, sf_dir, "documents"), shards=24)


MIN_SITES = 8


@register(
    "op6_line_dedup",
    r"""
    WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
    k AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS plain FROM l),
    b AS (SELECT plain AS boiler FROM k WHERE plain <> '' GROUP BY plain HAVING count(DISTINCT coalesce(source, chr(1))) >= 8),
    r AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (boiler IS NULL), '') AS text,
            count(*) AS n_lines, count(boiler) AS removed_lines FROM k LEFT JOIN b ON plain = boiler GROUP BY doc_id)
    SELECT d.doc_id, r.text, coalesce(n_lines, 0) AS n_lines, coalesce(removed_lines, 0) AS removed_lines FROM documents d LEFT JOIN r USING (doc_id)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that eight or more sources share."""
    return line_dedup.clean(table(spark, sf_dir, "documents"), MIN_SITES)


@register(
    "op4_mtree_topk",
    """
    WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), true)),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of the highest inner product with each query vector."""
    vectors = table(spark, sf_dir, "embeddings").filter(mtree.usable(F.col("embedding"))).select("vec_id", mtree.quantised(F.col("embedding")).alias("vector"))
    return mtree.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def crc32_sql(codes: str) -> str:
    """The unsigned CRC-32 of a list of byte values, bit by bit."""
    bits = f"flatten([[(b >> k) & 1 FOR k IN range(8)] FOR b IN {codes}])"
    step = "lambda c, m: xor(c >> 1, 3988292384 * (xor(c, m) & 1))"
    return f"xor(list_reduce({bits}, {step}, 4294967295::BIGINT), 4294967295)"


LATIN = "".join(map(chr, range(0xC0, 0x100)))
SINGLE = "".join(chr(c) for c in range(33, 97))  # for each of them one byte that no word has

@register("op11_ngram_jaccard_join")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and the smallest document reachable over sets of similarity 0.9 or more."""
    return jaccard_join.near_sets(table(spark, sf_dir, "documents"), width=3, least=0.9)


@register(
    "op12_spelling_variants",
    f"""
    WITH RECURSIVE r AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    g AS (SELECT doc_id, run, count(*) AS times FROM r GROUP BY doc_id, run),
    o AS (SELECT doc_id, run, times, flatten([CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END
            FOR x IN string_split(concat(doc_id, ':', run), '')]) AS codes FROM g),
    h AS (SELECT run, times, {crc32_sql("codes")} AS h FROM o),
    s AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word, times FROM h),
    v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n, length(word) AS l, translate(word, '{LATIN}', '{SINGLE.replace("'", "''")}') AS plain
          FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
    p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM v a JOIN v b ON b.l IN (a.l - 1, a.l, a.l + 1) AND levenshtein(a.plain, b.plain) = 1),
    c AS (SELECT word, count(*) AS n_near FROM p GROUP BY word),
    f AS (SELECT word, near AS form, near_n AS form_n FROM p WHERE near_n >= 5 * n QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
    w AS (SELECT word, form AS root FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON w.root = f.word),
    t AS (SELECT word, root FROM w WHERE root NOT IN (SELECT word FROM f))
    SELECT v.word, form, coalesce(root, v.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
    FROM v LEFT JOIN c USING (word) LEFT JOIN f USING (word) LEFT JOIN t USING (word)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, each with the form it is a variant of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@register(
    "op13_conversation_trie",
    f"""
    WITH o AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                 ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    h AS (SELECT *, {crc32_sql("[ord(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]")} % 4 AS h FROM o),
    b AS (SELECT h.conv_id, list_concat(coalesce(base.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN o base ON base.conv_id = h.conv_id - h.conv_id % 20),
    m AS (SELECT conv_id, d, turns[1:d] AS prefix, d = len(turns) AS ends FROM b, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
    n AS (SELECT prefix, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM m GROUP BY prefix),
    k AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
    x AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
            (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(prefix[depth].t, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM n LEFT JOIN k USING (prefix)),
    a AS (SELECT x.prefix[1:up] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
          FROM x, LATERAL (SELECT unnest(range(depth + 1)) AS up) GROUP BY 1)
    SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(x.ids) AS ends_sha256
    FROM x JOIN a USING (prefix) LEFT JOIN n u ON x.depth > 0 AND u.prefix = x.prefix[1:x.depth - 1]
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations with their subtrees' leaves and savings."""
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations"))
