"""Governance, write-planning, paging and delivery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.numeric import cents
from ledgerloom.operators import deliveries as dlv
from ledgerloom.operators import governance, offsets, writes
from ledgerloom.operators.dedupe import ttl_dedupe
from ledgerloom.operators.edits import apply_watch_edits
from ledgerloom.operators.ordering import rank_within
from ledgerloom.plans.registry import query
from ledgerloom.plans.sql import cte, sql
from ledgerloom.session import scratch
from ledgerloom.sources import feeds, market, pages, stored
from ledgerloom.sources import writes as src
from ledgerloom.sources.tables import table
from ledgerloom.streaming import flows
from ledgerloom.streaming.state import offset_stream, watch_stream

_KINDS = "[" + ", ".join(f"'{k}'" for k in governance.LIMIT_KINDS) + "]"


@query(
    "limit_check",
    f"""SELECT request, kind, status FROM (SELECT *, CASE WHEN k = 5 THEN 'UNKNOWN_KIND' WHEN isnan(amount) OR amount < 0 THEN 'INVALID_AMOUNT'
           WHEN lim IS NULL OR lim <= 0 OR amount > lim THEN 'APPROVAL' ELSE 'OK' END AS status FROM (
          SELECT o_orderkey AS request, o_orderkey % 6 AS k, coalesce({_KINDS}[o_orderkey % 6 + 1], 'MAX_COFFEE') AS kind,
            CASE WHEN o_orderkey % 13 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 11 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount,
            [0, 100000, 250000.5, 400000, NULL, NULL][o_orderkey % 6 + 1] AS lim FROM orders))""",
)
def _limit_check(spark, sf_dir):
    return governance.limit_check(src.spend_requests(spark, sf_dir), src.limits(spark)).select("request", "kind", "status")


@query(
    "allow_list",
    """SELECT s_suppkey AS request, coalesce(lower(mode), 'dry-run') = 'live' AND listed AS live,
         CASE WHEN coalesce(lower(mode), 'dry-run') <> 'live' THEN 'write mode is "' || coalesce(lower(mode), 'dry-run') || '"'
              WHEN NOT listed THEN 'store "' || s_name || '" not in the allow list' ELSE 'live mode and store allow-listed' END AS reason
       FROM (SELECT *, ['LIVE', 'live', 'dry-run', NULL][s_suppkey % 4 + 1] AS mode, s_acctbal > 0 AND s_nationkey % 5 <> 0 AS listed FROM supplier)""",
)
def _allow_list(spark, sf_dir):
    out = governance.write_mode(src.store_requests(spark, sf_dir), src.allowed_stores(spark, sf_dir))
    return out.select("request", "live", "reason")


_LIMIT = lambda i: (
    f"CASE WHEN (s_suppkey + {i}) % 8 = 0 THEN NULL WHEN (s_suppkey + {i}) % 10 = 3 THEN -5 ELSE (s_suppkey * {i + 1}) % 4 * 100 END"
)


@query(
    "limits_validate",
    f"""SELECT s_name AS store, array_to_string(list_filter([CASE WHEN s_suppkey % 6 = 0 THEN 'currency must be ISO 4217 code' END, {', '.join(
        f"CASE WHEN coalesce({_LIMIT(i)}, -1) < 0 THEN '{k} must be a number >= 0' END" for i, k in enumerate(governance.LIMIT_KINDS))}], lambda x: x IS NOT NULL), '; ') AS errors,
        array_to_string(list_filter([{', '.join(f"CASE WHEN {_LIMIT(i)} > 0 THEN '{k}' END" for i, k in enumerate(governance.LIMIT_KINDS))}], lambda x: x IS NOT NULL), ', ') AS nonzero
        FROM supplier""",
)
def _limits_validate(spark, sf_dir):
    return src.limit_sets(spark, sf_dir).select(
        "store",
        F.array_join(governance.limit_errors(), "; ").alias("errors"),
        F.array_join(governance.nonzero_limits(), ", ").alias("nonzero"),
    )


@query("unknown_keys", "SELECT s_name AS store, 'MAX_COFFEE' AS unknown_key FROM supplier WHERE s_suppkey % 9 = 0")
def _unknown_keys(spark, sf_dir):
    return governance.unknown_keys(src.limit_sets(spark, sf_dir), "store")


_LISTS = """SELECT user_id, sym, ord - 1 AS ord, ord = 1 AS selected FROM (
         SELECT user_id, unnest(syms) AS sym, unnest(range(1, len(syms) + 1)) AS ord FROM (
           SELECT user_id, list_filter(string_split(list_reduce([','] || log, lambda a, x: CASE
               WHEN x[1] = 'a' THEN CASE WHEN contains(a, ',' || x[3:] || ',') THEN a ELSE a || x[3:] || ',' END
               WHEN length(a) - length(replace(a, ',', '')) <= 2 THEN a
               ELSE replace(a, ',' || x[3:] || ',', ',') END), ','), lambda s: s <> '') AS syms
           FROM (SELECT user_id, list(CASE WHEN event_type = 'click' THEN 'a:' ELSE 'r:' END || 'P' || (event_id % 20) ORDER BY event_id) AS log
                 FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)))"""


@query("watch_apply", _LISTS)
def _watch_apply(spark, sf_dir):
    return apply_watch_edits(src.watch_edits(spark, sf_dir))


cte(
    "catalog",
    """SELECT 'p-' || p_partkey AS handle, p_name AS title, p_retailprice AS price, p_partkey FROM part""",
)
cte(
    "patches",
    """SELECT 'p-' || p_partkey AS handle, p_name AS title, p_retailprice * 1.1 AS price FROM part WHERE p_size % 3 = 0
       UNION ALL SELECT 'new-' || p_partkey, p_name, p_retailprice FROM part WHERE p_brand = 'Brand#2'""",
)


@query(
    "upsert",
    sql(
        """SELECT coalesce(c.handle, n.handle) AS handle, coalesce(n.title, c.title) AS title, coalesce(n.price, c.price) AS price,
             CASE WHEN c.handle IS NULL THEN 'insert' WHEN n.handle IS NULL THEN 'keep' ELSE 'update' END AS op
           FROM catalog c FULL JOIN patches n ON n.handle = c.handle""",
        "catalog",
        "patches",
    ),
)
def _upsert(spark, sf_dir):
    return writes.upsert(catalog(spark, sf_dir), src.price_patches(spark, sf_dir), "handle", ["title", "price"])


def catalog(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("handle"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("price"),
    )


@query(
    "stored_upsert",
    sql(
        """SELECT coalesce(c.handle, n.handle) AS handle, coalesce(n.title, c.title) AS title, coalesce(n.price, c.price) AS price
           FROM catalog c FULL JOIN patches n ON n.handle = c.handle""",
        "catalog",
        "patches",
    ),
)
def _stored_upsert(spark, sf_dir):
    """The catalog as a table stored by handle, with the patches merged into the buckets they touch."""
    folder = scratch(spark, "stored-catalog")
    stored.create(spark, folder, catalog(spark, sf_dir), ["handle"])
    stored.merge(spark, folder, src.price_patches(spark, sf_dir), ["handle"])
    return stored.read(spark, folder)


@query(
    "bulk_patch",
    sql(
        """SELECT c.handle, c.title, coalesce(n.price, c.price) AS price FROM catalog c LEFT JOIN patches n ON n.handle = c.handle""",
        "catalog",
        "patches",
    ),
)
def _bulk_patch(spark, sf_dir):
    return writes.bulk_patch(catalog(spark, sf_dir), src.price_patches(spark, sf_dir), "handle", ["price"])


_CAS = """WITH stock AS (SELECT l_partkey AS item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cur FROM lineitem GROUP BY 1),
       first_try AS (SELECT * FROM (SELECT l_orderkey AS key, l_partkey AS item, CAST(l_quantity AS BIGINT) AS quantity,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, cur + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END, l_quantity) AS rn,
           cur, cur + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS expected FROM lineitem JOIN stock ON item = l_partkey) WHERE rn = 1)
       SELECT key, item, expected, cur AS "current", quantity, CASE WHEN expected <> cur THEN 'mismatch'
         WHEN key = min(key) FILTER (expected = cur) OVER (PARTITION BY item) THEN 'applied' ELSE 'superseded' END AS status FROM first_try"""


@query("inventory_cas", _CAS)
def _inventory_cas(spark, sf_dir):
    stock, requests = src.stock_requests(spark, sf_dir)
    return writes.compare_and_set(stock, requests)


@query(
    "stored_quantities",
    f"""WITH decided AS ({_CAS}), stock AS (SELECT l_partkey AS item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cur FROM lineitem GROUP BY 1)
        SELECT s.item, coalesce(d.quantity, s.cur) AS "current" FROM stock s LEFT JOIN decided d ON d.item = s.item AND d.status = 'applied'""",
)
def _stored_quantities(spark, sf_dir):
    """Stock stored by item after the quantity sets that still found what they expected."""
    folder = scratch(spark, "stored-stock")
    stock, requests = src.stock_requests(spark, sf_dir)
    stored.create(spark, folder, stock, ["item"])
    stored.set_quantities(spark, folder, requests)
    return stored.read(spark, folder)


@query(
    "change_plan",
    sql(
        """SELECT handle, op, store, live, CASE WHEN mode <> 'live' THEN 'write mode is "' || mode || '"' WHEN NOT listed THEN 'store "' || store || '" not in the allow list'
             ELSE 'live mode and store allow-listed' END AS reason FROM (
             SELECT *, mode = 'live' AND listed AS live FROM (
               SELECT n.handle, CASE WHEN c.handle IS NULL THEN 'insert' WHEN c.title = n.title AND c.price = n.price THEN 'noop' ELSE 'update' END AS op,
                 s_name AS store, coalesce(['live', 'live', 'dry-run', NULL][s_suppkey % 4 + 1], 'dry-run') AS mode,
                 s_acctbal > 0 AND s_nationkey % 5 <> 0 AS listed
               FROM (SELECT handle, title, price FROM patches UNION ALL SELECT 'p-' || p_partkey, p_name, p_retailprice FROM part WHERE p_size % 3 = 1) n
               LEFT JOIN catalog c ON c.handle = n.handle
               JOIN supplier ON s_suppkey = CAST(split_part(n.handle, '-', 2) AS BIGINT) % (SELECT count(*) FROM supplier)))""",
        "patches",
        "catalog",
    ),
)
def _change_plan(spark, sf_dir):
    """What would be written where, from changed, new and unchanged products of every store."""
    same = table(spark, sf_dir, "part").where(F.col("p_size") % 3 == 1).select(
        F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("handle"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("price"),
    )
    desired = src.price_patches(spark, sf_dir).unionByName(same)
    stores = src.store_requests(spark, sf_dir)
    count = stores.agg(F.count(F.lit(1))).scalar()
    owner = F.split_part("handle", F.lit("-"), F.lit(2)).cast("bigint")
    placed = desired.withColumn("request", owner % count).join(stores, "request")
    plan = writes.change_plan(catalog(spark, sf_dir), placed, "handle", ["title", "price"], src.allowed_stores(spark, sf_dir))
    return plan.select("handle", "op", "store", "live", "reason")


cte(
    "request_log",
    """SELECT *, CASE WHEN net THEN 'network_error' WHEN status = 429 OR throttled THEN 'throttled' WHEN status NOT BETWEEN 200 AND 299 THEN 'http_' || status
         WHEN errs THEN 'graphql_errors' ELSE 'ok' END AS outcome FROM (
       SELECT event_type AS operation, strftime(ts, '%Y-%m-%d %H') AS hour, event_id % 5 AS attempt, user_id % 2 = 1 AS is_mutation, event_id % 29 = 0 AS net,
         [200, 200, 200, 429, 500, 404, 200][event_id % 7 + 1] AS status, event_id % 17 = 0 AS throttled, event_id % 19 = 0 AS errs, value AS requested,
         CASE WHEN event_id % 23 <> 0 THEN (event_id * 7 % 200)::DOUBLE END AS available, CASE WHEN event_id % 31 = 0 THEN 0.0 ELSE 50.0 END::DOUBLE AS restore FROM events)""",
)


@query(
    "req_outcomes",
    sql(
        """SELECT operation, outcome, count(*) AS attempts, count(*) FILTER (CASE outcome WHEN 'network_error' THEN NOT is_mutation AND attempt < 1
             WHEN 'throttled' THEN attempt < 3 WHEN 'http_500' THEN NOT is_mutation AND attempt < 1 ELSE false END) AS retryable
           FROM request_log GROUP BY 1, 2""",
        "request_log",
    ),
)
def _req_outcomes(spark, sf_dir):
    log = src.request_log(spark, sf_dir).withColumn("outcome", writes.outcome())
    return log.groupBy("operation", "outcome").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(writes.retryable()).alias("retryable")
    )


@query(
    "throttle_report",
    sql(
        """SELECT operation, hour, count(*) AS throttled, CAST(sum(w) AS BIGINT) AS wait_ms, max(w) AS longest_ms FROM (
             SELECT *, CAST(CASE WHEN available IS NOT NULL AND requested - available > 0 AND restore <> 0
               THEN ceil((requested - available) / restore * 1000) + 100 ELSE 1000 * power(2, attempt) END AS BIGINT) AS w
             FROM request_log WHERE outcome = 'throttled') GROUP BY 1, 2""",
        "request_log",
    ),
)
def _throttle_report(spark, sf_dir):
    log = src.request_log(spark, sf_dir).withColumn("outcome", writes.outcome()).where("outcome = 'throttled'")
    return log.groupBy("operation", "hour").agg(
        F.count(F.lit(1)).alias("throttled"),
        F.sum(writes.wait_ms()).alias("wait_ms"),
        F.max(writes.wait_ms()).alias("longest_ms"),
    )


@query(
    "chunk25",
    """SELECT o_custkey AS owner, o_orderkey AS item, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 25 AS batch FROM orders""",
)
def _chunk25(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("item"))
    return writes.write_batches(rows, "owner", "item")


TEMPLATE = "# EXP-XXX · <title>\n| Created | YYYY-MM-DD |\nFile EXP-XXX.md, started YYYY-MM-DD"


@query(
    "next_ids",
    """SELECT id, title, '# ' || id || ' · ' || title || chr(10) || '| Created | 2024-02-01 |' || chr(10) || 'File ' || id || '.md, started YYYY-MM-DD' AS body
       FROM (SELECT c_name AS title, 'EXP-' || CASE WHEN n < 1000 THEN printf('%03d', n) ELSE CAST(n AS VARCHAR) END AS id FROM (
         SELECT c_name, row_number() OVER (ORDER BY c_name) + (SELECT max(s_suppkey) + 1 FROM supplier) AS n FROM customer))""",
)
def _next_ids(spark, sf_dir):
    existing = table(spark, sf_dir, "supplier").select(F.format_string("EXP-%03d", F.col("s_suppkey") + 1).alias("id"))
    titles = table(spark, sf_dir, "customer").select(F.col("c_name").alias("title"))
    return writes.next_ids(existing, titles, "title", TEMPLATE, "2024-02-01")


@query(
    "latest_ok",
    """SELECT sym, arg_max(run, run) AS run, arg_max(score, run) AS score FROM (
         SELECT 'P' || (event_id % 500) AS sym, event_id AS run, value AS score FROM events WHERE event_type <> 'error') GROUP BY 1""",
)
def _latest_ok(spark, sf_dir):
    """Newest successful report per symbol (max_by combines map-side)."""
    done = feeds.report_history(spark, sf_dir).where("status = 'done'")
    newest = F.max_by(F.struct("run", "score"), F.struct("ts", "run"))
    return done.groupBy("sym").agg(newest.alias("r")).select("sym", "r.run", "r.score")


@query(
    "order_pages",
    sql(
        f"""SELECT 'order/' || order_id AS order_id, strftime(dt, '%Y-%m-%d') AS created, CASE WHEN refund > 0 THEN 'PARTIALLY_REFUNDED' ELSE 'PAID' END AS status,
              CAST(subtotal AS DOUBLE) / 10000 AS subtotal, currency, order_id % 9 + 0.5::DOUBLE AS shipping,
              source AS first_source, medium AS utm_medium, campaign AS utm_campaign
            FROM orders_fact WHERE dt >= DATE '1996-10-01'""",
        "orders_fact",
    ),
)
def _order_pages(spark, sf_dir):
    """Orders read back out of landed page documents, from a date on."""
    docs = pages.parse_pages(pages.order_page_docs(spark, sf_dir), pages.ORDER_PAGE_SCHEMA)
    flat = pages.flatten_orders(docs, since="1996-10-01 00:00:00")
    return flat.select(
        "order_id",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        "status",
        F.col("subtotal").cast("double").alias("subtotal"),
        "currency",
        F.col("shipping").cast("double").alias("shipping"),
        "first_source",
        "utm_medium",
        "utm_campaign",
    )


@query(
    "product_pages",
    sql(
        "SELECT 'product/' || pk AS id, handle, title, status, total_inventory, seo_title, seo_description FROM products",
        "products",
    ),
)
def _product_pages(spark, sf_dir):
    docs = pages.parse_pages(pages.product_page_docs(spark, sf_dir), pages.PRODUCT_PAGE_SCHEMA)
    return pages.flatten_products(docs).drop("updated_at")


@query(
    "page_gaps",
    "SELECT 'cursor-' || unnest([p - 1]) AS end_cursor FROM (SELECT unnest(range(0, CAST(ceil((SELECT count(*) FROM part) / 50.0) AS BIGINT))) AS p) WHERE p % 5 = 3",
)
def _page_gaps(spark, sf_dir):
    """Chain check over product pages of which every fifth never landed."""
    docs = pages.product_page_docs(spark, sf_dir).where("page % 5 <> 3")
    return pages.page_gaps(pages.parse_pages(docs, pages.PRODUCT_PAGE_SCHEMA), "products")


def _landed(spark, docs, folder):
    """Product pages landed as files and streamed into stored tables."""
    docs.select("doc").write.text(f"{folder}/files")
    stream = pages.page_stream(spark, f"{folder}/files", pages.PRODUCT_PAGE_SCHEMA)
    flows.land_pages(stream, folder, "products", pages.product_rows, "id")


@query(
    "stream_pages",
    sql(
        "SELECT 'product/' || pk AS id, handle, title, status, total_inventory, seo_title, seo_description FROM products",
        "products",
    ),
)
def _stream_pages(spark, sf_dir):
    folder = scratch(spark, "stream-pages")
    _landed(spark, pages.product_page_docs(spark, sf_dir), folder)
    return stored.read(spark, f"{folder}/rows").drop("landed", "updated_at")


@query(
    "stream_page_gaps",
    "SELECT 'cursor-' || unnest([p - 1]) AS end_cursor FROM (SELECT unnest(range(0, CAST(ceil((SELECT count(*) FROM part) / 50.0) AS BIGINT))) AS p) WHERE p % 5 = 3",
)
def _stream_page_gaps(spark, sf_dir):
    """Chain check carried along with the landing of pages, of which every fifth is missing."""
    folder = scratch(spark, "stream-gaps")
    _landed(spark, pages.product_page_docs(spark, sf_dir).where("page % 5 <> 3"), folder)
    return flows.landed_gaps(spark, folder)


cte(
    "delivered",
    """SELECT event_id AS row_id, epoch_us(ts) AS us, ts, event_type AS topic, event_id % 11 <> 0 AND event_id % 37 <> 0 AS valid,
         CASE WHEN event_id % 46 = 0 THEN NULL WHEN event_id % 69 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'wh-' || event_id
              ELSE 'evt-' || (event_id % (SELECT count(*) // 20 FROM events)) END AS event FROM events""",
)


def _chain_sql(source: str) -> str:
    """Greedy acceptance by stepping from each accepted row to the next one past its expiry."""
    return f"""chain AS (
      SELECT id, min(us) AS us FROM {source} GROUP BY 1
      UNION ALL
      SELECT c.id, n.us FROM chain c, LATERAL (SELECT min(r.us) AS us FROM {source} r WHERE r.id = c.id AND r.us >= c.us + 172800000000) n WHERE n.us IS NOT NULL)"""


@query("hmac_ok", sql("SELECT row_id, valid FROM delivered", "delivered"))
def _hmac_ok(spark, sf_dir):
    return dlv.authenticate(feeds.deliveries(spark, sf_dir), feeds.TEST_SECRET).select("row_id", "valid")


@query(
    "ttl_dedupe",
    f"""WITH RECURSIVE claims AS (SELECT event_id % (SELECT count(*) // 20 FROM events) AS id, epoch_us(ts) AS us, event_id FROM events),
        {_chain_sql('claims')}
        SELECT event_id AS row_id, (k.id, k.us) IN (SELECT (id, us) FROM chain) AS accepted FROM claims k""",
)
def _ttl_dedupe(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ids = ev.agg(F.floor(F.count(F.lit(1)) / feeds.REPEATS)).scalar()
    rows = ev.select(
        (F.col("event_id") % ids).alias("id"), feeds.micros(F.col("ts")).alias("us"), F.col("event_id").alias("row_id")
    )
    return ttl_dedupe(rows)


def _delivered_sql(body: str) -> str:
    base = sql("", "delivered").strip().removeprefix("WITH ")
    return f"""WITH RECURSIVE {base}, claims AS (SELECT event AS id, us FROM delivered WHERE valid AND event IS NOT NULL),
      {_chain_sql('claims')},
      handled AS (SELECT *, CASE WHEN NOT valid THEN 'invalid_hmac' WHEN event IS NULL THEN 'no_event_id'
          WHEN (event, us) IN (SELECT (id, us) FROM chain) THEN 'process' ELSE 'duplicate' END AS reason FROM delivered)
      {body}"""


@query(
    "deliveries",
    _delivered_sql(
        """SELECT row_id, topic, event, CASE WHEN valid THEN 200 ELSE 401 END AS status, reason IN ('no_event_id', 'process') AS process, reason FROM handled"""
    ),
)
def _deliveries(spark, sf_dir):
    return dlv.handle(feeds.deliveries(spark, sf_dir), feeds.TEST_SECRET).drop("us")


@query(
    "delivery_stats",
    _delivered_sql("SELECT strftime(ts, '%Y-%m-%d %H') AS hour, topic, reason, count(*) AS deliveries FROM handled GROUP BY 1, 2, 3"),
)
def _delivery_stats(spark, sf_dir):
    done = dlv.handle(feeds.deliveries(spark, sf_dir), feeds.TEST_SECRET)
    hour = F.date_format(F.window(F.timestamp_micros("us"), "1 hour")["start"], "yyyy-MM-dd HH")
    return done.groupBy(hour.alias("hour"), "topic", "reason").agg(F.count(F.lit(1)).alias("deliveries"))


@query(
    "clamped_state",
    """SELECT sym, off AS offset_micro, CASE WHEN off > prev THEN 'up' ELSE 'down' END AS dir, n AS ticks FROM (
         SELECT sym, n, list_reduce([0::BIGINT] || steps, lambda a, s: greatest(-60000, least(60000, a + s))) AS off,
           list_reduce([0::BIGINT] || steps[:-2], lambda a, s: greatest(-60000, least(60000, a + s))) AS prev FROM (
             SELECT 'P' || (user_id % 60) AS sym, count(*) AS n,
               list(CAST(floor(value * 100) AS BIGINT) * 37 % 24001 - 12000 ORDER BY event_id) AS steps FROM events GROUP BY 1))""",
)
def _clamped_state(spark, sf_dir):
    return offsets.clamped_offsets(feeds.offset_steps(spark, sf_dir))


@query(
    "stream_daily",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (event_type = 'view') AS sessions,
         count(*) FILTER (event_type = 'purchase') AS orders,
         coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'purchase'), 0)::DOUBLE / 100 AS revenue
       FROM events GROUP BY 1""",
)
def _stream_daily(spark, sf_dir):
    """Event files streamed through the daily aggregation into a table, then read back."""
    folder = scratch(spark, "stream-daily")
    flows.run_to_table(flows.daily_metrics(flows.event_stream(spark, f"{sf_dir}/events.parquet")), folder, "update")
    days = flows.latest_per_key(spark, folder, ["day"], ["events", "sessions", "orders", "cents"])
    return days.select("day", "events", "sessions", "orders", (F.col("cents") / 100).alias("revenue"))


@query(
    "stream_refunds",
    """WITH o AS (SELECT o_orderkey, o_orderdate FROM orders),
         r AS (SELECT l_orderkey, l_shipdate, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem WHERE l_returnflag = 'R'),
         seen AS (SELECT least((SELECT max(o_orderdate) FROM o), (SELECT max(l_shipdate) FROM r)) AS newest)
       SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS refunds, CAST(sum(cents) AS BIGINT) AS cents
       FROM o JOIN r ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 14 DAY, seen
       WHERE date_trunc('day', o_orderdate) + INTERVAL 1 DAY < newest - INTERVAL 28 DAY GROUP BY 1""",
)
def _stream_refunds(spark, sf_dir):
    """Orders and returned lines streamed through the interval join; days whose refunds are settled."""
    placed = flows.table_stream(spark, f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp").alias("ordered_at"))
    lines = flows.table_stream(spark, f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'")
    back = lines.select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").cast("timestamp").alias("refunded_at"), cents(F.col("l_extendedprice")).alias("cents"))
    folder = scratch(spark, "stream-refunds")
    flows.run_to_table(flows.settled_refunds(placed, back), folder)
    return spark.read.parquet(f"{folder}/rows").select("day", "refunds", "cents")


@query(
    "live_board",
    sql(
        """SELECT sym, ord, prev_close * (1 + day_move + off / 1e6::DOUBLE) AS price,
             (prev_close * (1 + day_move + off / 1e6::DOUBLE) - prev_close) / prev_close * 100 AS chg_pct, CASE WHEN off > prev THEN 'up' ELSE 'down' END AS dir FROM (
             SELECT sym, ord, list_reduce([0::BIGINT] || steps, lambda a, s: greatest(-60000, least(60000, a + s))) AS off,
               list_reduce([0::BIGINT] || steps[:-2], lambda a, s: greatest(-60000, least(60000, a + s))) AS prev FROM (
                 SELECT 'P' || (user_id % 60) AS sym, max(event_id) AS ord,
                   list(CAST(floor(value * 100) AS BIGINT) * 37 % 24001 - 12000 ORDER BY event_id) AS steps FROM events GROUP BY 1))
           JOIN (SELECT i.sym, coalesce(prior_px, last_px, base) AS prev_close, coalesce(last_px / coalesce(prior_px, last_px) - 1, 0) AS day_move
                 FROM instruments i LEFT JOIN last_two t ON t.pk = i.ord) USING (sym)
           WHERE sym IN (SELECT sym FROM holdings)""",
        "instruments",
        "last_two",
        "holdings",
    ),
)
def _live_board(spark, sf_dir):
    """Offsets streamed into the table of the newest quote of every held symbol."""
    folder = scratch(spark, "live-board")
    held = lambda: market.account_lines(spark, sf_dir).select(market.symbol(F.col("l_partkey")).alias("sym"))
    steps = feeds.steps_of(flows.event_stream(spark, f"{sf_dir}/events.parquet"))
    quotes = flows.live_quotes(offset_stream(steps), market.quote_inputs(spark, sf_dir))
    flows.run_to_latest(quotes, folder, ["sym"], "ord", held)
    return flows.latest_version(spark, folder)


@query(
    "stream_delivery_stats",
    _delivered_sql(
        """SELECT strftime(ts, '%Y-%m-%d %H') AS hour, topic, reason, count(*) AS deliveries FROM handled
           WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM handled) - INTERVAL 1 HOUR GROUP BY 1, 2, 3"""
    ),
)
def _stream_delivery_stats(spark, sf_dir):
    """Deliveries streamed through signature check, claims and hourly windows in one query; hours that are complete."""
    ids = max(table(spark, sf_dir, "events").count() // feeds.REPEATS, 1)
    streamed = feeds.deliveries_of(flows.spread(flows.event_stream(spark, f"{sf_dir}/events.parquet")), F.lit(ids))
    folder = scratch(spark, "stream-deliveries")
    flows.run_to_table(flows.delivery_stats(streamed, feeds.TEST_SECRET), folder)
    hour = F.date_format("hour", "yyyy-MM-dd HH").alias("hour")
    return spark.read.parquet(f"{folder}/rows").select(hour, "topic", "reason", "deliveries")


@query("stream_watch", _LISTS)
def _stream_watch(spark, sf_dir):
    """Watchlist edits streamed through keyed state into a table stored by user and symbol."""
    folder = scratch(spark, "stream-watch")
    edits = src.edits_of(flows.event_stream(spark, f"{sf_dir}/events.parquet"))
    flows.run_to_stored(watch_stream(edits), folder, ["user_id", "sym"], "ord")
    listed = stored.read(spark, f"{folder}/table").where("place IS NOT NULL")
    ranked = rank_within(listed.select("user_id", "sym", "place"), ["user_id"], ["place"], "at")
    return ranked.select("user_id", "sym", (F.col("at") - 1).alias("ord"), (F.col("at") == 1).alias("selected"))
