"""Market-desk queries: quotes, screens, portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import round_scaled
from ledgerloom.operators import portfolio, quotes, screener
from ledgerloom.operators.edits import apply_watch_edits
from ledgerloom.plans.registry import query
from ledgerloom.plans.sql import cte, fixed, grouped, sql
from ledgerloom.sources import market
from ledgerloom.sources.tables import table

SEARCH = " SM "  # trimmed and lower-cased by the screen; hits names and one sector at different levels


def quote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.derive_quote(market.quote_inputs(spark, sf_dir))


def screen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_rows(spark, sf_dir).withColumn("heat", quotes.heat(F.col("chg_pct"), F.col("mcap_num")))


@query("quotes", sql("SELECT sym, price, prev_close, chg, chg_pct FROM quotes", "quotes"))
def _quotes(spark, sf_dir):
    return quote_rows(spark, sf_dir).select("sym", "price", "prev_close", "chg", "chg_pct")


cte(
    "scored",
    """SELECT *, CASE WHEN lower(sym) = 'sm' THEN 100 WHEN starts_with(lower(sym), 'sm') THEN 80
         WHEN contains(lower(sym), 'sm') THEN 60
         WHEN len(list_filter(string_split(lower(name), ' '), lambda w: starts_with(w, 'sm'))) > 0 THEN 50
         WHEN contains(lower(name), 'sm') THEN 34 WHEN starts_with(lower(sector), 'sm') THEN 22
         WHEN contains(lower(sector), 'sm') THEN 14 ELSE 0 END AS score FROM screen""",
    "screen",
)


@query("rel_score", sql("SELECT sym, score FROM scored", "scored"))
def _rel_score(spark, sf_dir):
    return market.listing(spark, sf_dir).select("sym", screener.rel_score(SEARCH.strip().lower()).alias("score"))


@query(
    "screen_filter",
    sql("SELECT sym, name, sector, score FROM scored WHERE sector = 'ECONOMY' AND score > 0", "scored"),
)
def _screen_filter(spark, sf_dir):
    return screener.screen(screen_rows(spark, sf_dir), SEARCH, "ECONOMY").select("sym", "name", "sector", "score")


def _ranked_query(name: str, sort: str, order_sql: str, search: str, where_sql: str) -> None:
    measure = {"relevance": "heat", "gainers": "chg_pct", "losers": "chg_pct", "mcap": "mcap_num", "alpha": "base"}[sort]

    @query(
        name,
        sql(
            f"""SELECT sym, score, round({measure}, 6) AS measure, row_number() OVER (ORDER BY {order_sql}, ord) AS rank
            FROM {where_sql}""",
            "scored",
        ),
    )
    def _run(spark, sf_dir):
        rows = screener.screen(screen_rows(spark, sf_dir), search)
        return screener.ranked(rows, sort).select("sym", "score", round_scaled(F.col(measure), 6).alias("measure"), "rank")


_ALL = "(SELECT * REPLACE (0 AS score) FROM scored)"
_HITS = "(SELECT * FROM scored WHERE score > 0)"
_ranked_query("screen_relevance", "relevance", "score DESC, heat DESC NULLS LAST", SEARCH, _HITS)
_ranked_query("screen_gainers", "gainers", "chg_pct DESC NULLS LAST", "", _ALL)
_ranked_query("screen_losers", "losers", "chg_pct ASC NULLS LAST", "", _ALL)
_ranked_query("screen_mcap", "mcap", "mcap_num DESC NULLS LAST", "", _ALL)
_ranked_query("screen_alpha", "alpha", "sym", "", _ALL)


@query(
    "screen_names",
    """SELECT 'P' || ord AS sym, name, row_number() OVER (ORDER BY name COLLATE en, name, ord) AS rank FROM (
         SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'é') WHEN 2 THEN replace(p_name, ' ', '-') ELSE p_name END AS name
         FROM part)""",
)
def _screen_names(spark, sf_dir):
    """Names of mixed case and accents in alphabetical order."""
    k, name = F.col("ord") % 4, F.col("name")
    mixed = F.when(k == 0, F.upper(name)).when(k == 1, F.replace(name, F.lit("e"), F.lit("é"))).when(k == 2, F.replace(name, F.lit(" "), F.lit("-"))).otherwise(name)
    rows = market.listing(spark, sf_dir).withColumn("name", mixed)
    return screener.ranked(rows, "names").select("sym", "name", "rank")


@query(
    "screen_page",
    sql(
        """SELECT sym, rank, page FROM (
             SELECT sym, row_number() OVER (ORDER BY heat DESC NULLS LAST, ord) AS rank, count(*) OVER () AS n, 2::BIGINT AS page FROM scored)
           WHERE (rank - 1) // 25 = least(2, greatest(1, CAST(ceil(n / 25.0) AS BIGINT)) - 1)""",
        "scored",
    ),
)
def _screen_page(spark, sf_dir):
    """The third page of the default screen."""
    return screener.page(screener.screen(screen_rows(spark, sf_dir)), "relevance", 2).select("sym", "rank", "page")


@query(
    "screen_count",
    sql("SELECT count(*) FILTER (score > 0) AS matched, count(*) AS universe FROM scored", "scored"),
)
def _screen_count(spark, sf_dir):
    score = screener.rel_score(SEARCH.strip().lower())
    return market.listing(spark, sf_dir).agg(F.count_if(score > 0).alias("matched"), F.count(F.lit(1)).alias("universe"))


@query("sectors", "SELECT DISTINCT p_type AS sector FROM part")
def _sectors(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("sector")).distinct().orderBy("sector")


@query(
    "in_watch",
    sql(
        """SELECT i.sym, w.sym IS NOT NULL AS in_watch FROM instruments i
           LEFT JOIN (SELECT DISTINCT sym FROM watch) w ON w.sym = i.sym""",
        "instruments",
        "watch",
    ),
)
def _in_watch(spark, sf_dir):
    members = market.watch(spark, sf_dir).select("sym").distinct().withColumn("hit", F.lit(True))
    rows = table(spark, sf_dir, "part").select(market.symbol(F.col("p_partkey")).alias("sym"))
    return rows.join(members, "sym", "left").select("sym", F.col("hit").isNotNull().alias("in_watch"))


@query(
    "universe_union",
    sql("SELECT ord, sym, name, sector, curated FROM instruments", "instruments"),
)
def _universe_union(spark, sf_dir):
    """Curated instruments followed by the rest, keeping duplicates (UNION ALL)."""
    cols = ["ord", "sym", "name", "sector", "curated"]
    rows = market.listing(spark, sf_dir).select(*cols)
    return rows.where("curated").unionByName(rows.where("NOT curated"))


def sector_indices(quote_df: DataFrame) -> DataFrame:
    """One equal-weight index per sector; indices carry no sector, cap or P/E of their own."""
    total = lambda c: F.sum(F.col(c).cast("decimal(28,8)")).cast("double")
    n = F.count(F.lit(1))
    return (
        quote_df.groupBy(F.col("sector").alias("sym"))
        .agg((total("price") / n * 10).alias("price"), (total("prev_close") / n * 10).alias("prev_close"))
        .withColumn("chg_pct", (F.col("price") - F.col("prev_close")) / F.col("prev_close") * 100)
        .withColumn("ord", F.lit(-1).cast("bigint"))
    )


cte(
    "tape",
    """SELECT ord, 1 AS kind, sym, sector, price, chg_pct, mcap_num FROM quotes
       UNION ALL
       SELECT -1, 0, sym, NULL, price, (price - prev_close) / prev_close * 100, NULL FROM (
         SELECT sector AS sym, CAST(sum(CAST(price AS DECIMAL(28,8))) AS DOUBLE) / count(*) * 10 AS price,
                CAST(sum(CAST(prev_close AS DECIMAL(28,8))) AS DOUBLE) / count(*) * 10 AS prev_close
         FROM quotes GROUP BY 1)""",
    "quotes",
)


@query(
    "tape_board",
    sql(
        f"""SELECT ord, kind, sym, sector,
          CASE WHEN price > 5000 THEN {grouped('price', 1)} ELSE {grouped('price', 2)} END AS price_text,
          CASE WHEN chg_pct >= 0 THEN '+' ELSE '−' END || {grouped('abs(chg_pct)', 2)} AS chg_text,
          CASE WHEN mcap_num >= 1e12 THEN {fixed('mcap_num / 1e12', 2)} || 'T'
               WHEN mcap_num >= 1e9 THEN {fixed('mcap_num / 1e9', 1)} || 'B'
               ELSE {fixed('mcap_num / 1e6', 0)} || 'M' END AS cap_text,
          {grouped('abs(chg_pct)', 2)} AS move_text,
          CASE WHEN chg_pct >= 0 THEN 'up' ELSE 'down' END AS dir FROM tape""",
        "tape",
    ),
)
def _tape_board(spark, sf_dir):
    """Indices then stocks, with display columns."""
    stocks = quote_rows(spark, sf_dir)
    both = (
        sector_indices(stocks)
        .withColumn("kind", F.lit(0))
        .unionByName(stocks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    )
    return quotes.tape_columns(both)


@query(
    "tick_set",
    sql(
        """SELECT sym FROM (SELECT unnest(list_filter(string_split(list_reduce([','] || log, lambda a, x: CASE
               WHEN x[1] = 'a' THEN CASE WHEN contains(a, ',' || x[3:] || ',') THEN a ELSE a || x[3:] || ',' END
               WHEN length(a) - length(replace(a, ',', '')) <= 2 THEN a
               ELSE replace(a, ',' || x[3:] || ',', ',') END), ','), lambda s: s <> '')) AS sym
             FROM (SELECT user_id, list(CASE WHEN event_type = 'click' THEN 'a:' ELSE 'r:' END || 'P' || (CAST(json_extract_string(props, '$.k') AS BIGINT) + user_id * 100)
                     ORDER BY event_id) AS log
                   FROM events WHERE event_type IN ('click', 'view') AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1))
           UNION SELECT sym FROM holdings""",
        "holdings",
    ),
)
def _tick_set(spark, sf_dir):
    """Symbols to tick: those on a watchlist after all its edits, and those held; the two come from different logs."""
    held = market.account_lines(spark, sf_dir).select(F.col("l_partkey").alias("pk")).distinct()
    watched = apply_watch_edits(market.watch_edits(spark, sf_dir)).select("sym")
    return watched.union(held.select(market.symbol(F.col("pk")).alias("sym"))).distinct()


@query(
    "live_or_snapshot",
    sql(
        """SELECT s.sym, coalesce(l.price, s.base) AS price, l.sym IS NOT NULL AS live FROM instruments s
           LEFT JOIN (SELECT sym, price FROM quotes WHERE sym IN (SELECT sym FROM watch)) l ON l.sym = s.sym""",
        "instruments",
        "quotes",
        "watch",
    ),
)
def _live_or_snapshot(spark, sf_dir):
    """Live quote when the symbol is watched, else the captured base row."""
    watched = market.watch(spark, sf_dir).select("sym").distinct()
    live = quote_rows(spark, sf_dir).select("sym", "price").join(watched, "sym", "left_semi")
    snap = table(spark, sf_dir, "part").select(
        market.symbol(F.col("p_partkey")).alias("sym"), F.col("p_retailprice").alias("base")
    )
    return snap.join(live, "sym", "left").select(
        "sym", F.coalesce("price", "base").alias("price"), F.col("price").isNotNull().alias("live")
    )


@query(
    "lookup_last_wins",
    """SELECT p_name AS name, max(p_partkey) AS ord, arg_max(p_retailprice, p_partkey) AS base,
       arg_max(p_type, p_partkey) AS sector FROM part GROUP BY 1""",
)
def _lookup_last_wins(spark, sf_dir):
    """Lookup table keyed by name; the last duplicate wins (max_by combines map-side)."""
    last = F.max_by(F.struct("p_partkey", "p_retailprice", "p_type"), "p_partkey")
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_name").alias("name"))
        .agg(last.alias("r"))
        .select("name", F.col("r.p_partkey").alias("ord"), F.col("r.p_retailprice").alias("base"), F.col("r.p_type").alias("sector"))
    )


_BLURB_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quotes.SECTOR_BLURBS.items())


@query(
    "lookup_default",
    f"""SELECT c_custkey, segment, CASE segment {_BLURB_SQL} ELSE '{quotes.DEFAULT_BLURB}' END AS blurb FROM (
          SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Industrials' WHEN 'FURNITURE' THEN 'Consumer'
            WHEN 'AUTOMOBILE' THEN 'Technology' ELSE c_mktsegment END AS segment FROM customer)""",
)
def _lookup_default(spark, sf_dir):
    names = {"MACHINERY": "Industrials", "FURNITURE": "Consumer", "AUTOMOBILE": "Technology"}
    seg = F.col("c_mktsegment")
    for raw, sector in names.items():
        seg = F.when(F.col("c_mktsegment") == raw, sector).otherwise(seg)
    rows = table(spark, sf_dir, "customer").select("c_custkey", seg.alias("segment"))
    return rows.withColumn("blurb", quotes.lookup(F.col("segment"), quotes.SECTOR_BLURBS, quotes.DEFAULT_BLURB))


@query(
    "eps",
    sql(
        """SELECT sym, pe, price / coalesce(nullif(try_cast(pe AS DOUBLE), 0), 25) AS eps FROM quotes""",
        "quotes",
    ),
)
def _eps(spark, sf_dir):
    return quote_rows(spark, sf_dir).select("sym", "pe", quotes.eps(F.col("price"), F.col("pe")).alias("eps"))


@query(
    "market_open",
    "SELECT event_id, hour(ts) >= 9 AND hour(ts) < 16 AS is_open FROM events",
)
def _market_open(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", quotes.market_open(F.col("ts")).alias("is_open"))


def position_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.positions(market.holdings(spark, sf_dir), quote_rows(spark, sf_dir), key="ord")


@query(
    "positions",
    sql(
        """SELECT account, sym, mv, cost_basis, mv - cost_basis AS pl, (mv - cost_basis) / nullif(cost_basis, 0) * 100 AS pl_pct,
           day_pl, price IS NULL AS missing_quote FROM positions""",
        "positions",
    ),
)
def _positions(spark, sf_dir):
    return position_rows(spark, sf_dir).select(
        "account", "sym", "mv", "cost_basis", "pl", "pl_pct", "day_pl", "missing_quote"
    )


@query(
    "portfolio_totals",
    sql(
        """SELECT account, CAST(mv AS DOUBLE) AS tot_mv, CAST(cost AS DOUBLE) AS tot_cost, CAST(mv - cost AS DOUBLE) AS tot_pl,
           CAST(day AS DOUBLE) AS tot_day, CAST(mv - cost AS DOUBLE) / CAST(cost AS DOUBLE) * 100 AS tot_pl_pct FROM (
             SELECT account, sum(CAST(mv AS DECIMAL(28,8))) AS mv, sum(CAST(cost_basis AS DECIMAL(28,8))) AS cost,
                    sum(CAST(day_pl AS DECIMAL(28,8))) AS day FROM positions GROUP BY ROLLUP (account))""",
        "positions",
    ),
)
def _portfolio_totals(spark, sf_dir):
    return portfolio.totals(position_rows(spark, sf_dir))


@query(
    "weights",
    sql(
        """SELECT account, sym, mv / CAST(sum(CAST(mv AS DECIMAL(28,8))) OVER (PARTITION BY account) AS DOUBLE) * 100 AS weight_pct
           FROM positions""",
        "positions",
    ),
)
def _weights(spark, sf_dir):
    return portfolio.weights(position_rows(spark, sf_dir))
