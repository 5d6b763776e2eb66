"""Price-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import series as ops
from ledgerloom.plans.market import quote_rows
from ledgerloom.plans.registry import query
from ledgerloom.plans.sql import fixed, sql
from ledgerloom.sources import market
from ledgerloom.sources.tables import table

WALK_SCALE = 1000.0


@query(
    "time_axis",
    sql(
        """SELECT sector, range_id, i,
             CASE WHEN range_id = '1D' THEN strftime(TIMESTAMP '2000-01-01 09:30:00' + to_minutes(5 * i), '%-I:%M %p')
                  WHEN range_id = '1Y' THEN strftime(d, '%b %-d, %Y') ELSE strftime(d, '%b %-d') END AS label
           FROM (SELECT *, anchor - CAST(floor(days * (1 - i / (pts - 1)::DOUBLE) + 0.5) AS INTEGER) AS d FROM (
             SELECT sector, anchor, range_id, pts, days, unnest(range(0, pts)) AS i FROM
               (SELECT p_type AS sector, max(CAST(l_shipdate AS DATE)) AS anchor FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
               (VALUES ('1D', 78, 1), ('1W', 70, 7), ('1M', 64, 30), ('3M', 66, 91), ('1Y', 120, 365)) r(range_id, pts, days)))"""
    ),
)
def _time_axis(spark, sf_dir):
    """Axis labels per sector, anchored at the sector's last trading date."""
    last = market.last_two(market.prices(spark, sf_dir)).select(F.col("pk").alias("p_partkey"), "last_dt")
    anchors = (
        table(spark, sf_dir, "part")
        .join(last, "p_partkey")
        .groupBy(F.col("p_type").alias("sector"))
        .agg(F.max("last_dt").alias("anchor"))
    )
    return ops.time_axis(anchors, "sector")


@query(
    "minmax_norm",
    sql(
        """SELECT sym, i, (price - lo) / CASE WHEN hi - lo = 0 THEN 1 ELSE hi - lo END AS norm FROM (
             SELECT *, min(price) OVER (PARTITION BY pk) AS lo, max(price) OVER (PARTITION BY pk) AS hi FROM series)""",
        "series",
    ),
)
def _minmax_norm(spark, sf_dir):
    return ops.minmax_norm(market.price_series(spark, sf_dir)).select("sym", "i", "norm")


@query(
    "range_52w",
    sql(
        """SELECT sym, hi AS hi52, lo AS lo52, (price - lo) / nullif(hi - lo, 0) * 100 AS pos52 FROM (
             SELECT q.sym, q.price, greatest(h, q.price) AS hi, least(l, q.price) AS lo FROM quotes q JOIN (
               SELECT pk, max(price) AS h, min(price) AS l FROM ranged WHERE range_id = '1Y' GROUP BY 1) g ON g.pk = q.ord)""",
        "ranged",
        "quotes",
    ),
)
def _range_52w(spark, sf_dir):
    year = ops.in_ranges(market.prices(spark, sf_dir)).where("range_id = '1Y'")
    return ops.high_low(year, quote_rows(spark, sf_dir))


@query(
    "price_bins",
    sql(
        """SELECT sym, bin, lo + (bin + 0.5) / 4 * (hi - lo) AS tick,
             (SELECT count(*) FROM unnest(pts) u(p) WHERE floor((p - lo) / (hi - lo) * 4) = bin) AS points FROM (
           SELECT sym, pts, l - pad AS lo, h + pad AS hi, unnest(range(0, 4)) AS bin FROM (
             SELECT sym, pts, l, h, CASE WHEN h - l = 0 THEN 1.0::DOUBLE ELSE (h - l) * 0.08::DOUBLE END AS pad FROM (
               SELECT s.sym, list(s.price) AS pts, least(min(s.price), any_value(q.prev_close)) AS l,
                      greatest(max(s.price), any_value(q.prev_close)) AS h
               FROM series s JOIN quotes q ON q.ord = s.pk GROUP BY 1)))""",
        "series",
        "quotes",
    ),
)
def _price_bins(spark, sf_dir):
    return ops.price_bins(market.prices(spark, sf_dir), quote_rows(spark, sf_dir))


@query(
    "cum_walk",
    sql(
        """SELECT sym, i, CAST(sum(lean) OVER w - first_value(lean) OVER w AS BIGINT) AS walk FROM series
           WINDOW w AS (PARTITION BY pk ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "series",
    ),
)
def _cum_walk(spark, sf_dir):
    return ops.cumulative_walk(market.price_series(spark, sf_dir), "lean").select("sym", "i", "walk")


@query(
    "bridge",
    sql(
        """SELECT sym, i, last_px * (1 + walk / 1000.0::DOUBLE - endw / 1000.0::DOUBLE
             * coalesce(CAST(i AS DOUBLE) / nullif(n - 1, 0), 0)) AS bridged FROM (
             SELECT *, last_value(walk) OVER f AS endw, last_value(price) OVER f AS last_px FROM (
               SELECT *, CAST(sum(lean) OVER w - first_value(lean) OVER w AS BIGINT) AS walk FROM series
               WINDOW w AS (PARTITION BY pk ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
             WINDOW f AS (PARTITION BY pk ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
        "series",
    ),
)
def _bridge(spark, sf_dir):
    walked = ops.cumulative_walk(market.price_series(spark, sf_dir), "lean")
    return ops.bridge(walked, WALK_SCALE).select("sym", "i", "bridged")


@query(
    "series_patch",
    sql(
        """SELECT sym, range_id, i, CASE WHEN i = 0 AND range_id = '1D' THEN prev_close WHEN i = n - 1 THEN live ELSE price END AS price
           FROM (SELECT r.sym, range_id, r.price, q.prev_close, q.price AS live,
                   row_number() OVER (PARTITION BY pk, range_id ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY pk, range_id) AS n
                 FROM ranged r JOIN quotes q ON q.ord = r.pk)""",
        "ranged",
        "quotes",
    ),
)
def _series_patch(spark, sf_dir):
    ranged = ops.in_ranges(market.prices(spark, sf_dir))
    return ops.patch(ranged, quote_rows(spark, sf_dir))


@query("range_change", sql("SELECT sym, range_id, chg, chg_pct FROM perf", "perf"))
def _range_change(spark, sf_dir):
    ranged = ops.in_ranges(market.prices(spark, sf_dir))
    return ops.performance(ranged, quote_rows(spark, sf_dir)).drop("range_ord")


@query("perf_ranges", sql("SELECT sym, range_id, chg_pct FROM perf", "perf"))
def _perf_ranges(spark, sf_dir):
    ranged = ops.in_ranges(market.prices(spark, sf_dir))
    return ops.performance(ranged, quote_rows(spark, sf_dir)).select("sym", "range_id", "chg_pct")


@query(
    "perf_string",
    sql(
        f"""SELECT sym, string_agg(range_id || ': ' || {fixed('chg_pct', 1)} || '%', ', ' ORDER BY range_ord) AS perf
            FROM perf GROUP BY 1""",
        "perf",
    ),
)
def _perf_string(spark, sf_dir):
    ranged = ops.in_ranges(market.prices(spark, sf_dir))
    return ops.performance_text(ops.performance(ranged, quote_rows(spark, sf_dir)))


@query(
    "trailing20",
    sql(
        """SELECT sym, range_id, max(px) AS hi, min(px) AS lo FROM (
             SELECT sym, range_id, i, n, CASE WHEN i = 0 AND range_id = '1D' THEN prev_close WHEN i = n - 1 THEN live ELSE price END AS px
             FROM (SELECT r.sym, range_id, r.price, q.prev_close, q.price AS live,
                     row_number() OVER (PARTITION BY pk, range_id ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY pk, range_id) AS n
                   FROM ranged r JOIN quotes q ON q.ord = r.pk))
           WHERE range_id = '1D' OR i >= n - 20 GROUP BY 1, 2""",
        "ranged",
        "quotes",
    ),
)
def _trailing20(spark, sf_dir):
    """High and low of the last twenty points of each range, of all points for the day."""
    return ops.trailing_range(ops.in_ranges(market.prices(spark, sf_dir)), quote_rows(spark, sf_dir))


@query(
    "open_px",
    sql(
        """SELECT q.sym, max(s.price) FILTER (s.i = 1) AS open_1d, any_value(q.prev_close) * 1.001 AS open_other
           FROM series s JOIN quotes q ON q.ord = s.pk GROUP BY 1""",
        "series",
        "quotes",
    ),
)
def _open_px(spark, sf_dir):
    return ops.open_price(market.price_series(spark, sf_dir), quote_rows(spark, sf_dir))


@query(
    "frac_sample",
    sql(
        """SELECT sym, f.fraction::DOUBLE AS fraction, i, price FROM series
           JOIN (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) f(fraction) ON i = floor(f.fraction::DOUBLE * (n - 1) + 0.5)""",
        "series",
    ),
)
def _frac_sample(spark, sf_dir):
    return ops.fraction_sample(market.price_series(spark, sf_dir))


@query(
    "asof_nearest",
    sql(
        """SELECT pk, strftime(d, '%Y-%m-%d') AS pick_dt,
             strftime(CASE WHEN after_dt IS NULL OR d - before_dt < after_dt - d THEN before_dt ELSE after_dt END, '%Y-%m-%d') AS price_dt,
             CASE WHEN after_dt IS NULL OR d - before_dt < after_dt - d THEN before_px ELSE after_px END AS price
           FROM (SELECT k.pk, k.d, b.dt AS before_dt, b.price AS before_px, a.dt AS after_dt, a.price AS after_px
             FROM (SELECT DISTINCT l_partkey AS pk, CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) k
             ASOF LEFT JOIN prices b ON b.pk = k.pk AND k.d >= b.dt
             ASOF LEFT JOIN prices a ON a.pk = k.pk AND k.d <= a.dt)""",
        "prices",
    ),
)
def _asof_nearest(spark, sf_dir):
    """Nearest traded price to each date a part was ordered on."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("pk"))
    od = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("dt"))
    picks = li.join(od, li.l_orderkey == od.o_orderkey).select("pk", "dt")
    near = ops.nearest_price(picks, market.prices(spark, sf_dir))
    return near.select(
        "pk",
        F.date_format("pick_dt", "yyyy-MM-dd").alias("pick_dt"),
        F.date_format("price_dt", "yyyy-MM-dd").alias("price_dt"),
        "price",
    )
