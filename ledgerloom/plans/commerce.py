"""Commerce metric, session, experiment and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.numeric import cents
from ledgerloom.functions.web import utm_fields
from ledgerloom.operators import metrics, quality, sessions
from ledgerloom.plans.registry import query
from ledgerloom.plans.sql import cte, fixed, sql
from ledgerloom.sources import commerce
from ledgerloom.sources.tables import table
from ledgerloom.sources.writes import products

cte(
    "slotted_sessions",
    """SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session_no,
         count(*) OVER (PARTITION BY user_id, us // 3600000000) AS in_hour FROM (
       SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= 1800000000 THEN 0 ELSE 1 END AS starts
       FROM (SELECT *, epoch_us(ts) AS us FROM events))""",
)
cte(
    "sessions",
    """SELECT user_id, session_no, min(ts) AS s, max(ts) AS e, count(*) AS n, count(*) FILTER (event_type = 'click') AS carts,
         count(*) FILTER (event_type = 'signup') AS checkouts, count(*) FILTER (event_type = 'purchase') AS orders,
         coalesce(CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'purchase') AS BIGINT), 0) AS cents,
         max(in_hour) AS peak
       FROM slotted_sessions GROUP BY 1, 2""",
    "slotted_sessions",
)
cte(
    "orders_fact",
    """SELECT o_orderkey AS order_id, o_custkey AS customer, CAST(o_orderdate AS DATE) AS dt, strftime(o_orderdate, '%Y-%m') AS month,
         o_orderpriority AS source, o_orderstatus AS medium, c_mktsegment AS campaign, 'shop-' || n_regionkey AS shop,
         ['USD', 'USD', 'JPY', 'EUR', 'AED'][n_regionkey + 1] AS shop_currency,
         CASE WHEN n_nationkey % 6 = 5 THEN 'GBP' ELSE ['USD', 'USD', 'JPY', 'EUR', 'AED'][n_regionkey + 1] END AS currency,
         coalesce(subtotal, 0) AS subtotal, coalesce(discount, 0) AS discount, coalesce(refund, 0) AS refund
       FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
       LEFT JOIN (SELECT l_orderkey, sum(x * 100) AS subtotal, sum(x * d) AS discount, coalesce(sum(x * (100 - d)) FILTER (l_returnflag = 'R'), 0) AS refund
             FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS x, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem)
             GROUP BY 1) ON l_orderkey = o_orderkey""",
)


def _period_cte(name: str, key: str) -> None:
    cte(
        name,
        f"""SELECT *, revenue * 0.4 AS cogs, orders * 0.5::DOUBLE AS shipping_cost, revenue * 0.029 + orders * 0.3::DOUBLE AS fees FROM (
          SELECT {key} AS period,
            coalesce(sum(x) FILTER (event_type = 'purchase'), 0)::DOUBLE / 100 AS revenue, count(*) FILTER (event_type = 'purchase') AS orders,
            count(*) FILTER (event_type = 'view') AS sessions, count(*) FILTER (event_type = 'click') AS clicks,
            coalesce(sum(x) FILTER (event_type = 'error'), 0)::DOUBLE / 100 AS refunds,
            sum(x) FILTER (event_type = 'click')::DOUBLE / 100 AS ad_spend,
            sum(x) FILTER (event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INT) >= 50)::DOUBLE / 100 AS attributed_revenue,
            count(*) FILTER (event_type = 'signup') AS new_customers
          FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS x FROM events) GROUP BY 1)""",
    )


_period_cte("by_week", "strftime(date_trunc('week', ts), '%Y-%m-%d')")
_period_cte("by_day", "strftime(ts, '%Y-%m-%d')")
cte(
    "summary_week",
    """SELECT period, revenue, orders::DOUBLE AS orders, revenue / nullif(orders, 0) AS aov, orders / nullif(sessions, 0) AS conversion_rate,
         attributed_revenue / nullif(ad_spend, 0) AS roas, ad_spend / nullif(new_customers, 0) AS cac,
         refunds / nullif(revenue, 0) AS refund_rate,
         revenue - cogs - shipping_cost - fees - refunds - ad_spend AS contribution FROM by_week""",
    "by_week",
)



def week_totals(spark, sf_dir):
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    return commerce.period_totals(commerce.events(spark, sf_dir), week, "period")


def day_totals(spark, sf_dir):
    return commerce.period_totals(commerce.events(spark, sf_dir), F.date_format("ts", "yyyy-MM-dd"), "period")


@query(
    "sessions",
    sql(
        """SELECT user_id, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(e, '%Y-%m-%d %H:%M:%S.%f') AS ended,
             n AS events, carts, checkouts, orders, cents / 100.0::DOUBLE AS revenue FROM sessions""",
        "sessions",
    ),
)
def _sessions(spark, sf_dir):
    return sessions.sessions(commerce.events(spark, sf_dir)).select(
        "user_id",
        sessions.us_text(F.col("start_us")).alias("started"),
        sessions.us_text(F.col("end_us")).alias("ended"),
        "events",
        "carts",
        "checkouts",
        "orders",
        (F.col("cents") / 100).alias("revenue"),
    )


@query(
    "m_funnel",
    sql(
        """SELECT day, sessions, orders / nullif(sessions, 0) AS conversion_rate, with_cart / nullif(sessions, 0) AS add_to_cart_rate,
             reached / nullif(sessions, 0) AS checkout_rate FROM (
             SELECT strftime(s, '%Y-%m-%d') AS day, count(*) AS sessions, CAST(sum(orders) AS BIGINT) AS orders,
               count(*) FILTER (carts > 0) AS with_cart, count(*) FILTER (checkouts > 0) AS reached FROM sessions GROUP BY 1)""",
        "sessions",
    ),
)
def _m_funnel(spark, sf_dir):
    daily = (
        sessions.sessions(commerce.events(spark, sf_dir))
        .groupBy(sessions.us_day(F.col("start_us")).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.sum("orders").alias("orders"),
            F.count_if(F.col("carts") > 0).alias("with_cart"),
            F.count_if(F.col("checkouts") > 0).alias("reached"),
        )
    )
    n = F.col("sessions")
    return daily.select(
        "day",
        "sessions",
        metrics.conversion_rate(F.col("orders"), n).alias("conversion_rate"),
        metrics.add_to_cart_rate(F.col("with_cart"), n).alias("add_to_cart_rate"),
        metrics.checkout_rate(F.col("reached"), n).alias("checkout_rate"),
    )


@query(
    "m_aov",
    sql(
        """SELECT month, orders, revenue, revenue / nullif(orders, 0) AS aov FROM (
             SELECT month, count(*) AS orders, sum(subtotal - discount)::DOUBLE / 10000 AS revenue FROM orders_fact GROUP BY 1)""",
        "orders_fact",
    ),
)
def _m_aov(spark, sf_dir):
    fact = commerce.orders_fact(spark, sf_dir).withColumn("net", F.col("subtotal") - F.col("discount"))
    monthly = fact.groupBy("month").agg(
        F.count(F.lit(1)).alias("orders"), commerce.as_amount(commerce.amount_sum("net")).alias("revenue")
    )
    return monthly.withColumn("aov", metrics.aov(F.col("revenue"), F.col("orders")))


@query(
    "m_ads",
    sql(
        """SELECT period, clicks / nullif(sessions, 0) AS ctr, ad_spend / nullif(clicks, 0) AS cpc, ad_spend / nullif(sessions, 0) * 1000 AS cpm,
             ad_spend / nullif(orders, 0) AS cpa, attributed_revenue / nullif(ad_spend, 0) AS roas FROM by_day""",
        "by_day",
    ),
)
def _m_ads(spark, sf_dir):
    c = F.col
    return day_totals(spark, sf_dir).select(
        "period",
        metrics.ctr(c("clicks"), c("sessions")).alias("ctr"),
        metrics.cpc(c("ad_spend"), c("clicks")).alias("cpc"),
        metrics.cpm(c("ad_spend"), c("sessions")).alias("cpm"),
        metrics.cpa(c("ad_spend"), c("orders")).alias("cpa"),
        metrics.roas(c("attributed_revenue"), c("ad_spend")).alias("roas"),
    )


@query(
    "m_refund_rate",
    sql(
        """SELECT month, sum(refund)::DOUBLE / 10000 / nullif(sum(subtotal - discount)::DOUBLE / 10000, 0) AS refund_rate FROM orders_fact GROUP BY 1""",
        "orders_fact",
    ),
)
def _m_refund_rate(spark, sf_dir):
    fact = commerce.orders_fact(spark, sf_dir).withColumn("net", F.col("subtotal") - F.col("discount"))
    monthly = fact.groupBy("month").agg(
        commerce.as_amount(commerce.amount_sum("refund")).alias("r"),
        commerce.as_amount(commerce.amount_sum("net")).alias("v"),
    )
    return monthly.select("month", metrics.refund_rate(F.col("r"), F.col("v")).alias("refund_rate"))


@query(
    "m_net_revenue",
    sql(
        "SELECT month, sum(subtotal - discount - refund)::DOUBLE / 10000 AS net_revenue FROM orders_fact GROUP BY 1",
        "orders_fact",
    ),
)
def _m_net_revenue(spark, sf_dir):
    fact = commerce.orders_fact(spark, sf_dir)
    net = fact.withColumn("net", F.col("subtotal") - F.col("discount") - F.col("refund"))
    return net.groupBy("month").agg(commerce.as_amount(commerce.amount_sum("net")).alias("net_revenue"))


cte(
    "unit_inputs",
    """SELECT 'P' || p_partkey AS sym, p_retailprice AS price, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice * 0.4 END AS cogs,
         p_size * 0.1::DOUBLE AS ship, coalesce(r.back / r.n::DOUBLE, 0) AS rate, r.disc / 100.0::DOUBLE AS discount
       FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS back,
                              max(CAST(round(l_discount * 100) AS BIGINT)) AS disc FROM lineitem GROUP BY 1) r ON l_partkey = p_partkey""",
)


def unit_inputs(spark, sf_dir):
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("l_returnflag") == "R").alias("back"),
            F.max(cents(F.col("l_discount"))).alias("disc"),
        )
    )
    return (
        table(spark, sf_dir, "part")
        .join(lines, "p_partkey", "left")
        .select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sym"),
            F.col("p_retailprice").alias("price"),
            F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice") * 0.4).alias("cogs"),
            (F.col("p_size") * 0.1).alias("ship"),
            (F.col("back") / F.col("n")).alias("rate"),
            (F.col("disc") / 100).alias("discount"),
        )
    )


def _unit(price, cogs):
    return metrics.unit_contribution(
        price, cogs, F.col("ship"), F.lit(0.029), F.lit(0.30), refund_rate=F.col("rate"), discount=F.col("discount")
    )


def _unit_sql(tag: str, p: str, c: str) -> str:
    """Contribution of one unit at price p and cost c."""
    rev = f"({p} + 0 - coalesce(discount, 0))"
    return (
        f"CASE WHEN cogs IS NOT NULL THEN {rev} END AS {tag}revenue, "
        f"{rev} - {c} - ship - ({rev} * 0.029 + 0.30) - {rev} * rate AS {tag}contribution"
    )


@query(
    "m_unit",
    sql(
        f"""SELECT sym, revenue, contribution, CASE WHEN revenue > 0 THEN contribution / revenue END AS margin_pct,
             CASE WHEN contribution > 0 THEN revenue / contribution END AS break_even_roas, CASE WHEN contribution > 0 THEN contribution
             WHEN contribution IS NOT NULL THEN 0 END AS max_cpa FROM (SELECT sym, {_unit_sql('', 'price', 'cogs')} FROM unit_inputs)""",
        "unit_inputs",
    ),
)
def _m_unit(spark, sf_dir):
    rows = unit_inputs(spark, sf_dir).withColumn("u", _unit(F.col("price"), F.col("cogs")))
    return rows.select("sym", "u.*")


@query(
    "m_unit_range",
    sql(
        f"""SELECT sym, low_contribution, low_contribution / low_revenue AS low_margin, high_contribution, high_contribution / high_revenue AS high_margin
            FROM (SELECT sym, {_unit_sql('low_', '(price * 0.9)', '(cogs * 1.1)')}, {_unit_sql('high_', '(price * 1.1)', '(cogs * 0.9)')} FROM unit_inputs)""",
        "unit_inputs",
    ),
)
def _m_unit_range(spark, sf_dir):
    """Pessimistic and optimistic price and cost, evaluated in one projection (no pivot exchange)."""
    low = _unit(F.col("price") * 0.9, F.col("cogs") * 1.1)
    high = _unit(F.col("price") * 1.1, F.col("cogs") * 0.9)
    rows = unit_inputs(spark, sf_dir).withColumn("r", metrics.unit_contribution_range(low, high))
    return rows.select(
        "sym",
        F.col("r.low.contribution").alias("low_contribution"),
        F.col("r.low.margin_pct").alias("low_margin"),
        F.col("r.high.contribution").alias("high_contribution"),
        F.col("r.high.margin_pct").alias("high_margin"),
    )


@query("m_period", sql("SELECT * FROM summary_week", "summary_week"))
def _m_period(spark, sf_dir):
    return metrics.period_summary(week_totals(spark, sf_dir), "period")


_CDF_SQL = (
    "0.5 * (1 + (1 - ((((((0.0 + 1.061405429) * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592)"
    " * t * exp(-(z * z) / 2)))"
)


def _test_sql(arms: str, keys: str) -> str:
    """Pooled test over rows (keys, conv_a, n_a, conv_b, n_b)."""
    return f"""SELECT {keys}, conv_a, n_a, conv_b, n_b, round(CASE WHEN ok THEN (pb - pa) / nullif(pa, 0) END, 9) AS lift, round(CASE WHEN ok THEN z END, 9) AS z,
      round(CASE WHEN ok THEN 2 * (1 - cdf) END, 9) AS p_value FROM (SELECT *, {_CDF_SQL.replace('z * z', 'abs(z) * abs(z)')} AS cdf FROM (
        SELECT *, 1.0::DOUBLE / (1 + 0.3275911::DOUBLE * (abs(z) / sqrt(2.0))) AS t FROM (
          SELECT *, (pb - pa) / sqrt(nullif(p * (1 - p) * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b), 0)) AS z, n_a >= 100 AND n_b >= 100 AND p > 0 AND p < 1 AS ok FROM (
            SELECT *, conv_a::DOUBLE / n_a AS pa, conv_b::DOUBLE / n_b AS pb, (conv_a + conv_b)::DOUBLE / (n_a + n_b) AS p FROM ({arms})))))"""


@query(
    "m_abtest",
    _test_sql(
        """SELECT 'users' AS unit, count(DISTINCT user_id) FILTER (user_id % 2 = 0 AND event_type = 'purchase') AS conv_a,
             count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS n_a,
             count(DISTINCT user_id) FILTER (user_id % 2 = 1 AND event_type = 'purchase') AS conv_b,
             count(DISTINCT user_id) FILTER (user_id % 2 = 1) AS n_b FROM events
           UNION ALL
           SELECT 'events', count(*) FILTER (user_id % 2 = 0 AND event_type = 'purchase'), count(*) FILTER (user_id % 2 = 0),
             count(*) FILTER (user_id % 2 = 1 AND event_type = 'purchase'), count(*) FILTER (user_id % 2 = 1) FROM events""",
        "unit",
    ),
)
def _m_abtest(spark, sf_dir):
    """The same split read by user and by event; one pass per user feeds both."""
    per_user = (
        commerce.events(spark, sf_dir)
        .groupBy("user_id")
        .agg(F.count_if(F.col("event_type") == "purchase").alias("bought"), F.count(F.lit(1)).alias("n"))
        .withColumn("arm", F.col("user_id") % 2)
    )
    both = F.explode(
        F.array(
            F.struct(F.lit("users").alias("unit"), (F.col("bought") > 0).cast("bigint").alias("conv"), F.lit(1).cast("bigint").alias("size")),
            F.struct(F.lit("events").alias("unit"), F.col("bought").alias("conv"), F.col("n").alias("size")),
        )
    )
    rows = per_user.select("arm", both.alias("r")).select("arm", "r.*")
    return metrics.arm_test(rows, ["unit"], "arm", F.col("conv"), F.col("size"))


STOP_LOSS = -0.1  # lift at which an experiment is stopped


@query(
    "exp_readout",
    _test_sql(
        """SELECT format('EXP-{:03d}', user_id // 2 % 9) AS experiment, count(*) FILTER (user_id % 2 = 0 AND event_type = 'purchase') AS conv_a,
             count(*) FILTER (user_id % 2 = 0) AS n_a, count(*) FILTER (user_id % 2 = 1 AND event_type = 'purchase') AS conv_b,
             count(*) FILTER (user_id % 2 = 1) AS n_b FROM events GROUP BY 1""",
        "experiment",
    ).replace(
        "SELECT experiment, conv_a",
        "SELECT experiment, CASE WHEN NOT ok OR 2 * (1 - cdf) >= 0.05 THEN 'INCONCLUSIVE' WHEN z > 0 THEN 'WIN' ELSE 'LOSS' END AS decision, "
        "CASE WHEN n_a < 100 OR n_b < 100 OR conv_a = 0 THEN NULL ELSE round((pb - pa) / pa, 9) <= -0.1 END AS stopped, conv_a",
        1,
    ),
)
def _exp_readout(spark, sf_dir):
    """Primary metric per arm, the decision and the stop-loss outcome for every experiment."""
    ev = commerce.events(spark, sf_dir)
    rows = ev.select(
        F.format_string("EXP-%03d", F.floor(F.col("user_id") / 2) % 9).alias("experiment"),
        (F.col("user_id") % 2).alias("arm"),
        (F.col("event_type") == "purchase").cast("bigint").alias("conv"),
    )
    read = metrics.arm_test(rows, ["experiment"], "arm", F.col("conv"), F.lit(1).cast("bigint"))
    decided = F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    return metrics.stop_loss(read, STOP_LOSS).withColumn(
        "decision", F.when(~decided, "INCONCLUSIVE").when(F.col("z") > 0, "WIN").otherwise("LOSS")
    )


@query(
    "m_returning",
    """SELECT c_mktsegment AS segment, count(*) FILTER (n >= 2) AS returning_customers, count(*) AS customers,
         count(*) FILTER (n >= 2) / count(*) AS returning_rate
       FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def _m_returning(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    seg = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    agg = (
        per.join(seg, "c_custkey")
        .groupBy("segment")
        .agg(F.count_if(F.col("n") >= 2).alias("returning_customers"), F.count(F.lit(1)).alias("customers"))
    )
    return agg.withColumn("returning_rate", metrics.ratio(F.col("returning_customers"), F.col("customers")))


@query(
    "m_cogs",
    """SELECT p_brand AS brand, CAST(sum(q) AS BIGINT) AS units, CAST(sum(q * CAST(round(p_retailprice * 100) AS BIGINT) * 4) AS DOUBLE) / 1000 AS cogs
       FROM (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1) JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def _m_cogs(spark, sf_dir):
    """Landed cost (40% of list) times units; units are combined per part before the join."""
    units = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    )
    landed = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("brand"), (cents(F.col("p_retailprice")) * 4).alias("landed")
    )
    cost = F.sum((F.col("q") * F.col("landed")).cast("decimal(20,0)"))
    return (
        units.join(landed, "p_partkey")
        .groupBy("brand")
        .agg(F.sum("q").alias("units"), (cost.cast("double") / 1000).alias("cogs"))
    )


@query("m_daily", sql("SELECT * FROM by_day", "by_day"))
def _m_daily(spark, sf_dir):
    return day_totals(spark, sf_dir)


@query(
    "m_attribution",
    sql(
        """SELECT source, medium, campaign, count(*) AS orders, sum(subtotal - discount)::DOUBLE / 10000 AS revenue,
             CAST(grouping(source, medium, campaign) AS BIGINT) AS level FROM orders_fact GROUP BY ROLLUP (source, medium, campaign)""",
        "orders_fact",
    ),
)
def _m_attribution(spark, sf_dir):
    """Revenue by first-visit source, medium and campaign with subtotals.

    The finest cells are aggregated first, so the rollup expands a small table instead of every order.
    """
    fact = commerce.orders_fact(spark, sf_dir, with_customer=True).withColumn("net", F.col("subtotal") - F.col("discount"))
    cells = fact.groupBy("source", "medium", "campaign").agg(
        F.count(F.lit(1)).alias("n"), commerce.amount_sum("net").alias("v")
    )
    return cells.rollup("source", "medium", "campaign").agg(
        F.sum("n").alias("orders"),
        commerce.as_amount(F.sum("v")).alias("revenue"),
        F.grouping_id().cast("bigint").alias("level"),
    )


_MEASURED = {"revenue": "events.purchase", "orders": "events.purchase", "sessions": "events.view", "ad_spend": "events.click"}
_ESTIMATED = {"cogs": "40% of revenue", "attributed_revenue": "tagged purchases"}


@query(
    "m_labelled",
    sql(
        " UNION ALL ".join(
            f"""SELECT period, '{m}' AS metric, CASE WHEN {m} IS NULL THEN 'UNKNOWN' ELSE {fixed(f'CAST({m} AS DOUBLE)', 4)} END AS shown,
                '{'ESTIMATED' if m in _ESTIMATED else 'MEASURED'}' AS label, '{s}' AS source FROM by_day"""
            for m, s in {**_MEASURED, **_ESTIMATED}.items()
        ),
        "by_day",
    ),
)
def _m_labelled(spark, sf_dir):
    names = [*_MEASURED, *_ESTIMATED]
    rows = day_totals(spark, sf_dir).select("period", *[F.col(n).cast("double") for n in names])
    return metrics.labelled(rows, ["period"], _MEASURED, _ESTIMATED, "amount")


@query(
    "m_wow",
    sql(
        " UNION ALL ".join(
            f"""SELECT w.period, '{m}' AS metric, w.{m} AS this_week, b.{m} AS last_week, w.{m} - b.{m} AS delta
                FROM summary_week w LEFT JOIN summary_week b ON CAST(b.period AS DATE) + 7 = CAST(w.period AS DATE)"""
            for m in ("revenue", "aov", "conversion_rate", "cac", "refund_rate", "contribution")
        ),
        "summary_week",
    ),
)
def _m_wow(spark, sf_dir):
    weekly = metrics.period_summary(week_totals(spark, sf_dir), "period")
    return metrics.week_over_week(
        weekly, "period", ["revenue", "aov", "conversion_rate", "cac", "refund_rate", "contribution"]
    )


cte(
    "visits",
    """SELECT *, 'https://shop.example.com/land?utm_source=' || event_type || '&utm_medium=' || ['paid', 'organic', 'email'][event_id % 3 + 1]
         || '&utm_campaign=' || format('EXP-{:03d}_', user_id % 9) || ['fit', 'price', 'proof', 'gift'][user_id % 4 + 1]
         || '&utm_content=c' || (event_id % 13) AS url FROM events""",
)


def _utm_sql(field: str) -> str:
    return f"nullif(regexp_extract(url, '[?&]utm_{field}=([^&#]*)', 1), '')"


cte(
    "utm",
    f"""SELECT *, nullif(regexp_extract(campaign, '^(EXP-[0-9]{{3,}})_', 1), '') AS experiment,
          nullif(regexp_extract(campaign, '^EXP-[0-9]{{3,}}_(.+)$', 1), '') AS angle FROM (
        SELECT kind, id, event_type, value, {_utm_sql('source')} AS source, {_utm_sql('medium')} AS medium, {_utm_sql('campaign')} AS campaign,
          {_utm_sql('content')} AS content FROM (
            SELECT 'visit' AS kind, event_id AS id, url, event_type, value FROM visits
            UNION ALL SELECT 'page', page_id, url, NULL, NULL FROM pages))""",
    "visits",
)


@query("utm_parse", sql("SELECT kind, id, source, medium, campaign, experiment, angle, content FROM utm", "utm"))
def _utm_parse(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    seen = commerce.visits(spark, sf_dir).select(F.lit("visit").alias("kind"), F.col("event_id").alias("id"), "url")
    return seen.unionByName(pages).select("kind", "id", *utm_fields("url"))


@query(
    "m_campaign",
    sql(
        """SELECT experiment, angle, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS orders,
             coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'purchase'), 0)::DOUBLE / 100 AS revenue,
             count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view'), 0) AS conversion_rate
           FROM utm WHERE kind = 'visit' GROUP BY 1, 2""",
        "utm",
    ),
)
def _m_campaign(spark, sf_dir):
    rows = commerce.visits(spark, sf_dir).select("event_type", "value", *utm_fields("url"))
    bought = F.col("event_type") == "purchase"
    out = rows.groupBy("experiment", "angle").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(bought).alias("orders"),
        (F.coalesce(F.sum(F.when(bought, cents(F.col("value")))), F.lit(0)) / 100).alias("revenue"),
        F.count_if(F.col("event_type") == "view").alias("views"),
    )
    return out.withColumn("conversion_rate", metrics.conversion_rate(F.col("orders"), F.col("views"))).drop("views")


@query(
    "top_bottom_k",
    sql(
        """SELECT side, place, creative, rate FROM (
             SELECT creative, rate, unnest([{'side': 'best', 'place': b}, {'side': 'weakest', 'place': w}], recursive := true) FROM (
               SELECT *, row_number() OVER (ORDER BY rate DESC, creative) AS b, row_number() OVER (ORDER BY rate, creative) AS w FROM (
                 SELECT experiment || '/' || angle || '/' || content AS creative, count(*) FILTER (event_type = 'purchase') / count(*) AS rate
                 FROM utm WHERE kind = 'visit' GROUP BY 1))) WHERE place <= 5""",
        "utm",
    ),
)
def _top_bottom_k(spark, sf_dir):
    """Five best and five weakest creatives by purchase rate."""
    rows = commerce.visits(spark, sf_dir).select("event_type", *utm_fields("url"))
    creative = F.concat_ws("/", "experiment", "angle", "content")
    rates = rows.groupBy(creative.alias("creative")).agg(
        (F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1))).alias("rate")
    )
    return metrics.top_bottom(rates, "rate", "creative", 5)


@query(
    "dq_tracking",
    """SELECT user_id, day, tag, fired, CASE WHEN fired = 0 THEN 'missing' ELSE 'duplicate' END AS status FROM (
         SELECT user_id, day, tag, count(e.event_id) AS fired FROM
           (SELECT user_id, strftime(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)), '%Y-%m-%d') AS day
            FROM (SELECT DISTINCT user_id FROM events))
           CROSS JOIN (VALUES ('view', 'page_view'), ('click', 'view_item'), ('signup', 'add_to_cart'), ('error', 'begin_checkout'), ('purchase', 'purchase')) k(raw, tag)
           LEFT JOIN (SELECT event_id, user_id AS u, strftime(ts, '%Y-%m-%d') AS d, event_type FROM events) e
             ON e.u = user_id AND e.d = day AND e.event_type = raw GROUP BY 1, 2, 3) WHERE fired <> 1""",
)
def _dq_tracking(spark, sf_dir):
    expected = {
        "view": "page_view",
        "click": "view_item",
        "signup": "add_to_cart",
        "error": "begin_checkout",
        "purchase": "purchase",
    }
    return quality.tracking_coverage(commerce.events(spark, sf_dir), "user_id", expected)


@query(
    "dq_bots",
    sql(
        """SELECT user_id, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS started, n AS events, CAST(peak AS BIGINT) AS peak_hour_events
           FROM sessions WHERE peak <= 2""",
        "sessions",
    ),
)
def _dq_bots(spark, sf_dir):
    kept = quality.without_bots(sessions.sessions(commerce.events(spark, sf_dir)))
    return kept.select("user_id", sessions.us_text(F.col("start_us")).alias("started"), "events", "peak_hour_events")


@query(
    "attr_window",
    """SELECT day, 7 AS window_days, CAST(sum(x) AS DOUBLE) / 100 AS revenue,
         coalesce(sum(x) FILTER (EXISTS (SELECT 1 FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click'
           AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 7 DAY)), 0)::DOUBLE / 100 AS attributed
       FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day, CAST(round(value * 100) AS BIGINT) AS x FROM events WHERE event_type = 'purchase') p
       GROUP BY 1""",
)
def _attr_window(spark, sf_dir):
    """Revenue within seven days after the buyer's last click; the window is stated on every row."""
    days = 7
    ev = commerce.events(spark, sf_dir).where(F.col("event_type").isin("click", "purchase"))
    rows = ev.select("user_id", "event_id", "event_type", cents(F.col("value")).alias("x"), commerce.micros(F.col("ts")).alias("us"))
    seen = sessions.last_marked_before(rows, "user_id", "us", "event_id", F.col("event_type") == "click")
    hit = F.col("us") - F.col("last_marked_us") <= days * 86_400_000_000
    return (
        seen.where("event_type = 'purchase'")
        .groupBy(sessions.us_day(F.col("us")).alias("day"))
        .agg(
            F.lit(days).alias("window_days"),
            (F.sum("x") / 100).alias("revenue"),
            (F.coalesce(F.sum(F.when(hit, F.col("x"))), F.lit(0)) / 100).alias("attributed"),
        )
    )


@query(
    "dq_currency",
    sql(
        """SELECT shop, count(DISTINCT currency) AS currencies, count(*) FILTER (currency <> shop_currency) AS stray_orders,
             count(DISTINCT currency) = 1 AND count(*) FILTER (currency <> shop_currency) = 0 AS ok FROM orders_fact GROUP BY 1""",
        "orders_fact",
    ),
)
def _dq_currency(spark, sf_dir):
    return quality.currency_consistency(commerce.orders_fact(spark, sf_dir, with_customer=True))


@query(
    "dq_provisional",
    sql(
        """SELECT strftime(dt, '%Y-%m-%d') AS day, r / nullif(v, 0) AS refund_rate, dt > max(dt) OVER () - 14 AS provisional FROM (
             SELECT dt, sum(refund)::DOUBLE / 10000 AS r, sum(subtotal - discount)::DOUBLE / 10000 AS v FROM orders_fact GROUP BY 1)""",
        "orders_fact",
    ),
)
def _dq_provisional(spark, sf_dir):
    fact = commerce.orders_fact(spark, sf_dir).withColumn("net", F.col("subtotal") - F.col("discount"))
    daily = fact.groupBy("dt").agg(
        commerce.as_amount(commerce.amount_sum("refund")).alias("r"),
        commerce.as_amount(commerce.amount_sum("net")).alias("v"),
    )
    return quality.flag_provisional(daily, "dt").select(
        F.date_format("dt", "yyyy-MM-dd").alias("day"),
        metrics.refund_rate(F.col("r"), F.col("v")).alias("refund_rate"),
        "provisional",
    )


cte(
    "products",
    """SELECT p_partkey AS pk, 'p-' || p_partkey AS handle, p_name AS title, ['ACTIVE', 'DRAFT', 'ARCHIVED'][p_size % 3 + 1] AS status,
         coalesce(q, 0) - 600 AS total_inventory, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name || ' | shop' END AS seo_title,
         CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN ' ' ELSE p_brand || ' ' || p_name END AS seo_description,
         p_retailprice AS price, p_size AS size
       FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
)


@query(
    "catalog_audit",
    sql(
        """SELECT unnest(['missing_seo_title', 'missing_seo_description', 'no_inventory', 'status_ACTIVE', 'status_ARCHIVED', 'status_DRAFT', 'duplicate_title']) AS issue,
             unnest([count(*) FILTER (coalesce(trim(seo_title), '') = ''), count(*) FILTER (coalesce(trim(seo_description), '') = ''),
               count(*) FILTER (total_inventory <= 0), count(*) FILTER (status = 'ACTIVE'), count(*) FILTER (status = 'ARCHIVED'),
               count(*) FILTER (status = 'DRAFT'), count(*) FILTER (dup > 1)]) AS products
           FROM (SELECT *, count(*) OVER (PARTITION BY title) AS dup FROM products)""",
        "products",
    ),
)
def _catalog_audit(spark, sf_dir):
    return quality.catalog_audit(products(spark, sf_dir))
