"""Ordered price series: ranges, patches, walks, samples and summaries.

Every window here is per symbol over daily points, so its size is bounded by the trading calendar (the daily
pre-aggregation that builds the series runs map-side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import js_round, ratio, to_fixed

# Chart ranges as (id, points, days back from the anchor).
RANGES = (("1D", 78, 1), ("1W", 70, 7), ("1M", 64, 30), ("3M", 66, 91), ("1Y", 120, 365))
SESSION_OPEN_MINUTE = 9 * 60 + 30
INTRADAY_STEP_MINUTES = 5
FRACTIONS = (0.0, 0.25, 0.5, 0.75, 1.0)
DOMAIN_PAD = 0.08
TICKS = 4
TRAILING = 20
OPEN_MARKUP = 1.001


def _range_dim() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r).alias("range_id"),
                F.lit(i).alias("range_ord"),
                F.lit(pts).alias("pts"),
                F.lit(days).alias("days"),
            )
            for i, (r, pts, days) in enumerate(RANGES)
        ]
    )


def in_ranges(series: DataFrame) -> DataFrame:
    """Tag each point with every range it falls in, counting back from its symbol's last date.

    The five ranges are exploded from a literal, so this is a projection rather than a range join.
    """
    age = F.date_diff(F.max("dt").over(Window.partitionBy("pk")), F.col("dt"))
    hits = F.filter(_range_dim(), lambda r: r["days"] >= F.col("_age"))
    return (
        series.withColumn("_age", age)
        .withColumn("_r", F.explode(hits))
        .select("*", "_r.range_id", "_r.range_ord")
        .drop("_age", "_r")
    )


def range_base(ranged: DataFrame, quotes: DataFrame) -> DataFrame:
    """Base price of each range: the previous close for 1D, else the first point (of a range with one point the live price,
    which takes that point's place)."""
    firsts = ranged.groupBy("pk", "range_id", "range_ord").agg(F.min_by("price", "dt").alias("first_px"), F.count(F.lit(1)).alias("points"))
    q = quotes.select(F.col("ord").alias("pk"), "sym", "price", "prev_close")
    base = F.when(F.col("range_id") == "1D", F.col("prev_close")).when(F.col("points") == 1, F.col("price")).otherwise(F.col("first_px"))
    return firsts.join(q, "pk").withColumn("base_px", base)


def performance(ranged: DataFrame, quotes: DataFrame) -> DataFrame:
    """Change from the range base to the live price."""
    chg = F.col("price") - F.col("base_px")
    return range_base(ranged, quotes).select(
        "sym", "range_id", "range_ord", chg.alias("chg"), (ratio(chg, F.col("base_px")) * 100).alias("chg_pct")
    )


def performance_text(perf: DataFrame) -> DataFrame:
    """One line per symbol, ranges in order (five entries at most)."""
    part = F.concat(F.col("range_id"), F.lit(": "), to_fixed(F.col("chg_pct"), 1), F.lit("%"))
    items = F.array_sort(F.collect_list(F.struct("range_ord", part.alias("t"))))
    return perf.groupBy("sym").agg(F.array_join(F.transform(items, lambda x: x["t"]), ", ").alias("perf"))


def patch(ranged: DataFrame, quotes: DataFrame) -> DataFrame:
    """Last point becomes the live price; in 1D the first becomes the previous close (last wins on one point)."""
    w = Window.partitionBy("pk", "range_id")
    q = quotes.select(F.col("ord").alias("pk"), F.col("price").alias("live"), "prev_close")
    return (
        ranged.withColumn("i", (F.row_number().over(w.orderBy("dt")) - 1).cast("bigint"))
        .withColumn("n", F.count(F.lit(1)).over(w))
        .join(q, "pk")
        .withColumn(
            "price",
            F.when((F.col("i") == 0) & (F.col("range_id") == "1D"), F.col("prev_close"))
            .when(F.col("i") == F.col("n") - 1, F.col("live"))
            .otherwise(F.col("price")),
        )
        .select("sym", "range_id", "i", "price")
    )


def cumulative_walk(series: DataFrame, step: str) -> DataFrame:
    """Running sum of whole-number steps, starting from zero at the first point."""
    w = Window.partitionBy("pk").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("walk", F.sum(step).over(w) - F.first(step).over(w))


def bridge(walked: DataFrame, scale: float) -> DataFrame:
    """Detrend the walk so that the last point equals the base, which is the series' last price."""
    full = Window.partitionBy("pk").orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.col("walk") / scale
    end = F.last("walk").over(full) / scale
    along = F.coalesce(F.try_divide(F.col("i").cast("double"), (F.col("n") - 1).cast("double")), F.lit(0.0))
    return walked.withColumn("bridged", F.last("price").over(full) * (1 + v - end * along))


def trailing_range(series: DataFrame, quotes: DataFrame, points: int = TRAILING) -> DataFrame:
    """High and low of each range's last points, for 1D of all of its points, with the ends patched (see :func:`patch`)."""
    patched = patch(series, quotes)
    by_range = Window.partitionBy("sym", "range_id")
    back = F.count(F.lit(1)).over(by_range) - F.col("i")
    tail = patched.withColumn("back", back).where((F.col("range_id") == "1D") | (F.col("back") <= points))
    return tail.groupBy("sym", "range_id").agg(F.max("price").alias("hi"), F.min("price").alias("lo"))


def open_price(series: DataFrame, quotes: DataFrame) -> DataFrame:
    """Second point of the intraday series; other ranges take the marked-up previous close."""
    second = series.groupBy("pk").agg(F.max(F.when(F.col("i") == 1, F.col("price"))).alias("open_1d"))
    q = quotes.select(F.col("ord").alias("pk"), "sym", (F.col("prev_close") * OPEN_MARKUP).alias("open_other"))
    return second.join(q, "pk").select("sym", "open_1d", "open_other")


def fraction_sample(series: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """Points at the given fractions of each series, one row per fraction."""
    wanted = F.filter(
        F.array(*[F.lit(f) for f in fractions]),
        lambda f: js_round(f * (F.col("n") - 1)) == F.col("i"),
    )
    return series.withColumn("fraction", F.explode(wanted)).select("sym", "fraction", "i", "price")


def minmax_norm(series: DataFrame) -> DataFrame:
    """Position of each point between its symbol's low and high; a flat series divides by one."""
    w = Window.partitionBy("pk")
    lo, hi = F.min("price").over(w), F.max("price").over(w)
    span = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    return series.withColumn("norm", (F.col("price") - lo) / span)


def high_low(year: DataFrame, quotes: DataFrame) -> DataFrame:
    """52-week high, low and position of the live price; a flat range has no position."""
    ends = year.groupBy("pk").agg(F.max("price").alias("h"), F.min("price").alias("l"))
    q = quotes.select(F.col("ord").alias("pk"), "sym", "price")
    hi, lo = F.greatest("h", "price"), F.least("l", "price")
    return ends.join(q, "pk").select(
        "sym", hi.alias("hi52"), lo.alias("lo52"), (ratio(F.col("price") - lo, hi - lo) * 100).alias("pos52")
    )


def price_bins(series: DataFrame, quotes: DataFrame) -> DataFrame:
    """Padded value domain per symbol (with its previous close), four bins, their mid ticks and point counts.

    Points find their bin beside their symbol's ends and are counted; a symbol is one row of ``TICKS`` counts.
    """
    q = quotes.select(F.col("ord").alias("pk"), "prev_close")
    by_sym = Window.partitionBy("pk")
    ends = series.select("pk", "sym", "price", F.min("price").over(by_sym).alias("l"), F.max("price").over(by_sym).alias("h"))
    lo, hi = F.least("l", "prev_close"), F.greatest("h", "prev_close")
    pad = F.when(hi - lo == 0, F.lit(1.0)).otherwise((hi - lo) * DOMAIN_PAD)
    dom = ends.join(q, "pk").select("pk", "sym", "price", (lo - pad).alias("lo"), (hi + pad).alias("hi"))
    bin_of = F.floor((F.col("price") - F.col("lo")) / (F.col("hi") - F.col("lo")) * TICKS)
    counts = dom.groupBy("pk", "sym", "lo", "hi").agg(*[F.count_if(bin_of == b).alias(f"b{b}") for b in range(TICKS)])
    bins = F.posexplode(F.array(*[f"b{b}" for b in range(TICKS)])).alias("bin", "points")
    return counts.select("sym", "lo", "hi", bins).select(
        "sym",
        F.col("bin").cast("bigint").alias("bin"),
        (F.col("lo") + (F.col("bin") + 0.5) / TICKS * (F.col("hi") - F.col("lo"))).alias("tick"),
        "points",
    )


def nearest_price(picks: DataFrame, series: DataFrame) -> DataFrame:
    """Closest dated price to each (pk, dt) pick; on equal gaps the later one.

    Picks and points share one per-symbol window, bounded by two rows per calendar day.
    """
    both = (
        series.select("pk", "dt", F.struct("dt", "price").alias("pt"))
        .unionByName(picks.select("pk", "dt").distinct().withColumn("pt", F.lit(None).cast("struct<dt:date,price:double>")))
        .withColumn("is_pick", F.col("pt").isNull())
    )
    by = Window.partitionBy("pk").orderBy("dt", "is_pick")
    around = both.withColumn(
        "before", F.last("pt", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("after", F.first("pt", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)))
    back = F.date_diff(F.col("dt"), F.col("before.dt"))
    ahead = F.date_diff(F.col("after.dt"), F.col("dt"))
    take_before = F.col("after").isNull() | (F.col("before").isNotNull() & (back < ahead))
    best = F.when(take_before, F.col("before")).otherwise(F.col("after"))
    return around.where("is_pick").select("pk", F.col("dt").alias("pick_dt"), best.alias("b")).select(
        "pk", "pick_dt", F.col("b.dt").alias("price_dt"), F.col("b.price").alias("price")
    )


def time_axis(anchors: DataFrame, key: str) -> DataFrame:
    """Axis labels for every range of every anchor row (key, anchor date)."""
    pos = anchors.withColumn("r", F.explode(_range_dim())).select(
        key, "anchor", "r.*", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("r.pts") - 1).cast("bigint"))).alias("i")
    )
    minute = F.lit(SESSION_OPEN_MINUTE) + F.col("i") * INTRADAY_STEP_MINUTES
    clock = F.date_format(F.timestamp_seconds(minute * 60), "h:mm a")
    offset = js_round(F.col("days") * (1 - F.col("i") / (F.col("pts") - 1)))
    day = F.date_sub("anchor", offset.cast("int"))
    dated = F.when(F.col("range_id") == "1Y", F.date_format(day, "MMM d, yyyy")).otherwise(F.date_format(day, "MMM d"))
    return pos.select(
        key, "range_id", "i", F.when(F.col("range_id") == "1D", clock).otherwise(dated).alias("label")
    )
