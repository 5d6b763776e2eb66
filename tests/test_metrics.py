import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import normal_cdf, ratio
from ledgerloom.operators import metrics

L = F.lit
def null():
    return F.lit(None).cast("double")



def near(x):
    return pytest.approx(x, abs=1e-9)


def test_ratio_is_unknown_not_guessed(one):
    assert one(metrics.conversion_rate(L(5), L(0))) is None
    assert one(metrics.aov(null(), L(3))) is None
    assert one(metrics.conversion_rate(L(5), L(250))) == near(0.02)
    assert one(metrics.cpm(L(10), L(2000))) == near(5)


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
def test_ratio_rejects_non_finite(one, bad):
    assert one(ratio(L(bad), L(2.0)), ratio(L(2.0), L(bad))) == (None, None)


def unit(one, price, cogs, ship, pct, fixed, **more):
    return one(metrics.unit_contribution(L(price), cogs, ship, pct, fixed, **more))


def test_unit_contribution(one):
    u = unit(one, 40.0, L(10.0), L(5.0), L(0.029), L(0.30), refund_rate=L(0.05))
    assert u["contribution"] == near(21.54) and u["margin_pct"] == near(0.5385)
    assert u["break_even_roas"] == near(1.857010213556)


def test_unit_contribution_needs_every_input(one):
    assert unit(one, 40.0, null(), L(5.0), L(0.029), L(0.30)) is None
    assert unit(one, 40.0, L(math.nan), L(5.0), L(0.029), L(0.30)) is None


def test_losing_unit_has_no_break_even(one):
    u = unit(one, 10.0, L(9.0), L(5.0), L(0.03), L(0.30))
    assert u["contribution"] == near(-4.6) and u["break_even_roas"] is None and u["max_cpa"] == 0


def test_unit_range(one):
    low = metrics.unit_contribution(L(10.0), L(9.0), L(5.0), L(0.03), L(0.30))
    high = metrics.unit_contribution(L(40.0), L(10.0), L(5.0), L(0.029), L(0.30))
    both = one(metrics.unit_contribution_range(low, high))
    assert both["low"]["contribution"] < 0 < both["high"]["contribution"]


def test_period_summary_unknown_spend(spark):
    cols = "revenue double, orders double, sessions double, cogs double, shipping_cost double, fees double, refunds double, ad_spend double, attributed_revenue double, new_customers double"
    rows = spark.createDataFrame([(1000.0, 20.0, 1000.0, 300.0, 100.0, 35.0, 0.0, None, None, None)], cols)
    r = metrics.period_summary(rows).first()
    assert (r["contribution"], r["roas"], r["cac"]) == (None, None, None)
    assert r["aov"] == near(50) and r["conversion_rate"] == near(0.02) and r["refund_rate"] == 0


def ab(one, *args):
    return one(metrics.two_proportion_test(*[L(a) for a in args]))


def test_two_proportions(one):
    assert ab(one, 1, 50, 2, 50) is None
    assert ab(one, 0, 500, 0, 500) is None  # no variance
    assert ab(one, 600, 500, 700, 500) is None  # more conversions than visitors
    t = ab(one, 100, 5000, 160, 5000)
    assert t["lift"] == near(0.6) and t["z"] == near(3.77037978225227) and t["p_value"] == pytest.approx(0.000163051501, abs=1e-11)
    t = ab(one, 100, 5000, 101, 5000)
    assert t["z"] == pytest.approx(0.0712543, abs=1e-7) and t["p_value"] == pytest.approx(0.9431952, abs=1e-7)
    assert ab(one, 0, 500, 5, 500)["lift"] is None


def test_normal_cdf(one):
    assert one(normal_cdf(L(0.0))) == pytest.approx(0.5000000005, abs=1e-11)
    for x in (0.1, 0.5, 1.0, 1.96, 3.0):
        exact = 0.5 * (1 + math.erf(x / math.sqrt(2)))
        assert one(normal_cdf(L(x))) == pytest.approx(exact, abs=8e-8)


def test_a_missing_week_is_not_replaced(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-08", 3.0), ("2024-01-22", 7.0)], "week string, revenue double")
    got = {r["week"]: (r["last_week"], r["delta"]) for r in metrics.week_over_week(df, "week", ["revenue"]).collect()}
    assert got == {"2024-01-01": (None, None), "2024-01-08": (1.0, 2.0), "2024-01-22": (None, None)}


def test_hourly_peak_for_a_gap_that_does_not_divide_an_hour(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators.sessions import sessions

    minutes = [50, 55, 58, 61, 65]
    df = spark.createDataFrame([(i, m * 60, 1, "view", 1.0) for i, m in enumerate(minutes)], "event_id long, s long, user_id long, event_type string, value double")
    rows = sessions(df.withColumn("ts", F.timestamp_seconds("s")), 25 * 60).collect()
    assert [r["peak_hour_events"] for r in rows] == [3]


def test_stop_loss(spark):
    df = spark.createDataFrame([(100, 1000, 90, 1000), (100, 1000, 91, 1000), (0, 1000, 5, 1000), (10, 99, 1, 1000)], "conv_a long, n_a long, conv_b long, n_b long")
    assert [r["stopped"] for r in metrics.stop_loss(df, -0.1).collect()] == [True, False, None, None]


def test_newest_landing_counts(spark, tmp_path):
    import os

    from ledgerloom.sources import pages

    page = '{"data":{"products":{"pageInfo":{"hasNextPage":false},"nodes":[{"id":"p1","handle":"h","title":"%s","status":"A","totalInventory":1}]}}}'
    for n, (name, title) in enumerate([("z", "old"), ("a", "new")]):
        path = tmp_path / f"{name}.json"
        path.write_text(page % title)
        os.utime(path, (1_700_000_000 + n * 100,) * 2)
    assert [r["title"] for r in pages.read_product_pages(spark, str(tmp_path)).collect()] == ["new"]
