from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import fmt, fmt_adaptive, fmt_cap, fmt_scaled, fmt_sign, js_round, leading_number, round_scaled, to_fixed
from ledgerloom.operators.quotes import direction, eps, lookup
from ledgerloom.operators.text import json_number

L = F.lit


@pytest.mark.parametrize(
    "x, d, text",
    [(1.005, 2, "1.00"), (0.125, 2, "0.13"), (-0.125, 2, "-0.13"), (2.5, 0, "3"), (-2.345, 1, "-2.3"), (34211.735, 2, "34211.74"), (0.0, 2, "0.00")],
)
def test_to_fixed(one, x, d, text):
    assert one(to_fixed(L(x), d)) == text


def test_to_fixed_matches_exact_rounding(spark):
    @given(st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=60), st.sampled_from([2, 4, 8, 16, 40, 100, 200, 1000]))
    @settings(max_examples=15, deadline=None)
    def check(ints, q):
        xs = [i / q for i in ints]
        got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(to_fixed(F.col("x"), 2)).collect()]
        want = [str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP)) for x in xs]
        assert [Decimal(g) for g in got] == [Decimal(w) for w in want]

    check()


def test_grouped_and_signed(one):
    assert one(fmt(L(0.125))) == "0.13"
    assert one(fmt(L(1234567.005))) == "1,234,567.01"
    assert one(fmt_sign(L(-3.456)), fmt_sign(L(0.0)), fmt_sign(L(2.0))) == ("−3.46", "+0.00", "+2.00")
    assert one(fmt_adaptive(L(17188.25), 5000, 1)) == "17,188.3"


def test_grouped_rounds_the_scaled_double_like_sql(spark):
    xs = [s * x for x in (2382.345, 1170.975, 4235.985, 2.675, 1e308, 1.005, *(n / 1000 + 5e-3 for n in range(0, 5_000_000, 1237))) for s in (1, -1)] + [0.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round_scaled(F.col("x"), 2).alias("r"), fmt_scaled(F.col("x")).alias("t")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT unnest(?::DOUBLE[]) AS x", [xs])
    want = {r[0]: r[1:] for r in con.execute("SELECT x, round(x, 2), format('{:,.2f}', round(x, 2)) FROM v").fetchall()}
    assert [r["r"] for r in rows] == [want[r["x"]][0] for r in rows]
    assert [r["t"] for r in rows if abs(r["x"]) < 1e12] == [want[r["x"]][1] for r in rows if abs(r["x"]) < 1e12]
    assert rows[0]["t"] == "2,382.34"
    assert spark.range(1).select(fmt_adaptive(L(2382.345), 5000, 1)).first()[0] == "2,382.34"


def test_caps(one):
    assert one(fmt_cap(L(2.92e12)), fmt_cap(L(583.7e9)), fmt_cap(L(12.4e6)), fmt_cap(L(4e5))) == ("2.92T", "583.7B", "12M", "0M")
    assert one(fmt_cap(L(None).cast("double"))) is None


def test_js_round_halves_go_up(one):
    assert one(js_round(L(-0.5)), js_round(L(2.5)), js_round(L(-1.5))) == (0, 3, -1)


def test_eps_falls_back(one):
    assert one(eps(L(50.0), L("—")), eps(L(50.0), L("0")), eps(L(50.0), L("12.5x"))) == (2.0, 2.0, 4.0)
    assert one(leading_number(L("x12"))) is None


def test_direction_and_lookup(one):
    assert one(direction(L(0.0)), direction(L(-0.1))) == ("up", "down")
    assert one(lookup(L("a"), {"a": "x"}, "z"), lookup(L("b"), {"a": "x"}, "z"), lookup(L(None).cast("string"), {"a": "x"}, "z")) == ("x", "z", "z")


def test_json_numbers(one):
    assert [one(json_number(L(x))) for x in (2974.0, 100.0, 12.5, -0.001, 0.0, 1.256)] == ["2974", "100", "12.5", "0", "0", "1.26"]
