"""Registered queries of the corpus operators against their SQL, and the shape of all."""

import pytest

from ledgerloom.llm.queries import ORACLES, QUERIES
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    rows, error = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert error is None and rows > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_row_has_a_result(spark, con, name):
    table, key = {"op4": ("embeddings", "query_id"), "op9": ("pages", "page_id"), "op10": ("pages", "page_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    got = QUERIES[name](spark, SF)
    if name.startswith(("op12_", "op13_")):  # a row per word or node, compared with SQL above
        keys = ["word"] if name.startswith("op12_") else ["conv_id", "depth"]
        assert got.count() == got.select(*keys).distinct().count() > 0
        return
    if table == "embeddings":
        want = con.execute("SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0").fetchall()[0][0]
        assert got.select(key).distinct().count() == want
    else:
        assert got.count() == got.select(key).distinct().count() == con.execute(f"SELECT count(*) FROM {table}").fetchall()[0][0]


def test_all_are_there():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
