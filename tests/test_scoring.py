import json

import pytest

from pyspark.sql import functions as F

from ledgerloom.operators import scoring
from ledgerloom.sources.research import read_candidates
from ledgerloom.sources.sinks import write_ranking

SCHEMA = "ord long, id string, name string, scores map<string,int>, knockouts map<string,boolean>"


def cands(spark, *rows):
    return spark.createDataFrame([(i, r[0], r[0], r[1], r[2]) for i, r in enumerate(rows)], SCHEMA)


def all_of(v):
    return dict.fromkeys(scoring.FACTORS, v)


def test_catalog():
    assert len(scoring.FACTORS) == 16 and scoring.ALL_WEIGHT == 32 and scoring.MAX_TOTAL == 160


def test_verdicts(spark):
    rows = cands(
        spark, ("top", all_of(5), {}), ("none", all_of(None), {}), ("absent", {}, None),
        ("ip", all_of(5), {"ipRisk": True, "unsafeToShip": False, "regulatedCategory": None}), ("mid", all_of(3), {}),
    )
    got = {r["id"]: r for r in scoring.score(rows).collect()}
    assert (got["top"]["pct"], got["top"]["confidence"], got["top"]["verdict"]) == (1, 1, "SHORTLIST")
    for k in ("none", "absent"):
        assert (got[k]["pct"], got[k]["confidence"], got[k]["verdict"], got[k]["known"]) == (0.4, 0, "NEEDS_RESEARCH", 0)
        assert got[k]["unknowns"] == list(scoring.FACTORS)
    assert got["ip"]["verdict"] == "REJECT" and got["ip"]["knocked_out_by"] == ["ipRisk"]
    assert got["mid"]["verdict"] == "HOLD"


def test_threshold_is_inclusive(spark):
    exact = all_of(3) | {"customerProblem": 5, "demandEvidence": 5, "differentiation": 5}  # 96 + 16 = 112 of 160
    r = scoring.score(cands(spark, ("x", exact, {}))).first()
    assert (r["total"], r["verdict"]) == (112, "SHORTLIST")


def test_invalid_rows_are_rejected(spark):
    rows = cands(
        spark, ("six", all_of(5) | {"returnRisk": 6}, {}), ("zero", all_of(5) | {"returnRisk": 0}, {}),
        ("odd", all_of(5), {"tooTrendy": True}), ("quiet", all_of(5), {"tooTrendy": False}),
    )
    good, bad = scoring.split_valid(rows)
    assert [r["id"] for r in good.collect()] == ["quiet"]
    assert {r["id"]: r["reasons"] for r in bad.collect()} == {
        "six": ["returnRisk=6"], "zero": ["returnRisk=0"], "odd": ["unknown knockout tooTrendy"],
    }


def test_rank_is_stable(spark):
    rows = cands(spark, ("low", all_of(2), {}), ("b", all_of(5), {}), ("mid", all_of(3), {}), ("a", all_of(5), {}))
    ranked = scoring.rank(scoring.score(rows)).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == ["b", "a", "mid", "low"]


def test_shortlist_flag(spark):
    few = scoring.shortlist(scoring.score(cands(spark, ("a", all_of(5), {}), ("b", all_of(1), {})))).collect()
    assert [(r["id"], r["rank"], r["enough"]) for r in few] == [("a", 1, False)]


def test_consistency_rules(spark):
    rows = cands(spark, ("a", all_of(5), {})).withColumn("quantitative", F.lit(False)).withColumn("verified", F.lit(False))
    s = scoring.apply_consistency_rules(rows).first()["scores"]
    assert s["demandEvidence"] == 3 and s["supplierReliability"] is None and s["returnRisk"] == 5


def test_margin_floor(spark):
    cases = [(39.0, 12.0, 7.0, 1.47, False), (34.99, 15.60, 0.0, 0.0, True), (34.99, 9.00, 10.50, 1.31, False),
             (34.99, 11.36, 9.50, 1.31, True), (30.0, 12.0, 0.0, 0.0, False), (30.0, 12.0, 11.0, 1.3, True)]
    df = spark.createDataFrame(cases, "price double, landed double, ship double, fees double, want boolean")
    assert all(r["below_floor"] == r["want"] for r in scoring.margin_floor(df).collect())


def test_document_to_report(spark, tmp_path):
    doc = {"_doc": "x", "candidates": [{"id": "C-2", "name": "two", "scores": all_of(3), "knockouts": {}},
                                       {"id": "C-1", "name": "one", "scores": all_of(4) | {"returnRisk": None}, "knockouts": {"ipRisk": False}}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    read = read_candidates(spark, str(tmp_path / "c.json"))
    assert [r["id"] for r in read.orderBy("ord").collect()] == ["C-2", "C-1"]
    write_ranking(scoring.rank(scoring.score(read)), str(tmp_path / "out"))
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0].startswith("| Rank |") and lines[2] == "| 1 | C-1 | one | 78% | 94% | **SHORTLIST** | returnRisk | — |"
    assert lines[3] == "| 2 | C-2 | two | 60% | 100% | **HOLD** | — | — |"


def test_candidates_of_many_files_keep_one_order(spark, tmp_path):
    for n, ids in (("b", ["3", "4"]), ("a", ["1", "2"])):
        doc = {"candidates": [{"id": f'C-"{i}', "name": 'say "hi"', "scores": all_of(3), "knockouts": {}} for i in ids]}
        (tmp_path / f"{n}.json").write_text(json.dumps(doc))
    rows = read_candidates(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["id"] for r in rows] == [f'C-"{i}' for i in "1234"] and len({r["ord"] for r in rows}) == 4


def test_strict_validation(spark):
    from ledgerloom.sources.research import candidates

    every = candidates(spark, "/root/testdata/sf0.001").withColumn("ord", F.col("ord"))
    good, bad = scoring.split_valid(every)
    assert scoring.require_valid(good).count() == good.count()
    assert not bad.isEmpty()
    with pytest.raises(Exception, match="candidate C-"):
        scoring.require_valid(every).collect()
