"""Removal of rows by key."""

from pyspark.sql import functions as F

from ledgerloom.llm import common


def test_without_moves_only_marked_rows(spark, frame, monkeypatch):
    monkeypatch.setattr(common, "PART_BITS", 6)  # many parts, and rows that only seem to be dropped
    rows = [(i, f"t{i}", None, None) for i in range(3000)] + [(7, "t7", None, None)] * 3 + [(9000, "again", None, None)] * 4
    key = common.row_key("doc_id", "text")
    docs = frame(rows)
    dropped = docs.filter("doc_id % 3 = 1").select(key.alias("_key")).distinct()
    repeated = docs.filter("doc_id = 9000").select(key.alias("_key")).distinct()
    got = common.without(docs, key, dropped, repeated)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(3000) if i % 3 != 1] + [9000]
    marks = docs.filter(common.marked(dropped)(key))
    assert marks.filter(F.col("doc_id") % 3 == 1).count() == 1003 and marks.count() < 1600
