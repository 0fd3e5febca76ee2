"""Finds that later rules see are stored as a table."""

from hushmark.operators import pipeline


def test_finds_are_stored_as_a_table(spark, monkeypatch):
    units = spark.createDataFrame([(1, 0, "a", "성명: 김가민"), (1, 1, "b", "오늘 김가민님은")], "doc_id long, unit_seq int, unit_id string, text string")
    relations = spark.createDataFrame([], "doc_id long, unit_id string, relation string, rel_ord long, src_unit_id string, src_text string")
    kept, write = [], pipeline.stored
    monkeypatch.setattr(pipeline, "stored", lambda frame, purpose: kept.append(purpose) or write(frame, purpose))
    found = pipeline.detect_all(units, "2026-01-01", relations)
    assert sorted((r.unit_id, r.value) for r in found.collect()) == [("a", "김가민"), ("b", "김가민")]
    assert kept == ["first", "names"]
