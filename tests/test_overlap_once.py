"""Records that overlap candidates are made of the same candidates."""

from hushmark.plans import d_evidence
from hushmark.plans.catalog import QUERIES


def test_overlap_records_come_from_the_candidates_they_meet(spark, monkeypatch, tmp_path):
    spark.range(1, 4).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "'M' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    calls, whole = [], d_evidence.detect_all
    monkeypatch.setattr(d_evidence, "detect_all", lambda *a, **k: calls.append(a) or whole(*a, **k))
    QUERIES["merge_overlap"](spark, str(tmp_path))
    assert len(calls) == 1
