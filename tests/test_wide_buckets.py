"""What lines take on disk: few of them are shuffled twice."""

from pyspark.sql import functions as F

from hushmark.operators import evidence as E
from hushmark.operators.joins import interval_join


def test_few_lines_are_shuffled_twice(spark, monkeypatch):
    """Lines of text height down a page, each with its reach of 72 points above: a bucket holds several reaches."""
    lines = spark.range(400).selectExpr("1L AS doc_id", "1 AS page", "concat('u', id) AS unit_id", "CAST(id AS INT) AS unit_seq", "'값' AS text", "50 AS x0", "id * 20 AS y0", "90 AS x1", "id * 20 + 12 AS y1")
    dealt = []

    def counted(left, right, on, left_range, right_range, width, condition=None):
        for side, (low, high) in ((left, left_range), (right, right_range)):
            dealt.append(side.selectExpr(f"floor(({high}) / {width}) - floor(({low}) / {width}) + 1 AS n").agg(F.sum("n")).first()[0])
        return interval_join(left, right, on, left_range, right_range, width, condition)

    monkeypatch.setattr(E, "interval_join", counted)
    above = {r.unit_id: r.src_unit_id for r in E.line_relations(lines).where("relation = 'nearest_above'").collect()}
    assert above == {f"u{k}": f"u{k - 1}" for k in range(1, 400)}
    assert sum(dealt[:2]) < 2 * 400 * 1.25
