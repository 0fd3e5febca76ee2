"""Glyphs and lines take little room on disk: they are shuffled once, or stored as tables."""

from hushmark.operators import audit
from hushmark.plans import c_labels


def test_glyphs_are_brought_together_once(spark):
    shape = "doc_id long, page int, unit_id string, idx int, c string, x0 double, y0 double, x1 double, y1 double"
    rows = [(d, 1, "u", k, "a", 9.0 * k, 0.0, 9.0 * k, 0.0) for d in range(20) for k in range(50)]
    # Of no document and of no page: each side stands apart.
    odd = [(None, 1, "u", 0, "a", 0.0, 0.0, 0.0, 0.0), (30, None, "u", 0, "a", 0.0, 0.0, 0.0, 0.0), (30, None, "u", 1, "a", 9.0, 0.0, 9.0, 0.0)]
    source = spark.createDataFrame(rows + odd, shape)
    saved = source.drop("unit_id", "idx").where("NOT (doc_id <=> 7 AND x0 = 0)")
    hidden = spark.createDataFrame([(7, "u", 0), (8, "u", 1), (8, "u", 1), (30, "u", 0), (None, "u", 0)], "doc_id long, unit_id string, idx int")
    found = audit.glyph_check(source, saved, hidden)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    want = [(d, 1, int(d == 8), 0, int(d == 8), d != 8) for d in range(20)]
    want += [(None, 1, 0, 1, 0, False), (None, 1, 0, 0, 1, False), (30, None, 0, 1, 0, False), (30, None, 0, 0, 2, False)]
    assert got == sorted(want, key=str)
    # Source, saved and marks meet without a join; only counts of pages are joined.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_forms_and_lines_are_stored_as_tables(spark, tmp_path):
    spark.range(8).selectExpr("id AS c_custkey", "'n' AS c_name", "'s' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(8).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    for made, rows in ((c_labels.forms, 72), (c_labels.lines, 24)):
        frame = made(spark, str(tmp_path))
        assert "parquet" in frame._jdf.queryExecution().executedPlan().toString().lower() and frame.count() == rows
