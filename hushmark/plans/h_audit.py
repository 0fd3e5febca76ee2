"""Queries over verification, outputs, and the SQL function surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushmark.functions import aggregates
from hushmark.functions import catalog as functions
from hushmark.operators import audit as A
from hushmark.operators import detect as D
from hushmark.operators import mask as O
from hushmark.operators.pipeline import detect_all
from hushmark.plans import fixtures as fx
from hushmark.plans.a_sources import all_units, kr_units
from hushmark.plans.b_formats import settled
from hushmark.plans.c_labels import EVERYTHING, T, forms, made
from hushmark.plans.d_evidence import CANDS_DUCK, cands
from hushmark.plans.f_masking import DECIDED_DUCK, _HIDDEN, RANGE_ROWS, decided
from hushmark.plans.g_policy import METADATA
from hushmark.session import cut, work_folder
from hushmark.sources import sink
from hushmark.sources import units as U


def redacted(spark, d, choice):
    """Korean units with their decisions applied, as a saved copy."""
    return O.redact_units(kr_units(spark, d), choice).selectExpr("doc_id", "unit_seq", "unit_id", "redacted AS text")


def _damaged(copy):
    """The saved copy with one unit changed, one lost and one added in some documents."""
    return copy.selectExpr(
        "doc_id", "unit_seq", "CASE WHEN doc_id % 7 = 1 AND unit_seq = 3 THEN concat(unit_id, 'x') ELSE unit_id END AS unit_id",
        "CASE WHEN doc_id % 5 = 2 AND unit_seq = 12 THEN concat(text, ' ') ELSE text END AS text")


def h1(spark, d):
    copy = cut(redacted(spark, d, decided(spark, d)))
    return A.verify_units(copy, _damaged(copy))


def h2(spark, d):
    want = fx.derive(spark, d, METADATA).withColumn("action", F.expr("IF(meta_id = 'info:title', 'delete', 'keep')"))
    got = want.where("action = 'keep' OR doc_id % 9 = 2").selectExpr("doc_id", "meta_id", "IF(doc_id % 8 = 3 AND meta_id = 'xmp:1:x', 'w', value) AS value")
    return A.verify_metadata(want, got)


def h3(spark, d):
    choice = decided(spark, d)
    return A.leak_scan(redacted(spark, d, choice), choice)


def h4(spark, d):
    """Every fourth form keeps a glyph that should be gone, every fifth loses one, every sixth gains one; all move by 0.2.

    Besides, each form has a glyph that is found again at the very distance allowed (every seventh: beyond it), and two of which the one could take the other's place.
    """
    chars = U.chars_from_lines(forms(spark, d))
    hidden = chars.where("unit_id = 'p1:b0:l5'").select("doc_id", "unit_id", "idx")
    saved = chars.where("NOT (unit_id = 'p1:b0:l5' AND NOT (doc_id % 4 = 1 AND idx = 0)) AND NOT (doc_id % 5 = 2 AND unit_id = 'p1:b0:l4' AND idx = 0)").selectExpr(
        "doc_id", "page", "c", "x0 + 0.2 AS x0", "y0 - 0.2 AS y0", "x1 + 0.2 AS x1", "y1 - 0.2 AS y1")
    more = chars.where("doc_id % 6 = 3 AND unit_id = 'p1:b0:l0' AND idx = 0").selectExpr("doc_id", "page", "'Z' AS c", "x0 + 500 AS x0", "y0", "x1 + 500 AS x1", "y1")
    docs = chars.select("doc_id", "page").distinct()

    def beside(*places):
        rows = ", ".join(f"struct('{c}', CAST({x} AS DOUBLE))" for c, x in places)
        return docs.selectExpr("doc_id", "page", f"inline(array({rows})) AS (c, x)").selectExpr("doc_id", "page", "c", "x AS x0", "0.0D AS y0", "x AS x1", "0.0D AS y1")

    source = chars.unionByName(beside(("I", "0"), ("T", "-100"), ("T", "-99.7")).selectExpr("*", "'p1:extra' AS unit_id", "CAST(-10 * x0 AS INT) AS idx"), allowMissingColumns=True)
    found = saved.unionByName(more).unionByName(beside(("I", "IF(doc_id % 7 = 1, 0.350001, 0.35)"), ("T", "-100.3"), ("T", "-99.8")))
    return A.glyph_check(source, found, hidden).select("doc_id", "page", "leaked", "lost", "left_over", "passed")


def h5(spark, d):
    choice = decided(spark, d)
    copy = redacted(spark, d, choice)
    return A.copy_review(D.pii_union(copy), choice).selectExpr("doc_id", "type", "value", "planned_keep")


def h5_all(spark, d):
    """The same with every detector, names, addresses and numbers included."""
    choice = decided(spark, d)
    copy = redacted(spark, d, choice)
    return A.copy_review(detect_all(cut(copy), T), choice).selectExpr("doc_id", "unit_id", "type", "value", "planned_keep")


def h6(spark, d):
    found = detect_all(kr_units(spark, d), T)
    return A.detection_audit(found, fx.derive(spark, d, fx.TRUTH)).selectExpr(
        "coalesce(type, 'all') AS type", "coalesce(CAST(doc_id AS STRING), 'all') AS doc", "expected", "detected", "matched", "missed", "extra")


NEGATIVES = f"SELECT k AS doc_id, phone2 AS value FROM ({fx.PEOPLE}) p UNION ALL SELECT k AS doc_id, 'DOC-2026-' || CAST(k % 1000 AS STRING) AS value FROM ({fx.PEOPLE}) q"


def h7(spark, d):
    return A.negative_controls(cands(spark, d), fx.derive(spark, d, NEGATIVES)).select("doc_id", "cand_id", "type")


def h8(spark, d):
    docs = fx.table(spark, d, "documents").selectExpr("concat('doc/', doc_id) AS path", "text", "doc_id")
    manifest = docs.where("doc_id % 10 <> 3").selectExpr("IF(doc_id % 10 = 4, concat(path, '.old'), path) AS path", "sha2(IF(doc_id % 10 = 5, concat(text, ' '), text), 256) AS sha256")
    return A.hash_manifest(manifest, docs)


def h9(spark, d):
    artifacts = fx.table(spark, d, "orders").selectExpr("o_orderkey AS doc_id", "o_orderkey % 3 AS version", "o_orderkey % 5 % 3 AS validation_version", "o_orderkey % 3 AS doc_version")
    checks = fx.table(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber % 3 AS version", "l_returnflag <> 'R' AS passed")
    return A.checks_rollup(artifacts, checks).select("doc_id", "version", "n_checks", "valid")


def h10(spark, d):
    source = fx.table(spark, d, "orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS page", "595 AS width", "842 AS height", "CAST(90 * (o_orderkey % 4) AS INT) AS rotation")
    saved = source.where("page % 50 <> 7").withColumn("rotation", F.expr("IF(page % 31 = 3, 180, rotation)"))
    return A.verify_geometry(source, saved)


def a8(spark, d):
    """Redact, check for leaks, write, and return the manifest."""
    choice = decided(spark, d)
    copy = redacted(spark, d, choice)
    leaks = A.leak_scan(copy, choice).select("doc_id").distinct().withColumn("leak", F.lit(True))
    checks = copy.select("doc_id").distinct().join(leaks, "doc_id", "left").selectExpr("doc_id", "'leak_scan' AS name", "leak IS NULL AS passed")
    folder = work_folder(spark, "copies")
    for run, part in (("even", "doc_id % 2 = 0"), ("odd", "doc_id % 2 = 1")):  # two batches of one version share the folder
        sink.redacted_sink(copy.where(part), checks.where(part), 2, folder, run)
    listed = sink.read_manifest(spark, folder, 2)
    stored = sink.read_copies(spark, folder, 2).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_stored"))
    return listed.join(stored, "doc_id").select("doc_id", "version", "n_units", "n_checks", "sha256", "n_stored")


def j1(spark, d):
    functions.register(spark, T)
    people = fx.derive(spark, d, fx.PEOPLE)
    return spark.sql(
        "SELECT k, mask_value(name, 'partial', array(named_struct('a', 1, 'b', 2))) AS masked, mask_text(concat(phone, ' ', email)) AS chained, is_valid_value('account', account) AS account_ok, "
        "is_valid_value('dob', phone) AS dob_ok, coalesce(label_type('성 명:'), '-') AS label, span_id('name', 'u#1', 0, 3) AS id, is_public_contact(concat('대표전화 ', phone2), phone2) AS public, "
        "array_join(array_sort(map_keys(mask_presets('name', name))), ',') AS presets FROM {people}", people=people)


def j2(spark, d):
    functions.register(spark, T)
    units = all_units(spark, d)
    return spark.sql("SELECT u.doc_id, u.unit_id, f.type, f.start, f.stop, f.value FROM {units} u, LATERAL find_pii(u.text) f", units=units)


def j3(spark, d):
    aggregates.register(spark)
    parts = aggregates.span_partials(fx.derive(spark, d, RANGE_ROWS), ["k"])
    return spark.sql("SELECT k, inline(span_union(a, b)) AS (a, b) FROM {parts} GROUP BY k", parts=parts)


QUERIES = {
    "verify_units": h1, "verify_metadata": h2, "leak_scan": h3, "glyph_check": h4, "copy_review": h5, "copy_review_all": h5_all, "detection_audit": h6, "negative_controls": h7,
    "hash_manifest": h8, "checks_rollup": h9, "verify_geometry": h10, "redacted_sink": a8, "sql_scalar_functions": j1, "sql_table_function": j2, "span_aggregate": j3,
}

# The saved copy: pieces between decided spans, joined in order.
COPY_DUCK = f"""
    WITH c AS ({DECIDED_DUCK}), u AS ({fx.KR_UNITS_DUCK}),
    o AS (SELECT doc_id, unit_id, start, "end", {_HIDDEN} AS out, lag("end", 1, 0) OVER (PARTITION BY doc_id, unit_id ORDER BY start) AS prev FROM c),
    j AS (SELECT o.doc_id, o.unit_id, string_agg(substr(u.text, o.prev + 1, o.start - o.prev) || o.out, '' ORDER BY o.start) AS head, max(o."end") AS tail
          FROM o JOIN u ON o.doc_id = u.doc_id AND o.unit_id = u.unit_id GROUP BY 1, 2)
    SELECT u.doc_id, u.unit_seq, u.unit_id, CASE WHEN j.tail IS NULL THEN u.text ELSE j.head || substr(u.text, j.tail + 1) END AS text
    FROM u LEFT JOIN j ON u.doc_id = j.doc_id AND u.unit_id = j.unit_id"""
LEAK_DUCK = f"""
    SELECT DISTINCT s.doc_id, s.unit_id, c.type, sha256(c.value) AS value_hash FROM ({COPY_DUCK}) s JOIN ({DECIDED_DUCK}) c ON s.doc_id = c.doc_id
    AND c.method IN ('full', 'delete', 'partial') AND contains(s.text, c.value)"""

ORACLE = {
    "verify_units": f"""
        SELECT doc_id, unit_id, 'different' AS fault FROM ({fx.KR_UNITS_DUCK}) WHERE doc_id % 5 = 2 AND unit_seq = 12
        UNION ALL SELECT doc_id, unit_id, 'missing' FROM ({fx.KR_UNITS_DUCK}) WHERE doc_id % 7 = 1 AND unit_seq = 3
        UNION ALL SELECT doc_id, unit_id || 'x', 'unexpected' FROM ({fx.KR_UNITS_DUCK}) WHERE doc_id % 7 = 1 AND unit_seq = 3""",
    "verify_metadata": """
        SELECT c_custkey AS doc_id, 'info:title' AS meta_id, 'left_over' AS fault FROM customer WHERE c_custkey % 9 = 2
        UNION ALL SELECT c_custkey, 'xmp:1:x', f FROM customer, (VALUES ('left_over'), ('not_kept')) v(f) WHERE c_custkey % 8 = 3""",
    "leak_scan": LEAK_DUCK,
    "glyph_check": f"""
        SELECT k AS doc_id, 1 AS page, (k % 4 = 1)::INT AS leaked, (k % 5 = 2)::INT + (k % 7 = 1)::INT AS lost, (k % 4 = 1)::INT + (k % 6 = 3)::INT + (k % 7 = 1)::INT AS left_over,
            NOT (k % 4 = 1 OR k % 5 = 2 OR k % 6 = 3 OR k % 7 = 1) AS passed FROM ({fx.PEOPLE})""",
    "copy_review": f"""
        WITH f AS ({settled(COPY_DUCK)}), k AS (SELECT DISTINCT doc_id, type, value FROM ({DECIDED_DUCK}) WHERE method = 'keep')
        SELECT doc_id, type, value, (doc_id, type, value) IN (SELECT (doc_id, type, value) FROM k) AS planned_keep FROM f""",
    "detection_audit": f"""
        WITH people AS ({fx.PEOPLE}), got AS (SELECT doc_id, type, value, count(*) AS g FROM ({made(*EVERYTHING)}) GROUP BY 1, 2, 3),
        wanted AS (SELECT doc_id, type, CASE WHEN type = 'account' THEN replace(value, '국민은행 ', '') ELSE value END AS value, count(*) AS w FROM ({fx.TRUTH}) GROUP BY 1, 2, 3),
        m AS (SELECT coalesce(got.doc_id, wanted.doc_id) AS doc_id, coalesce(got.type, wanted.type) AS type, coalesce(w, 0) AS w, coalesce(g, 0) AS g
              FROM got FULL JOIN wanted ON got.doc_id = wanted.doc_id AND got.type = wanted.type AND got.value = wanted.value),
        s AS (SELECT *, least(w, g) AS hit FROM m),
        r AS (SELECT type, '' || doc_id AS doc, w, g, hit FROM s UNION ALL SELECT type, 'all', w, g, hit FROM s UNION ALL SELECT 'all', 'all', w, g, hit FROM s)
        SELECT type, doc, sum(w)::BIGINT AS expected, sum(g)::BIGINT AS detected, sum(hit)::BIGINT AS matched, sum(w - hit)::BIGINT AS missed, sum(g - hit)::BIGINT AS extra FROM r GROUP BY 1, 2""",
    "negative_controls": f"SELECT c.doc_id, c.cand_id, c.type FROM ({CANDS_DUCK}) c JOIN ({fx.PEOPLE}) p ON c.doc_id = p.k AND c.value = p.phone2",
    "hash_manifest": """
        SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 10 IN (3, 4) THEN 'unlisted' WHEN doc_id % 10 = 5 THEN 'changed' ELSE 'ok' END AS outcome FROM documents
        UNION ALL SELECT 'doc/' || doc_id || '.old', 'missing' FROM documents WHERE doc_id % 10 = 4""",
    "checks_rollup": """
        SELECT o_orderkey AS doc_id, o_orderkey % 3 AS version, count(l_orderkey) AS n_checks,
            count(l_orderkey) > 0 AND count(*) FILTER (WHERE l_returnflag = 'R') = 0 AND o_orderkey % 5 % 3 = o_orderkey % 3 AS valid
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber % 3 = o_orderkey % 3 GROUP BY o_orderkey""",
    "verify_geometry": """
        SELECT o_custkey AS doc_id, count(*) FILTER (WHERE o_orderkey % 50 = 7) = 0 AS same_pages,
            count(*) FILTER (WHERE o_orderkey % 50 = 7 OR (o_orderkey % 31 = 3 AND o_orderkey % 4 <> 2)) = 0 AS same_geometry FROM orders GROUP BY 1""",
    "redacted_sink": f"""
        WITH s AS ({COPY_DUCK}), bad AS (SELECT DISTINCT doc_id FROM ({LEAK_DUCK}))
        SELECT doc_id, 2 AS version, count(*) AS n_units, 1 AS n_checks, sha256(sha256(string_agg(sha256(text), '' ORDER BY unit_seq))) AS sha256, count(*) AS n_stored
        FROM s WHERE doc_id NOT IN (SELECT doc_id FROM bad) GROUP BY doc_id""",
    "sql_scalar_functions": f"""
        SELECT k, left(name, 1) || '*' || right(name, 1) AS masked, '****-' || substr(phone, 5) || ' ****@*****.***' AS chained, true AS account_ok, false AS dob_ok, 'name' AS label,
            'c_' || substr(sha256('["name","u#1",0,3]'), 1, 24) AS id, true AS public, 'name_initial,name_middle' AS presets FROM ({fx.PEOPLE})""",
    "sql_table_function": f"SELECT doc_id, unit_id, type, start, \"end\" AS stop, value FROM ({settled()})",
    "span_aggregate": f"""
        WITH p AS (SELECT DISTINCT k, unnest(range(a, b)) AS pos FROM ({RANGE_ROWS}) WHERE 0 <= a AND a < b),
        n AS (SELECT k, pos, pos - row_number() OVER (PARTITION BY k ORDER BY pos) AS g FROM p)
        SELECT k, min(pos) AS a, max(pos) + 1 AS b FROM n GROUP BY k, g""",
}
