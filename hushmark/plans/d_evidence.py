"""Queries over location evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushmark import constants as K
from hushmark.operators import detect as D
from hushmark.operators import evidence as E
from hushmark.operators.pipeline import detect_all
from hushmark.plans import fixtures as fx
from hushmark.plans.a_sources import all_units, kr_units
from hushmark.plans.b_formats import ID_DUCK, settled
from hushmark.plans.c_labels import EVERYTHING, GRID_DUCK, T, forms, grid, lines, made
from hushmark.session import cut
from hushmark.sources import units as U

# All candidates of the Korean units, names repeated in other lines among them, by construction.
CANDS_DUCK = (
    f"WITH people AS ({fx.PEOPLE}) SELECT *, CAST(split_part(unit_id, '#', 2) AS INT) AS unit_seq, {ID_DUCK} AS cand_id FROM ("
    + made(*EVERYTHING) + ")"
)


def cands(spark, d):
    """The candidate table of the Korean units, written once because later steps read it several times."""
    return cut(detect_all(kr_units(spark, d), T))


def flagged_units(spark, d):
    """Lines 0, 4 and 9 are headings, lines 6 and 7 sit in a table; line 4 alone may be blank text."""
    return kr_units(spark, d).withColumns({
        "heading": F.expr("unit_seq IN (0, 4, 9, 15)"), "in_cell": F.expr("unit_seq IN (6, 7)"),
    })


def d1(spark, d):
    units = all_units(spark, d)
    return E.evidence_self(units, D.pii_union(units), K.EXCERPT).selectExpr("doc_id", "cand_id", "src_unit_id", "ev_start", "ev_end", "ev_text")


def _paragraph(relation):
    def query(spark, d):
        return E.paragraph_relations(flagged_units(spark, d)).where(f"relation = '{relation}'").select("doc_id", "unit_id", "src_unit_id", "src_text")

    return query


def _cells(spark, d):
    """Cells of which every first one has another paragraph, and those of the first row twelve, laid on the grid."""
    cells = grid(spark, d).drop("grid_col", "span")
    more = cells.where("cell_ord = 0").selectExpr(*[c for c in cells.columns if c not in ("unit_id", "text", "unit_seq")],
                                                  "explode(sequence(1, IF(row = 0, 12, 1))) AS n", "unit_id AS u", "unit_seq AS s").selectExpr(
        *[c for c in cells.columns if c not in ("unit_id", "text", "unit_seq")], "concat(u, 'b', n) AS unit_id", "s + n AS unit_seq", "'확인' AS text")
    return U.cell_grid(cells.unionByName(more))


def d4(spark, d):
    return E.cell_relations(_cells(spark, d)).select("doc_id", "unit_id", "relation", "src_unit_id", "src_text")


def _lines(build):
    def query(spark, d):
        every = forms(spark, d).unionByName(lines(spark, d).withColumn("doc_id", F.expr("-1 - doc_id")))
        return build(every).select("doc_id", "unit_id", "src_unit_id", "src_text")

    return query


def d8(spark, d):
    """All pieces; those after the third are over this query's limit. Every second document's candidates are proven by two characters of their unit."""
    found = forms(spark, d).unionByName(lines(spark, d).withColumn("doc_id", F.expr("-1 - doc_id")))
    probes = found.selectExpr("doc_id", "unit_id", "unit_id AS cand_id", "0 AS start", "IF(doc_id % 2 = 0, unit_id, NULL) AS proof_unit", "0 AS proof_start", "2 AS proof_end")
    return E.evidence_top8(found, probes, E.line_relations(found), 3).selectExpr("doc_id", "cand_id", "ord", "relation", "src_unit_id", "over_limit")


PLACES = (
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN CAST(1 + o_orderkey % 9 AS INT) END AS page, "
    "CASE WHEN o_orderkey % 3 = 1 THEN CAST(1 + o_orderkey % 5 AS INT) END AS tbl, CAST(1 + o_orderkey % 4 AS INT) AS row, CAST(1 + o_orderkey % 7 AS INT) AS col, "
    "CASE WHEN o_orderkey % 7 = 0 THEN 'header' WHEN o_orderkey % 7 = 1 THEN 'footer' WHEN o_orderkey % 7 = 2 THEN 'other' ELSE 'body' END AS region FROM orders"
)


def d9(spark, d):
    return E.location_label(fx.derive(spark, d, PLACES)).select("k", "label")


def d10(spark, d):
    """Candidates against units whose even lines were edited after detection."""
    edited = kr_units(spark, d).withColumn("text", F.expr("CASE WHEN unit_seq % 2 = 0 AND doc_id % 3 = 0 THEN concat('- ', text) ELSE text END"))
    return E.stale_spans(edited, cands(spark, d)).select("doc_id", "cand_id", "stale")


QUERIES = {
    "evidence_self": d1, "evidence_heading": _paragraph("preceding_heading"), "evidence_prev_paragraph": _paragraph("preceding_paragraph"),
    "evidence_cells": d4, "evidence_left": _lines(E.left_relations), "evidence_above": _lines(E.above_relations),
    "evidence_numbered": _lines(E.numbered_relations), "evidence_top8": d8, "location_label": d9, "stale_spans": d10,
}

_EVERY = f"SELECT * FROM ({fx.FORMS}) UNION ALL SELECT -1 - doc_id, page, unit_id, unit_seq, text, x0, y0, x1, y1 FROM ({fx.LINES})"
_LEFT = """SELECT a.doc_id, a.unit_id, b.unit_id AS src_unit_id, b.text AS src_text, b.x0, b.unit_seq,
        row_number() OVER (PARTITION BY a.doc_id, a.unit_id ORDER BY b.x0, b.unit_seq) AS up,
        row_number() OVER (PARTITION BY a.doc_id, a.unit_id ORDER BY b.x0 DESC, b.unit_seq DESC) AS down
    FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.page = b.page AND a.unit_id <> b.unit_id AND b.x1 <= a.x0 + 1
        AND greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 6"""
_ABOVE = """SELECT a.doc_id, a.unit_id, b.unit_id AS src_unit_id, b.text AS src_text,
        row_number() OVER (PARTITION BY a.doc_id, a.unit_id ORDER BY a.y0 - b.y1, abs(a.x0 - b.x0), b.unit_seq) AS rn
    FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.page = b.page AND a.unit_id <> b.unit_id AND a.y0 - b.y1 BETWEEN 0 AND 72
        AND (least(a.x1, b.x1) > greatest(a.x0, b.x0) OR abs(b.x0 - a.x0) <= 12)"""
_NUMBERED = """SELECT a.doc_id, a.unit_id, b.unit_id AS src_unit_id, b.text AS src_text,
        row_number() OVER (PARTITION BY a.doc_id, a.unit_id ORDER BY a.y0 - b.y1, b.unit_seq) AS rn
    FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.page = b.page AND a.unit_id <> b.unit_id AND a.y0 - b.y1 > 0 AND a.y0 - b.y1 <= 360
        AND b.x0 <= a.x0 + 2 AND (b.text LIKE '1. %' OR b.text LIKE '가) %')"""
_FLAGGED = f"""SELECT *, unit_seq IN (0, 4, 9, 15) AS heading, unit_seq IN (6, 7) AS in_cell FROM ({fx.KR_UNITS_DUCK})"""
_HEAD = """(SELECT max(h.unit_seq) FROM f h WHERE h.doc_id = f.doc_id AND h.unit_seq < f.unit_seq AND h.heading AND trim(h.text) <> '')"""

ORACLE = {
    "evidence_self": f"""
        SELECT c.doc_id, {ID_DUCK.replace('unit_id', 'c.unit_id').replace('start', 'c.start')} AS cand_id, u.unit_id AS src_unit_id,
            CASE WHEN least(c.start - 80, length(u.text) - 300) < 0 THEN 0 ELSE least(c.start - 80, length(u.text) - 300) END AS ev_start,
            least(length(u.text), greatest(0, least(c.start - 80, length(u.text) - 300)) + 300) AS ev_end,
            substr(u.text, greatest(0, least(c.start - 80, length(u.text) - 300)) + 1, 300) AS ev_text
        FROM ({settled()}) c JOIN ({fx.ALL_UNITS_DUCK}) u ON c.doc_id = u.doc_id AND c.unit_id = u.unit_id""",
    "evidence_heading": f"""
        WITH f AS ({_FLAGGED}), h AS (SELECT doc_id, unit_id, {_HEAD} AS hs FROM f)
        SELECT h.doc_id, h.unit_id, s.unit_id AS src_unit_id, s.text AS src_text FROM h JOIN f s ON s.doc_id = h.doc_id AND s.unit_seq = h.hs""",
    "evidence_prev_paragraph": f"""
        WITH f AS ({_FLAGGED}), h AS (SELECT doc_id, unit_id, unit_seq, {_HEAD} AS hs,
            (SELECT max(p.unit_seq) FROM f p WHERE p.doc_id = f.doc_id AND p.unit_seq < f.unit_seq AND NOT p.in_cell AND trim(p.text) <> '') AS ps,
            (SELECT max(t.unit_seq) FROM f t WHERE t.doc_id = f.doc_id AND t.unit_seq < f.unit_seq AND t.in_cell) AS ts
            FROM f WHERE NOT in_cell AND NOT heading)
        SELECT h.doc_id, h.unit_id, s.unit_id AS src_unit_id, s.text AS src_text FROM h JOIN f s ON s.doc_id = h.doc_id AND s.unit_seq = h.ps
        WHERE h.ps > coalesce(h.ts, -1) AND h.ps <> coalesce(h.hs, -1)""",
    "evidence_cells": f"""
        WITH c AS ({fx.CELLS}), g0 AS ({GRID_DUCK}),
        g AS (SELECT doc_id, tbl, row, cell_ord, col, span, unit_id, text FROM g0
              UNION ALL SELECT doc_id, tbl, row, cell_ord, col, span, unit_id || 'b' || n, '확인' FROM g0, unnest(range(1, 13)) AS p(n) WHERE cell_ord = 0 AND (row = 0 OR n = 1))
        SELECT a.doc_id, a.unit_id, 'same_cell' AS relation, b.unit_id AS src_unit_id, b.text AS src_text FROM g a JOIN g b
            ON a.doc_id = b.doc_id AND a.tbl = b.tbl AND a.row = b.row AND a.cell_ord = b.cell_ord AND a.unit_id <> b.unit_id
        UNION ALL SELECT a.doc_id, a.unit_id, 'table_row_first_cell', b.unit_id, b.text FROM g a JOIN g b
            ON a.doc_id = b.doc_id AND a.tbl = b.tbl AND a.row = b.row AND a.col > 1 AND b.cell_ord = 0
        UNION ALL SELECT a.doc_id, a.unit_id, 'table_first_row', b.unit_id, b.text FROM g a JOIN g b
            ON a.doc_id = b.doc_id AND a.tbl = b.tbl AND a.row > 0 AND b.row = 0 AND a.col = b.col AND a.span = b.span""",
    "evidence_left": f"WITH e AS ({_EVERY}) SELECT doc_id, unit_id, src_unit_id, src_text FROM ({_LEFT}) WHERE up = 1 OR down = 1",
    "evidence_above": f"WITH e AS ({_EVERY}) SELECT doc_id, unit_id, src_unit_id, src_text FROM ({_ABOVE}) WHERE rn = 1",
    "evidence_numbered": f"WITH e AS ({_EVERY}) SELECT doc_id, unit_id, src_unit_id, src_text FROM ({_NUMBERED}) WHERE rn = 1",
    "evidence_top8": f"""
        WITH e AS ({_EVERY}), r AS (
            SELECT doc_id, unit_id, unit_id AS src_unit_id, 'self' AS relation, 0 AS o FROM e
            UNION ALL SELECT doc_id, unit_id, src_unit_id, 'same_row_left', 100 + up FROM ({_LEFT}) WHERE up = 1 OR down = 1
            UNION ALL SELECT doc_id, unit_id, src_unit_id, 'nearest_above', 1000 FROM ({_ABOVE}) WHERE rn = 1
            UNION ALL SELECT doc_id, unit_id, src_unit_id, 'preceding_numbered_line', 2000 FROM ({_NUMBERED}) WHERE rn = 1
            UNION ALL SELECT doc_id, unit_id, unit_id, 'label_proof', 1000000 FROM e WHERE doc_id % 2 = 0 AND length(text) > 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY o) AS ord FROM r)
        SELECT doc_id, unit_id AS cand_id, ord, relation, src_unit_id, ord > 3 AS over_limit FROM n""",
    "location_label": f"""
        SELECT k, CASE WHEN page > 0 THEN page || '쪽' WHEN tbl > 0 THEN r || ' · 표 ' || tbl || ' · ' || row || '행 ' || col || '열' ELSE r END AS label
        FROM (SELECT *, coalesce((SELECT n FROM (VALUES ('header', '머리말'), ('footer', '꼬리말')) v(g, n) WHERE g = region), '본문') AS r FROM ({PLACES}))""",
    "stale_spans": f"SELECT doc_id, cand_id, unit_seq % 2 = 0 AND doc_id % 3 = 0 AS stale FROM ({CANDS_DUCK})",
}
