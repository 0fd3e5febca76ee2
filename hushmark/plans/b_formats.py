"""Queries over format detection and literal search."""

from __future__ import annotations

from hushmark.operators import detect as D
from hushmark.plans import fixtures as fx
from hushmark.plans.a_sources import all_units

# Offset scan: at each position, does the shape start here, and does its left neighbour allow it?
def scan(shape: str, after: str, before: str, width: int = 80) -> str:
    return (
        f"list_filter(range(1, length(text) + 1), lambda i: regexp_matches(substr(text, i, {width}), '^(?:{shape}){after}') "
        f"AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '{before}')))"
    )


def scan_sql(shape: str, after: str, before: str, units: str = fx.ALL_UNITS_DUCK, guard: str = "[0-9@]") -> str:
    return f"""
        WITH u AS (SELECT * FROM ({units}) WHERE regexp_matches(text, '{guard}')),
        h AS (SELECT doc_id, unit_id, text, unnest({scan(shape, after, before)}) AS i FROM u)
        SELECT doc_id, unit_id, i - 1 AS start,
               i - 1 + length(regexp_extract(substr(text, i), '^({shape}){after}', 1)) AS "end",
               regexp_extract(substr(text, i), '^({shape}){after}', 1) AS value FROM h"""


SHAPES = {
    "resident_id": ("[0-9]{6}[- ]?[1-4][0-9]{6}", "(?:[^0-9]|$)", "[0-9]"),
    "foreign_id": ("[0-9]{6}[- ]?[5-8][0-9]{6}", "(?:[^0-9]|$)", "[0-9]"),
    "phone": ("(?:01[016789]|0[0-9]{1,2})[- ]?[0-9]{3,4}[- ]?[0-9]{4}", "(?:[^0-9]|$)", "[0-9.-]"),
    "email": ("[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[a-zA-Z]{2,}", "", "[\\p{L}\\p{N}_.+-]"),
}


def _one(kind):
    return lambda spark, d: D.detect_formats(all_units(spark, d), kind)


# Text with overlapping shapes: a run of digits that two formats claim, or a phone in an e-mail.
OVERLAP = (
    "SELECT c_custkey AS doc_id, 0 AS unit_seq, '/u#0' AS unit_id, "
    "CASE WHEN c_custkey % 3 = 0 THEN '010-1234-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || '@mail.example.com 끝' "
    "WHEN c_custkey % 3 = 1 THEN '번호 0' || lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') || ' 1' || lpad(CAST(c_custkey AS STRING), 6, '0') || ' x' "
    "ELSE 'a@b.example.com 950817-1' || lpad(CAST(c_custkey AS STRING), 6, '0') END AS text FROM customer"
)


def b7(spark, d):
    units = fx.derive(spark, d, OVERLAP)
    found = D.pii_union(units)
    return found.selectExpr("doc_id", "unit_id", "start", "end", "type", "array_join(alts, ',') AS alts")


def b8(spark, d):
    found = D.pii_union(all_units(spark, d))
    return found.select("doc_id", "unit_id", "type", "start", "end", "cand_id")


def b9(spark, d):
    found = D.pii_union(all_units(spark, d))
    return found.selectExpr("doc_id", "unit_id", "type", "start", "end", "value", "method", "confirmed", "located", "source",
                            "size(mask) AS n_mask", "array_join(alts, ',') AS alts")


def union_all(units: str = fx.ALL_UNITS_DUCK) -> str:
    return " UNION ALL ".join(
        f"SELECT *, '{k}' AS type, {i} AS prio FROM ({scan_sql(*SHAPES[k], units=units)}) s{i}" for i, k in enumerate(SHAPES)
    )


# First in (start, priority) order wins; written as a recursive walk so that chains of overlaps are settled in order.
def settled(units: str = fx.ALL_UNITS_DUCK) -> str:
    return f"""
        WITH RECURSIVE raw AS ({union_all(units)}),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY start, prio) AS rn FROM raw),
        walk AS (SELECT doc_id, unit_id, rn, rn AS keeper, "end" AS reach FROM n WHERE rn = 1
            UNION ALL SELECT n.doc_id, n.unit_id, n.rn, CASE WHEN n.start >= w.reach THEN n.rn ELSE w.keeper END,
                CASE WHEN n.start >= w.reach THEN n."end" ELSE w.reach END
            FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.unit_id = w.unit_id AND n.rn = w.rn + 1)
        SELECT k.doc_id, k.unit_id, k.start, k."end", k.type, k.value,
            coalesce(string_agg(m.type, ',' ORDER BY m.rn) FILTER (WHERE m.rn <> k.rn), '') AS alts
        FROM walk w JOIN n k ON k.doc_id = w.doc_id AND k.unit_id = w.unit_id AND k.rn = w.keeper
        JOIN n m ON m.doc_id = w.doc_id AND m.unit_id = w.unit_id AND m.rn = w.rn
        GROUP BY k.doc_id, k.unit_id, k.rn, k.start, k."end", k.type, k.value"""


ID_DUCK = "'c_' || substr(sha256('[\"' || type || '\",\"' || unit_id || '\",' || CAST(start AS STRING) || ',' || CAST(\"end\" AS STRING) || ']'), 1, 24)"

QUERIES = {f"detect_{k}": _one(k) for k in SHAPES}
QUERIES |= {"resolve_overlaps": b7, "candidate_id": b8, "pii_union": b9}
ORACLE = {f"detect_{k}": scan_sql(*SHAPES[k]) for k in SHAPES}
ORACLE |= {
    "resolve_overlaps": f"SELECT doc_id, unit_id, start, \"end\", type, alts FROM ({settled(OVERLAP)})",
    "candidate_id": f"SELECT doc_id, unit_id, type, start, \"end\", {ID_DUCK} AS cand_id FROM ({settled()})",
    "pii_union": f"SELECT doc_id, unit_id, type, start, \"end\", value, 'full' AS method, false AS confirmed, true AS located, "
                 f"'rule' AS source, 0 AS n_mask, alts FROM ({settled()})",
}
