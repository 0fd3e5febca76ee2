"""Queries over grounding of extraction records."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushmark.operators import ground as G
from hushmark.operators import layout as L
from hushmark.plans import fixtures as fx
from hushmark.plans.a_sources import kr_units
from hushmark.plans.c_labels import forms
from hushmark.plans.d_evidence import CANDS_DUCK, cands
from hushmark.session import cut
from hushmark.sources import units as U


def payloads(spark, d):
    return fx.derive(spark, d, fx.EXTRACTIONS)


def records(spark, d):
    return G.parse_extractions(payloads(spark, d))[0]


def kept(spark, d):
    return G.drop_non_values(records(spark, d))


def grounded(spark, d):
    return G.ground_passport(G.ground_literal(kr_units(spark, d), kept(spark, d)))


def open_records(spark, d):
    rows = kept(spark, d)
    return G.ungrounded(rows, G.ground_passport(G.ground_literal(kr_units(spark, d), rows)))


def e1(spark, d):
    good, bad = G.parse_extractions(payloads(spark, d))
    return good.selectExpr("doc_id", "type", "raw_value", "role_raw", "context_raw", "'' AS fault").unionByName(
        bad.selectExpr("doc_id", "'' AS type", "'' AS raw_value", "'' AS role_raw", "'' AS context_raw", "fault"))


_OLDER = {"confirmed": "doc_id % 5 = 2", "decision_source": "IF(doc_id % 7 = 3, 'user', NULL)", "has_proposal": "doc_id % 11 = 4"}


def older(rows):
    """Candidates that an earlier run made of records; people confirmed or decided some."""
    return G.unresolved_candidates(rows).withColumns({name: F.expr(rule) for name, rule in _OLDER.items()})


def e2(spark, d):
    every = records(spark, d)
    _, removed = G.drop_absent_candidates(older(every))
    return G.omitted_counts(every).join(G.drop_non_values(every).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept")), "doc_id").join(removed, "doc_id")


def e3(spark, d):
    return G.ground_literal(kr_units(spark, d), kept(spark, d)).select("doc_id", "type", "raw_value", "unit_id", "start", "end")


def e4(spark, d):
    return grounded(spark, d).where("type = 'passport'").select("doc_id", "raw_value", "unit_id", "start", "end")


def _reconciled(rule):
    def query(spark, d):
        known = cands(spark, d)
        met = G.with_variants(known, rule(cut(open_records(spark, d)), known)).where("size(variants) > 0")
        return met.selectExpr("doc_id", "cand_id", "type", "array_join(sources, ',') AS sources", "array_join(variants, '|') AS variants")

    return query


WRAPPED = (
    "SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN address || '  ' || extra WHEN k % 3 = 1 THEN address || chr(10) || extra ELSE address || extra || ' 별관' END AS value "
    f"FROM (SELECT k, address, CAST(1 + k % 20 AS STRING) || '동 ' || CAST(100 + k % 900 AS STRING) || '호' AS extra FROM ({fx.PEOPLE}) p) q"
)


def e8(spark, d):
    f = forms(spark, d)
    found = L.ground_multiline(f, U.chars_from_lines(f), fx.derive(spark, d, WRAPPED))
    return found.select("doc_id", "linked_value", "link_index", "link_count", "link_group", "unit_id", "start", "end", "value")


def e9(spark, d):
    return G.merge_same_span(cands(spark, d), grounded(spark, d)).selectExpr(
        "doc_id", "cand_id", "type", "array_join(alts, ',') AS alts", "array_join(sources, ',') AS sources")


def overlap_records(spark, d, known):
    """Grounded records plus spans that sit inside, reach outside, or repeat earlier records, made of the known candidates."""
    base = known.where("type IN ('phone', 'address', 'dob')")
    inside = base.where("type = 'phone'").selectExpr("doc_id", "unit_id", "start + 4 AS start", "end", "'account' AS type", "substring(value, 5) AS raw_value", "9000000 AS rec_no", "'' AS context_raw")
    wide = base.where("type = 'dob'").selectExpr("doc_id", "unit_id", "start - 3 AS start", "end", "'management_id' AS type", "value AS raw_value", "11000000 AS rec_no", "'생일' AS context_raw")
    free = kr_units(spark, d).where("unit_seq = 12").selectExpr("doc_id", "unit_id", "0 AS start", "5 AS end", "'name' AS type", "'예산 합계' AS raw_value", "0 AS rec_no", "'' AS context_raw")
    again = free.selectExpr("doc_id", "unit_id", "start", "end", "'card' AS type", "raw_value", "10000000 AS rec_no", "context_raw")
    part = free.selectExpr("doc_id", "unit_id", "3 AS start", "8 AS end", "'dob' AS type", "'합계 10' AS raw_value", "4000000 AS rec_no", "'x' AS context_raw")
    every = inside.unionByName(wide).unionByName(free).unionByName(again).unionByName(part)
    return every.withColumn("page", F.expr("IF(doc_id % 2 = 0, CAST(1 + doc_id % 7 AS INT), NULL)"))


def e10(spark, d):
    known = cands(spark, d)
    found, unresolved = G.merge_overlap(known, overlap_records(spark, d, known))
    a = found.selectExpr("doc_id", "cand_id", "type", "value", "array_join(alts, ',') AS alts", "array_join(sources, ',') AS sources", "fresh", "start")
    b = unresolved.selectExpr("doc_id", "cand_id", "type", "value", "'proposed' AS alts", "'service' AS sources", "true AS fresh", "proposed_start AS start")
    return a.unionByName(b)


def e11(spark, d):
    return G.unresolved_candidates(open_records(spark, d)).select("doc_id", "cand_id", "type", "value", "located", "source")


RUNS = (
    "SELECT o_custkey AS doc_id, 'c_' || CAST(o_orderkey % 7 AS STRING) AS cand_id, CAST(o_orderkey % 5 AS INT) AS run, o_orderkey AS seq, "
    "o_orderstatus AS method, o_orderpriority AS note FROM orders"
)


def e12(spark, d):
    return G.dedupe_candidates(fx.derive(spark, d, RUNS))


CROWD = (
    "SELECT l_suppkey AS doc_id, CAST(l_orderkey AS INT) AS unit_seq, l_linenumber AS start, "
    "CAST(l_partkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING) AS cand_id FROM lineitem"
)


def e13(spark, d):
    return G.cap_candidates(fx.derive(spark, d, CROWD).distinct(), 600)


def e14(spark, d):
    elements = kr_units(spark, d).selectExpr("doc_id", "unit_seq AS element_ord", "concat('e', unit_seq) AS element_id", "CAST(1 + unit_seq / 6 AS INT) AS page",
                                             "CASE WHEN unit_seq = 0 THEN 'heading1' ELSE 'paragraph' END AS category", "text")
    placed = cands(spark, d).withColumn("page", F.expr("CAST(1 + unit_seq / 6 AS INT)"))
    free = G.structure_evidence(placed.drop("page"), elements, False, 3).selectExpr("'flow' AS kind", "doc_id", "cand_id", "n", "element_id", "category", "over_limit")
    paged = G.structure_evidence(placed, elements, True, 3).selectExpr("'paged' AS kind", "doc_id", "cand_id", "n", "element_id", "category", "over_limit")
    return free.unionByName(paged)


ADDITIONAL = (
    "SELECT doc_id, type, CASE WHEN doc_id % 4 = 0 THEN value || 'x' ELSE value END AS value, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, "
    f"CAST(1 + doc_id % 3 AS INT) AS page, 'x' || CAST(doc_id % 90 AS STRING) AS coordinates, 1 AS ord FROM ({fx.TRUTH}) t UNION ALL SELECT doc_id, type, value, 'medium' AS confidence, 9 AS page, NULL AS coordinates, 2 AS ord FROM ({fx.TRUTH}) t2"
)


def e15(spark, d):
    return G.confidence_evidence(cands(spark, d), fx.derive(spark, d, ADDITIONAL)).selectExpr(
        "doc_id", "cand_id", "coalesce(confidence, 'none') AS confidence", "coalesce(confidence_page, 0) AS page", "coalesce(coordinates, '-') AS coordinates")


def e16(spark, d):
    return G.quote_guard(grounded(spark, d)).selectExpr(
        "doc_id", "type", "unit_id", "start", "coalesce(role_raw, '-') AS role_raw", "coalesce(context_raw, '-') AS context_raw")


def e17(spark, d):
    """Open records of other spellings, and addresses over two lines, of which every fourth document lacks the second line's candidate."""
    rows = cut(open_records(spark, d))
    known = cands(spark, d)
    explained = G.reconcile_email(rows, known).unionByName(G.reconcile_address(rows, known)).unionByName(G.reconcile_whitespace(rows, known))
    f = forms(spark, d)
    linked = cut(L.ground_multiline(f, U.chars_from_lines(f), fx.derive(spark, d, WRAPPED)))
    lines = linked.where("NOT (doc_id % 4 = 1 AND link_index = 1)").selectExpr("doc_id", "unit_id", "start", "end", "value", "'address' AS type", "true AS located")
    wrapped = fx.derive(spark, d, WRAPPED).selectExpr("doc_id", "'address' AS type", "value AS raw_value", "'' AS context_raw")
    old = older(rows.select(*wrapped.columns).unionByName(wrapped))
    every = explained.selectExpr("doc_id", "type", "raw_value AS value").unionByName(G.repaired_addresses(linked, lines))
    return G.repair_unresolved(old, every).select("doc_id", "cand_id", "type", "value")


def e18(spark, d):
    docs = fx.table(spark, d, "documents")
    manual = fx.table(spark, d, "labels").where("toxic = 1 OR quality = 0").selectExpr("doc_id", "IF(toxic = 1, 'case_record', 'other') AS class")
    service = docs.where("lang IN ('en', 'fr')").selectExpr("doc_id", "IF(lang = 'en', 'report_minutes', 'contract_agreement') AS class")
    return G.final_doc_type(docs, manual, service).selectExpr("doc_id", "coalesce(class, '-') AS class", "coalesce(source, '-') AS source")


def _find_literal(disjoint):
    def query(spark, d):
        from hushmark.operators.literal import locate

        units = U.units_from_text(fx.table(spark, d, "benchmark").selectExpr("item_id AS doc_id", "text"))
        values = fx.table(spark, d, "benchmark").selectExpr("item_id AS doc_id", "explode(array('th', 'en', 'haha', substring(text, 5, 4), 'an')) AS value")
        rows = locate(units, values, disjoint)
        people = fx.dealt(fx.table(spark, d, "customer"))
        own = U.units_from_text(fx.derive(spark, d, "SELECT c_custkey AS doc_id, repeat('가나', 4) || '😀' || c_name || repeat('0', 5) AS text FROM customer"))
        seeds = people.selectExpr("c_custkey AS doc_id", "explode(array('가나가', '000', 'Customer#', '(?a)')) AS value")
        rows = rows.unionByName(locate(own, seeds, disjoint).withColumn("doc_id", F.expr("-1 - doc_id")))
        # One document that holds every customer as a line and is searched for every customer's name.
        ledger = people.selectExpr("1000000000L AS doc_id", "CAST(c_custkey AS INT) AS unit_seq", "concat('#', c_custkey) AS unit_id", "'ledger' AS part",
                                                           "concat(c_name, ' / ', c_name, ' / ', c_mktsegment) AS text")
        names = people.selectExpr("1000000000L AS doc_id", "c_name AS value")
        return rows.unionByName(locate(ledger, names, disjoint)).select("doc_id", "unit_id", "value", "start", "end")

    return query


QUERIES = {
    "locate_literal": _find_literal(False), "locate_literal_disjoint": _find_literal(True),
    "parse_extractions": e1, "drop_non_values": e2, "ground_literal": e3, "ground_passport": e4, "reconcile_email": _reconciled(G.reconcile_email),
    "reconcile_address": _reconciled(G.reconcile_address), "reconcile_whitespace": _reconciled(G.reconcile_whitespace), "ground_multiline": e8,
    "merge_same_span": e9, "merge_overlap": e10, "unresolved_candidates": e11, "dedupe_candidates": e12, "cap_candidates": e13,
    "structure_evidence": e14, "confidence_evidence": e15, "quote_guard": e16, "repair_unresolved": e17, "final_doc_type": e18,
}

# Records by construction: (type, value, role, context).
_VALID = "k % 13 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AND k % 23 <> 0"
_RECORDS = [
    ("name", "name", "성명", "''"), ("name", "other", "담당", "''"),
    ("phone", "CASE WHEN k % 4 = 1 THEN substr(phone, 1, 4) || ' ' || substr(phone, 5) ELSE phone END", "연락처", "'연락처: ' || phone"),
    ("email", "CASE WHEN k % 3 = 1 THEN substr(email, 1, 4) || ' ' || substr(email, 5) ELSE email END", "이메일", "''"),
    ("address", "CASE WHEN k % 3 = 2 THEN replace(address, ' ', '  ') ELSE address END", "주소", "''"),
    ("dob", "CASE WHEN k % 5 = 0 THEN '해당 없음' ELSE dob END", "생년월일", "''"),
    ("resident_id", "CASE WHEN k % 6 = 0 THEN '990101-9999999' ELSE resident END", "주민등록번호", "''"),
    ("passport", "CASE WHEN k % 7 = 0 THEN substr(passport, 1, 7) ELSE passport END", "여권번호", "''"),
    ("driver_license", "CASE WHEN k % 5 = 1 THEN 'N/A' ELSE license END", "없는 역할", "''"),
    ("account", "CASE WHEN k % 3 = 0 THEN '국민은행 ' || account ELSE account END", "계좌번호", "''"),
    ("card", "substr(card, 1, 14)", "카드번호", "''"), ("management_id", "staff", "사번", "''"),
]
X_DUCK = " UNION ALL ".join(
    f"SELECT k AS doc_id, '{t}' AS type, {v} AS raw_value, '{r}' AS role_raw, {c} AS context_raw FROM ({fx.PEOPLE}) x{i} WHERE {_VALID}"
    for i, (t, v, r, c) in enumerate(_RECORDS)
)
_ABSENT = "raw_value IN ('해당 없음', 'N/A')"
# Literal places: every position of every unit is compared with every record of the document.
GROUND_DUCK = f"""
    SELECT x.*, u.unit_id, u.text, i.i - 1 AS start, i.i - 1 + length(raw_value) AS "end"
    FROM (SELECT * FROM ({X_DUCK}) WHERE NOT {_ABSENT}) x JOIN ({fx.KR_UNITS_DUCK}) u ON x.doc_id = u.doc_id AND contains(u.text, x.raw_value),
    unnest(range(1, length(u.text) + 1)) AS i(i) WHERE substr(u.text, i.i, length(raw_value)) = raw_value"""
GROUNDED_DUCK = f"SELECT * FROM ({GROUND_DUCK}) WHERE type <> 'passport' OR length(raw_value) = 9"
OPEN_DUCK = f"SELECT * FROM ({X_DUCK}) o WHERE NOT {_ABSENT} AND NOT EXISTS (SELECT 1 FROM ({GROUNDED_DUCK}) g WHERE g.doc_id = o.doc_id AND g.type = o.type AND g.raw_value = o.raw_value)"
_U_ID = """'u_' || substr(sha256('{"context": "' || context_raw || '", "proposedLocation": ' || proposed || ', "type": "' || type || '", "value": "' || raw_value || '"}'), 1, 24)"""


def _reconcile_duck(kinds: str, normal: str) -> str:
    return f"""
        WITH c AS ({CANDS_DUCK}), o AS ({OPEN_DUCK})
        SELECT o.doc_id, c.cand_id, c.type, CASE WHEN c.type IN ('phone', 'email', 'resident_id', 'foreign_id') THEN 'rule' ELSE 'local_label' END || ',service' AS sources,
            string_agg(DISTINCT o.raw_value, '|') AS variants FROM o JOIN c ON o.doc_id = c.doc_id AND o.type = c.type AND {normal.format('o.raw_value')} = {normal.format('c.value')}
        WHERE o.type IN ({kinds}) AND o.raw_value <> c.value
          AND (SELECT count(DISTINCT value) FROM c y WHERE y.doc_id = o.doc_id AND y.type = o.type AND {normal.format('y.value')} = {normal.format('o.raw_value')}) = 1 GROUP BY 1, 2, 3"""


_NUMBERS = "'resident_id', 'foreign_id', 'passport', 'driver_license', 'phone', 'account', 'card', 'dob', 'management_id'"
_NO_SPACE = "replace({0}, ' ', '')"
_LITERALS = """
    SELECT item_id AS doc_id, u.i - 1 AS seq, list_extract(string_split(text, chr(10)), u.i) AS text, item_id AS k, text AS whole FROM benchmark, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)"""
_ALL_HITS = f"""
    WITH b AS ({_LITERALS}), v AS (SELECT DISTINCT item_id AS doc_id, unnest(['th', 'en', 'haha', substr(text, 5, 4), 'an']) AS value FROM benchmark),
    t AS (SELECT b.doc_id, '/word/document.xml#' || seq AS unit_id, b.text, v.value FROM b JOIN v ON b.doc_id = v.doc_id
        UNION ALL SELECT -1 - c_custkey, '/word/document.xml#0', repeat('가나', 4) || '😀' || c_name || repeat('0', 5), x FROM customer, (VALUES ('가나가'), ('000'), ('Customer#'), ('(?a)')) s(x)
        UNION ALL SELECT 1000000000, '#' || c_custkey, c_name || ' / ' || c_name || ' / ' || c_mktsegment, c_name FROM customer),
    h AS (SELECT doc_id, unit_id, value, i.i - 1 AS start, i.i - 1 + length(value) AS "end" FROM t, unnest(range(1, length(text) + 1)) AS i(i) WHERE substr(text, i.i, length(value)) = value)"""

ORACLE = {
    "locate_literal": f"{_ALL_HITS} SELECT * FROM h",
    # Left to right without overlap: follow the next hit that starts at or after the last end.
    "locate_literal_disjoint": _ALL_HITS.replace("WITH b AS", "WITH RECURSIVE b AS") + """,
        w AS (SELECT doc_id, unit_id, value, min(start) AS start FROM h GROUP BY 1, 2, 3
              UNION ALL SELECT w.doc_id, w.unit_id, w.value, (SELECT min(h.start) FROM h WHERE h.doc_id = w.doc_id AND h.unit_id = w.unit_id AND h.value = w.value
                    AND h.start >= w.start + length(w.value)) FROM w WHERE w.start IS NOT NULL)
        SELECT doc_id, unit_id, value, start, start + length(value) AS "end" FROM w WHERE start IS NOT NULL""",
    "parse_extractions": f"""
        SELECT *, '' AS fault FROM ({X_DUCK}) UNION ALL SELECT k, '', '', '', '', CASE WHEN k % 13 = 0 THEN 'invalid_json' WHEN k % 17 = 0 THEN 'missing_key'
            WHEN k % 19 = 0 THEN 'management_id:not_array' ELSE 'management_id:raw_value' END FROM ({fx.PEOPLE}) WHERE NOT ({_VALID})""",
    "drop_non_values": f"SELECT doc_id, sum(CASE WHEN {_ABSENT} THEN 1 ELSE 0 END)::BIGINT AS omitted, sum(CASE WHEN {_ABSENT} THEN 0 ELSE 1 END)::BIGINT AS kept, "
                       f"sum(CASE WHEN {_ABSENT} AND doc_id % 5 <> 2 AND doc_id % 7 <> 3 THEN 1 ELSE 0 END)::BIGINT AS removed FROM ({X_DUCK}) GROUP BY doc_id",
    "ground_literal": f'SELECT doc_id, type, raw_value, unit_id, start, "end" FROM ({GROUND_DUCK})',
    "ground_passport": f"SELECT doc_id, raw_value, unit_id, start, \"end\" FROM ({GROUND_DUCK}) WHERE type = 'passport' AND NOT regexp_matches(substr(text, \"end\" + 1, 1), '[A-Za-z0-9_-]') "
                       "AND NOT (start > 0 AND regexp_matches(substr(text, start, 1), '[A-Za-z0-9_-]'))",
    "reconcile_email": _reconcile_duck("'email'", _NO_SPACE),
    "reconcile_address": _reconcile_duck("'address'", "regexp_replace({0}, ' +', ' ', 'g')"),
    "reconcile_whitespace": _reconcile_duck(_NUMBERS, _NO_SPACE),
    "ground_multiline": f"""
        WITH p AS (SELECT w.*, q.address, q.extra FROM ({WRAPPED}) w JOIN (SELECT k, address, CAST(1 + k % 20 AS STRING) || '동 ' || CAST(100 + k % 900 AS STRING) || '호' AS extra FROM ({fx.PEOPLE}) p0) q ON w.doc_id = q.k
            WHERE k % 3 < 2 AND k % 4 <> 0)
        SELECT doc_id, value AS linked_value, v.i AS link_index, 2 AS link_count,
            'address_' || substr(sha256('[["p1:b0:l2",0,' || length(address) || '],["p1:b0:l3",0,' || length(extra) || ']]'), 1, 24) AS link_group,
            'p1:b0:l' || (v.i + 1) AS unit_id, 0 AS start, length(CASE v.i WHEN 1 THEN address ELSE extra END) AS "end", CASE v.i WHEN 1 THEN address ELSE extra END AS value
        FROM p, (VALUES (1), (2)) v(i)""",
    "merge_same_span": f"""
        WITH c AS ({CANDS_DUCK}), g AS ({GROUNDED_DUCK})
        SELECT c.doc_id, c.cand_id, c.type, coalesce((SELECT string_agg(DISTINCT g.type, ',' ORDER BY g.type) FROM g WHERE g.doc_id = c.doc_id AND g.unit_id = c.unit_id AND g.start = c.start AND g."end" = c."end" AND g.type <> c.type), '') AS alts,
            CASE WHEN c.type IN ('phone', 'email', 'resident_id', 'foreign_id') THEN 'rule' ELSE 'local_label' END
            || CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.doc_id = c.doc_id AND g.unit_id = c.unit_id AND g.start = c.start AND g."end" = c."end") THEN ',service' ELSE '' END AS sources FROM c""",
    "merge_overlap": f"""
        WITH c AS ({CANDS_DUCK}),
        old AS (SELECT doc_id, cand_id, type, value, CASE WHEN type = 'phone' THEN 'account' ELSE '' END AS alts,
            CASE WHEN type IN ('phone', 'email', 'resident_id', 'foreign_id') THEN 'rule' ELSE 'local_label' END || CASE WHEN type = 'phone' THEN ',service' ELSE '' END AS sources, false AS fresh, start FROM c),
        wide AS (SELECT doc_id, '생일' AS context_raw, 'management_id' AS type, value AS raw_value, start - 3 AS start, "end",
            '[{{"end": ' || "end" || ', "page": ' || CASE WHEN doc_id % 2 = 0 THEN CAST(1 + doc_id % 7 AS VARCHAR) ELSE 'null' END || ', "start": ' || (start - 3) || ', "unitId": "' || unit_id || '"}}]' AS proposed FROM c WHERE type = 'dob'),
        part AS (SELECT c_custkey AS doc_id, 'x' AS context_raw, 'dob' AS type, '합계 10' AS raw_value, 3 AS start, 8 AS "end",
            '[{{"end": 8, "page": ' || CASE WHEN c_custkey % 2 = 0 THEN CAST(1 + c_custkey % 7 AS VARCHAR) ELSE 'null' END || ', "start": 3, "unitId": "/word/document.xml#12"}}]' AS proposed FROM customer)
        SELECT * FROM old
        UNION ALL SELECT c_custkey, 'c_' || substr(sha256('["name","/word/document.xml#12",0,5]'), 1, 24), 'name', '예산 합계', 'card', 'service', true, 0 FROM customer
        UNION ALL SELECT doc_id, {_U_ID}, type, raw_value, 'proposed', 'service', true, start FROM (SELECT * FROM wide UNION ALL SELECT * FROM part)""".replace("{{", "{").replace("}}", "}"),
    "unresolved_candidates": f"SELECT doc_id, {_U_ID} AS cand_id, type, raw_value AS value, false AS located, 'service' AS source FROM (SELECT *, '[]' AS proposed FROM ({OPEN_DUCK}))",
    "dedupe_candidates": f"SELECT doc_id, cand_id, run, seq, method, note FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cand_id ORDER BY run, seq) AS rn FROM ({RUNS})) WHERE rn = 1",
    "cap_candidates": f"""
        WITH c AS (SELECT DISTINCT * FROM ({CROWD})), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_seq, start, cand_id) AS rn, count(*) OVER (PARTITION BY doc_id) AS total FROM c)
        SELECT doc_id, unit_seq, start, cand_id, rn > 600 AS over_limit, total > 600 AS incomplete FROM n""",
    "structure_evidence": f"""
        WITH c AS (SELECT *, CAST(floor(unit_seq / 6) AS INT) + 1 AS page FROM ({CANDS_DUCK})), e AS (SELECT *, CAST(floor(unit_seq / 6) AS INT) + 1 AS page FROM ({fx.KR_UNITS_DUCK})),
        m AS (SELECT 'flow' AS kind, c.doc_id, c.cand_id, e.unit_seq, e.page FROM c JOIN e ON c.doc_id = e.doc_id AND contains(e.text, c.value)
            UNION ALL SELECT 'paged', c.doc_id, c.cand_id, e.unit_seq, e.page FROM c JOIN e ON c.doc_id = e.doc_id AND c.page = e.page AND contains(e.text, c.value)),
        r AS (SELECT *, row_number() OVER (PARTITION BY kind, doc_id, cand_id ORDER BY unit_seq) AS n FROM m)
        SELECT kind, doc_id, cand_id, n, 'e' || unit_seq AS element_id, CASE WHEN unit_seq = 0 THEN 'heading1' ELSE 'paragraph' END AS category, n > 3 AS over_limit FROM r""",
    "confidence_evidence": f"""
        WITH c AS ({CANDS_DUCK}), a AS (SELECT DISTINCT * FROM ({ADDITIONAL}))
        SELECT c.doc_id, c.cand_id, CASE WHEN a1.doc_id IS NOT NULL THEN coalesce(a1.confidence, 'low') WHEN a2.doc_id IS NOT NULL THEN 'medium' ELSE 'none' END AS confidence,
            coalesce(a1.page, a2.page, 0) AS page, coalesce(a1.coordinates, '-') AS coordinates FROM c LEFT JOIN a a1 ON a1.doc_id = c.doc_id AND a1.type = c.type AND a1.value = c.value AND a1.ord = 1
            LEFT JOIN a a2 ON a2.doc_id = c.doc_id AND a2.type = c.type AND a2.value = c.value AND a2.ord = 2""",
    "quote_guard": f"""SELECT doc_id, type, unit_id, start, CASE WHEN position(role_raw IN text) > 0 THEN role_raw ELSE '-' END AS role_raw,
        CASE WHEN context_raw <> '' AND position(context_raw IN text) > 0 THEN context_raw ELSE '-' END AS context_raw FROM ({GROUNDED_DUCK})""",
    "repair_unresolved": f"""
        SELECT doc_id, {_U_ID} AS cand_id, type, raw_value AS value FROM (SELECT *, '[]' AS proposed FROM ({OPEN_DUCK}))
        WHERE doc_id % 5 = 2 OR doc_id % 7 = 3 OR doc_id % 11 = 4 OR NOT ((type = 'email' AND doc_id % 3 = 1) OR (type = 'address' AND doc_id % 3 = 2) OR (type = 'phone' AND doc_id % 4 = 1))
        UNION ALL SELECT doc_id, 'u_' || substr(sha256('{{"context": "", "proposedLocation": [], "type": "address", "value": "' || replace(value, chr(10), '\\n') || '"}}'), 1, 24), 'address', value FROM ({WRAPPED})
        WHERE doc_id % 5 = 2 OR doc_id % 7 = 3 OR doc_id % 11 = 4 OR doc_id % 3 = 2 OR doc_id % 4 IN (0, 1)""",
    "final_doc_type": """
        SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'case_record' WHEN l.quality = 0 THEN 'other' WHEN lang = 'en' THEN 'report_minutes' WHEN lang = 'fr' THEN 'contract_agreement' ELSE '-' END AS class,
            CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 'user' WHEN lang IN ('en', 'fr') THEN 'service' ELSE '-' END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}
