"""Queries over label-grounded and layout detection.

The SQL side states what each document holds by construction: the generated lines are
known, so the expected spans follow from the values and the length of the words before them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hushmark.functions.validate import label_type, valid_value
from hushmark.operators import detect as D
from hushmark.operators import evidence as E
from hushmark.operators import layout as L
from hushmark.operators.pipeline import detect_all, propagate_names
from hushmark.plans import fixtures as fx
from hushmark.plans.a_sources import all_units, kr_units
from hushmark.plans.b_formats import settled
from hushmark.session import stored
from hushmark.sources import units as U

T = fx.TODAY
SPAN = ["doc_id", "unit_id", "start", "end", "type", "value"]

LABEL_TEXTS = (
    "SELECT c_custkey AS k, CASE c_custkey % 16 WHEN 0 THEN ' 성  명 :' WHEN 1 THEN '[주소]' WHEN 2 THEN '갑의 주소' WHEN 3 THEN 'Passport No.' "
    "WHEN 4 THEN '* 계좌번호' WHEN 5 THEN '결제 카드번호：' WHEN 6 THEN '사번' WHEN 7 THEN '생년월일·' WHEN 8 THEN '운전면허증번호' "
    "WHEN 9 THEN '문서번호' WHEN 10 THEN '연락처' WHEN 11 THEN '성명(한글)' WHEN 12 THEN '주소 변경' WHEN 13 THEN '' WHEN 14 THEN '예금주' "
    "ELSE c_name END AS text FROM customer"
)
LABEL_ANSWER = (
    "(VALUES (' 성  명 :', 'name'), ('[주소]', 'address'), ('갑의 주소', 'address'), ('Passport No.', 'passport'), ('* 계좌번호', 'account'), "
    "('결제 카드번호：', 'card'), ('사번', 'management_id'), ('생년월일·', 'dob'), ('운전면허증번호', 'driver_license'), ('성명(한글)', 'name'), "
    "('예금주', 'name')) a(label, type)"
)


def c1(spark, d):
    return fx.derive(spark, d, LABEL_TEXTS).selectExpr("k", "text", f"coalesce({label_type('text')}, 'none') AS type")


def _finds(spark, d, expression, source=all_units):
    return D.as_rows(source(spark, d), expression).select(*SPAN)


def c2(spark, d):
    return _finds(spark, d, D.inline_fields(T))


def _labelled(kind):
    return lambda spark, d: _finds(spark, d, D.labelled(kind, T))


def c4(spark, d):
    units = all_units(spark, d).withColumn("has_phone", F.expr(f"exists({D.format_candidates()}, f -> f.type = 'phone')"))
    return D.as_rows(units, D.role_names()).select(*SPAN)


def c5(spark, d):
    return _finds(spark, d, D.residence_addresses(T))


def c6(spark, d):
    return _finds(spark, d, D.care_receipts(T))


VALUES = (
    f"SELECT doc_id AS k, type, CASE doc_id % 6 WHEN 1 THEN value || '1' WHEN 2 THEN substr(value, 1, 7) WHEN 3 THEN '없음' "
    f"WHEN 4 THEN replace(value, '-', ' ') WHEN 5 THEN replace(value, '-0', '-') ELSE value END AS value FROM ({fx.TRUTH}) t"
)


def c7(spark, d):
    return fx.derive(spark, d, VALUES).selectExpr("k", "type", "value", f"{valid_value('type', 'value', T)} AS valid")


def grid(spark, d):
    return U.cell_grid(fx.derive(spark, d, fx.CELLS))


def cell_units(spark, d):
    return fx.derive(spark, d, fx.CELLS).select("doc_id", "unit_seq", "unit_id", "text")


def c8(spark, d):
    return E.neighbour_fields(cell_units(spark, d), E.cell_relations(grid(spark, d)), T).select(*SPAN, "relation")


def forms(spark, d):
    return stored(fx.derive(spark, d, fx.FORMS), "forms")


def lines(spark, d):
    return stored(fx.derive(spark, d, fx.LINES), "lines")


def c9(spark, d):
    return L.address_row_label(forms(spark, d), T).select(*SPAN, "proof_unit")


def c10(spark, d):
    f = forms(spark, d)
    found = D.finish(L.address_row_label(f, T))
    return L.address_continuation(f, found).select(*SPAN, "group_id")


def c11a(spark, d):
    return L.layout_rows(lines(spark, d)).select("doc_id", "page", "unit_id", "row_no")


def c11b(spark, d):
    return L.table_headers(L.layout_rows(lines(spark, d))).selectExpr(
        "doc_id", "page", "row_no", "col_no", "kind", "CAST(left_edge AS INT) AS left_edge")


def c11c(spark, d):
    found = lines(spark, d)
    return L.table_column_fields(found, T, U.chars_from_lines(found)).select(*SPAN)


def c12(spark, d):
    units = kr_units(spark, d)
    return propagate_names(units, D.detect_in_unit(units, T)).select("doc_id", "unit_id", "start", "end", "value")


PRECEDENCE = (
    "SELECT k AS doc_id, 0 AS unit_seq, '/u#0' AS unit_id, CASE k % 5 WHEN 0 THEN '계좌번호: ' || n WHEN 1 THEN '사번: ' || n "
    "WHEN 2 THEN '계좌번호: ' || n || '-90' WHEN 3 THEN '계좌번호: 950817-1' || substr(n, 10, 4) || '99' ELSE '운전면허번호 ' || n END AS text, n "
    "FROM (SELECT c_custkey AS k, '010-1234-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS n FROM customer) c"
)


def c13(spark, d):
    return D.detect_in_unit(fx.derive(spark, d, PRECEDENCE), T).selectExpr(
        "doc_id", "start", "end", "type", "value", "array_join(alts, ',') AS alts")


def c14(spark, d):
    return detect_all(all_units(spark, d), T).selectExpr(
        "doc_id", "unit_id", "start", "end", "type", "value", "cand_id", "array_join(alts, ',') AS alts", "source", "method")


def c14_layout(spark, d):
    every = forms(spark, d).unionByName(lines(spark, d).withColumn("doc_id", F.expr("-1 - doc_id")))
    units = every.select("doc_id", "unit_seq", "unit_id", "text")
    found = detect_all(units, T, E.line_relations(every), every, U.chars_from_lines(every))
    return found.selectExpr("doc_id", "unit_id", "start", "end", "type", "value")


def c15(spark, d):
    return D.classify_documents(all_units(spark, d))


QUERIES = {"label_lookup": c1, "inline_fields": c2}
QUERIES |= {f"detect_{k}": _labelled(k) for k in ("account", "card", "passport", "driver_license", "management_id", "dob")}
QUERIES |= {
    "detect_role_name": c4, "detect_address": c5, "detect_case_receipt": c6, "validate_value": c7, "label_neighbour_fields": c8,
    "address_row_label": c9, "address_continuation": c10, "layout_rows": c11a, "table_headers": c11b, "table_column_fields": c11c,
    "propagate_names": c12, "label_precedence": c13, "detect_all": c14, "detect_all_layout": c14_layout, "classify_document": c15,
}


def made(*rows: tuple[int, str, str, str, str]) -> str:
    """Expected spans: (line, words before the value, value, type, condition on k)."""
    return " UNION ALL ".join(
        f"SELECT k AS doc_id, '/word/document.xml#{line}' AS unit_id, length({before}) AS start, length({before}) + length({value}) AS \"end\", "
        f"'{kind}' AS type, {value} AS value FROM people WHERE {condition}"
        for line, before, value, kind, condition in rows
    )


def _made(*rows, columns="*"):
    return f"WITH people AS ({fx.PEOPLE}) SELECT {columns} FROM ({made(*rows)})"


ACCOUNT = [(6, "'계좌번호: 국민은행 '", "account", "account", "k % 3 = 0"), (6, "'정산 계좌번호 : '", "account", "account", "k % 3 = 1"),
           (6, "'입금 계좌('", "account", "account", "k % 3 = 2")]
CARD = [(7, "'카드번호: '", "card", "card", "true")]
PASSPORT = [(7, "'카드번호: ' || card || ' 여권번호: '", "passport", "passport", "true")]
LICENSE = [(8, "'운전면허번호 '", "license", "driver_license", "true")]
STAFF = [(8, "'운전면허번호 ' || license || ' 사번: '", "staff", "management_id", "true")]
DOB = [(4, "'생년월일: '", "dob", "dob", "true")]
NAME = [(1, "'성명: '", "name", "name", "true")]
ROLE = [(10, "'😀 문의: 급여담당 '", "other", "name", "k % 5 = 0"), (10, "'가족(모) '", "other", "name", "k % 5 = 1"),
        (10, "'주식회사 예시 (대표 '", "other", "name", "k % 5 = 2"), (10, "'갑: '", "other", "name", "k % 5 = 3")]
ADDRESS = [(5, "'주소: '", "address", "address", "true")]
HOME = [(14, "'거주지 '", "(address || ' 101동')", "address", "true")]
RECEIPT = [(11, "'상담 기록 접수번호: '", "receipt", "management_id", "k % 2 = 0")]
REPEAT = [(9, "'오늘 '", "name", "name", "true"), (9, "'오늘 ' || name || '님은 참석했고 '", "name", "name", "true")]
FORMATS = [
    (2, "'연락처: '", "phone", "phone", "true"), (2, "'연락처: ' || phone || ' 이메일: '", "email", "email", "true"),
    (3, "'주민등록번호 '", "resident", "resident_id", "true"),
    (3, "'주민등록번호 ' || resident || ' 외국인등록번호 '", "foreign_no", "foreign_id", "true"),
    (10, "'😀 문의: 급여담당 ' || other || ' '", "phone2", "phone", "k % 5 = 0"),
    (10, "'가족(모) ' || other || ' 에게 '", "phone2", "phone", "k % 5 = 1"),
    (14, "'거주지 ' || address || ' 101동; 문의 창구 대표전화 '", "phone2", "phone", "true"),
    (16, "'담당자 검토 메모 '", "phone", "phone", "true"), (16, "'담당자 검토 메모 ' || phone || ' '", "email", "email", "true"),
]
EVERYTHING = FORMATS + NAME + ROLE + HOME + RECEIPT + ACCOUNT + CARD + PASSPORT + LICENSE + STAFF + DOB + ADDRESS + REPEAT
INLINE = NAME + DOB + ADDRESS + [ACCOUNT[1]] + CARD + PASSPORT

ID = "'c_' || substr(sha256('[\"' || type || '\",\"' || unit_id || '\",' || CAST(start AS STRING) || ',' || CAST(\"end\" AS STRING) || ']'), 1, 24)"

GRID_DUCK = f"""
    SELECT *, 1 + coalesce((SELECT sum(CASE WHEN b.colspan < 1 THEN 1 ELSE b.colspan END) FROM c b WHERE b.doc_id = a.doc_id AND b.tbl = a.tbl
        AND b.row = a.row AND b.cell_ord < a.cell_ord), 0) AS col, CASE WHEN colspan < 1 THEN 1 ELSE colspan END AS span FROM c a"""

VALID_DUCK = """CASE WHEN value = '없음' THEN false
    WHEN type = 'name' THEN regexp_full_match(value, '[가-힣A-Za-z][가-힣A-Za-z''-]{1,29}')
    WHEN type = 'address' THEN length(value) >= 8 AND regexp_matches(value, '[0-9]') AND starts_with(value, '서울')
    WHEN type = 'dob' THEN coalesce(CASE WHEN regexp_full_match(value, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') OR regexp_full_match(value, '[0-9]{8}')
        THEN try_cast(CASE WHEN value LIKE '%-%' THEN value ELSE substr(value,1,4)||'-'||substr(value,5,2)||'-'||substr(value,7,2) END AS DATE)
            BETWEEN DATE '1900-01-01' AND DATE '2026-01-01' ELSE false END, false)
    WHEN type = 'passport' THEN regexp_full_match(value, '[A-Z0-9]{6,12}') AND regexp_matches(value, '[0-9]')
    WHEN type = 'driver_license' THEN regexp_full_match(value, '([0-9]{2}|[가-힣]{2,4})[- ][0-9]{2}[- ][0-9]{6}[- ][0-9]{2}') OR regexp_full_match(value, '[0-9]{12}')
    WHEN type = 'account' THEN regexp_full_match(value, '[0-9]+([ -][0-9]+)*') AND length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 8 AND 18
    WHEN type = 'card' THEN regexp_full_match(value, '[0-9]+([ -][0-9]+)*') AND length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 13 AND 19
    WHEN type = 'management_id' THEN regexp_full_match(value, '[A-Za-z0-9][A-Za-z0-9_-]{2,63}') AND regexp_matches(value, '[0-9]')
    ELSE false END"""

LAYOUT_TABLE = f"""
    SELECT doc_id, 'p1:b' || CAST(tbl AS STRING) || ':l' || CAST(r * 3 + v.pos AS STRING) AS unit_id, 0 AS start, length(v.value) AS "end", v.type, v.value
    FROM ({fx.ORDER_PEOPLE}) o, LATERAL (SELECT * FROM (VALUES
        (CASE WHEN tbl % 6 = 4 THEN 1 ELSE 0 END, 'name', name),
        (CASE WHEN tbl % 6 = 4 THEN 0 ELSE 1 END, CASE WHEN tbl % 6 = 5 THEN 'phone' ELSE 'management_id' END, staff),
        (2, 'dob', dob)) x(pos, type, value)) v
    WHERE r >= 1 AND v.type <> 'phone' AND (tbl % 6 IN (0, 4, 5) OR r = 1)"""

ORACLE = {
    "label_lookup": f"SELECT k, text, coalesce(type, 'none') AS type FROM ({LABEL_TEXTS}) t LEFT JOIN {LABEL_ANSWER} ON text = label",
    "inline_fields": _made(*INLINE),
    "detect_account": _made(*ACCOUNT), "detect_card": _made(*CARD), "detect_passport": _made(*PASSPORT),
    "detect_driver_license": _made(*LICENSE), "detect_management_id": _made(*STAFF), "detect_dob": _made(*DOB),
    "detect_role_name": _made(*NAME, *ROLE), "detect_address": _made(*HOME), "detect_case_receipt": _made(*RECEIPT),
    "validate_value": f"SELECT k, type, value, {VALID_DUCK} AS valid FROM ({VALUES})",
    "label_neighbour_fields": f"""
        WITH c AS ({fx.CELLS}), g AS ({GRID_DUCK}),
        m AS (SELECT d.doc_id, d.unit_id, d.text AS value, CASE h.text WHEN '성 명' THEN 'name' WHEN '사번' THEN 'management_id' WHEN '생년월일' THEN 'dob' END AS type
              FROM g d JOIN g h ON d.doc_id = h.doc_id AND d.tbl = h.tbl AND d.col = h.col AND d.span = h.span AND h.row = 0 AND d.row > 0)
        SELECT doc_id, unit_id, 0 AS start, length(value) AS "end", type, value, 'table_first_row' AS relation FROM m WHERE value <> '미기재'""",
    "address_row_label": f"""
        WITH f AS ({fx.FORMS})
        SELECT v.doc_id, v.unit_id, 0 AS start, length(v.text) AS "end", 'address' AS type, v.text AS value, l.unit_id AS proof_unit
        FROM f v JOIN f l ON v.doc_id = l.doc_id AND v.page = l.page AND replace(l.text, ' ', '') = '주소' AND v.text LIKE '서울%'
            AND l.x1 < v.x0 AND abs((l.y0 + l.y1) / 2.0 - (v.y0 + v.y1) / 2.0) <= 12""",
    "address_continuation": f"""
        WITH f AS ({fx.FORMS}),
        n AS (SELECT b.*, row_number() OVER (PARTITION BY a.doc_id, a.unit_id ORDER BY b.y0, b.unit_seq) AS rn,
                'c_' || substr(sha256('["address","' || a.unit_id || '",0,' || CAST(length(a.text) AS STRING) || ']'), 1, 24) AS group_id
              FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.text LIKE '서울%' AND abs(a.x0 - b.x0) <= 2 AND b.y0 - a.y1 BETWEEN 0 AND 18)
        SELECT doc_id, unit_id, 0 AS start, length(text) AS "end", 'address' AS type, text AS value, group_id FROM n
        WHERE rn = 1 AND regexp_matches(text, '[0-9]+호')""",
    "layout_rows": f"""
        WITH l AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0) <= 3 THEN 0 ELSE 1 END AS fresh FROM ({fx.LINES}))
        SELECT doc_id, page, unit_id, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY y0) AS row_no FROM l""",
    "table_headers": f"""
        WITH l AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0) <= 3 THEN 0 ELSE 1 END AS fresh FROM ({fx.LINES})),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY y0) AS row_no FROM l),
        k AS (SELECT n.*, m.kind FROM n LEFT JOIN (VALUES ('성명', 'name'), ('사번', 'management_id'), ('생년월일', 'dob'), ('연락처', 'phone')) m(t, kind) ON text = t)
        SELECT doc_id, page, row_no, row_number() OVER (PARTITION BY doc_id, page, row_no ORDER BY x0) AS col_no, kind, x0 - 2 AS left_edge FROM k
        WHERE (doc_id, page, row_no) IN (SELECT (doc_id, page, row_no) FROM k GROUP BY doc_id, page, row_no
            HAVING count(*) >= 3 AND count(*) = count(kind) AND count(DISTINCT kind) = count(*))""",
    "table_column_fields": LAYOUT_TABLE,
    "propagate_names": _made(*NAME, *ROLE, *REPEAT, columns='doc_id, unit_id, start, "end", value'),
    "label_precedence": f"""
        SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 4 WHEN 4 THEN 7 ELSE 6 END AS start,
            length(text) AS "end", CASE doc_id % 5 WHEN 1 THEN 'phone' WHEN 4 THEN 'phone' WHEN 3 THEN 'resident_id' ELSE 'account' END AS type,
            CASE doc_id % 5 WHEN 2 THEN n || '-90' WHEN 3 THEN substr(text, 7) ELSE n END AS value,
            CASE WHEN doc_id % 5 IN (0, 2) THEN 'phone' ELSE '' END AS alts FROM ({PRECEDENCE})""",
    "detect_all": f"""
        WITH people AS ({fx.PEOPLE}), labelled AS ({made(*EVERYTHING)}),
        plain AS ({settled(f"SELECT -1 - doc_id AS doc_id, unit_seq, unit_id, text FROM ({fx.DOCUMENT_UNITS_DUCK}) x")}),
        every AS (SELECT *, '' AS alts FROM labelled UNION ALL SELECT doc_id, unit_id, start, "end", type, value, alts FROM plain)
        SELECT doc_id, unit_id, start, "end", type, value, {ID} AS cand_id, alts,
            CASE WHEN type IN ('phone', 'email', 'resident_id', 'foreign_id') THEN 'rule' ELSE 'local_label' END AS source, 'full' AS method FROM every""",
    "classify_document": f"""
        SELECT k AS doc_id, c.class FROM ({fx.PEOPLE}) p JOIN (VALUES (0, 'transaction_settlement'), (1, 'contract_agreement'), (2, 'personnel_roster'),
            (3, 'case_record'), (4, 'report_minutes'), (5, 'other')) c(m, class) ON k % 6 = m
        UNION ALL SELECT -1 - doc_id, 'other' FROM documents""",
}
_PHONE_CELLS = f"""
    SELECT -1 - doc_id AS doc_id, 'p' || CAST(1 + CASE WHEN tbl % 6 = 3 AND r >= 2 THEN 1 ELSE 0 END AS STRING) || ':b' || CAST(tbl AS STRING) || ':l' ||
        CAST(r * 3 + 1 AS STRING) AS unit_id, 0 AS start, length(phone) AS "end", 'phone' AS type, phone AS value
    FROM ({fx.ORDER_PEOPLE}) WHERE tbl % 6 = 5 AND r >= 1"""
ORACLE["detect_all_layout"] = f"""
    WITH people AS ({fx.PEOPLE}),
    f AS (SELECT k AS doc_id, 'p1:b0:l2' AS unit_id, address AS value, 'address' AS type FROM people
        UNION ALL SELECT k, 'p1:b0:l3', CAST(1 + k % 20 AS STRING) || '동 ' || CAST(100 + k % 900 AS STRING) || '호', 'address' FROM people
        UNION ALL SELECT k, 'p1:b0:l5', name, 'name' FROM people UNION ALL SELECT k, 'p1:b0:l8', dob, 'dob' FROM people)
    SELECT doc_id, unit_id, 0 AS start, length(value) AS "end", type, value FROM f
    UNION ALL SELECT -1 - doc_id, unit_id, start, "end", type, value FROM ({LAYOUT_TABLE})
    UNION ALL SELECT * FROM ({_PHONE_CELLS})"""
