"""Korean test inputs derived from the supplied tables.

The supplied tables hold no Korean text, so units, truth, cells and lines are computed
from customer and order keys. Each text is SQL that both engines read; it grows with the
tables and uses no random function and no clock.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from hushmark.sources.units import spread

TODAY = "2026-01-01"


def _digits(expression: str, width: int) -> str:
    return f"lpad(CAST({expression} AS STRING), {width}, '0')"


# Values of one person, from one key.
_PERSON = {
    "name": "substr('김이박최정강조윤장임', CAST(k % 10 AS INT) + 1, 1) || "
            "substr('가나다라마바사아자차', CAST(CAST((k - k % 10) / 10 AS BIGINT) % 10 AS INT) + 1, 1) || "
            "substr('민서준우진현수영호연', CAST((k * 3 + 1) % 10 AS INT) + 1, 1)",
    "other": "substr('한오서신권황안송전홍', CAST((k * 7) % 10 AS INT) + 1, 1) || "
             "substr('지하은유채도태세승윤', CAST(CAST((k - k % 10) / 10 AS BIGINT) % 10 AS INT) + 1, 1) || "
             "substr('민서준우진현수영호연', CAST(k % 10 AS INT) + 1, 1)",
    "phone": "'010-' || " + _digits("1000 + k % 9000", 4) + " || '-' || " + _digits("(k * 7) % 10000", 4),
    "phone2": "'02-' || " + _digits("200 + k % 800", 3) + " || '-' || " + _digits("(k * 13) % 10000", 4),
    "email": "'user' || CAST(k AS STRING) || '@mail' || CAST(k % 7 AS STRING) || '.example.com'",
    "resident": _digits("50 + k % 50", 2) + " || " + _digits("1 + k % 12", 2) + " || " + _digits("1 + k % 28", 2)
                + " || '-' || CAST(1 + k % 4 AS STRING) || " + _digits("(k * 7919) % 1000000", 6),
    "foreign_no": _digits("50 + k % 50", 2) + " || " + _digits("1 + k % 12", 2) + " || " + _digits("1 + k % 28", 2)
                  + " || '-' || CAST(5 + k % 4 AS STRING) || " + _digits("(k * 6007) % 1000000", 6),
    "dob": "CAST(1950 + k % 55 AS STRING) || '-' || " + _digits("1 + k % 12", 2) + " || '-' || "
           + _digits("1 + k % 28", 2),
    "passport": "'M' || " + _digits("(k * 104729) % 100000000", 8),
    "license": "'11-' || " + _digits("k % 100", 2) + " || '-' || " + _digits("(k * 17) % 1000000", 6) + " || '-' || "
               + _digits("10 + k % 89", 2),
    "account": _digits("100 + k % 900", 3) + " || '-' || " + _digits("k % 100", 2) + " || '-' || "
               + _digits("(k * 31) % 1000000", 6),
    "card": _digits("4000 + k % 1000", 4) + " || '-' || " + _digits("(k * 3) % 10000", 4) + " || '-' || "
            + _digits("(k * 11) % 10000", 4) + " || '-' || " + _digits("(k * 19) % 10000", 4),
    "staff": "'EMP-' || " + _digits("k % 100000", 5),
    "receipt": "'RCP-' || " + _digits("(k * 5) % 100000", 5),
    "address": "'서울특별시 강남구 역삼동 ' || CAST(1 + k % 900 AS STRING) || '-' || CAST(1 + k % 30 AS STRING)",
}

PEOPLE = "SELECT k, c_name, c_mktsegment, " + ", ".join(f"{v} AS {n}" for n, v in _PERSON.items()) + (
    " FROM (SELECT c_custkey AS k, c_name, c_mktsegment FROM customer) c"
)

# One line per entry; a document is the lines joined by line feeds.
_LINES = [
    "CASE WHEN k % 6 = 0 THEN '3월 출장비 정산서' WHEN k % 6 = 1 THEN '업무 계약서' WHEN k % 6 = 2 THEN '참가자 명단' "
    "WHEN k % 6 = 3 THEN '상담일지' WHEN k % 6 = 4 THEN '분기 보고서' ELSE '안내문' END",
    "'성명: ' || name",
    "'연락처: ' || phone || ' 이메일: ' || email",
    "'주민등록번호 ' || resident || ' 외국인등록번호 ' || foreign_no",
    "'생년월일: ' || dob || '; 비고: 없음'",
    "'주소: ' || address",
    "CASE WHEN k % 3 = 0 THEN '계좌번호: 국민은행 ' || account WHEN k % 3 = 1 THEN '정산 계좌번호 : ' || account "
    "ELSE '입금 계좌(' || account || ')' END",
    "'카드번호: ' || card || ' 여권번호: ' || passport",
    "'운전면허번호 ' || license || ' 사번: ' || staff",
    "'오늘 ' || name || '님은 참석했고 ' || name || ', 그리고 ' || name || '입니다 라고 적었다'",
    "CASE WHEN k % 5 = 0 THEN '😀 문의: 급여담당 ' || other || ' ' || phone2 WHEN k % 5 = 1 THEN '가족(모) ' || other || ' 에게 ' || phone2 "
    "WHEN k % 5 = 2 THEN '주식회사 예시 (대표 ' || other || ')' WHEN k % 5 = 3 THEN '갑: ' || other || ' (서명)' "
    "ELSE '가족(부) ' || other || ' 에게 알림' END",
    "CASE WHEN k % 2 = 0 THEN '상담 기록 접수번호: ' || receipt ELSE '일반 접수번호: ' || receipt END",
    "'예산 합계 ' || CAST(1000000 + k * 37 AS STRING) || '원, 문서번호: DOC-2026-' || CAST(k % 1000 AS STRING)",
    "'성명: 미기재'",
    "'거주지 ' || address || ' 101동; 문의 창구 대표전화 ' || phone2",
    "''",
    "'담당자 검토 메모 ' || phone || ' ' || email",
]
DOCS = (
    "SELECT k AS doc_id, " + " || chr(10) || ".join(f"({line})" for line in _LINES) + f" AS text FROM ({PEOPLE}) p"
)
N_LINES = len(_LINES)

# The same documents as DuckDB units, stated by list position instead of Spark's split.
KR_UNITS_DUCK = (
    "SELECT doc_id, u.i - 1 AS unit_seq, '/word/document.xml#' || CAST(u.i - 1 AS STRING) AS unit_id, "
    "list_extract(string_split(text, chr(10)), u.i) AS text "
    f"FROM ({DOCS}) d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)"
)
DOCUMENT_UNITS_DUCK = (
    "SELECT doc_id, u.i - 1 AS unit_seq, '/word/document.xml#' || CAST(u.i - 1 AS STRING) AS unit_id, "
    "list_extract(string_split(text, chr(10)), u.i) AS text "
    "FROM documents d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)"
)
# Supplied documents get negative ids so that both families live in one table.
ALL_UNITS_DUCK = (
    f"{KR_UNITS_DUCK} UNION ALL SELECT -1 - doc_id, unit_seq, unit_id, text FROM ({DOCUMENT_UNITS_DUCK}) x"
)

# What is really in each document, independent of detection. Every tenth person's phone
# and every eleventh person's account is recorded differently, so that an audit of the
# detections has both missed and extra values.
TRUTH = " UNION ALL ".join(
    f"SELECT k AS doc_id, '{kind}' AS type, {value} AS value FROM ({PEOPLE}) t{i}"
    for i, (kind, value) in enumerate([
        ("name", "name"), ("phone", "CASE WHEN k % 10 = 0 THEN phone || '9' ELSE phone END"), ("email", "email"),
        ("resident_id", "resident"), ("foreign_id", "foreign_no"), ("dob", "dob"), ("address", "address"),
        ("account", "CASE WHEN k % 11 = 0 THEN '1' || account ELSE '국민은행 ' || account END"), ("card", "card"),
        ("passport", "passport"), ("driver_license", "license"), ("management_id", "staff"), ("phone", "phone"),
        ("email", "email"),
    ])
)

# Tables of four rows: a heading row and three people. Table numbers come from order keys.
_ROW = "o_orderkey % 4"
_TBL = "CAST((o_orderkey - o_orderkey % 4) / 4 AS BIGINT)"
_ORDERS = (
    f"SELECT o_orderkey AS k, {_ROW} AS r, {_TBL} AS tbl, "
    f"CAST(({_TBL} - {_TBL} % 5) / 5 AS BIGINT) AS doc_id FROM orders"
)
ORDER_PEOPLE = (
    "SELECT k, r, tbl, doc_id, " + ", ".join(
        f"{_PERSON[n]} AS {n}" for n in ("name", "phone", "email", "dob", "staff", "address", "card", "account")
    ) + f" FROM ({_ORDERS}) o"
)


def _cell(position: int, head: str, body: str, colspan: str = "1") -> str:
    return (
        f"SELECT doc_id, tbl, r AS row, {position} AS cell_ord, {colspan} AS colspan, "
        f"'/word/document.xml#' || CAST(tbl * 12 + r * 3 + {position} AS STRING) AS unit_id, "
        f"tbl * 12 + r * 3 + {position} AS unit_seq, "
        f"CASE WHEN r = 0 THEN {head} ELSE {body} END AS text FROM ({ORDER_PEOPLE}) c{position}"
    )


CELLS = " UNION ALL ".join([
    _cell(0, "'성 명'", "name", "CASE WHEN r = 0 AND tbl % 7 = 3 THEN 2 ELSE 1 END"),
    _cell(1, "'사번'", "staff", "CASE WHEN tbl % 9 = 4 THEN 0 ELSE 1 END"),
    _cell(2, "'생년월일'", "CASE WHEN tbl % 5 = 2 AND r = 2 THEN '미기재' ELSE dob END"),
])

# The same rows drawn on pages. tbl % 6 picks the variant: 1 a vertical gap after row 1,
# 2 an unfilled value, 3 a page break, 4 other column order, 5 a phone column.
_PAGE = "1 + CASE WHEN tbl % 6 = 3 AND r >= 2 THEN 1 ELSE 0 END"
_Y = "70 + 25 * r + 300 * (tbl % 5) + CASE WHEN tbl % 6 = 1 AND r >= 2 THEN 100 ELSE 0 END"


def _line(position: int, head: str, body: str) -> str:
    return (
        f"SELECT doc_id, {_PAGE} AS page, 'p' || CAST({_PAGE} AS STRING) || ':b' || CAST(tbl AS STRING) || ':l' || "
        f"CAST(r * 3 + {position} AS STRING) AS unit_id, tbl * 12 + r * 3 + {position} AS unit_seq, text, "
        f"50 + 150 * {position} AS x0, y AS y0, 50 + 150 * {position} + 10 * length(text) AS x1, y + 12 AS y1 "
        f"FROM (SELECT *, {_Y} + {2 if position == 1 else 0} AS y, CASE WHEN r = 0 THEN {head} ELSE {body} END AS text FROM ({ORDER_PEOPLE}) o{position}) l{position}"
    )


LINES = " UNION ALL ".join([
    _line(0, "CASE WHEN tbl % 6 = 4 THEN '사번' ELSE '성명' END", "CASE WHEN tbl % 6 = 4 THEN staff ELSE name END"),
    _line(1, "CASE WHEN tbl % 6 = 4 THEN '성명' WHEN tbl % 6 = 5 THEN '연락처' ELSE '사번' END",
          "CASE WHEN tbl % 6 = 4 THEN name WHEN tbl % 6 = 5 THEN phone ELSE staff END"),
    _line(2, "'생년월일'", "CASE WHEN tbl % 6 = 2 AND r = 2 THEN '미기재' ELSE dob END"),
])


def _placed(position: int, text: str, x: str, y: str, page: str = "1") -> str:
    return (
        f"SELECT k AS doc_id, {page} AS page, 'p1:b0:l{position}' AS unit_id, {position} AS unit_seq, text, "
        f"{x} AS x0, {y} AS y0, {x} + 10 * length(text) AS x1, {y} + 12 AS y1 "
        f"FROM (SELECT k, {text} AS text FROM ({PEOPLE}) q{position}) w{position}"
    )


# A form per customer: numbered heading, a label centred beside a two-line address, a row
# of two fields, and a note. Every fourth form has a rival second line (ambiguous chain).
FORMS = " UNION ALL ".join([
    _placed(0, "CASE WHEN k % 2 = 0 THEN '1. 기본 정보' ELSE '가) 기본 정보' END", "50", "60"),
    _placed(1, "'주 소'", "50", "100"),
    _placed(2, "address", "150", "94"),
    _placed(3, "CAST(1 + k % 20 AS STRING) || '동 ' || CAST(100 + k % 900 AS STRING) || '호'", "151", "110"),
    _placed(4, "'성명'", "50", "150"),
    _placed(5, "name", "150", "151"),
    _placed(6, "CASE WHEN k % 4 = 0 THEN '상세 주소 확인' ELSE '비고 없음' END", "CASE WHEN k % 4 = 0 THEN 152 ELSE 400 END",
            "CASE WHEN k % 4 = 0 THEN 110 ELSE 300 END"),
    _placed(7, "'생년월일'", "300", "150"),
    _placed(8, "dob", "420", "150"),
])

# Records of an outside extraction service, one JSON payload per document.
_ITEM = "'{{\"raw_value\":\"' || {v} || '\",\"role_raw\":\"{role}\",\"context_raw\":\"' || {c} || '\"}}'"


def _array(kind: str, *items: str) -> str:
    body = " || ',' || ".join(items) if items else "''"
    return f"'\"{kind}\":[' || {body} || ']'"


def _item(value: str, role: str, context: str = "''") -> str:
    return _ITEM.format(v=value, role=role, c=context)


_EXTRACTED = [
    _array("name", _item("name", "성명"), _item("other", "담당")),
    _array("phone", _item("CASE WHEN k % 4 = 1 THEN substr(phone, 1, 4) || ' ' || substr(phone, 5) ELSE phone END", "연락처",
                          "'연락처: ' || phone")),
    _array("email", _item("CASE WHEN k % 3 = 1 THEN substr(email, 1, 4) || ' ' || substr(email, 5) ELSE email END", "이메일")),
    _array("address", _item("CASE WHEN k % 3 = 2 THEN replace(address, ' ', '  ') ELSE address END", "주소")),
    _array("dob", _item("CASE WHEN k % 5 = 0 THEN '해당 없음' ELSE dob END", "생년월일")),
    _array("resident_id", _item("CASE WHEN k % 6 = 0 THEN '990101-9999999' ELSE resident END", "주민등록번호")),
    _array("foreign_id"),
    _array("passport", _item("CASE WHEN k % 7 = 0 THEN substr(passport, 1, 7) ELSE passport END", "여권번호")),
    _array("driver_license", _item("CASE WHEN k % 5 = 1 THEN 'N/A' ELSE license END", "없는 역할")),
    _array("account", _item("CASE WHEN k % 3 = 0 THEN '국민은행 ' || account ELSE account END", "계좌번호")),
    _array("card", _item("substr(card, 1, 14)", "카드번호")),
]
EXTRACTIONS = (
    "SELECT k AS doc_id, CASE WHEN k % 13 = 0 THEN 'not json' WHEN k % 17 = 0 THEN '{' || "
    + _array("name", _item("name", "성명")) + " || '}' ELSE '{' || " + " || ',' || ".join(_EXTRACTED)
    + " || ',' || CASE WHEN k % 19 = 0 THEN '\"management_id\":\"' || staff || '\"' ELSE "
    + _array("management_id", _item("CASE WHEN k % 23 = 0 THEN '' ELSE staff END", "사번"))
    + f" END || '}}' END AS payload FROM ({PEOPLE}) x"
)

_TABLES = ["customer", "orders", "lineitem", "events", "documents", "pages", "labels", "benchmark", "conversations",
           "supplier", "part", "nation", "region"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of short rows, in few splits, of which long texts are made.
_COMPACT = ("customer", "orders")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over all cores before the texts are made of them: their file has too few splits for that work."""
    return spread(rows, rows.sparkSession.sparkContext.defaultParallelism)


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the texts above over the supplied tables."""
    used = {t: table(spark, sf_dir, t) for t in _TABLES if re.search(rf"\bFROM {t}\b", sql)}
    used = {t: dealt(rows) if t in _COMPACT else rows for t, rows in used.items()}
    text = sql
    for name in used:
        text = re.sub(rf"\bFROM {name}\b", f"FROM {{{name}}}", text)
    # Braces that belong to JSON text must survive the formatter.
    if used:
        text = _protect(text, used)
    return spark.sql(text, **used)


def _protect(text: str, used: dict) -> str:
    marked = text
    for name in used:
        marked = marked.replace(f"{{{name}}}", f"\u0001{name}\u0002")
    marked = marked.replace("{", "{{").replace("}", "}}")
    return marked.replace("\u0001", "{").replace("\u0002", "}")
