"""Queries over masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushmark.functions import masking as M
from hushmark.operators import mask as O
from hushmark.plans import fixtures as fx
from hushmark.plans.a_sources import all_units, kr_units
from hushmark.plans.c_labels import forms
from hushmark.plans.d_evidence import CANDS_DUCK, cands
from hushmark.sources import units as U

# Methods by place, those of names by document, for one name stands in several lines; partial hides the first half of the value.
_METHOD = "CASE (doc_id + CASE WHEN type = 'name' THEN 0 ELSE start END) % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'delete' ELSE 'keep' END"
DECIDED_DUCK = f"SELECT *, {_METHOD} AS method, CAST(floor(length(value) / 2) AS INT) AS half FROM ({CANDS_DUCK})"


def decided(spark, d):
    half = M.rng("0", "floor(length(value) / 2)")
    return cands(spark, d).withColumn("method", F.expr(_METHOD)).withColumn(
        "mask", F.expr(f"IF(method = 'partial', array({half}), {M.EMPTY})"))


def f1(spark, d):
    return decided(spark, d).selectExpr("doc_id", "cand_id", "method", f"{M.mask_value('value', 'method', 'mask')} AS masked")


RANGE_ROWS = (
    "SELECT l_orderkey AS k, CAST(l_linenumber * 5 - l_quantity % 5 AS INT) AS a, CAST(l_linenumber * 5 + l_quantity % 7 AS INT) AS b FROM lineitem"
)


def f2(spark, d):
    rows = fx.derive(spark, d, RANGE_ROWS)
    return O.islands(rows, ["k"])


def f2b(spark, d):
    rows = fx.table(spark, d, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber + CAST(l_quantity AS INT) % 5 AS pos")
    return O.position_islands(rows, ["k"])


def f3(spark, d):
    return O.redact_units(all_units(spark, d), decided(spark, d)).select("doc_id", "unit_id", "redacted")


def f4(spark, d):
    return O.visible_segments(kr_units(spark, d), decided(spark, d)).selectExpr("doc_id", "unit_id", "start", "end", "hidden")


def f5(spark, d):
    f = forms(spark, d)
    picks = f.selectExpr("doc_id", "unit_id", "true AS located", "0 AS start", "length(text) AS end",
                         "CASE doc_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'delete' ELSE 'keep' END AS method",
                         f"array({M.rng('1', '3')}) AS mask").where("end > 3")
    boxes = O.redact_boxes(U.chars_from_lines(f), picks)
    return boxes.selectExpr("doc_id", "unit_id", "idx", "CAST(round(x0 * 100) AS BIGINT) AS x0", "CAST(round(y0 * 100) AS BIGINT) AS y0",
                            "CAST(round(x1 * 100) AS BIGINT) AS x1", "CAST(round(y1 * 100) AS BIGINT) AS y1", "colour")


# Values by type with odd forms mixed in.
_VARIANTS = {
    "phone": "CASE k % 5 WHEN 0 THEN phone WHEN 1 THEN replace(phone, '-', '') WHEN 2 THEN '+82 10-' || substr(phone, 5) WHEN 3 THEN '010' ELSE phone || '내선' END",
    "email": "CASE k % 4 WHEN 0 THEN email WHEN 1 THEN 'a@mail' || CAST(k % 7 AS STRING) || '.example.com' WHEN 2 THEN '가나' || email ELSE replace(email, '@', '@@') END",
    "resident_id": "CASE k % 3 WHEN 0 THEN resident WHEN 1 THEN replace(resident, '-', '') ELSE substr(resident, 1, 12) END",
    "address": "CASE k % 5 WHEN 0 THEN address WHEN 1 THEN '경기도 수원시 영통구 영통동 ' || CAST(k AS STRING) WHEN 2 THEN '세종특별자치시 조치원읍 새내로 ' || CAST(k AS STRING) "
               "WHEN 3 THEN '강남구 역삼동 ' || CAST(k AS STRING) ELSE '서울시 강남구 테스트로 ' || CAST(k AS STRING) END",
    "dob": "CASE k % 4 WHEN 0 THEN dob WHEN 1 THEN substr(dob, 1, 4) || '년 ' || CAST(1 + k % 12 AS STRING) || '월 2일' WHEN 2 THEN replace(dob, '-', '') ELSE substr(dob, 1, 5) || '13-01' END",
    "account": "CASE k % 3 WHEN 0 THEN account WHEN 1 THEN staff ELSE '계좌' || account END",
    "card": "CASE k % 3 WHEN 0 THEN card WHEN 1 THEN replace(card, '-', '') ELSE substr(card, 1, 14) END",
    "name": "CASE k % 4 WHEN 0 THEN name WHEN 1 THEN substr(name, 1, 2) WHEN 2 THEN '남궁' || substr(name, 2) ELSE 'Alex Lee' END",
}


def preset_rows(kind: str) -> str:
    return f"SELECT k, {_VARIANTS[kind]} AS value FROM ({fx.PEOPLE}) p"


def _preset(kind, only=None):
    def query(spark, d):
        rows = fx.derive(spark, d, preset_rows(kind))
        made = M.presets(f"'{kind}'", "value")
        if only:
            made = f"map_filter({made}, (p, r) -> p RLIKE '{only}')"
        return rows.selectExpr("k", "value", f"explode({made}) AS (preset, ranges)").selectExpr(
            "k", "preset", f"{M.mask_value('value', M_PARTIAL, 'ranges')} AS masked")

    return query


M_PARTIAL = "'partial'"
GUARDED = (
    "SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN 'hong@example.com' WHEN 1 THEN 'e' || chr(769) || 'cho@example.com' WHEN 2 THEN chr(4352) || chr(4449) || 'a@example.com' "
    "WHEN 3 THEN chr(128104) || chr(8205) || chr(128105) || 'ab@example.com' WHEN 4 THEN chr(127472) || chr(127479) || 'ab@example.com' "
    "WHEN 5 THEN chr(128077) || chr(127997) || 'ab@example.com' WHEN 6 THEN repeat('x', 1001) || '@example.com' ELSE chr(233) || 'ab' || CAST(c_custkey AS STRING) || '@example.com' END AS value FROM customer"
)


def f7(spark, d):
    # chr() of Spark stops at one byte; the same characters are spelled with decode.
    sql = GUARDED
    for code in (769, 4352, 4449, 128104, 8205, 128105, 127472, 127479, 128077, 127997, 233):
        sql = sql.replace(f"chr({code})", "'" + chr(code) + "'")
    rows = fx.derive(spark, d, sql)
    return rows.selectExpr("k", f"array_join(array_sort(map_keys({M.presets(EMAIL, 'value')})), ',') AS presets")


EMAIL = "'email'"


def f8(spark, d):
    return O.preset_previews(cands(spark, d)).select("doc_id", "cand_id", "preset", "preview")


def f9(spark, d):
    return all_units(spark, d).selectExpr("doc_id", "unit_id", f"{M.mask_text_chain('text')} AS masked")


QUERIES = {
    "mask_value": f1, "merge_ranges": f2, "positions_to_ranges": f2b, "redact_units": f3, "visible_segments": f4, "redact_boxes": f5,
    "preset_phone": _preset("phone"), "preset_email": _preset("email"), "preset_resident": _preset("resident_id"),
    "preset_address": _preset("address"), "preset_dob": _preset("dob"), "preset_id_suffix": _preset("account"),
    "preset_card": _preset("card", "card_isms"), "preset_name": _preset("name"), "preset_guard": f7, "preset_previews": f8, "mask_text_chain": f9,
}

_HIDDEN = ("CASE method WHEN 'full' THEN repeat('*', length(value)) WHEN 'delete' THEN '' WHEN 'keep' THEN value "
           "ELSE repeat('*', half) || substr(value, half + 1) END")


def _rows(kind: str, *branches: tuple[str, str, str]) -> str:
    """Masked text per preset, stated as string pieces: (preset, condition, text)."""
    body = " UNION ALL ".join(f"SELECT k, '{p}' AS preset, {text} AS masked FROM v WHERE {cond}" for p, cond, text in branches)
    return f"WITH v AS ({preset_rows(kind)}) {body}"


def _keep_tail(n: int) -> str:
    return f"repeat('*', length(value) - {n}) || right(value, {n})"


_PHONE_OK = "k % 5 IN (0, 1, 2)"
_AT = "position('@' IN value) - 1"
_REST = "length(value) - length({0})"


def _cut(prefix: str) -> str:
    return f"{prefix} || repeat('*', length(value) - length({prefix}))"


_SEOUL = "k % 5 = 0"
CHAIN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(01[016789]-[0-9]{3,4}-[0-9]{4})|(0[2-9]-[0-9]{3,4}-[0-9]{4})', '<<\0>>', 'g'),
    '<<[0-9]{3}-([0-9]{4}-[0-9]{4})>>', '****-\1', 'g'), '<<([0-9]{2,3})-[0-9]{3,4}-([0-9]{4})>>', '\1-****-\2', 'g'),
    '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '****@*****.***', 'g'),
    '\b[0-9]{6}-[0-9]{7}\b', '******-*******', 'g'),
    '\b((?:19|20)[0-9]{2}[-.])[0-9]{2}[-.][0-9]{2}\b', '\1-**-**', 'g'), '[가-힣]{2,4}', '***', 'g')"""

ORACLE = {
    "mask_value": f"SELECT doc_id, cand_id, method, {_HIDDEN} AS masked FROM ({DECIDED_DUCK})",
    "merge_ranges": f"""
        WITH p AS (SELECT DISTINCT k, unnest(range(a, b)) AS pos, FROM ({RANGE_ROWS}) WHERE 0 <= a AND a < b),
        n AS (SELECT k, pos, pos - row_number() OVER (PARTITION BY k ORDER BY pos) AS g FROM p)
        SELECT k, min(pos) AS a, max(pos) + 1 AS b FROM n GROUP BY k, g""",
    "positions_to_ranges": """
        WITH p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber + CAST(l_quantity AS INT) % 5 AS pos FROM lineitem),
        s AS (SELECT * FROM p WHERE (k, pos - 1) NOT IN (SELECT (k, pos) FROM p))
        SELECT s.k, s.pos AS a, (SELECT min(e.pos) + 1 FROM p e WHERE e.k = s.k AND e.pos >= s.pos
            AND NOT EXISTS (SELECT 1 FROM p x WHERE x.k = e.k AND x.pos = e.pos + 1)) AS b FROM s""",
    "redact_units": f"""
        WITH c AS ({DECIDED_DUCK}), u AS ({fx.ALL_UNITS_DUCK}),
        o AS (SELECT doc_id, unit_id, start, "end", {_HIDDEN} AS out, lag("end", 1, 0) OVER (PARTITION BY doc_id, unit_id ORDER BY start) AS prev FROM c),
        j AS (SELECT o.doc_id, o.unit_id, string_agg(substr(u.text, o.prev + 1, o.start - o.prev) || o.out, '' ORDER BY o.start) AS head, max(o."end") AS tail
              FROM o JOIN u ON o.doc_id = u.doc_id AND o.unit_id = u.unit_id GROUP BY 1, 2)
        SELECT u.doc_id, u.unit_id, CASE WHEN j.tail IS NULL THEN u.text ELSE j.head || substr(u.text, j.tail + 1) END AS redacted
        FROM u LEFT JOIN j ON u.doc_id = j.doc_id AND u.unit_id = j.unit_id""",
    "visible_segments": f"""
        WITH c AS ({DECIDED_DUCK}), u AS ({fx.KR_UNITS_DUCK}),
        b AS (SELECT doc_id, unit_id, start AS n FROM c UNION SELECT doc_id, unit_id, "end" FROM c UNION SELECT doc_id, unit_id, start + half FROM c WHERE method = 'partial'
              UNION SELECT doc_id, unit_id, 0 FROM c UNION SELECT u.doc_id, u.unit_id, length(u.text) FROM u JOIN c ON u.doc_id = c.doc_id AND u.unit_id = c.unit_id),
        s AS (SELECT doc_id, unit_id, n AS start, lead(n) OVER (PARTITION BY doc_id, unit_id ORDER BY n) AS stop FROM b)
        SELECT s.doc_id, s.unit_id, s.start, s.stop AS "end", coalesce(bool_or(c.method IN ('full', 'delete') OR (c.method = 'partial' AND s.stop <= c.start + half)), false) AS hidden
        FROM s LEFT JOIN c ON s.doc_id = c.doc_id AND s.unit_id = c.unit_id AND s.start >= c.start AND s.stop <= c."end"
        WHERE s.stop IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "redact_boxes": f"""
        SELECT doc_id, unit_id, i AS idx, (x0 + 10 * i) * 100 + 1 AS x0, y0 * 100 + 1 AS y0, (x0 + 10 * i + 10) * 100 - 1 AS x1, y1 * 100 - 1 AS y1,
            CASE WHEN doc_id % 4 = 2 THEN 'white' ELSE 'black' END AS colour
        FROM (SELECT *, unnest(range(length(text))) AS i FROM ({fx.FORMS}) WHERE length(text) > 3)
        WHERE doc_id % 4 IN (0, 2) OR (doc_id % 4 = 1 AND i IN (1, 2))""",
    "preset_phone": _rows(
        "phone", ("phone_suffix2", _PHONE_OK, _keep_tail(2)), ("phone_suffix4", _PHONE_OK, _keep_tail(4)),
        ("phone_middle", "k % 5 = 0", "substr(value, 1, 4) || '****' || substr(value, 9)"), ("phone_tail", "k % 5 = 0", "substr(value, 1, 9) || '****'")),
    "preset_email": _rows(
        "email", ("email_first_and_domain", "k % 4 IN (0, 2)", f"left(value, 1) || repeat('*', {_AT} - 1) || substr(value, {_AT} + 1)"),
        ("email_keep2", "k % 4 IN (0, 2)", f"left(value, 2) || repeat('*', {_AT} - 2) || substr(value, {_AT} + 1)"),
        ("email_local_part", "k % 4 < 3", f"repeat('*', {_AT}) || substr(value, {_AT} + 1)")),
    "preset_resident": _rows(
        "resident_id", ("rrn_birth_gender", "k % 3 < 2", "left(value, length(value) - 6) || '******'"),
        ("rrn_birth_only", "k % 3 < 2", "left(value, length(value) - 7) || '*******'"),
        ("rrn_gender_only", "k % 3 < 2", "'******' || substr(value, 7, length(value) - 12) || '******'"),
        ("rrn_year_only", "k % 3 < 2", "left(value, 2) || '****' || substr(value, 7, length(value) - 13) || '*******'")),
    "preset_address": _rows(
        "address", ("address_region", "k % 5 <> 3", _cut("split_part(value, ' ', 1)")),
        ("address_city", "k % 5 IN (0, 1, 4)", _cut("split_part(value, ' ', 1) || ' ' || split_part(value, ' ', 2)").replace("split_part(value, ' ', 1) || ' ' || split_part(value, ' ', 2) ||", "(split_part(value, ' ', 1) || ' ' || split_part(value, ' ', 2)) ||", 1)),
        ("address_district", "k % 5 = 1", "'경기도 수원시 영통구' || repeat('*', length(value) - 11)"),
        ("address_locality", "k % 5 IN (0, 1, 2)", "CASE k % 5 WHEN 0 THEN '서울특별시 강남구 역삼동' || repeat('*', length(value) - 13) "
         "WHEN 1 THEN '경기도 수원시 영통구 영통동' || repeat('*', length(value) - 15) ELSE '세종특별자치시 조치원읍' || repeat('*', length(value) - 12) END")),
    "preset_dob": _rows("dob", ("dob_year_only", "k % 4 < 3", "CASE WHEN k % 4 = 1 THEN left(value, 5) || repeat('*', length(value) - 5) ELSE left(value, 4) || repeat('*', length(value) - 4) END")),
    "preset_id_suffix": _rows("account", ("id_suffix2", "k % 3 < 2", _keep_tail(2)), ("id_suffix4", "k % 3 < 2", _keep_tail(4))),
    "preset_card": _rows("card", ("card_isms", "k % 3 < 2", "CASE k % 3 WHEN 0 THEN left(value, 7) || '**-****-' || right(value, 4) ELSE left(value, 6) || '******' || right(value, 4) END")),
    "preset_name": _rows("name", ("name_initial", "k % 4 < 3", "left(value, 1) || repeat('*', length(value) - 1)"),
                         ("name_middle", "k % 4 IN (0, 2)", "left(value, 1) || repeat('*', length(value) - 2) || right(value, 1)")),
    "preset_guard": """SELECT c_custkey AS k, CASE WHEN c_custkey % 8 IN (0, 6, 7) THEN 'email_first_and_domain,email_keep2,email_local_part' ELSE '' END AS presets FROM customer""",
    "mask_text_chain": f"SELECT doc_id, unit_id, {CHAIN} AS masked FROM ({fx.ALL_UNITS_DUCK})",
}
_P = f"SELECT * FROM ({CANDS_DUCK})"
ORACLE["preset_previews"] = f"""
    WITH v AS ({_P})
    SELECT doc_id, cand_id, p AS preset, {_keep_tail(2)} AS preview FROM v JOIN (VALUES ('phone', 'phone_suffix2'), ('account', 'id_suffix2'), ('card', 'id_suffix2'), ('management_id', 'id_suffix2')) t(t, p) ON type = t
    UNION ALL SELECT doc_id, cand_id, p, {_keep_tail(4)} FROM v JOIN (VALUES ('phone', 'phone_suffix4'), ('account', 'id_suffix4'), ('card', 'id_suffix4'), ('management_id', 'id_suffix4')) t(t, p) ON type = t
    UNION ALL SELECT doc_id, cand_id, 'phone_middle', split_part(value, '-', 1) || '-' || repeat('*', length(split_part(value, '-', 2))) || '-' || split_part(value, '-', 3) FROM v WHERE type = 'phone'
    UNION ALL SELECT doc_id, cand_id, 'phone_tail', left(value, length(value) - 4) || '****' FROM v WHERE type = 'phone'
    UNION ALL SELECT doc_id, cand_id, 'email_first_and_domain', left(value, 1) || repeat('*', {_AT} - 1) || substr(value, {_AT} + 1) FROM v WHERE type = 'email'
    UNION ALL SELECT doc_id, cand_id, 'email_keep2', left(value, 2) || repeat('*', {_AT} - 2) || substr(value, {_AT} + 1) FROM v WHERE type = 'email'
    UNION ALL SELECT doc_id, cand_id, 'email_local_part', repeat('*', {_AT}) || substr(value, {_AT} + 1) FROM v WHERE type = 'email'
    UNION ALL SELECT doc_id, cand_id, 'address_region', '서울특별시' || repeat('*', length(value) - 5) FROM v WHERE type = 'address'
    UNION ALL SELECT doc_id, cand_id, 'address_city', '서울특별시 강남구' || repeat('*', length(value) - 9) FROM v WHERE type = 'address'
    UNION ALL SELECT doc_id, cand_id, 'address_locality', '서울특별시 강남구 역삼동' || repeat('*', length(value) - 13) FROM v WHERE type = 'address'
    UNION ALL SELECT doc_id, cand_id, 'dob_year_only', left(value, 4) || '******' FROM v WHERE type = 'dob'
    UNION ALL SELECT doc_id, cand_id, 'card_isms', left(value, 7) || '**-****-' || right(value, 4) FROM v WHERE type = 'card'
    UNION ALL SELECT doc_id, cand_id, 'name_initial', left(value, 1) || '**' FROM v WHERE type = 'name'
    UNION ALL SELECT doc_id, cand_id, 'name_middle', left(value, 1) || '*' || right(value, 1) FROM v WHERE type = 'name'"""
