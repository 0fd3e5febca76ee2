"""Queries over decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushmark.functions.masking import EMPTY, rng
from hushmark.operators import policy as P
from hushmark.plans import fixtures as fx
from hushmark.plans.a_sources import kr_units
from hushmark.plans.d_evidence import CANDS_DUCK, cands
from hushmark.session import cut

MODEL = "judge-1"
# Place of a candidate as one number, the same in both engines.
_SPOT = "(doc_id + unit_seq * 7 + start)"
_M = f"CASE {_SPOT} % 7 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'delete' WHEN 3 THEN 'keep' WHEN 4 THEN 'partial' WHEN 5 THEN 'blur' ELSE 'keep' END"
# Mask variants: none, first half, whole value, overlapping pair, beyond the end.
_V = f"CAST({_SPOT} % 5 AS INT)"


def decisions(found):
    half = "CAST(floor(length(value) / 2) AS INT)"
    mask = (
        f"CASE {_V} WHEN 0 THEN {EMPTY} WHEN 1 THEN array({rng('0', half)}) WHEN 2 THEN array({rng('0', 'length(value)')}) "
        f"WHEN 3 THEN array({rng('0', '2')}, {rng('1', '3')}) ELSE array({rng('1', 'length(value) + 1')}) END"
    )
    return found.selectExpr("doc_id", "cand_id", "unit_seq", "start", f"{_M} AS method", f"{mask} AS mask", f"{_SPOT} % 3 <> 0 AS confirmed")


_ERR = f"""CASE WHEN {_SPOT} % 7 = 5 THEN 'method' WHEN {_V} = 4 THEN 'range' WHEN {_V} = 3 THEN 'overlap'
    WHEN {_SPOT} % 7 IN (1, 4) THEN CASE WHEN {_V} IN (0, 2) THEN 'partial' ELSE 'ok' END ELSE CASE WHEN {_V} = 0 THEN 'ok' ELSE 'unused_mask' END END"""


def g1(spark, d):
    """With one decision per document on a candidate that doesn't exist."""
    found = cands(spark, d)
    made = decisions(found)
    stray = made.where("unit_seq = 1").dropDuplicates(["doc_id"]).withColumn("cand_id", F.lit("c_unknown"))
    return P.validate_decisions(made.unionByName(stray), found).selectExpr("doc_id", "cand_id", "coalesce(error, 'ok') AS error")


def _known(found):
    return found.withColumns({"decision_source": F.lit(None).cast("string")})


def _plan(found):
    """Version stale in every 6th document, a double in every 7th, an unknown id in every 8th, a bad mask in every 9th."""
    base = found.where("type IN ('phone', 'name')")
    mask = f"CASE WHEN doc_id % 9 = 4 AND type = 'name' THEN array({rng('0', '1')}) ELSE {EMPTY} END"
    rows = base.selectExpr("doc_id", "IF(doc_id % 8 = 5 AND type = 'name', concat(cand_id, 'x'), cand_id) AS cand_id", "'keep' AS method", f"{mask} AS mask",
                           "true AS confirmed", "IF(doc_id % 6 = 1, 1L, 2L) AS version")
    return rows.unionByName(rows.where("doc_id % 7 = 2"))


def g2(spark, d):
    versions = fx.table(spark, d, "customer").selectExpr("c_custkey AS doc_id", "2L AS version")
    found = cands(spark, d)
    merged, refused = P.apply_plan(_known(found), _plan(found), versions)
    return merged.join(refused, "doc_id", "left").selectExpr("doc_id", "cand_id", "method", "confirmed", "coalesce(decision_source, '-') AS decided_by", "coalesce(reason, '-') AS refused")


_REFUSED = "CASE WHEN doc_id % 6 = 1 THEN 'conflict' WHEN doc_id % 7 = 2 THEN 'duplicate' WHEN doc_id % 8 = 5 THEN 'unknown' WHEN doc_id % 9 = 4 THEN 'invalid' ELSE '-' END"


def _picks(spark, d):
    """Five picks per document: free, overlapping the first, overlapping a find, out of range, odd type."""
    picks = [(0, "'name'", 12, "0", "2"), (1, "'card'", 12, "1", "5"), (2, "'name'", 2, "4", "8"), (3, "'dob'", 12, "5", "4000"), (4, "'colour'", 12, "6", "8"),
             (5, "'dob'", 12, "6", "8")]
    entries = ", ".join(
        f"named_struct('pick_no', {n}, 'type', {t}, 'unit_id', '/word/document.xml#{u}', 'start', {a}, 'end', {b})" for n, t, u, a, b in picks)
    return fx.table(spark, d, "customer").selectExpr("c_custkey AS doc_id", f"inline(array({entries}))")


def g3(spark, d):
    return P.add_manual(cands(spark, d), kr_units(spark, d), _picks(spark, d)).selectExpr("doc_id", "pick_no", "outcome", "coalesce(value, '-') AS value", "cand_id")


def g4(spark, d):
    found = cands(spark, d).selectExpr("doc_id", "cand_id", "type", "unit_id", "start", "end", "value", "alts", "true AS confirmed", "true AS located", "source")
    lost = fx.table(spark, d, "customer").selectExpr(
        "c_custkey AS doc_id", "explode(array('u_a', 'u_b', 'u_c')) AS cand_id").selectExpr(
        "doc_id", "cand_id", "CASE cand_id WHEN 'u_b' THEN 'card' ELSE 'name' END AS type", "CAST(NULL AS STRING) AS unit_id", "CAST(NULL AS INT) AS start", "CAST(NULL AS INT) AS end",
        "'예 산' AS value", "CAST(array() AS array<string>) AS alts", "false AS confirmed", "false AS located", "'service' AS source")
    picks = fx.table(spark, d, "customer").selectExpr("c_custkey AS doc_id", "inline(array("
        "named_struct('pick_no', 0, 'cand_id', 'u_a', 'unit_id', '/word/document.xml#12', 'start', 0, 'end', 2),"
        "named_struct('pick_no', 1, 'cand_id', 'u_b', 'unit_id', '/word/document.xml#2', 'start', 5, 'end', 18),"
        "named_struct('pick_no', 2, 'cand_id', 'u_c', 'unit_id', '/word/document.xml#2', 'start', 3, 'end', 7)))")
    out, _ = P.resolve_locations(cut(found.unionByName(lost)), kr_units(spark, d), picks)
    return out.selectExpr("doc_id", "cand_id", "type", "coalesce(unit_id, '-') AS unit_id", "coalesce(start, -1) AS start", "value", "array_join(alts, ',') AS alts", "confirmed", "located", "source")


DOC_FLAGS = (
    "SELECT c_custkey AS doc_id, c_custkey % 11 <> 3 AS metadata_reviewed, c_custkey % 13 = 5 AS incomplete, c_custkey % 3 = 0 AS full_redaction, "
    "c_custkey % 9 <> 2 AS ai_enabled, CASE WHEN c_custkey % 2 = 0 THEN 'validated' ELSE 'review' END AS status, 'secret' AS _token FROM customer"
)
METADATA = (
    "SELECT c_custkey AS doc_id, 'info:title' AS meta_id, 'title' AS label, c_name AS value, 'info' AS source, 'delete' AS action FROM customer UNION ALL "
    "SELECT c_custkey AS doc_id, 'xmp:0:creator' AS meta_id, 'creator' AS label, c_mktsegment AS value, 'XMP' AS source, CASE WHEN c_custkey % 10 = 7 THEN 'hide' ELSE 'keep' END AS action FROM customer UNION ALL "
    "SELECT c_custkey AS doc_id, 'xmp:1:x' AS meta_id, CASE WHEN c_custkey % 12 = 6 THEN 'creator' ELSE 'subject' END AS label, 'v' AS value, 'XMP' AS source, 'keep' AS action FROM customer"
)


def _ready_cands(spark, d):
    """Confirmed candidates with one planted fault in some documents."""
    return cands(spark, d).selectExpr(
        "doc_id", "cand_id", "unit_id", "unit_seq", "type", "start", "end", "method", "mask", "NOT (doc_id % 7 = 1 AND unit_seq = 1) AS confirmed",
        "true AS located", "IF(doc_id % 8 = 2 AND unit_seq = 5, concat(substring(value, 1, length(value) - 1), '?'), value) AS value", "CAST(NULL AS STRING) AS decision_source")


def _overlapping(spark, d):
    base = _ready_cands(spark, d)
    more = base.where("doc_id % 5 = 4 AND unit_seq = 4").withColumns({"start": F.expr("start + 2"), "value": F.expr("substring(value, 3)"), "cand_id": F.lit("c_more")})
    return base.unionByName(more)


def g5(spark, d):
    return P.readiness_gate(fx.derive(spark, d, DOC_FLAGS), cut(_overlapping(spark, d)), kr_units(spark, d), fx.derive(spark, d, METADATA)).selectExpr(
        "doc_id", "ready", "coalesce(reason, '-') AS reason")


def g6(spark, d):
    docs, meta = fx.derive(spark, d, DOC_FLAGS), fx.derive(spark, d, METADATA)
    rows = cut(cands(spark, d).withColumns({"method": F.lit("keep"), "located": F.expr("unit_seq <> 8"), "decision_source": F.lit("ai_default")}))
    after = P.force_full(rows, docs)
    left = P.full_violations(after, P.force_full_metadata(meta, docs), docs)
    before = P.full_violations(rows, meta, docs)
    spans = after.selectExpr("doc_id", "cand_id", "method", "confirmed", "decision_source AS note", "0 AS n")
    return spans.unionByName(left.selectExpr("doc_id", "'after' AS cand_id", "'-' AS method", "false AS confirmed", "'-' AS note", "CAST(spans * 100 + metadata AS INT) AS n")).unionByName(
        before.selectExpr("doc_id", "'before' AS cand_id", "'-' AS method", "false AS confirmed", "'-' AS note", "CAST(spans * 100 + metadata AS INT) AS n"))


CONTACTS = f"""SELECT k, phone2 AS value, CASE k % 9 WHEN 0 THEN '대표전화 ' || phone2 WHEN 1 THEN '대표 전화 ' || phone2 || ' / ' || phone WHEN 2 THEN '개인 대표전화 ' || phone2
    WHEN 3 THEN phone2 || ' 대표전화' WHEN 4 THEN '담당 ' || phone || '; 공용 ' || phone2 WHEN 5 THEN '문의 창구' WHEN 6 THEN '대표번호 02-123-4567' WHEN 7 THEN '공식 이메일 | Personal ' || phone2 ELSE phone2 END AS text FROM ({fx.PEOPLE}) p"""


def g7(spark, d):
    return fx.derive(spark, d, CONTACTS).selectExpr("k", "text", f"{P.public_contact('text', 'value')} AS public")


def judged(spark, d):
    """Candidates with role, own-unit fact and a keep request for some names."""
    own = kr_units(spark, d).select("doc_id", "unit_id", F.col("text").alias("unit_text"))
    role = "CASE WHEN type = 'phone' AND unit_seq = 2 AND doc_id % 4 = 0 THEN '대표전화' WHEN type = 'phone' AND unit_seq = 2 AND doc_id % 4 = 1 THEN '개인 대표전화' ELSE '' END"
    return cands(spark, d).join(own, ["doc_id", "unit_id"]).selectExpr(
        "doc_id", "cand_id", "unit_seq", "start", "end", "type", "value", "located", f"{role} AS role_raw", "'' AS context_raw",
        "array(named_struct('relation', 'self', 'text', unit_text)) AS facts", "IF(type = 'name' AND unit_seq = 1 AND doc_id % 9 = 0, concat(value, ' 유지'), '') AS keep_text", "unit_text")


_J_DUCK = f"""SELECT c.*, u.text AS unit_text, CASE WHEN c.type = 'phone' AND c.unit_seq = 2 AND c.doc_id % 4 = 0 THEN '대표전화' WHEN c.type = 'phone' AND c.unit_seq = 2 AND c.doc_id % 4 = 1 THEN '개인 대표전화' ELSE '' END AS role_raw,
    CASE WHEN c.type = 'name' AND c.unit_seq = 1 AND c.doc_id % 9 = 0 THEN c.value || ' 유지' ELSE '' END AS keep_text
    FROM ({CANDS_DUCK}) c JOIN ({fx.KR_UNITS_DUCK}) u ON c.doc_id = u.doc_id AND c.unit_id = u.unit_id"""


def suggested(spark, d, j):
    v = f"CAST({_SPOT} % 6 AS INT)"
    rows = j.selectExpr(
        "doc_id", "cand_id", f"IF({v} = 4, 'question', 'recommendation') AS kind", "'제안' AS content", "'' AS reason",
        f"IF({v} IN (1, 2), 'keep', 'full') AS recommendation",
        f"CASE {v} WHEN 0 THEN substring(unit_text, 1, 5) WHEN 1 THEN unit_text WHEN 2 THEN '없는 근거' WHEN 3 THEN '' ELSE unit_text END AS evidence",
        f"IF({v} = 4, '공개해도 되나요?', NULL) AS question", f"IF({v} = 5, 'phone_suffix4', NULL) AS preset_id")
    stray = fx.table(spark, d, "customer").selectExpr(
        "c_custkey AS doc_id", "'c_unknown' AS cand_id", "'recommendation' AS kind", "'제안' AS content", "'' AS reason", "'full' AS recommendation", "'x' AS evidence",
        "CAST(NULL AS STRING) AS question", "CAST(NULL AS STRING) AS preset_id")
    return rows.unionByName(stray)


def g8(spark, d):
    j = cut(judged(spark, d))
    return P.validate_suggestions(suggested(spark, d, j), j).selectExpr(
        "doc_id", "cand_id", "coalesce(error, 'ok') AS error", "coalesce(preset_id, '-') AS preset_id", "suggestion_id")


def g9(spark, d):
    return P.keep_grounds(judged(spark, d))


def g10(spark, d):
    """Every sixth document has no facts at all."""
    bare = "IF(doc_id % 6 = 5, filter(facts, f -> false), facts)"
    return P.local_recommend(judged(spark, d).withColumn("facts", F.expr(bare)))


def g11(spark, d):
    b = fx.table(spark, d, "orders").selectExpr("o_custkey AS batch", "CAST(o_orderkey AS STRING) AS cand_id")
    s = fx.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber").join(
        fx.table(spark, d, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS batch"), "l_orderkey").selectExpr(
        "batch", "IF(l_linenumber = 7, concat('?', l_orderkey), CAST(l_orderkey AS STRING)) AS cand_id")
    return P.suggestion_coverage(b, s)


def g12(spark, d):
    rows = cands(spark, d).withColumns({"doc_id": F.expr("CAST(floor(doc_id / 50) AS BIGINT)"), "cand_id": F.expr("concat(doc_id, '/', cand_id)"),
                                        "unit_seq": F.expr("CAST((doc_id % 50) * 20 + unit_seq AS INT)")})
    return P.batch_assign(rows, 20).groupBy("doc_id", "batch", "batch_key").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "batch", "n", "batch_key")


def votes(base):
    v = f"CAST({_SPOT} % 6 AS INT)"
    one = base.where(f"{v} <> 0").selectExpr("doc_id", "cand_id", f"IF({v} IN (1, 2), 'keep', 'full') AS recommendation", f"IF({v} IN (4, 5), 'phone_suffix2', NULL) AS preset_id")
    two = base.where(f"{v} IN (2, 4, 5)").selectExpr("doc_id", "cand_id", "'full' AS recommendation", f"CASE {v} WHEN 4 THEN 'phone_suffix2' WHEN 5 THEN 'phone_tail' END AS preset_id")
    return one.unionByName(two)


def consensus(spark, d):
    found = cands(spark, d)
    rows = found.selectExpr("doc_id", "cand_id", "unit_seq", "start", "type", "value", "IF(unit_seq = 14, 'delete', method) AS method", "mask", "unit_seq IN (14, 16) AS confirmed",
                                      "CASE unit_seq WHEN 14 THEN 'user' WHEN 16 THEN 'ai_automatic' END AS decision_source")
    return P.consensus_decision(rows, votes(found))


def g13(spark, d):
    return consensus(spark, d).selectExpr("doc_id", "cand_id", "method", "array_join(transform(mask, m -> concat(m.a, '-', m.b)), ',') AS mask", "confirmed")


def g14(spark, d):
    return P.export_summary(consensus(spark, d))


STAGES = (
    "SELECT o_custkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'parse' WHEN 1 THEN 'classify' WHEN 2 THEN 'extract' ELSE 'judge' END AS stage, "
    "CASE WHEN o_orderkey % 4 = 3 AND o_custkey % 5 = 2 THEN 'not_needed' ELSE 'completed' END AS status, CASE WHEN o_custkey % 7 = 3 THEN 'other' ELSE 'judge-1' END AS model, o_custkey % 4 = 2 AS required FROM orders"
)


def _stages(spark, d):
    return fx.derive(spark, d, STAGES)


def g15(spark, d):
    return P.stage_gate(fx.derive(spark, d, DOC_FLAGS), _stages(spark, d), MODEL).selectExpr("doc_id", "coalesce(reason, '-') AS reason")


def g16(spark, d):
    c = fx.table(spark, d, "customer").selectExpr(
        "c_custkey AS doc_id", "IF(c_custkey % 5 = 1, 'info:other', 'info:title') AS meta_id", "IF(c_custkey % 7 = 4, 'hide', 'keep') AS action")
    out, refused = P.metadata_policy(fx.derive(spark, d, METADATA), c)
    return out.selectExpr("doc_id", "meta_id", "action").unionByName(refused.selectExpr("doc_id", "'refused' AS meta_id", "reason AS action"))


def g17(spark, d):
    return P.repeat_groups(cands(spark, d)).select("doc_id", "cand_id", "group_no")


def _reviewed(spark, d):
    return cands(spark, d).selectExpr(
        "doc_id", "cand_id", "unit_seq", "start", "type", "value", "CASE WHEN unit_seq = 2 THEN 'keep' WHEN unit_seq = 14 THEN 'delete' ELSE method END AS method", "mask",
        "unit_seq IN (2, 14) AS confirmed", "CASE WHEN unit_seq = 2 AND doc_id % 3 = 0 THEN 'ai_automatic' WHEN unit_seq IN (2, 14) THEN 'user' END AS decision_source", "unit_seq <> 16 OR doc_id % 4 <> 1 AS located")


def g18(spark, d):
    return P.inherit_choice(cut(_reviewed(spark, d))).selectExpr("doc_id", "cand_id", "coalesce(suggested_method, '-') AS suggested")


def g19(spark, d):
    rows = cut(_reviewed(spark, d))
    picks = rows.where("unit_seq = 2 AND type = 'phone'").selectExpr(
        "doc_id", "1 AS choice_id", "cand_id", "CASE doc_id % 4 WHEN 0 THEN 'one' WHEN 1 THEN 'same_value' WHEN 2 THEN 'same_type' ELSE 'following' END AS scope")
    classes, members = P.spread_choice(rows, picks)
    return P.reached(classes, members).selectExpr("doc_id", "cand_id", "-1L AS excluded").unionByName(classes.selectExpr("doc_id", "'-' AS cand_id", "excluded"))


def g20(spark, d):
    rows = cut(_reviewed(spark, d))
    s = rows.where("unit_seq IN (2, 4) AND doc_id % 2 = 0").selectExpr("doc_id", "cand_id", "'?' AS question")
    out = None
    for wanted, search in (("all", ""), ("unconfirmed", ""), ("keep", ""), ("mask", "EMAIL")):
        part = P.review_queue(rows, s, wanted, search).selectExpr(f"'{wanted}' AS queue", "doc_id", "type", "value", "n", "pending", "questions")
        out = part if out is None else out.unionByName(part)
    return out


def g21(spark, d):
    return P.judge_payload(judged(spark, d)).selectExpr(
        "doc_id", "cand_id", "get_json_object(payload, '$.role_raw') AS role_raw", "get_json_object(payload, '$.evidence[0].text') AS first_text",
        "get_json_object(payload, '$.allowedRecommendations') AS allowed", "get_json_object(payload, '$.decisionTask') AS task", "get_json_object(payload, '$.selectablePresets') AS presets")


ANSWERS = """SELECT k AS batch, CASE k % 8 WHEN 0 THEN '{"suggestions":[' || i || ']}' WHEN 1 THEN '```json' || chr(10) || '{"suggestions":[' || i || ',' || i || ']}' || chr(10) || '```' WHEN 2 THEN 'sorry'
    WHEN 3 THEN '{"suggestions":[' || i || '],"toolcalls":[1]}' WHEN 4 THEN '{"suggestions":[' || replace(i, '"evidence"', '"extra":"1","evidence"') || ']}' WHEN 5 THEN '{"suggestions":[' || replace(i, '"full"', '"keep"') || ']}'
    WHEN 6 THEN '{"suggestions":[' || replace(i, '"evidence":"e"', '"evidence":"e","question":"공개?"') || ']}' ELSE '{"suggestions":[' || replace(i, '"e"', '5') || ']}' END AS answer
    FROM (SELECT c_custkey AS k, '{"candidateId":"c_' || CAST(c_custkey AS STRING) || '","recommendation":"full","evidence":"e"}' AS i FROM customer) c"""


def g22(spark, d):
    return P.normalize_suggestions(fx.derive(spark, d, ANSWERS)).selectExpr(
        "batch", *[f"coalesce({c}, '-') AS {c}" for c in ("cand_id", "recommendation", "evidence", "question", "kind", "content", "fault")])


def g23(spark, d):
    batches = fx.table(spark, d, "lineitem").selectExpr("l_suppkey AS doc_id", "l_linenumber AS batch")
    return P.public_view(fx.derive(spark, d, DOC_FLAGS), _stages(spark, d), batches, MODEL).selectExpr(
        "doc_id", "status", "coalesce(blocked, '-') AS blocked", "completed_stages", "saved_batches", "ai_enabled")


QUERIES = {
    "validate_decisions": g1, "apply_plan": g2, "add_manual": g3, "resolve_locations": g4, "readiness_gate": g5, "force_full": g6, "public_contact": g7,
    "validate_suggestions": g8, "keep_grounds": g9, "local_recommend": g10, "suggestion_coverage": g11, "batch_assign": g12, "consensus_decision": g13,
    "export_summary": g14, "stage_gate": g15, "metadata_policy": g16, "repeat_groups": g17, "inherit_choice": g18, "spread_choice": g19, "review_queue": g20,
    "judge_payload": g21, "normalize_suggestions": g22, "public_view": g23,
}

_GATE = """CASE WHEN doc_id % 9 = 2 THEN 'analysis_off' WHEN NOT coalesce(p, false) THEN 'parse' WHEN NOT coalesce(c, false) THEN 'classify' WHEN NOT coalesce(e, false) THEN 'extract'
    WHEN NOT coalesce(j, false) THEN 'judge_unknown' WHEN doc_id % 5 = 2 THEN CASE WHEN doc_id % 4 = 2 THEN 'judge' WHEN doc_id % 13 = 5 THEN 'incomplete' END
    WHEN doc_id % 7 = 3 THEN 'judge_model' WHEN doc_id % 13 = 5 THEN 'incomplete' END"""
_SEEN = """SELECT o_custkey AS doc_id, bool_or(o_orderkey % 4 = 0) AS p, bool_or(o_orderkey % 4 = 1) AS c, bool_or(o_orderkey % 4 = 2) AS e, bool_or(o_orderkey % 4 = 3) AS j FROM orders GROUP BY 1"""
_PARTIAL = "length(value) - 2"
_SG = f"CAST({_SPOT} % 6 AS INT)"
_CONSENSUS = f"""CASE WHEN unit_seq = 14 THEN 'delete' WHEN {_SG} = 1 THEN 'keep' WHEN {_SG} = 4 AND type = 'phone' THEN 'partial' ELSE 'full' END"""
_REV = f"""SELECT *, CASE WHEN unit_seq = 2 THEN 'keep' WHEN unit_seq = 14 THEN 'delete' ELSE 'full' END AS method, unit_seq IN (2, 14) AS confirmed,
    (unit_seq = 2 AND doc_id % 3 <> 0) OR unit_seq = 14 AS manual, unit_seq <> 16 OR doc_id % 4 <> 1 AS located FROM ({CANDS_DUCK})"""

ORACLE = {
    "validate_decisions": f"SELECT doc_id, cand_id, {_ERR} AS error FROM ({CANDS_DUCK}) UNION ALL SELECT DISTINCT doc_id, 'c_unknown', 'unknown' FROM ({CANDS_DUCK}) WHERE unit_seq = 1",
    "apply_plan": f"""SELECT doc_id, cand_id, CASE WHEN hit THEN 'keep' ELSE 'full' END AS method, hit AS confirmed, CASE WHEN hit THEN 'user' ELSE '-' END AS decided_by, refused
        FROM (SELECT *, refused = '-' AND type IN ('phone', 'name') AS hit FROM (SELECT *, {_REFUSED} AS refused FROM ({CANDS_DUCK})))""",
    "add_manual": """SELECT c_custkey AS doc_id, n AS pick_no, o AS outcome, CASE n WHEN 0 THEN '예산' WHEN 1 THEN '산 합계' WHEN 2 THEN ' 010' WHEN 5 THEN '10' ELSE '-' END AS value,
        'c_' || substr(sha256('["' || t || '","/word/document.xml#' || u || '",' || a || ',' || b || ']'), 1, 24) AS cand_id FROM customer, (VALUES
        (0, 'name', 12, 0, 2, 'placed'), (1, 'card', 12, 1, 5, 'overlap'), (2, 'name', 2, 4, 8, 'overlap'), (3, 'dob', 12, 5, 4000, 'range'), (4, 'colour', 12, 6, 8, 'type'), (5, 'dob', 12, 6, 8, 'placed')) p(n, t, u, a, b, o)""",
    "resolve_locations": f"""
        SELECT doc_id, cand_id, type, unit_id, start, value, CASE WHEN unit_seq = 2 AND start = 5 THEN 'card' ELSE '' END AS alts, NOT (unit_seq = 2 AND start = 5) AS confirmed, true AS located,
            CASE WHEN type IN ('phone', 'email', 'resident_id', 'foreign_id') THEN 'rule' ELSE 'local_label' END AS source FROM ({CANDS_DUCK})
        UNION ALL SELECT c_custkey, 'u_a', 'name', '/word/document.xml#12', 0, '예산', '', false, true, 'manual_resolution' FROM customer
        UNION ALL SELECT c_custkey, 'u_c', 'name', '-', -1, '예 산', '', false, false, 'service' FROM customer""",
    "readiness_gate": """SELECT doc_id, reason = '-' AS ready, reason FROM (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 11 = 3 THEN 'metadata_not_reviewed' WHEN c_custkey % 13 = 5 THEN 'incomplete'
        WHEN c_custkey % 10 = 7 THEN 'metadata_action' WHEN c_custkey % 7 = 1 THEN 'unconfirmed' WHEN c_custkey % 8 = 2 THEN 'value_changed' WHEN c_custkey % 5 = 4 THEN 'overlap' ELSE '-' END AS reason FROM customer)""",
    "force_full": f"""
        SELECT doc_id, cand_id, CASE WHEN doc_id % 3 = 0 THEN 'full' ELSE 'keep' END AS method, doc_id % 3 = 0 AND unit_seq <> 8 AS confirmed, CASE WHEN doc_id % 3 = 0 THEN 'user' ELSE 'ai_default' END AS note, 0 AS n FROM ({CANDS_DUCK})
        UNION ALL SELECT doc_id, 'after', '-', false, '-', 100 * count(*) FROM ({CANDS_DUCK}) WHERE doc_id % 3 = 0 AND unit_seq = 8 GROUP BY doc_id
        UNION ALL SELECT doc_id, 'before', '-', false, '-', 100 * count(*) + 2 FROM ({CANDS_DUCK}) WHERE doc_id % 3 = 0 GROUP BY doc_id""",
    "public_contact": f"SELECT k, text, k % 9 IN (0, 4, 5) AS public FROM ({CONTACTS})",
    "validate_suggestions": f"""
        SELECT doc_id, cand_id, CASE {_SG} WHEN 1 THEN CASE WHEN type = 'phone' AND unit_seq = 14 THEN 'ok' ELSE 'keep_not_grounded' END WHEN 2 THEN 'not_literal' WHEN 3 THEN 'empty_evidence' ELSE 'ok' END AS error,
            CASE WHEN {_SG} = 5 AND type = 'phone' THEN 'phone_suffix4' ELSE '-' END AS preset_id,
            substr(sha256(cand_id || CASE WHEN {_SG} = 4 THEN 'question' ELSE 'recommendation' END || '제안'), 1, 16) AS suggestion_id FROM ({CANDS_DUCK})
        UNION ALL SELECT c_custkey, 'c_unknown', 'unknown_candidate', '-', substr(sha256('c_unknownrecommendation제안'), 1, 16) FROM customer""",
    "keep_grounds": f"""
        SELECT doc_id, cand_id, unit_text AS ground FROM ({_J_DUCK}) WHERE type = 'phone' AND unit_seq = 14
        UNION ALL SELECT doc_id, cand_id, role_raw FROM ({_J_DUCK}) WHERE role_raw = '대표전화'
        UNION ALL SELECT doc_id, cand_id, value FROM ({_J_DUCK}) WHERE keep_text <> ''""",
    "local_recommend": f"SELECT doc_id, cand_id, CASE WHEN type = 'phone' AND unit_seq = 14 AND doc_id % 6 <> 5 THEN 'keep' ELSE 'full' END AS recommendation, CASE WHEN doc_id % 6 = 5 THEN role_raw ELSE unit_text END AS evidence FROM ({_J_DUCK})",
    "suggestion_coverage": """
        WITH s AS (SELECT o_custkey AS batch, CASE WHEN l_linenumber = 7 THEN '?' || l_orderkey ELSE '' || l_orderkey END AS cand_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        b AS (SELECT o_custkey AS batch, '' || o_orderkey AS cand_id FROM orders)
        SELECT batch, sum(m)::BIGINT AS missing, sum(d)::BIGINT AS duplicate, sum(u)::BIGINT AS unknown FROM (
            SELECT batch, CASE WHEN (SELECT count(*) FROM s WHERE s.cand_id = b.cand_id) = 0 THEN 1 ELSE 0 END AS m, CASE WHEN (SELECT count(*) FROM s WHERE s.cand_id = b.cand_id) > 1 THEN 1 ELSE 0 END AS d, 0 AS u FROM b
            UNION ALL SELECT DISTINCT ON (batch, cand_id) batch, 0, 0, 1 FROM s WHERE cand_id LIKE '?%') GROUP BY batch""",
    "batch_assign": f"""
        WITH c AS (SELECT CAST(floor(doc_id / 50) AS BIGINT) AS doc_id, doc_id || '/' || cand_id AS cand_id, type, value,
                row_number() OVER (PARTITION BY CAST(floor(doc_id / 50) AS BIGINT) ORDER BY doc_id % 50 * 20 + unit_seq, start, "end") AS rn FROM ({CANDS_DUCK}))
        SELECT doc_id, (rn - 1) // 20 AS batch, count(*) AS n,
            sha256('[' || string_agg('{{"id":"' || cand_id || '","type":"' || type || '","value":"' || value || '"}}', ',' ORDER BY rn) || ']') AS batch_key FROM c GROUP BY 1, 2""",
    "consensus_decision": f"SELECT doc_id, cand_id, m AS method, CASE WHEN m = 'partial' THEN '0-' || (length(value) - 2) ELSE '' END AS mask, true AS confirmed FROM (SELECT *, {_CONSENSUS} AS m FROM ({CANDS_DUCK}))",
    "export_summary": f"""SELECT doc_id, sum((m = 'full')::INT)::BIGINT AS full_count, sum((m = 'partial')::INT)::BIGINT AS partial_count, sum((m = 'keep')::INT)::BIGINT AS keep_count,
        sum((unit_seq = 14)::INT)::BIGINT AS manual_preserved FROM (SELECT *, {_CONSENSUS} AS m FROM ({CANDS_DUCK})) GROUP BY doc_id""",
    "stage_gate": f"SELECT c_custkey AS doc_id, coalesce({_GATE.replace('doc_id', 'c_custkey')}, '-') AS reason FROM customer LEFT JOIN ({_SEEN}) ON c_custkey = doc_id",
    "metadata_policy": """
        WITH r AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 1 THEN 'unknown_id' WHEN c_custkey % 7 = 4 THEN 'action' WHEN c_custkey % 12 = 6 THEN 'duplicate_tag' END AS why FROM customer)
        SELECT doc_id, m AS meta_id, a AS action FROM r, (VALUES ('info:title', 'keep'), ('xmp:0:creator', 'delete'), ('xmp:1:x', 'delete')) v(m, a) WHERE why IS NULL
        UNION ALL SELECT doc_id, 'refused', why FROM r WHERE why IS NOT NULL""",
    "repeat_groups": f"""
        WITH c AS ({CANDS_DUCK}), f AS (SELECT *, min(unit_seq * 100000 + start) OVER (PARTITION BY doc_id, type, value) AS p FROM c)
        SELECT doc_id, cand_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY p) AS group_no FROM f""",
    "inherit_choice": f"""
        WITH r AS ({_REV}) SELECT a.doc_id, a.cand_id, coalesce((SELECT CASE WHEN count(DISTINCT b.method) = 1 THEN min(b.method) END FROM r b WHERE b.manual AND b.doc_id = a.doc_id AND b.type = a.type AND b.value = a.value), '-') AS suggested
        FROM r a WHERE NOT a.manual""",
    "spread_choice": f"""
        WITH r AS ({_REV}), p AS (SELECT doc_id, cand_id AS aid, type, value FROM r WHERE unit_seq = 2 AND type = 'phone'),
        t AS (SELECT r.* FROM r JOIN p ON r.doc_id = p.doc_id AND CASE r.doc_id % 4 WHEN 0 THEN r.cand_id = p.aid WHEN 1 THEN r.type = p.type AND r.value = p.value WHEN 2 THEN r.type = p.type
              ELSE r.cand_id = p.aid OR (r.type = p.type AND r.value = p.value AND NOT r.manual) END)
        SELECT doc_id, cand_id, -1 AS excluded FROM t WHERE located UNION ALL SELECT doc_id, '-', count(*) FILTER (WHERE NOT located) FROM t GROUP BY doc_id""",
    "review_queue": f"""
        WITH g AS (SELECT doc_id, type, value, count(*) AS n, count(*) FILTER (WHERE NOT confirmed) AS pending, count(*) FILTER (WHERE NOT confirmed AND unit_seq IN (2, 4) AND doc_id % 2 = 0) AS questions,
            count(*) FILTER (WHERE method = 'keep') AS kept FROM ({_REV}) GROUP BY 1, 2, 3)
        SELECT 'all' AS queue, doc_id, type, value, n, pending, questions FROM g UNION ALL SELECT 'unconfirmed', doc_id, type, value, n, pending, questions FROM g WHERE pending > 0
        UNION ALL SELECT 'keep', doc_id, type, value, n, pending, questions FROM g WHERE kept > 0 UNION ALL SELECT 'mask', doc_id, type, value, n, pending, questions FROM g WHERE type = 'email' AND kept < n""",
    "judge_payload": f"""SELECT doc_id, cand_id, role_raw, unit_text AS first_text,
        CASE WHEN (type = 'phone' AND unit_seq = 14) OR role_raw = '대표전화' OR keep_text <> '' THEN '["full","keep"]' ELSE '["full"]' END AS allowed, 'mask_or_keep' AS task,
        CASE type WHEN 'phone' THEN '["phone_middle","phone_suffix2","phone_suffix4","phone_tail"]' WHEN 'email' THEN '["email_first_and_domain","email_keep2","email_local_part"]'
            WHEN 'address' THEN '["address_city","address_locality","address_region"]' WHEN 'dob' THEN '["dob_year_only"]' WHEN 'card' THEN '["card_isms","id_suffix2","id_suffix4"]' WHEN 'account' THEN '["id_suffix2","id_suffix4"]'
            WHEN 'management_id' THEN '["id_suffix2","id_suffix4"]' WHEN 'name' THEN '["name_initial","name_middle"]' ELSE '[]' END AS presets FROM ({_J_DUCK})""",
    "normalize_suggestions": """
        SELECT c_custkey AS batch, 'c_' || c_custkey AS cand_id, CASE c_custkey % 8 WHEN 5 THEN 'keep' ELSE 'full' END AS recommendation, 'e' AS evidence, CASE WHEN c_custkey % 8 = 6 THEN '공개?' ELSE '-' END AS question,
            CASE WHEN c_custkey % 8 = 6 THEN 'question' ELSE 'recommendation' END AS kind, CASE c_custkey % 8 WHEN 6 THEN '공개?' WHEN 5 THEN '공유본에서 유지합니다.' ELSE '공유본에서 전체 가림합니다.' END AS content, '-' AS fault
        FROM customer, unnest(range(0, CASE c_custkey % 8 WHEN 1 THEN 2 ELSE 1 END)) WHERE c_custkey % 8 IN (0, 1, 5, 6)
        UNION ALL SELECT c_custkey, '-', '-', '-', '-', '-', '-', CASE c_custkey % 8 WHEN 2 THEN 'not_json' WHEN 3 THEN 'tool_calls' ELSE 'item' END FROM customer WHERE c_custkey % 8 IN (2, 3, 4, 7)""",
    "public_view": f"""
        WITH g AS (SELECT c_custkey AS doc_id, {_GATE.replace('doc_id', 'c_custkey')} AS r, coalesce(p, false)::INT + coalesce(c, false)::INT + coalesce(e, false)::INT AS n FROM customer LEFT JOIN ({_SEEN}) ON c_custkey = doc_id)
        SELECT doc_id, CASE WHEN r IS NULL AND doc_id % 2 = 0 THEN 'validated' ELSE 'review' END AS status, coalesce(r, '-') AS blocked, n AS completed_stages,
            (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_suppkey = doc_id) AS saved_batches, doc_id % 9 <> 2 AS ai_enabled FROM g""",
}
