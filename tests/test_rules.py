"""Small cases of single rules, and the invariants of every candidate table."""

import hashlib
import json
import re

from hushmark.functions import masking as M
from hushmark.functions.ids import candidate_id
from hushmark.operators import detect as D
from hushmark.operators import literal
from hushmark.operators.audit import copy_review, leak_scan
from hushmark.operators.evidence import cell_relations, evidence_self, evidence_top8
from hushmark.operators.ground import cap_candidates
from hushmark.operators.joins import block_rank, carry_last, interval_join
from hushmark.operators.pipeline import detect_all
from hushmark.operators.policy import keep_grounds, local_recommend
from hushmark.sources import sink
from hushmark.sources.units import cell_grid, units_from_text
from hushmark.streaming.jobs import drain, lifetime

TODAY = "2026-01-01"


def units(spark, *texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return units_from_text(spark.createDataFrame(rows, "doc_id long, text string"))


# --- fixed values: texts and what is found in them ---
CASES = [
    ("내담자 정하늘, 연락처 없음", [("name", "정하늘")]),
    ("예산 1234567890 원", []),
    ("생년월일: 1990-02-30", []),
    ("생년월일: 1990년 2월 3일", [("dob", "1990년 2월 3일")]),
    ("문의: 김하늘 (내선 02)", []),
    ("여권번호: ABCDEFGH", []),
    ("전화 010-1234-5678, 메일 가나@ex.kr", [("phone", "010-1234-5678"), ("email", "가나@ex.kr")]),
    ("번호 1-010-1234-5678", []),
    ("접수번호: RC-100", []),
    ("환자 접수 접수번호: RC-100", [("management_id", "RC-100")]),
    ("계좌번호: 02-1234-5678", [("account", "02-1234-5678")]),
    ("성명: 이름", []),
    ("주소: 부산 해운대구 😀 12", [("address", "부산 해운대구 😀 12")]),
    ("😀 주소: 부산 해운대구 우동 12", []),
]


def test_detection_cases(spark):
    rows = detect_all(units(spark, *[text for text, _ in CASES]), TODAY).orderBy("doc_id", "start").collect()
    for i, (text, expected) in enumerate(CASES):
        assert [(r.type, r.value) for r in rows if r.doc_id == i] == expected, text


def test_repeated_name_needs_a_boundary(spark):
    text = "성명: 김하늘\n김하늘님께서 왔다\n새김하늘 가게\n김하늘가게\n(김하늘)"
    hits = detect_all(units(spark, text), TODAY).where("type = 'name'").select("unit_seq").collect()
    assert sorted(r.unit_seq for r in hits) == [0, 1, 4]


def test_candidate_invariants(spark):
    from hushmark.plans.a_sources import kr_units

    table = kr_units(spark, "/root/testdata/sf0.001")
    rows = detect_all(table, TODAY)
    joined = rows.join(table.select("doc_id", "unit_id", "text"), ["doc_id", "unit_id"])
    assert joined.where("NOT (0 <= start AND start < end AND end <= length(text) AND substring(text, start + 1, end - start) = value)").count() == 0
    assert rows.groupBy("doc_id", "cand_id").count().where("count > 1").count() == 0
    clash = rows.selectExpr("end > lead(start) OVER (PARTITION BY doc_id, unit_id ORDER BY start) AS clash").where("clash").count()
    assert clash == 0
    assert rows.where("method <> 'full' OR size(mask) > 0 OR confirmed OR NOT located").count() == 0


# --- fixed values: preset cases (type, value, preset, masked) ---
PRESETS = [
    ("dob", "1995-08-17", {"dob_year_only": "1995******"}),
    ("dob", "1900-02-29", {}),
    ("dob", "1995-08/17", {}),
    ("phone", "010-1234-5678", {"phone_middle": "010-****-5678", "phone_tail": "010-1234-****", "phone_suffix2": "***********78",
                                "phone_suffix4": "*********5678"}),
    ("phone", "021234567", {"phone_suffix2": "*******67", "phone_suffix4": "*****4567"}),
    ("resident_id", "950817-1234567", {"rrn_birth_gender": "950817-1******", "rrn_birth_only": "950817-*******",
                                       "rrn_gender_only": "******-1******", "rrn_year_only": "95****-*******"}),
    ("name", "남궁가람", {"name_initial": "남***", "name_middle": "남**람"}),
    ("account", "😀123456", {}),
    ("passport", "M12345678", {}),
    ("card", "1234-5678-9012-3456", {"card_isms": "1234-56**-****-3456", "id_suffix2": "*****************56", "id_suffix4": "***************3456"}),
    ("email", "a@example.com", {"email_local_part": "*@example.com"}),
    ("email", "hong@@example.com", {}),
    ("address", "서울시 강남구", {"address_region": "서울시 ***".replace(" ***", "****")}),
]


def test_presets(spark):
    frame = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(PRESETS)], "i int, type string, value string")
    shown = M.mask_value("value", "'partial'", "ranges")
    rows = frame.selectExpr("i", "value", f"explode({M.presets('type', 'value')}) AS (preset, ranges)").selectExpr("i", "preset", f"{shown} AS masked").collect()
    for i, (_, value, expected) in enumerate(PRESETS):
        assert {r.preset: r.masked for r in rows if r.i == i} == expected, value


def test_literal_search(spark):
    texts = ["가나가나가", "x(?a)x(?a)", "", "aaaa 😀aa", "no hit", "long value here, a long value"]
    table = units(spark, *texts)
    for wanted in (("가나가", "(?a)", "aa", "a", "😀"), ("long value", "long value here", "가나가나가", "no hit")):
        values = spark.createDataFrame([(i, v) for i in range(len(texts)) for v in wanted], "doc_id long, value string")
        rows = literal.locate(table, values).collect()
        assert sorted((r.doc_id, r.value, r.start) for r in rows) == sorted(
            (i, v, p) for i, t in enumerate(texts) for v in wanted for p in range(len(t)) if t.startswith(v, p))
        split = literal.locate(table, values, True).collect()
        assert sorted((r.doc_id, r.value, r.start) for r in split) == sorted(
            (i, v, m.start()) for i, t in enumerate(texts) for v in wanted for m in re.finditer(re.escape(v), t))


def test_literal_search_of_many_values_in_one_document(spark):
    table = spark.range(3000).selectExpr("0L AS doc_id", "CAST(id AS INT) AS unit_seq", "CAST(id AS STRING) AS unit_id", "concat('no. ', id * 7, ' and ', id * 11) AS text")
    values = spark.range(5000).selectExpr("0L AS doc_id", "concat('no. ', id * 7, ' ') AS value")
    assert literal.locate(table, values).where("value = concat('no. ', unit_seq * 7, ' ')").count() == 3000 == literal.locate(table, values).count()


def test_ids_escape_what_json_escapes(spark):
    for unit in ("plain#1", "한글#2", 'q"\\b', "tab\tnl\n\x01\x7f", "😀é"):
        body = json.dumps(["name", unit, 3, 5], separators=(",", ":"))
        got = spark.createDataFrame([(unit,)], "u string").selectExpr(f"{candidate_id(chr(39) + 'name' + chr(39), 'u', '3', '5')} AS id").first().id
        assert got == "c_" + hashlib.sha256(body.encode()).hexdigest()[:24], unit


def test_leaks_of_partly_masked_values(spark):
    decided = spark.createDataFrame([(0, "phone", "010-1234-5678", True, "partial"), (1, "phone", "010-1234-5678", True, "keep")], "doc_id long, type string, value string, located boolean, method string")
    saved = units(spark, "call 010-1234-5678", "call 010-1234-5678")
    assert [r.doc_id for r in leak_scan(saved, decided).collect()] == [0]


def test_copy_review_finds_every_type(spark):
    copy = units(spark, "성명: 김하늘 주소: 서울특별시 강남구 역삼동 12-3\n계좌번호: 123-45-678901 연락처 010-1234-5678")
    kinds = {r.type for r in copy_review(detect_all(copy, TODAY), spark.createDataFrame([], "doc_id long, type string, value string, method string")).collect()}
    assert {"name", "account", "phone"} <= kinds


def test_limits_flag_and_keep(spark):
    rows = spark.range(2000).selectExpr("0L AS doc_id", "CAST(id AS INT) AS unit_seq", "0 AS start", "CAST(id AS STRING) AS cand_id")
    assert cap_candidates(rows).where("over_limit OR incomplete").count() == 0
    limited = cap_candidates(rows, 1000)
    assert limited.count() == 2000 and limited.where("over_limit").count() == 1000
    judged = spark.createDataFrame([(0, "c", "phone", "02-123-4567", True, "", "")], "doc_id long, cand_id string, type string, value string, located boolean, role_raw string, context_raw string").selectExpr(
        "*", "array(named_struct('relation', 'self', 'text', concat('대표전화 02-123-4567 ', repeat('가', 900)))) AS facts", "'' AS keep_text")
    assert local_recommend(judged).first().recommendation == "keep" and keep_grounds(judged).count() == 1


def test_cells_of_many_paragraphs(spark):
    cells = spark.range(12).selectExpr("0L AS doc_id", "0 AS tbl", "0 AS row", "0 AS cell_ord", "2 AS colspan", "CAST(id AS INT) AS unit_seq", "concat('a', id) AS unit_id", "'x' AS text").unionByName(
        spark.range(1).selectExpr("0L AS doc_id", "0 AS tbl", "0 AS row", "1 AS cell_ord", "1 AS colspan", "99 AS unit_seq", "'b' AS unit_id", "'y' AS text"))
    grid = cell_grid(cells)
    assert {(r.cell_ord, r.grid_col) for r in grid.collect()} == {(0, 1), (1, 3)}
    assert cell_relations(grid).where("relation = 'same_cell'").count() == 132


def test_second_batch_of_a_version_keeps_the_first(spark, tmp_path):
    def batch(doc, run):
        copy = spark.createDataFrame([(doc, 0, "u", "text")], "doc_id long, unit_seq int, unit_id string, text string")
        sink.redacted_sink(copy, spark.createDataFrame([(doc, "c", True)], "doc_id long, name string, passed boolean"), 1, str(tmp_path), run)

    for doc, run in ((1, "a"), (2, "b"), (2, "b")):
        batch(doc, run)
    assert sorted(r.doc_id for r in sink.read_copies(spark, str(tmp_path), 1).collect()) == [1, 2]


def test_carry_and_rank_do_not_depend_on_blocks(spark):
    rows = spark.range(500).selectExpr("id % 3 AS k", "CAST(id AS INT) AS seq", "IF(id % 7 = 0, id, NULL) AS v")
    outcomes = set()
    for block in (4, 64, 100000):
        carried = carry_last(rows, ["k"], "seq", "v", "last", block)
        ranked = block_rank(carried, ["k"], "seq", ["seq"], "rn", block)
        outcomes.add(tuple(sorted((r.k, r.seq, r.last, r.rn) for r in ranked.collect())))
    assert len(outcomes) == 1
    seen = {(k, seq): (last, rn) for k, seq, last, rn in outcomes.pop()}
    for k in range(3):
        own = list(range(k, 500, 3))
        for n, seq in enumerate(own):
            before = [s for s in own[:n] if s % 7 == 0]
            assert seen[(k, seq)] == (before[-1] if before else None, n + 1)


def test_interval_join_equals_brute_force(spark):
    left = spark.range(60).selectExpr("id % 2 AS k", "id AS a", "CAST((id * 37) % 100 AS DOUBLE) AS lo", "CAST((id * 37) % 100 + id % 9 AS DOUBLE) AS hi")
    right = spark.range(50).selectExpr("id % 2 AS k", "id AS b", "CAST((id * 53) % 100 AS DOUBLE) AS lo", "CAST((id * 53) % 100 + id % 30 AS DOUBLE) AS hi")
    pairs = interval_join(left, right, ["k"], ("lo", "hi"), ("lo", "hi"), 8).collect()
    got = sorted((r.a, r.r_b) for r in pairs)
    want = sorted((l.a, r.b) for l in left.collect() for r in right.collect() if l.k == r.k and l.lo <= r.hi and r.lo <= l.hi)
    assert got == want


def test_redaction_in_one_row_equals_candidates(spark):
    table = units(spark, "성명: 김하늘 전화 010-1234-5678", "빈 줄 없음")
    rows = {r.doc_id: (r.redacted, r.n_found) for r in D.redact_in_unit(table, TODAY).collect()}
    assert rows[0] == ("성명: 김하늘 전화 *************", 1)
    assert rows[1] == ("빈 줄 없음", 0)


def test_no_python_in_the_detection_plan(spark):
    plan = D.detect_in_unit(units(spark, "성명: 김하늘"), TODAY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_evidence_is_whole(spark):
    text, near = "가" * 400 + "b" * 350 + "나" * 50, "다" * 1000
    table = spark.createDataFrame([(1, "1#0", text)], "doc_id long, unit_id string, text string")
    cands = spark.createDataFrame([(1, "1#0", "c", 400, 750)], "doc_id long, unit_id string, cand_id string, start int, end int")
    relations = spark.createDataFrame([(1, "1#0", "same_cell", 20, "1#1", near)], "doc_id long, unit_id string, relation string, rel_ord long, src_unit_id string, src_text string")
    own = evidence_self(table, cands).first()
    assert (own.ev_start, own.ev_end, own.ev_text, own.ev_cut) == (0, 800, text, False)
    assert [(r.ev_start, r.ev_end, r.ev_text, r.ev_cut) for r in evidence_top8(table, cands, relations).orderBy("ord").collect()] == [(0, 800, text, False), (0, 1000, near, False)]
    cut = evidence_top8(table, cands, relations, width=300).orderBy("ord").collect()
    assert [(r.ev_start, r.ev_end, r.ev_text, r.ev_cut) for r in cut] == [(320, 620, text[320:620], True), (0, 300, near[:300], True)]


def test_lifetimes_over_many_batches(spark, tmp_path):
    """Documents are created in the first of six micro-batches; their events come later, those of document 2 after empty batches."""
    when = {0: [(1, 0), (2, 0)], 1: [(1, 600)], 2: [(3, 900)], 3: [(1, 1800)], 4: [(1, 2400), (3, 2400)], 5: [(1, 3600), (2, 3000), (2, 3601), (3, 4500), (3, 4501)]}
    schema, expected = "doc_id long, event_id long, ts timestamp, creates boolean", {}
    for batch, rows in when.items():
        made = [(doc, 10_000 * doc + at, at, batch == 0 or (doc, at) == (3, 900)) for doc, at in rows]
        expected |= {event: at <= {1: 3600, 2: 3600, 3: 4500}[doc] for doc, event, at, _ in made}
        frame = spark.createDataFrame(made, "doc_id long, event_id long, at long, creates boolean")
        frame.selectExpr("doc_id", "event_id", "timestamp_seconds(1700000000 + at) AS ts", "creates").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert {r.event_id: r.accepted for r in drain(lifetime(events), f"{tmp_path}/work").collect()} == expected
