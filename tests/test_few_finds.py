"""Units with few finds take short ways, which give what the general ones give."""

import re

from hushmark.functions.expr import running_sums, scan, span_array
from hushmark.operators import detect as D

TODAY = "2026-01-01"


def test_spans_of_one_hit_and_of_many(spark):
    texts = ["", "none", "a1", "😀 22 b", "1 22 333 4", "\u0001 7\u0002\u00038", "\u0003", " ".join(str(n) for n in range(700))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: [(s.pstart, s.start, s.end, s.value) for s in r.s] for r in rows.selectExpr("i", f"{span_array('text', '[0-9]+')} AS s").collect()}
    assert got == {i: [(m.start(), m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", t)] for i, t in enumerate(texts)}
    # A pattern that splits at each of three marks would be compiled for every row.
    assert "[\u0001" not in span_array("text", "[0-9]+")


def test_sums_of_few_and_of_many(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (1, 3, 8, 9, 300)], "ls array<int>")
    for few, many in rows.selectExpr(running_sums("ls"), scan("ls", "int", "0", "s + x")).collect():
        assert few == many


def test_fields_are_placed_where_they_stand(spark):
    text = "성명 : 김가민;비고: 없음\t생년월일:  1990-01-02 ; 주소: 성명; 사번:\u0001EMP-1"
    unit = spark.createDataFrame([(1, 0, "u", text), (2, 0, "u", None)], "doc_id long, unit_seq int, unit_id string, text string")
    found = D.in_unit(unit, TODAY).selectExpr("doc_id", "inline(finds)").where("prio = 5").collect()
    assert [(f.type, f.value, f.ord) for f in found] == [("name", "김가민", 0), ("dob", "1990-01-02", 1), ("management_id", "EMP-1", 2)]
    assert all(f.doc_id == 1 and text[f.start:f.end] == f.value for f in found)
    assert [text[f.proof_start:f.start].rstrip(" \u0001") for f in found] == ["성명 :", "생년월일:", "사번:"]
    # Each piece of a field is trimmed at one place of the expression only.
    assert D.inline_fields(TODAY).count("\\\\s+|\\\\s+$") <= 2


def test_finds_apart_stay_as_they_are(spark):
    def find(start, end, kind, prio=0):
        return f"named_struct('prio', {prio}, 'ord', 0L, 'start', {start}, 'end', {end}, 'type', '{kind}', 'value', 'v', 'alts', CAST(array() AS array<string>), 'relation', CAST(NULL AS STRING), 'proof_unit', CAST(NULL AS STRING), 'proof_start', CAST(NULL AS INT), 'proof_end', CAST(NULL AS INT))"

    cases = {
        "apart": ([find(9, 12, "phone"), find(0, 4, "email"), find(4, 9, "phone")], [(0, "email"), (4, "phone"), (9, "phone")]),
        "meet": ([find(9, 12, "phone"), find(0, 10, "email", 1)], [(9, "phone")]),
        "account": ([find(2, 9, "phone"), find(0, 10, "account", 4), find(20, 21, "name", 5)], [(0, "account"), (20, "name")]),
    }
    for finds, wanted in cases.values():
        row = spark.range(1).selectExpr(f"array({', '.join(finds)}) AS finds").selectExpr(f"{D.settle()} AS f").first()
        assert sorted((f.start, f.type) for f in row.f) == wanted
