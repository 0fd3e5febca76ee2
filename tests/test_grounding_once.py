"""Lists of a payload are read once, and a single hit needs no pattern."""

import json
import re

from hushmark.operators import ground as G
from hushmark.operators.literal import occurrences

KINDS = ("name", "phone", "email", "address", "dob", "resident_id", "foreign_id", "passport", "driver_license", "account", "card", "management_id")


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_value_that_stands_once_needs_no_pattern(spark):
    texts = ["aaa", "xaay", "한글😀한글 aa", "a.a", "aa\u0001aa", "b\u0001a", "", None]
    values = ["aa", "aaa", "한글", "😀", "a.a", "a", "b a", "b\u0001a", "\\E", "zz"]
    pairs = spark.createDataFrame([(t, v) for t in texts for v in values], "text string, value string").where("contains(text, value)")
    got = pairs.selectExpr("text", "value", f"{occurrences('text', 'value')} AS every", f"{occurrences('text', 'value', True)} AS apart").collect()
    for r in got:
        text = r.text.replace("\u0001", " ")
        every = [i for i in range(len(text)) if text.startswith(r.value, i)]
        assert r.every == every and r.apart == [m.start() for m in re.finditer(re.escape(r.value), text)], (r.text, r.value)
    assert "locate" in plan(pairs.selectExpr(occurrences("text", "value")))


def test_faults_of_payloads_and_each_list_read_once(spark):
    item = {"raw_value": "v", "role_raw": "", "context_raw": "c"}
    good = {k: [] for k in KINDS}
    cases = {
        "invalid_json": "not json", "not_object": "[1]", "missing_key": json.dumps({k: [] for k in KINDS[1:]}),
        "phone:not_array": json.dumps(good | {"phone": {"0": 1}}), "email:not_array": json.dumps(good | {"email": None}), "card:not_array": json.dumps(good | {"card": "[]"}),
        "dob:item_not_object": json.dumps(good | {"dob": [item, "x"]}), "name:item_not_object": json.dumps(good | {"name": [None], "phone": 1}),
        "account:raw_value": json.dumps(good | {"account": [item | {"raw_value": ""}]}), "passport:raw_value": json.dumps(good | {"passport": [item | {"raw_value": 5}]}),
        "address:role_raw": json.dumps(good | {"address": [item, item | {"role_raw": None}]}), "name:context_raw": json.dumps(good | {"name": [{"raw_value": "v", "role_raw": ""}]}),
    }
    rows = [(fault, payload) for fault, payload in cases.items()] + [("", json.dumps(good | {"phone": [item, item | {"raw_value": "w"}]}))]
    found = G.parsed(spark.createDataFrame(rows, "doc_id string, payload string"))
    assert {r.doc_id: r.fault for r in found.where("fault IS NOT NULL").collect()} == {fault: fault for fault in cases}
    assert [(r.type, r.rec_no, r.raw_value) for r in found.where("fault IS NULL").orderBy("rec_no").collect()] == [("phone", 1 << 32, "v"), ("phone", (1 << 32) + 1, "w")]
    assert len(re.findall(r"array<variant>|ArrayType\(VariantType", plan(found))) == len(KINDS)
