"""Payloads are parsed once, whatever is read of the result."""

from hushmark.operators.ground import parse_extractions


def test_records_and_refusals_come_from_one_parse(spark):
    kinds = ("name", "phone", "email", "address", "dob", "resident_id", "foreign_id", "passport", "driver_license", "account", "card", "management_id")
    item = '{"raw_value":"v","role_raw":"","context_raw":"c"}'
    whole = "{" + ",".join(f'"{k}":[{item if k == "name" else ""}]' for k in kinds) + "}"
    good, bad = parse_extractions(spark.createDataFrame([(1, whole), (2, "not json"), (3, None)], "doc_id int, payload string"))
    assert [(r.doc_id, r.type, r.raw_value, r.context_raw) for r in good.collect()] == [(1, "name", "v", "c")]
    assert sorted((r.doc_id, r.fault) for r in bad.collect()) == [(2, "invalid_json"), (3, "invalid_json")]
    for part in (good, bad):
        assert "parse_json" not in part._jdf.queryExecution().optimizedPlan().toString()
