"""SQL functions: masking, validators, ids and span search under names usable from SQL.

They are SQL function bodies over built-in functions, so the optimizer sees through them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from hushmark.functions import masking as M
from hushmark.functions.ids import candidate_id
from hushmark.functions.validate import label_type, valid_value
from hushmark.operators.detect import format_candidates
from hushmark.operators.policy import public_contact

_RANGES = "ARRAY<STRUCT<a: INT, b: INT>>"


def register(spark: SparkSession, today: str) -> None:
    """Create the session's functions."""
    scalars = [
        ("mask_value", f"value STRING, method STRING, ranges {_RANGES}", "STRING", M.mask_value("value", "method", "ranges")),
        ("mask_ranges", f"ranges {_RANGES}", _RANGES, M.merge_ranges("ranges")),
        ("mask_presets", "kind STRING, value STRING", f"MAP<STRING, {_RANGES}>", M.presets("kind", "value")),
        ("mask_text", "value STRING", "STRING", M.mask_text_chain("value")),
        ("is_valid_value", "kind STRING, value STRING", "BOOLEAN", valid_value("kind", "value", today)),
        ("label_type", "value STRING", "STRING", label_type("value")),
        ("span_id", "kind STRING, unit_id STRING, start INT, stop INT", "STRING", candidate_id("kind", "unit_id", "start", "stop")),
        ("is_public_contact", "context STRING, value STRING", "BOOLEAN", public_contact("context", "value")),
    ]
    for name, arguments, result, body in scalars:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION find_pii(content STRING) RETURNS TABLE (type STRING, start INT, stop INT, value STRING) "
        f"RETURN SELECT f.type, f.start, f.end, f.value FROM (SELECT explode({format_candidates('content')}) AS f)"
    )
