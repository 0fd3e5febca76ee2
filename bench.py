"""Time the headline queries on $BENCH_SF_DIR with $BENCH_CPUS cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from hushmark.plans.catalog import QUERIES, flagship
from hushmark.session import local_session

HEADLINE = [
    "pii_union", "mask_text_chain", "redact_units", "preset_previews", "evidence_above", "leak_scan", "detection_audit", "stream_redact",
    "detect_all", "detect_all_layout", "propagate_names", "glyph_check", "merge_overlap", "validate_suggestions", "table_column_fields",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus), "16g")
    spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    timings = {}
    for name, query in [("flagship", flagship)] + [(n, QUERIES[n]) for n in HEADLINE]:
        started = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - started, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": timings, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
