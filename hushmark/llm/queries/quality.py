"""op2: quality of all documents."""

from __future__ import annotations

from hushmark.llm import quality as op
from hushmark.llm.common import table


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return op.classified(docs, op.fit(docs, table(spark, sf_dir, "labels")))


NAME, ORACLE = "op2_quality_crf", None
