"""op12: tokens of all documents."""

from __future__ import annotations

from hushmark.llm import tokencount as op
from hushmark.llm.common import table


def query(spark, sf_dir):
    return op.counted(table(spark, sf_dir, "documents"))


NAME, ORACLE = "op12_token_counts", None
