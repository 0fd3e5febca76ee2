"""op7: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

from hushmark.llm import packing as op
from hushmark.llm.common import table


def query(spark, sf_dir):
    return op.packed(table(spark, sf_dir, "documents"))


NAME, ORACLE = "op7_best_fit_packing", None
