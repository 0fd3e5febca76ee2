"""op6: near-duplicates among all documents."""

from __future__ import annotations

from hushmark.llm import simhash as op
from hushmark.llm.common import table


def query(spark, sf_dir):
    return op.digest(op.near_duplicates(table(spark, sf_dir, "documents")))


NAME, ORACLE = "op6_simhash_near_dedup", None
