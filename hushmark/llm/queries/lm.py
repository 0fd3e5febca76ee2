"""op3: language-model scores of all documents."""

from __future__ import annotations

from hushmark.llm import lm as op
from hushmark.llm.common import table


def query(spark, sf_dir):
    return op.scored(table(spark, sf_dir, "documents"))


NAME, ORACLE = "op3_lm_maxent", None
