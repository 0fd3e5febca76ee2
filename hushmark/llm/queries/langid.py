"""op4: languages of all documents."""

from __future__ import annotations

from hushmark.llm import langid as op
from hushmark.llm.common import table


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return op.identified(docs, op.fit(docs))


NAME, ORACLE = "op4_language_ecoc", None
