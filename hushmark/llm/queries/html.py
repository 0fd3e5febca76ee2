"""op5: main text of all pages."""

from __future__ import annotations

from hushmark.llm import html as op
from hushmark.llm.common import table


def query(spark, sf_dir):
    return op.extract(table(spark, sf_dir, "pages"))


NAME, ORACLE = "op5_html_consensus", None
