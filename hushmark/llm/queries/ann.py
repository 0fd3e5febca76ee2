"""op9: ten nearest of every vector whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushmark.llm import ann as op
from hushmark.llm.common import table


def query(spark, sf_dir):
    return op.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


NAME, ORACLE = "op9_graph_neighbours", None
