"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark.llm.common import cut


def _mark(links: DataFrame) -> tuple:
    """What changes whenever the set of links does."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest of its neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    ends = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return ends.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of a link (u, v, same type); the label is the smallest node that can be reached.

    Rounds go on until no link changes; each round's links are written, so lineage stays short. Only a
    count and hashes come to the driver. Self links vanish.
    """
    links = cut(links.select("u", "v").where("u != v").distinct())
    mark = _mark(links)
    while mark[0]:
        links = cut(_small_star(_large_star(links)))
        now = _mark(links)
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
