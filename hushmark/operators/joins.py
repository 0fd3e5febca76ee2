"""Interval joins, carried values and ranks that keep no group whole in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(
    left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str],
    width: float, condition: str | None = None,
) -> DataFrame:
    """Pairs whose closed ranges meet, within equal keys.

    Both sides are cut into buckets of ``width``; a pair is reported only in the bucket where
    the later of the two ranges starts, so there are no duplicates. Work follows the number of
    rows that share a bucket, not the size of the key's group. Right columns get the prefix
    ``r_``.
    """
    l = left.withColumns({"_lo": F.expr(f"CAST({left_range[0]} AS DOUBLE)"), "_hi": F.expr(f"CAST({left_range[1]} AS DOUBLE)")})
    r = right.withColumns({"_rlo": F.expr(f"CAST({right_range[0]} AS DOUBLE)"), "_rhi": F.expr(f"CAST({right_range[1]} AS DOUBLE)")})
    others = [c for c in right.columns if c not in on]
    r = r.select(*on, *[F.col(c).alias(f"r_{c}") for c in others], "_rlo", "_rhi")
    cut = "explode(sequence(CAST(floor({0} / {2}) AS BIGINT), CAST(floor({1} / {2}) AS BIGINT))) AS _bucket"
    r = r.where("_rlo <= _rhi").selectExpr("*", cut.format("_rlo", "_rhi", width))
    l = l.where("_lo <= _hi").selectExpr("*", cut.format("_lo", "_hi", width))
    paired = l.join(r, [*on, "_bucket"])
    met = paired.where("_lo <= _rhi AND _rlo <= _hi").where(
        f"_bucket = CAST(floor(greatest(_lo, _rlo) / {width}) AS BIGINT)"
    )
    if condition:
        met = met.where(condition)
    return met.drop("_bucket", "_lo", "_hi", "_rlo", "_rhi")


BLOCK = 4096


def carry_last(rows: DataFrame, keys: list[str], seq: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Last non-null ``value`` before each row, in ``seq`` order within the keys.

    A window over a whole document would hold it in one task. Rows are cut into blocks of
    consecutive ``seq``; each block is scanned alone and only one row per block is carried on.
    """
    from pyspark.sql import Window

    cut = rows.withColumns({"_block": F.expr(f"CAST(floor({seq} / {block}) AS BIGINT)"), "_val": F.expr(value)})
    inside = Window.partitionBy(*keys, "_block").orderBy(seq)
    local = cut.withColumn("_local", F.last("_val", True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = cut.groupBy(*keys, "_block").agg(F.expr(f"max_by(_val, {seq}) FILTER (WHERE _val IS NOT NULL)").alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carry", F.last("_end", True).over(across)).drop("_end")
    return (
        local.join(carried, [*keys, "_block"])
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_block", "_val", "_local", "_carry")
    )


def block_rank(rows: DataFrame, keys: list[str], seq: str, order: list[str | Column], out: str, block: int = BLOCK) -> DataFrame:
    """Row number within the keys, ``seq`` leading the order, counted block by block; rows without ``seq`` come last."""
    from pyspark.sql import Window

    cut = rows.withColumns({"_late": F.expr(f"{seq} IS NULL"), "_block": F.expr(f"coalesce(CAST(floor({seq} / {block}) AS BIGINT), 0)")})
    inside = Window.partitionBy(*keys, "_late", "_block").orderBy(*order)
    local = cut.withColumn("_rn", F.row_number().over(inside))
    sizes = cut.groupBy(*keys, "_late", "_block").agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*keys).orderBy("_late", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n")
    return (
        local.join(offsets, [*keys, "_late", "_block"])
        .withColumn(out, F.col("_rn") + F.col("_before"))
        .drop("_late", "_block", "_rn", "_before")
    )
