"""The union of ranges as an aggregate in two steps: parts that any task makes of the rows it has, and their union by key.

``span_partials`` runs before the shuffle: a task hands on the joined ranges of each key, and holds no more than ``MOST`` of them at a time, so
a key that has most of all rows costs a few rows a task. Parts are ranges again and may be united in any order and any number
of times. In SQL both are functions: ``SELECT k, span_union(a, b) FROM span_partials(TABLE(ranges)) GROUP BY k``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from hushmark.operators.mask import islands

#: Ranges that a task holds before it hands them on.
MOST = 100_000
#: Ranges of a group that are joined one by one; setting up columns for so few costs many times the work.
FEW = 256


def united(rows: pa.Table, keys: list[str]) -> pa.Table:
    """Ranges [a, b) of each key joined where they touch or overlap; those without a place are dropped."""
    rows = rows.filter(pc.and_(pc.less_equal(0, rows["a"]), pc.less(rows["a"], rows["b"]))).combine_chunks()
    if not rows.num_rows:
        return rows
    rows = rows.sort_by([(k, "ascending") for k in [*keys, "a"]])
    n = rows.num_rows
    other = np.zeros(n, bool)
    other[0] = True
    for k in keys:
        column = rows[k].combine_chunks()
        same = pc.equal(column[1:], column[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        both_null = column.is_null().to_numpy(zero_copy_only=False)
        other[1:] |= ~(same | (both_null[1:] & both_null[:-1]))
    key = np.cumsum(other) - 1
    a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
    # The furthest end so far within a key: ends as ranks, so that the key's number can stand above them.
    order = np.sort(b)
    furthest = order[np.maximum.accumulate(key * n + np.searchsorted(order, b)) % n]
    new = other.copy()
    new[1:] |= a[1:] > furthest[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    out = rows.take(pa.array(first))
    return out.set_column(out.schema.get_field_index("b"), "b", pa.array(furthest[last], out.schema.field("b").type))


def span_partials(ranges: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """Keys, a, b: the ranges of each task's rows, joined there; no shuffle."""
    rows = ranges.select(*keys, "a", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size > most:
                held = [united(pa.concat_tables(held), keys)]
                size = held[0].num_rows
                if size > most // 2:
                    yield from held[0].to_batches(max_chunksize=10_000)
                    held, size = [], 0
        if held:
            yield from united(pa.concat_tables(held), keys).to_batches(max_chunksize=10_000)

    return rows.mapInArrow(work, rows.schema)


def span_union(ranges: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """Keys, a, b: the disjoint ranges of each key, as rows; no key is held whole."""
    return islands(span_partials(ranges, keys, most), keys)


class _Partials:
    """The table function: keys are all columns before the last two, which are the range."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.names: list[str] = []

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) < 2:
            raise ValueError("span_partials takes a table whose last two columns are the range")
        return AnalyzeResult(schema=StructType(rows.dataType.fields))

    def eval(self, row: Row) -> Iterator[tuple]:
        self.names = list(row.__fields__)
        self.rows.append(tuple(row))
        if len(self.rows) > MOST:
            self.rows = self._joined()
            if len(self.rows) > MOST // 2:
                yield from self.rows
                self.rows = []

    def terminate(self) -> Iterator[tuple]:
        yield from self._joined()

    def _joined(self) -> list[tuple]:
        if not self.rows:
            return []
        *keys, a, b = zip(*self.rows, strict=True)
        names = [f"k{i}" for i in range(len(keys))]
        out = united(pa.table([*(pa.array(k) for k in keys), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[*names, "a", "b"]), names)
        return list(zip(*(c.to_pylist() for c in out.columns), strict=True))


def _union(a: pa.Array, b: pa.Array) -> list[dict]:
    if len(a) <= FEW:
        out = []
        for start, end in sorted((s, e) for s, e in zip(a.to_pylist(), b.to_pylist(), strict=True) if s is not None and e is not None and 0 <= s < e):
            if out and start <= out[-1]["b"]:
                out[-1]["b"] = max(out[-1]["b"], end)
            else:
                out.append({"a": start, "b": end})
        return out
    out = united(pa.table([a.cast(pa.int64()), b.cast(pa.int64())], names=["a", "b"]), [])
    return out.to_pylist()


_union.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Scalar}


def register(spark: SparkSession) -> None:
    """``span_union(a, b)`` for GROUP BY, and ``span_partials(TABLE(...))`` for what is grouped."""
    spark.udf.register("span_union", F.arrow_udf(_union, "array<struct<a: bigint, b: bigint>>"))
    spark.udtf.register("span_partials", F.udtf(_Partials))
