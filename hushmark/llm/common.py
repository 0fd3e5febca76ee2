"""What the operators share: folders, numeric views of text columns, and bounds of a chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushmark.session import cut, shared_folder  # noqa: F401  one rule for folders

#: Bytes of text that a task turns into arrays at a time; a longer document makes a chunk of its own.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds).cast("long"))


def binary(column: pa.Array) -> pa.Array:
    """The texts as bytes, null as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    return column.fill_null(b"") if column.null_count else column


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes of the rows, row offsets within those bytes), a bounded stretch of rows at a time."""
    if not len(column):
        return
    column = binary(column)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(int(np.searchsorted(at, at[first] + limit, "right")) - 1, first + 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def per_batch(make, returns: str):
    """A column function on Arrow batches: ``make()`` runs once in a task and gives ``batch -> array``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            yield work(batch)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)
