"""Vector codes: each part of a vector becomes the index of its nearest codebook entry, in integers only.

Components become floor(1024 * x). Parts and entries are padded with zeros to a power of two and go through the integer Walsh-Hadamard
transform, which keeps squared distances but for the factor of that length. Squared differences are added up in sequency order,
slow waves first; every sum so far is a bound from below, so entries above the distance already reached for some entry
are left out, and what remains is exact. Codebooks start from the first vectors by id and move to the floor of their parts' mean, round by
round; a task sends one row of sums per entry, so what is shuffled and collected hangs on the codebooks, not on the vectors.

Rows whose vector is null or holds a null or non-finite component are dropped. Vectors of unequal length, or of one that the parts
don't divide, are padded with zeros at the end to the longest length that they do divide; empty vectors are all zeros then. Rows of one vec_id
are coded each for itself, and among them (null ids last) the smaller vector starts the codebook first. With fewer vectors than entries the codebook is as
short. An empty table gives no rows. Only vec_id, embedding and label are read, so other columns can't clash. Where 64 bits could
be passed within the transform, Python's integers take over; components beyond 2^62 and errors that no long holds raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of which all distances of a part are looked at together: as many as a processor's cache holds.
BLOCK = 128
_LOW = 32


def sequency(size: int) -> np.ndarray:
    """Rows of the natural Hadamard order by their number of sign changes: the bit-reversed Gray code."""
    k, bits = np.arange(size), size.bit_length() - 1
    gray, out = k ^ (k >> 1), np.zeros(size, np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def walsh(values: np.ndarray) -> np.ndarray:
    """The integer Walsh-Hadamard transform of the last axis, padded with zeros to a power of two, in sequency order."""
    width = values.shape[-1]
    size = 1 << (width - 1).bit_length() if width else 1
    out = np.zeros((*values.shape[:-1], size), values.dtype)
    out[..., :width] = values
    step = 1
    while step < size:
        pairs = out.reshape(*out.shape[:-1], size // (2 * step), 2, step)
        a, b = pairs[..., 0, :].copy(), pairs[..., 1, :].copy()
        pairs[..., 0, :], pairs[..., 1, :] = a + b, a - b
        step *= 2
    return out[..., sequency(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lowest) and its distance, both of transformed rows; distances keep the transform's factor."""
    n, size = parts.shape
    rows = np.arange(n)

    def whole(at: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = parts[at] - entries[entry]
        return (gap * gap).sum(axis=1)

    # While most entries are still in, all are added to at once; later only those that are.
    done = -(-size // 2)
    so_far, gap, waves = np.zeros((n, len(entries)), parts.dtype), np.empty((n, len(entries)), parts.dtype), np.ascontiguousarray(entries.T)
    for j in range(done):
        np.subtract(parts[:, j, None], waves[j], out=gap)
        np.multiply(gap, gap, out=gap)
        np.add(so_far, gap, out=so_far)
    reached = whole(rows, so_far.argmin(axis=1))
    at, entry = np.nonzero(so_far <= reached[:, None])
    so_far = so_far[at, entry]
    while done < size:
        more = min(max(1, size // 4), size - done)
        for j in range(done, done + more):
            gap = parts[at, j] - entries[entry, j]
            so_far = so_far + gap * gap
        done += more
        # The entry that now looks best sets a lower mark.
        first = np.searchsorted(at, rows)
        least = np.minimum.reduceat(so_far, first)
        best = np.flatnonzero(so_far == least[at])
        best = best[np.searchsorted(at[best], rows)]
        reached = np.minimum(reached, whole(rows, entry[best]))
        kept = so_far <= reached[at]
        at, entry, so_far = at[kept], entry[kept], so_far[kept]
    first = np.searchsorted(at, rows)
    least = np.minimum.reduceat(so_far, first)
    best = np.flatnonzero(so_far == least[at])
    best = best[np.searchsorted(at[best], rows)]
    return entry[best], so_far[best]


@dataclass
class Codebooks:
    """Entries by part, entry and position, and whether 64 bits hold all sums of the transform."""

    entries: np.ndarray
    exact64: bool

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for v in self.entries.ravel().tolist()).encode()).hexdigest()

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per vector its entry of each part, and the squared distances summed over parts."""
        kind = np.int64 if self.exact64 else object
        parts, _, width = self.entries.shape
        size = 1 << (width - 1).bit_length() if width else 1
        codes, errors = np.zeros((len(vectors), parts), np.int64), np.zeros(len(vectors), kind)
        for p in range(parts):
            entries = walsh(self.entries[p].astype(kind))
            for a in range(0, len(vectors), BLOCK):
                block = walsh(vectors[a : a + BLOCK, p * width : (p + 1) * width].astype(kind))
                codes[a : a + BLOCK, p], scaled = nearest(block, entries)
                errors[a : a + BLOCK] += scaled // size
        return codes, errors


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int, int]:
    """vec_id, label and the integer vector ``v`` of every kept row; the common length, and the largest size of a component."""
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).where(
        "x IS NOT NULL AND NOT exists(x, c -> c IS NULL OR isnan(c) OR abs(c) = double('Infinity'))")
    kept = kept.selectExpr("vec_id", "label", f"transform(x, c -> {scale}D * c) AS x")
    length, largest = kept.agg(F.max(F.size("x")), F.max(F.expr("array_max(transform(x, c -> abs(c)))"))).first()
    largest = int(np.ceil(largest or 0)) if not largest or np.isfinite(largest) else 1 << 1024
    if largest >= 1 << 62:
        raise OverflowError("components beyond 2^62 have no integer form here")
    length = -(-(length or 0) // parts) * parts
    out = kept.selectExpr("vec_id", "label", f"concat(transform(x, c -> CAST(floor(c) AS BIGINT)), array_repeat(0L, {length} - size(x))) AS v")
    return out, length, largest


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)


_SUMS = "part int, entry int, n long, high array<long>, low array<long>"


class _Sums:
    """Sums of vectors by part and entry, in Python's integers where 64 bits might not do."""

    def __init__(self, books: Codebooks):
        self.books, (parts, entries, width) = books, books.entries.shape
        self.n, self.sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        self.high, self.room = np.zeros((parts, entries, width), np.int64), 0

    def _settle(self) -> None:
        self.high += self.sums >> _LOW
        self.sums &= (1 << _LOW) - 1

    def add(self, vectors: np.ndarray) -> None:
        width = self.books.entries.shape[2]
        codes, _ = self.books.codes(vectors)
        for p in range(codes.shape[1]):
            part = vectors[:, p * width : (p + 1) * width]
            np.add.at(self.n[p], codes[:, p], 1)
            np.add.at(self.sums[p], codes[:, p], part & ((1 << _LOW) - 1))
            np.add.at(self.high[p], codes[:, p], part >> _LOW)
        self._settle()

    def merge(self, batch: pa.RecordBatch) -> None:
        for row in batch.to_pylist():
            at = row["part"], row["entry"]
            self.n[at] += row["n"]
            self.high[at] += np.array(row["high"], np.int64)
            self.sums[at] += np.array(row["low"], np.int64)
        self._settle()

    def rows(self) -> pa.RecordBatch:
        p, e = np.nonzero(self.n)
        return pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(self.n[p, e]),
             pa.array(list(self.high[p, e]), pa.list_(pa.int64())), pa.array(list(self.sums[p, e]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "high", "low"])


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: all parts to their nearest entries, each entry to the floor of its parts' mean."""
    length = books.entries.shape[0] * books.entries.shape[2]
    spread = vectors.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(spread.value)
        for batch in batches:
            sums.add(_matrix(batch, length))
        yield sums.rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(spread.value)
        for batch in batches:
            sums.merge(batch)
        yield sums.rows()

    # An entry's rows meet in one task, so at most one row per entry comes to the driver.
    found = vectors.select("v").mapInArrow(assign, _SUMS).repartition("part", "entry").mapInArrow(merge, _SUMS).collect()
    spread.destroy()
    entries = books.entries.copy()
    for row in found:
        entries[row["part"], row["entry"]] = [((h << _LOW) + low) // row["n"] for h, low in zip(row["high"], row["low"], strict=True)]
    return Codebooks(entries, books.exact64)


def fit(vectors: DataFrame, length: int, largest: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    first = [row["v"] for row in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    width = length // parts
    size = 1 << (width - 1).bit_length() if width else 1
    start = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    books = Codebooks(start, size * size * 4 * (largest + 1) ** 2 * parts < 1 << 62)
    for _ in range(rounds if first and width else 0):
        books = _moved(vectors, books)
    return books


def encoded(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    vectors, length, largest = integers(table, parts, scale)
    books = fit(vectors, length, largest, parts, entries, rounds)
    spread = table.sparkSession.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = spread.value.codes(_matrix(batch, length))
            text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors.tolist(), pa.int64())],
                names=["vec_id", "label", "code", "error"])

    found = cut(vectors.mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    sums = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return found.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
