"""Best-fit packing with certified repacking.

Documents become token ids (those that the tokenizer library gives their pre-tokens, then id 0) and are cut only if longer than
a sequence: into whole sequences, with the rest as the first piece. Pieces are dealt evenly to partitions of bounded size,
and each is packed by best-fit decreasing. A lower bound from dual feasible functions says how many
sequences a partition needs at least; where the packing meets it, nothing better exists and the
partition is settled. Partitions with a gap put the pieces of their loose sequences together, which are
dealt anew and packed again; the new packing is taken if it needs fewer sequences.

A null text is the empty text, whose only id is 0. Repeated rows are packed each for itself. An empty table gives no
rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark.llm.common import cut
from hushmark.llm.pretokens import Vocabulary, stretches, vocabulary

CAPACITY = 2048
#: Pieces that one task packs at a time.
PIECES_A_PARTITION = 40_000
#: A sequence of a partition with a gap is loose if at least so many tokens are free.
LOOSE = 16
ROUNDS = 3
END_OF_DOCUMENT = 0
#: Entries of a worker's cache of pre-tokens, and bytes of the longest it takes.
CACHED, CACHED_BYTES = 400_000, 256
_caches: dict[str, dict] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Ids(dict):
    """Ids of pre-tokens as the library gives them, as bytes, four an id; what is asked for first is encoded then. A full cache starts anew."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: bytes) -> bytes:
        ids = array("I", self.vocab.ids(word)).tobytes()
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[word] = ids
        return ids


def encoded(column: pa.Array, vocab: Vocabulary, cache: _Ids) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of every text, in order."""
    last, parts = 0, []
    for rows, data, at in stretches(column):
        whole, starts = data.tobytes(), vocab.starts(data, at)
        first = np.searchsorted(starts, at).tolist()
        bounds = np.append(starts, len(data)).tolist()
        words = map(cache.__getitem__, map(whole.__getitem__, map(slice, bounds[:-1], bounds[1:])))
        for k, row in enumerate(rows.tolist()):
            if row != last:
                yield last, np.frombuffer(b"".join(parts), "<u4")
                last, parts = row, []
            parts.append(b"".join(islice(words, first[k + 1] - first[k])))
    if len(column):
        yield last, np.frombuffer(b"".join(parts), "<u4")


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


_PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        cache = _caches.setdefault(path, _Ids(vocab))
        for batch in batches:
            rows, at = [], []
            for k, found in encoded(batch.column("text"), vocab, cache):
                ids = np.append(found, np.array([END_OF_DOCUMENT], "<u4"))
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    at.append(k)
                    rows.append((piece, start, length, zlib.crc32(part.tobytes()), part if with_ids else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            arrays = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:4]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int32) for p in columns[4]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {_PIECE}" + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and what is free in each bin."""
    bins, offsets, free = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has r free
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_free[room].pop()
            if not by_free[room]:
                open_ ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[k], offsets[k] = b, capacity - room
        free[b] = room - n
        if free[b]:
            by_free[free[b]].append(b)
            open_ |= 1 << free[b]
    return bins, offsets, np.array(free, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, steps: int = 24) -> int:
    """Fewest bins by dual feasible functions: the identity, steps of (k+1)x, and cutting off at a threshold."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, steps + 1):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)  # in 1/(k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    # Threshold t: items over capacity - t count whole, those under t not at all.
    many, total = np.cumsum(count[::-1])[::-1], np.concatenate([[0], np.cumsum(count * x)])
    t = np.arange(1, capacity // 2 + 1)
    whole = many[np.minimum(capacity - t + 1, capacity)] * (capacity - t + 1 <= capacity)
    between = total[capacity - t + 1] - total[t]
    return max(best, int((whole + -(-between // capacity)).max()))


_PACKED = "round_no int, part long, sequence_id long, offset long, free long, gap long"


def _pack(dealt: DataFrame, round_no: int, capacity: int) -> DataFrame:
    kept = [f for f in dealt.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", " + _PACKED

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        whole = pa.Table.from_batches(rows).combine_chunks()
        part = TaskContext.get().partitionId()
        lengths = whole.column("length").to_numpy()
        bins, offsets, free = best_fit(lengths, capacity)
        gap = len(free) - lower_bound(lengths, capacity)
        n = len(lengths)
        first = (round_no << 56) + (part << 28)
        for name, values, kind in (("round_no", np.full(n, round_no), pa.int32()), ("part", np.full(n, part), pa.int64()), ("sequence_id", first + bins, pa.int64()),
                                   ("offset", offsets, pa.int64()), ("free", free[bins], pa.int64()), ("gap", np.full(n, gap), pa.int64())):
            whole = whole.append_column(name, pa.array(values, kind))
        yield from whole.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(work, schema)


def _dealt(frame: DataFrame, rows: int, a_partition: int) -> DataFrame:
    return frame.repartition(max(1, -(-rows // a_partition)))


def pack(parts: DataFrame, capacity: int = CAPACITY, a_partition: int = PIECES_A_PARTITION, rounds: int = ROUNDS, loose: int = LOOSE) -> DataFrame:
    """All pieces (any columns, with ``length``) with sequence_id, offset and the gap of the partition that packed them."""
    parts = cut(parts)
    done = cut(_pack(_dealt(parts, parts.count(), a_partition), 0, capacity))
    for round_no in range(1, rounds + 1):
        free = (F.col("gap") > 0) & (F.col("free") >= loose)
        rows, bins, groups = done.where(free).agg(F.count("*"), F.count_distinct("sequence_id"), F.count_distinct("round_no", "part")).first()
        if groups < 2:
            break
        again = cut(_pack(_dealt(done.where(free).select(*parts.columns), rows, a_partition), round_no, capacity))
        if again.agg(F.count_distinct("sequence_id")).first()[0] >= bins:
            break
        done = done.where(~free).unionByName(again)
    return done.drop("round_no", "part", "free")


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids in order of offset, and the pieces' lengths."""
    whole = pack(pieces(docs, path, with_ids=True))
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return whole.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p["length"]).alias("lengths"))
