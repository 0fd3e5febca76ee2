"""Token counts by a two-tier lookup of pre-tokens, without a shuffle of pre-tokens.

A byte-level BPE text has as many tokens as its pre-tokens have together. First every task keeps a bounded summary of the pre-tokens it
meets (Misra-Gries: whatever is more frequent than one in ``FREQUENT`` stays), and the summaries are merged in two steps. The
frequent pre-tokens and their token numbers become a compact hash table of fixed size, which is broadcast. Then every
text is counted where it lies: its pre-tokens are looked up in the table by their packed bytes, compared whole, so that no hash can
deceive; those that miss go to a cache of the Python worker, and only what the cache misses too is encoded. The summary decides speed, never a count.

Null texts are empty: no bytes, no tokens. Repeated rows, and rows of one id, are counted each for itself. An empty table
gives no rows. Only the id and text columns are read, so other columns can't clash. Bytes that are no UTF-8 count as the replacement sign does.
A long text is read in parts that end where a pre-token ends anyway; a single pre-token is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark.llm.common import binary
from hushmark.llm.pretokens import KEY_BYTES, Vocabulary, mixed, packed, stretches, unpacked, vocabulary

#: Pre-tokens in the broadcast table; a summary holds as many.
FREQUENT = 16_384
#: Tasks that merge the summaries before the last one does.
MERGES = 64
#: Entries of a worker's cache, and bytes of the longest pre-token it takes; a full cache starts anew.
CACHED, CACHED_BYTES = 400_000, 256

Summary = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_EMPTY: Summary = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def merged(parts: list[Summary], most: int = FREQUENT) -> Summary:
    """Counts of several summaries added up; beyond ``most`` keys, all give up the count of the first one too many."""
    low, high, length, count = (np.concatenate(c) for c in zip(*parts, strict=True))
    keys = mixed(low, high, length)
    order = np.argsort(keys, kind="stable")
    low, high, length, count, keys = (c[order] for c in (low, high, length, count, keys))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (length[1:] != length[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return _EMPTY
    low, high, length, count = low[first], high[first], length[first], np.add.reduceat(count, first)
    if len(count) > most:
        count = count - np.partition(count, len(count) - most - 1)[len(count) - most - 1]
        kept = count > 0
        low, high, length, count = low[kept], high[kept], length[kept], count[kept]
    return low, high, length, count


def _lengths(starts: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.append(starts, size))


def summary(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, most: int = FREQUENT) -> Summary:
    """The frequent pre-tokens of a task's texts."""
    held = _EMPTY
    for batch in batches:
        for _, data, at in stretches(batch.column("text")):
            starts = vocab.starts(data, at)
            lengths = _lengths(starts, len(data))
            short = lengths <= KEY_BYTES
            low, high = packed(data, starts[short], lengths[short])
            held = merged([held, (low, high, lengths[short], np.ones(len(low), np.int64))], most)
    return held


_SUMMARY = "low array<long>, high array<long>, length array<long>, count array<long>"


def _row(held: Summary) -> pa.RecordBatch:
    names = ("low", "high", "length", "count")
    return pa.RecordBatch.from_arrays([pa.array([c.view(np.int64)], pa.list_(pa.int64())) for c in held], names=list(names))


def _rows(batch: pa.RecordBatch) -> list[Summary]:
    columns = [[np.array(v, np.int64) for v in batch.column(n).to_pylist()] for n in ("low", "high", "length", "count")]
    return [(low.view(np.uint64), high.view(np.uint64), length, count) for low, high, length, count in zip(*columns, strict=True)]


def frequent(docs: DataFrame, path: str, most: int = FREQUENT) -> Summary:
    """The most frequent pre-tokens of all texts, at most ``most``; each task sends one row, and the driver gets one."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _row(summary(batches, vocabulary(path), most))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _EMPTY
        for batch in batches:
            for part in _rows(batch):
                held = merged([held, part], most)
        yield _row(held)

    out = docs.select("text").mapInArrow(per_task, _SUMMARY)
    for tasks in (MERGES, 1):
        out = out.repartition(tasks).mapInArrow(merge, _SUMMARY)
    found = out.collect()
    return merged([tuple(np.array(c, np.int64).view(kind) for c, kind in zip(row, (np.uint64, np.uint64, np.int64, np.int64), strict=True)) for row in found], most) if found else _EMPTY


class Table:
    """Open addressing over packed pre-tokens: 16 bytes, their number, and how many tokens they make."""

    def __init__(self, held: Summary, vocab: Vocabulary):
        low, high, length, _ = held
        self.slots = 1 << max(4, (4 * len(low) - 1).bit_length())
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.length, self.tokens = np.zeros(self.slots, np.uint8), np.zeros(self.slots, np.uint8)
        for k, slot in enumerate((mixed(low, high, length) & np.uint64(self.slots - 1)).tolist()):
            while self.length[slot]:
                slot = (slot + 1) % self.slots
            self.low[slot], self.high[slot], self.length[slot] = low[k], high[k], length[k]
            self.tokens[slot] = len(vocab.ids(unpacked(low[k], high[k], length[k])))

    def tokens_of(self, low: np.ndarray, high: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, 0 where the table lacks it."""
        out = np.zeros(len(low), np.int64)
        slot = (mixed(low, high, lengths) & np.uint64(self.slots - 1)).astype(np.int64)
        left = np.flatnonzero(lengths <= KEY_BYTES)
        while len(left):
            s = slot[left]
            same = (self.low[s] == low[left]) & (self.high[s] == high[left]) & (self.length[s] == lengths[left])
            out[left[same]] = self.tokens[s[same]]
            left = left[~same & (self.length[s] != 0)]
            slot[left] = (slot[left] + 1) % self.slots
        return out


_caches: dict[str, dict[bytes, int]] = {}


def _missed(data: bytes, starts: np.ndarray, lengths: np.ndarray, vocab: Vocabulary, cache: dict[bytes, int]) -> list[int]:
    out = []
    for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        word = data[a : a + n]
        tokens = cache.get(word)
        if tokens is None:
            tokens = len(vocab.ids(word))
            if n <= CACHED_BYTES:
                if len(cache) >= CACHED:
                    cache.clear()
                cache[word] = tokens
        out.append(tokens)
    return out


def counted(docs: DataFrame, path: str | None = None, limit: int = 512, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    path = path or default_path()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spread = docs.sparkSession.sparkContext.broadcast(Table(frequent(docs, path, most), vocabulary(path)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, vocab, cache = spread.value, vocabulary(path), _caches.setdefault(path, {})
        for batch in batches:
            tokens = np.zeros(batch.num_rows, np.int64)
            for rows, data, at in stretches(batch.column("text")):
                starts = vocab.starts(data, at)
                lengths = _lengths(starts, len(data))
                found = table.tokens_of(*packed(data, starts, lengths), lengths)
                misses = np.flatnonzero(found == 0)
                if len(misses):
                    found[misses] = _missed(data.tobytes(), starts[misses], lengths[misses], vocab, cache)
                sums = np.concatenate([[0], np.cumsum(found)])[np.searchsorted(starts, at)]
                np.add.at(tokens, rows, np.diff(sums))
            texts = binary(batch.column("text"))
            size = np.array([len(t.as_buffer()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
