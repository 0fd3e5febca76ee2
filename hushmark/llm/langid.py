"""Language ID with error-correcting output codes.

Every language has a codeword; for each of its bits a binary classifier over hashed byte n-grams
tells the languages with a one from those with a zero. Its weights are log-ratios of n-gram frequencies, counted over all
training texts in one pass: each task counts for itself, and Spark adds up blocks of counts. Every
language weighs the same in a bit, however many texts it has. Decoding adds up, over the bits, the logistic loss of the
classifier's margin against the codeword, weighted by how well the bit separates; the nearest codeword wins.
A text is flagged ambiguous if the runner-up is close, or if the bits as such lie further from the codeword than the code can correct.

A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was
learnt. Rows without lang teach nothing. Repeated rows count each. An empty table gives no rows. Only text (and lang for training) is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushmark.llm.common import chunks, fold, per_batch

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
FOLDS = 3
BLOCK = 1024
DOCS_AT_ONCE = 64
UNKNOWN = "und"
#: Typical size of a margin after scaling, and the lead under which a decision is ambiguous.
MARGIN, LEAD = 4.0, 0.2


def _mapped() -> np.ndarray:
    table = np.full(256, 32, np.uint32)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_MAPPED = _mapped()


def grams(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram within a text that isn't all white space."""
    letters = _MAPPED[data]
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at, buckets = [], []
    rolled = np.zeros(len(letters), np.uint32)
    blank = np.ones(len(letters), bool)
    for n in range(1, max(ORDERS) + 1):
        size = len(letters) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint32(0x01000193) ^ letters[n - 1 :]
        blank = blank[:size] & (letters[n - 1 :] == 32)
        if n in ORDERS:
            kept = ~blank & (row[:size] == row[n - 1 :])
            mixed = rolled[kept] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            at.append(row[:size][kept])
            buckets.append(mixed >> np.uint32(17))
    return (np.concatenate(at), np.concatenate(buckets).astype(np.int64)) if at else (np.zeros(0, np.int64),) * 2


def counted(texts: DataFrame) -> dict[str, np.ndarray]:
    """Counts of each bucket for each language of (lang, text). The driver gets one array a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, data, rows in chunks(batch.column("text")):
                here = langs[first : first + len(rows) - 1]
                names = sorted(set(here))
                of = np.array([names.index(x) for x in here])
                row, bucket = grams(data, rows)
                table = np.bincount(of[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    totals[name] = totals.get(name, 0) + table[k]
        for name, whole in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (BUCKETS // BLOCK)), pa.array(range(BUCKETS // BLOCK), pa.int32()), pa.array([p.astype("<i8").tobytes() for p in np.split(whole, BUCKETS // BLOCK)], pa.binary())],
                ["lang", "block", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, block, part in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "counts")), strict=True):
                totals[name, block] = totals.get((name, block), 0) + np.frombuffer(part, "<i8")
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in totals]), pa.array([k[1] for k in totals], pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())],
                ["lang", "block", "counts"],
            )

    kind = "lang string, block int, counts binary"
    summed = texts.mapInArrow(count, kind).repartition("lang", "block").mapInArrow(add, kind)
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():
        out.setdefault(r.lang, np.zeros(BUCKETS, np.int64))[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, "<i8")
    return out


def codewords(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of n languages: all splits of up to five, else the splits of a fixed draw that keep words furthest apart."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        return np.array([[1.0 if k == 0 or not mask >> (k - 1) & 1 else -1.0 for mask in range(1, 1 << (n - 1))] for k in range(n)])
    bits = 8 * int(np.ceil(np.log2(n))) - 1
    draw = np.random.default_rng(n)
    best, apart = None, -1
    for _ in range(200):
        code = np.where(np.argsort(draw.random((bits, n)), axis=1) < n // 2, 1.0, -1.0).T
        distance = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if distance > apart:
            best, apart = code, distance
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bit_weight: np.ndarray

    def reach(self) -> int:
        """Wrong bits that the code can correct."""
        n, bits = self.code.shape
        apart = ((bits - self.code @ self.code.T) / 2 + bits * np.eye(n)).min() if n > 1 else 1
        return int((apart - 1) // 2)


def train(counts: dict[str, np.ndarray], least: float = 0.5) -> Model:
    langs = sorted(k for k, v in counts.items() if v.sum())
    code = codewords(len(langs))
    if not code.shape[1]:
        return Model(langs, code, np.zeros((BUCKETS, 0)), np.zeros(0))
    share = np.array([(counts[k] + least) / (counts[k].sum() + least * BUCKETS) for k in langs])
    ones, zeros = (code > 0).T.astype(float), (code < 0).T.astype(float)
    weights = (np.log(ones @ share / ones.sum(1)[:, None]) - np.log(zeros @ share / zeros.sum(1)[:, None])).T
    expected = share @ weights * code  # how far each language's typical text lies on its side
    scale = MARGIN / np.abs(expected).mean(0)
    return Model(langs, code, weights * scale, np.clip(expected.min(0) / np.abs(expected).mean(0), 0.05, None))


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each row of margins."""
    if not model.code.shape[1]:
        n = len(margins)
        return np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
    loss = np.stack([(np.logaddexp(0, -margins * word) * model.bit_weight).sum(1) for word in model.code], axis=1)
    odds = np.exp(loss.min(1, keepdims=True) - loss)
    odds /= odds.sum(1, keepdims=True)
    best = odds.argmax(1)
    ranked = np.sort(odds, axis=1)
    wrong = (margins * model.code[best] < 0).sum(1)
    return best, odds.max(1), (ranked[:, -1] - ranked[:, -2] < LEAD) | (wrong > model.reach())


def identify(model: Model, texts: pa.Array) -> pa.Array:
    langs, scores, unsure = [], [], []
    for first, data, rows in chunks(texts):
        has = np.zeros(len(rows) - 1, bool)
        ascii_letters = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
        has[:] = ascii_letters[rows[1:]] > ascii_letters[rows[:-1]]
        for k in np.flatnonzero(~has & (np.diff(rows) > 0)):
            has[k] = any(c.isalpha() for c in data[rows[k] : rows[k + 1]].tobytes().decode("utf-8", "replace"))
        for a in range(0, len(rows) - 1, DOCS_AT_ONCE):
            b = min(a + DOCS_AT_ONCE, len(rows) - 1)
            row, bucket = grams(data[rows[a] : rows[b]], rows[a : b + 1] - rows[a])
            table = np.bincount(row * BUCKETS + bucket, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
            margins = table @ model.weights / np.maximum(table.sum(1, keepdims=True), 1)
            best, score, doubt = decode(model, margins)
            for k in range(b - a):
                known = bool(has[a + k]) and bool(model.langs)
                langs.append(model.langs[best[k]] if known else UNKNOWN)
                scores.append(float(score[k]) if known else 0.0)
                unsure.append(bool(doubt[k]) if known else True)
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], ["lang", "score", "ambiguous"])


def fit(docs: DataFrame) -> Model:
    """Learns from all documents with text and lang outside the held-out fold."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 1))
    return train(counted(known.select("lang", "text")))


def language(text: Column, model: Model, spark) -> Column:
    sent = spark.sparkContext.broadcast(model)  # buckets x bits, whatever the size of the corpus
    return per_batch(lambda: lambda texts: identify(sent.value, texts), "struct<lang:string,score:double,ambiguous:boolean>")(text)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    found = docs.select("doc_id", language(F.col("text"), model, docs.sparkSession).alias("found"))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 1).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.ambiguous").alias("ambiguous"))
