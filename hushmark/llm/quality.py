"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line has measured features (shares of capitals, symbols, digits, repeated words, lengths, ...), each put into a
few bins; a line's good/bad potential adds weights of its own bins and of those of the lines before and after it.
Two weights for staying good or bad tie neighbours. Forward-backward gives each line's
probability of being good; their mean, weighted by the lines' lengths, is the document's score.

Training takes every line's label from its document, on at most ``max_docs`` labelled documents (the
smallest hashes of the id); only their binned features reach the driver. Scoring runs over all rows, in numpy.

Lines without a visible character don't count. A text without any (null and empty ones too) scores the share of
good documents in training, and without labels every document scores that share, which is then 1. Labels other
than 0 and 1 are ignored; of an id labelled both ways, bad counts. Repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushmark.llm.common import chunks, fold, per_batch

MAX_DOCS = 4000
THRESHOLD = 0.3
FOLDS = 5
BINS = 10
_LOWER, _UPPER, _DIGIT, _PUNCT, _BANG, _BAR, _SYMBOL, _LEAD, _TAIL, _SPACE = range(10)
_EDGES = (
    (0.02, 0.1, 0.3, 0.6),  # capitals among letters
    (0.001, 0.03, 0.1, 0.2),  # symbols among visible characters
    (0.01, 0.1, 0.5),  # exclamation marks a word
    (0.01, 0.1, 0.3),  # bars a word
    (0.001, 0.05, 0.2, 0.5),  # digits among visible characters
    (0.02, 0.1, 0.3, 0.8),  # punctuation marks a word
    (2, 3, 4, 5, 6, 8, 12),  # characters a word
    (2, 4, 8, 16, 32, 64, 128),  # words
    (0.001, 0.05, 0.2, 0.5),  # words equal to the one before
)
FEATURES = len(_EDGES)


def _classes() -> np.ndarray:
    kinds = np.full(256, _SYMBOL, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    kinds[97:123], kinds[65:91], kinds[48:58] = _LOWER, _UPPER, _DIGIT
    for c in b".,;:?'\"()-":
        kinds[c] = _PUNCT
    kinds[ord("!")], kinds[ord("|")] = _BANG, _BAR
    kinds[128:192], kinds[192:] = _TAIL, _LEAD
    return kinds


_CLASSES = _classes()
_MIX = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(23))
_PLACE = (np.arange(64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)


def line_features(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the visible lines of texts lying one after the other: row, length in characters, feature codes (bin + feature * BINS)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, FEATURES), np.int64)
    kinds = _CLASSES[data]
    opens = np.zeros(n, bool)
    opens[rows[:-1][rows[:-1] < n]] = True
    after = np.flatnonzero(data == 10) + 1
    opens[after[after < n]] = True
    line = np.cumsum(opens, dtype=np.int32) - 1
    lines = int(line[-1]) + 1
    counts = np.bincount(line * np.int64(10) + kinds, minlength=lines * 10).reshape(lines, 10).astype(np.float64)

    seen = kinds != _SPACE
    begins = seen.copy()
    begins[1:] &= ~seen[:-1] | opens[1:]
    visible, start = np.flatnonzero(seen), np.flatnonzero(begins)
    first = np.searchsorted(visible, start)
    place = np.arange(len(visible)) - np.repeat(first, np.diff(np.append(first, len(visible))))
    hashed = np.add.reduceat(_MIX[data[visible]] * _PLACE[place & 63] + place.astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
    of = line[start]
    again = np.zeros(len(start), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
    words, repeats = np.bincount(of, minlength=lines), np.bincount(of[again], minlength=lines)

    letters = counts[:, _LOWER] + counts[:, _UPPER] + counts[:, _LEAD]
    characters = counts.sum(1) - counts[:, _TAIL]
    shown = np.maximum(characters - counts[:, _SPACE], 1)
    many = np.maximum(words, 1)
    values = (counts[:, _UPPER] / np.maximum(letters, 1), counts[:, _SYMBOL] / shown, counts[:, _BANG] / many, counts[:, _BAR] / many, counts[:, _DIGIT] / shown,
              counts[:, _PUNCT] / many, shown / many, words, repeats / many)
    codes = np.stack([np.searchsorted(edges, v, "right") + k * BINS for k, (v, edges) in enumerate(zip(values, _EDGES, strict=True))], axis=1)
    row = np.searchsorted(rows, np.flatnonzero(opens), "right") - 1
    kept = words > 0
    return row[kept], characters[kept].astype(np.int64), codes[kept]


@dataclass
class Model:
    """weights: own, previous and next line's bins (three rows) with a place for 'none' at the end; stay: of bad, of good."""

    weights: np.ndarray
    bias: float
    stay: np.ndarray
    prior: float


class Chains:
    """Lines of many documents, the lines of each in a row."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = starts[order], lengths[order]
        longest = int(self.lengths[0]) if len(order) else 0
        #: How many documents have more than t lines.
        self.active = np.searchsorted(-self.lengths, -np.arange(longest), "left")
        total = int(lengths.sum())
        self.first, self.last = np.zeros(total, bool), np.zeros(total, bool)
        self.first[starts], self.last[starts + lengths - 1] = True, True

    def near(self, values: np.ndarray, none: float, step: int) -> np.ndarray:
        """The value of the line before (step 1) or after (-1)."""
        out = np.roll(values, step)
        out[self.first if step == 1 else self.last] = none
        return out

    def marginals(self, d: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of good from the lines up to each (itself included), from those after it, and the probability of good."""
        ahead, back = d.copy(), np.zeros_like(d)

        def turn(m: np.ndarray) -> np.ndarray:
            return np.logaddexp(stay[1] + m, 0) - np.logaddexp(m, stay[0])

        for t in range(1, len(self.active)):
            at = self.starts[: self.active[t]] + t
            ahead[at] += turn(ahead[at - 1])
        for t in range(len(self.active) - 2, -1, -1):
            at = self.starts[: self.active[t + 1]] + t
            back[at] = turn(d[at + 1] + back[at + 1])
        return ahead, back, 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))


def potentials(model: Model, codes: np.ndarray, chains: Chains) -> np.ndarray:
    own, before, after = (model.weights[k][codes].sum(1) for k in range(3))
    return own + chains.near(before, model.weights[1][-1], 1) + chains.near(after, model.weights[2][-1], -1) + model.bias


def train(docs: list[tuple[np.ndarray, int]], rounds: int = 200, rate: float = 0.3, shrink: float = 1e-5) -> Model:
    """docs: (feature codes of the lines, label). Adam on the conditional likelihood; each document weighs the same."""
    prior = float(np.mean([y for _, y in docs])) if docs else 1.0
    docs = [(c, y) for c, y in docs if len(c)]
    model = Model(np.zeros((3, FEATURES * BINS + 1)), 0.0, np.zeros(2), prior)
    if len({y for _, y in docs}) < 2:
        return model
    lengths = np.array([len(c) for c, _ in docs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    codes, y = np.concatenate([c for c, _ in docs]), np.repeat([float(v) for _, v in docs], lengths)
    weight = np.repeat(1 / lengths, lengths) / len(docs)
    chains = Chains(starts, lengths)
    flat = np.zeros(model.weights.size + 3)
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    width = FEATURES * BINS + 1
    inner = ~chains.last
    for step in range(1, rounds + 1):
        model.weights, model.bias, model.stay = flat[:-3].reshape(3, width), flat[-3], flat[-2:]
        d = potentials(model, codes, chains)
        ahead, back, good = chains.marginals(d, model.stay)
        error = (good - y) * weight
        grad = np.zeros_like(flat)
        for k, shifted in enumerate((error, chains.near(error, 0.0, -1), chains.near(error, 0.0, 1))):
            grad[k * width : k * width + width - 1] = np.bincount(codes.ravel(), np.repeat(shifted, FEATURES), width - 1)
        grad[2 * width - 1], grad[3 * width - 1], grad[-3] = error[chains.first].sum(), error[chains.last].sum(), error.sum()
        if inner.any():
            q = (d + back)[np.flatnonzero(inner) + 1]
            m = ahead[inner]
            both = np.stack([np.full_like(m, model.stay[0]), q, m, m + model.stay[1] + q])  # bad-bad, bad-good, good-bad, good-good
            both = np.exp(both - both.max(0))
            both /= both.sum(0)
            w, label = weight[inner], y[inner]
            grad[-2], grad[-1] = (w * (both[0] - (1 - label))).sum(), (w * (both[3] - label)).sum()
        grad += shrink * flat
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        flat = flat - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(flat[:-3].reshape(3, width), float(flat[-3]), flat[-2:], prior)


def scores(model: Model, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A score for each text."""
    n = len(rows) - 1
    row, length, codes = line_features(data, rows)
    out = np.full(n, model.prior)
    if not len(row):
        return out
    lines = np.bincount(row, minlength=n)
    some = lines > 0
    starts = (np.cumsum(lines) - lines)[some]
    chains = Chains(starts, lines[some])
    _, _, good = chains.marginals(potentials(model, codes, chains), model.stay)
    out[some] = np.bincount(row, good * length, n)[some] / np.bincount(row, length, n)[some]
    return out


def sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> list[tuple[np.ndarray, int]]:
    """Binned line features and labels of at most ``max_docs`` labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("__hushmark_label"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # at most max_docs rows of two numbers

    def make():
        def work(texts: pa.Array) -> pa.Array:
            out = []
            for _, data, rows in chunks(texts):
                row, _, codes = line_features(data, rows)
                parts = np.split(codes, np.searchsorted(row, np.arange(1, len(rows) - 1)))
                out += [(p - np.arange(FEATURES) * BINS).astype(np.uint8).tobytes() for p in parts]
            return pa.array(out, pa.binary())

        return work

    joined = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    chosen = joined.select("doc_id", "__hushmark_label", F.xxhash64("text").alias("h"), per_batch(make, "binary")("text").alias("codes"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(max_docs)
    return [(np.frombuffer(r.codes, np.uint8).reshape(-1, FEATURES).astype(np.int64) + np.arange(FEATURES) * BINS, r["__hushmark_label"]) for r in chosen.collect()]


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    return train(sample(docs, labels, max_docs))


def score(text: Column, model: Model, spark) -> Column:
    sent = spark.sparkContext.broadcast(model)  # a few hundred numbers

    def make():
        def work(texts: pa.Array) -> pa.Array:
            parts = [scores(sent.value, data, rows) for _, data, rows in chunks(texts)]
            return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

        return work

    return per_batch(make, "double")(text)


def classified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = docs.select("doc_id", score(F.col("text"), model, docs.sparkSession).alias("score"))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't rejected; columns as they were."""
    name = "__hushmark_score"
    return docs.withColumn(name, score(F.col("text"), model, docs.sparkSession)).where(F.col(name) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
