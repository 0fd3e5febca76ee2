"""LM scoring by a hashed maximum-entropy model, next to exact unigram scores.

Tokens are a text's words, A-Z in lower case, and one end.

*Counts.* One pass turns stretches of documents into lists of their distinct tokens, dealt by hash to buckets, and into
postings (which token stands in which document how often). A bucket's lists are added up to its training counts, and
then answered: each stretch gets the counts of its tokens back and works out its documents' unigram scores and known tokens. A token
is sent once a stretch, however often it occurs, so frequent tokens make no bucket hot; postings aren't sent to buckets at all. No
vocabulary is broadcast, and all tokens of all training texts count.

*Model.* P(token | two words before) = P(class | ...) * P(word | class, ...), each a softmax over sums of rows of a
hashed table: one row for the word before, one for the word before that (skip), one for both together; for the second
factor the class is hashed with them. The softmax covers the most frequent ``CLASSES * SLOTS - 2`` tokens, the end, and one escape, whose
words go by their training counts, or are spelled byte by byte, each after the hash of the three before it. Context words are hashed whether or not the softmax has them. Each round broadcasts the tables,
whose size is fixed; every task takes gradient steps over its share of the round's training texts, and Spark averages
the tasks' changes row by row, weighted by how often a task changed a row.

A null or empty text is its end alone. Repeated rows count, and are scored, each for itself. With nothing to learn
from, counts are zero and the model is even. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark.llm.common import CHUNK_BYTES, chunks, cut, fold

FOLDS, HELD = 5, 1
CLASSES, SLOTS = 32, 32
VOCABULARY = CLASSES * SLOTS
ROWS = 1 << 12
BLOCK = 64
ROUNDS = 2
#: Hashed contexts of three letters, and how many letters of its own a context needs to be trusted half.
SPELLING_ROWS, SPELLING_PRIOR = 1 << 13, 4.0
MINIBATCH = 32768
RATE = 0.1
ESCAPE, END = 0, 1
#: No word holds a space.
END_TOKEN = b" "
#: Text for each bucket of tokens: what one task holds to count and answer a bucket is a share of that.
BUCKET_BYTES = 32_000_000
_DOCS_A_CHUNK = 60_000


class Stretch:
    """Tokens of some texts as numbers of the stretch's distinct words (0 is the end)."""

    def __init__(self, data: np.ndarray, rows: np.ndarray):
        index: dict[bytes, int] = {END_TOKEN: 0}
        parts, lengths = [], []
        whole = data.tobytes().lower()
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            words = whole[a:b].split()
            parts += [index.setdefault(w, len(index)) for w in words]
            parts.append(0)
            lengths.append(len(words) + 1)
        self.words = list(index)
        self.ids = np.array(parts, np.int32)
        self.lengths = np.array(lengths, np.int64)
        self.docs = np.repeat(np.arange(len(lengths)), self.lengths)


def _stretches(column: pa.Array) -> Iterator[tuple[int, Stretch]]:
    for first, data, rows in chunks(column, CHUNK_BYTES):
        for a in range(0, len(rows) - 1, _DOCS_A_CHUNK):
            at = rows[a : a + _DOCS_A_CHUNK + 1]
            yield first + a, Stretch(data[at[0] : at[-1]], at - at[0])


def _packed(values: np.ndarray | bytes) -> bytes:
    """Compressed, with the length at the end."""
    plain = values if isinstance(values, bytes) else values.tobytes()
    return pa.compress(plain, codec="zstd", asbytes=True) + len(plain).to_bytes(8, "little")


def _unpacked(data: bytes, kind: str | None = None):
    whole = pa.decompress(data[:-8], decompressed_size=int.from_bytes(data[-8:], "little"), codec="zstd", asbytes=True)
    return whole if kind is None else np.frombuffer(whole, kind)


def _tokens(data: bytes) -> list[bytes]:
    """Tokens of a list; none of them is empty or holds a line feed."""
    whole = _unpacked(data)
    return whole.split(b"\n") if whole else []


_POSTED = "chunk long, bucket int, tokens binary, trained binary, words binary, posts binary, doc_ids array<bigint>, hashes array<bigint>"


def postings(docs: DataFrame, buckets: int) -> DataFrame:
    """Of each stretch (chunk): its distinct tokens with their training counts, a row for each bucket of tokens by hash; and one
    row without bucket that says which tokens stand in which document how often, and what the documents are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for first, s in _stretches(batch.column("text")):
                n, m = len(s.lengths), len(s.words)
                bucket = np.array([zlib.crc32(w) % buckets for w in s.words])
                order = np.argsort(bucket, kind="stable")
                place = np.empty(m, np.int64)
                place[order] = np.arange(m)  # tokens are numbered bucket after bucket
                pairs, times = np.unique(place[s.ids] * n + s.docs, return_counts=True)
                word, doc = pairs // n, pairs % n
                here = ~held[first : first + n].astype(bool)
                trained = np.bincount(word, times * here[doc], m).astype("<i8")
                found, at = np.unique(bucket[order], return_index=True)
                ends = [*at[1:].tolist(), m]
                rows = [(chunk, int(b), _packed(b"\n".join([s.words[k] for k in order[a:z]])), _packed(trained[a:z]), None, None, None, None) for b, a, z in zip(found, at.tolist(), ends, strict=True)]
                ids, hashes = (batch.column(c).slice(first, n).to_pylist() for c in ("doc_id", "text_hash"))
                documents = np.bincount(word, minlength=m).astype("<u4")
                rows.append((chunk, None, _packed(s.lengths.astype("<i8")), None, _packed(documents), _packed(doc.astype("<u2").tobytes() + times.astype("<u4").tobytes()), ids, hashes))
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                chunk += 1

    names = [c.split()[0] for c in _POSTED.split(", ")]
    return docs.mapInArrow(work, _POSTED)


def counts(posted: DataFrame) -> DataFrame:
    """Of each bucket: its tokens in training (bucket, tokens, counts), counted over all training texts."""

    def add(group: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for tokens, trained in zip(group.column("tokens").to_pylist(), group.column("trained").to_pylist(), strict=True):
            for t, n in zip(_tokens(tokens), _unpacked(trained, "<i8").tolist(), strict=True):
                if n:
                    total[t] = total.get(t, 0) + n
        values = np.array(list(total.values()), "<i8")
        return pa.table({"bucket": group.column("bucket")[:1], "tokens": pa.array([_packed(b"\n".join(total))], pa.binary()), "counts": pa.array([_packed(values)], pa.binary())})

    asked = posted.where("bucket IS NOT NULL").select("bucket", "tokens", "trained")
    return asked.groupBy("bucket").applyInArrow(add, "bucket int, tokens binary, counts binary")


def unigram_scores(posted: DataFrame, counted: DataFrame, model: Model, total: int, distinct: int) -> DataFrame:
    """doc_id, text_hash, n_tokens, n_known, base_score, escaped (what the model's escaped words cost): a row for each document row."""
    below = float(np.log10(total + 0.5 * (distinct + 1)))
    sent = counted.sparkSession.sparkContext.broadcast(model)

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        count = np.zeros(1, np.int64)
        for tokens, values in zip(known.column("tokens").to_pylist(), known.column("counts").to_pylist(), strict=True):
            index = {t: k + 1 for k, t in enumerate(_tokens(tokens))}
            count = np.concatenate([[0], _unpacked(values, "<i8")])
        cost = np.zeros(len(count))
        cost[1:] = sent.value.escape_costs(list(index), count[1:])
        chunks_, counts_, costs = [], [], []
        for chunk, tokens in zip(asked.column("chunk").to_pylist(), asked.column("tokens").to_pylist(), strict=True):
            words = _tokens(tokens)
            at = np.array([index.get(w, 0) for w in words], np.int64)
            own = cost[at]
            fresh = np.flatnonzero(at == 0)
            if len(fresh):
                own[fresh] = sent.value.escape_costs([words[k] for k in fresh], np.zeros(len(fresh), np.int64))
            chunks_.append(chunk)
            counts_.append(_packed(count[at].astype("<i8")))
            costs.append(_packed(own.astype("<f4")))
        return pa.table({"chunk": pa.array(chunks_, pa.int64()), "bucket": pa.array(asked.column("bucket").to_pylist(), pa.int32()), "counts": pa.array(counts_, pa.binary()), "costs": pa.array(costs, pa.binary())})

    asked = posted.where("bucket IS NOT NULL").select("chunk", "bucket", "tokens")
    answers = asked.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(answer, "chunk long, bucket int, counts binary, costs binary")

    def add(stretch: pa.Table, answered: pa.Table) -> pa.Table:
        order = np.argsort(answered.column("bucket").to_numpy(), kind="stable").tolist()
        count = np.concatenate([np.zeros(0, np.int64), *[_unpacked(answered.column("counts")[k].as_py(), "<i8") for k in order]])
        cost = np.concatenate([np.zeros(0), *[_unpacked(answered.column("costs")[k].as_py(), "<f4") for k in order]])
        parts = []
        for row in stretch.to_pylist():
            lengths, documents, posts = _unpacked(row["tokens"], "<i8"), _unpacked(row["words"], "<u4"), _unpacked(row["posts"])
            n = len(posts) // 6
            doc, times = np.frombuffer(posts, "<u2", n), np.frombuffer(posts, "<u4", n, 2 * n).astype(np.int64)
            word = np.repeat(np.arange(len(documents)), documents)
            size = len(lengths)
            parts.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "text_hash": pa.array(row["hashes"], pa.int64()), "n_tokens": pa.array(lengths),
                "n_known": pa.array(np.bincount(doc, times * (count[word] > 0), size).astype(np.int64)),
                "base_score": pa.array(np.bincount(doc, times * (np.log10(count[word] + 0.5) - below), size)),
                "escaped": pa.array(np.bincount(doc, times * cost[word], size)),
            }))
        return pa.concat_tables(parts)

    stretches = posted.where("bucket IS NULL").select("chunk", "tokens", "words", "posts", "doc_ids", "hashes")
    return stretches.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add, "doc_id long, text_hash long, n_tokens long, n_known long, base_score double, escaped double")


@dataclass
class Model:
    words: dict[bytes, int]  # token -> number in the softmax
    spelling: np.ndarray  # log10 of each byte, and of the stop, after each hashed context
    class_bias: np.ndarray
    word_bias: np.ndarray
    tables: np.ndarray  # 2 x ROWS x CLASSES (= SLOTS)
    escapes: int = 0  # tokens in training that the softmax doesn't have
    fresh: float = 1.0  # share of them that is spelled; the rest goes by counts

    def escape_costs(self, tokens: list[bytes], counts: np.ndarray) -> np.ndarray:
        """log10 probability of each word given the escape; 0 for those of the softmax."""
        if not tokens:
            return np.zeros(0)
        inside = np.array([t in self.words for t in tokens], bool)
        first, letters, context = _letters(tokens)
        spelled = np.add.reduceat(self.spelling[context, letters].astype(np.float64), first)
        counted = (1 - self.fresh) * counts / max(self.escapes, 1)
        # The larger of the two is taken out, so that long words don't vanish.
        with np.errstate(divide="ignore"):
            a, b = np.log10(counted), spelled + np.log10(self.fresh)
        top = np.maximum(a, b)
        return np.where(inside, 0.0, top + np.log10(10 ** (a - top) + 10 ** (b - top)))


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words one after the other: first places, letters with a stop (256) after each word, hashes of the three letters before."""
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    first = np.cumsum(lengths) - lengths
    letters = np.full(int(lengths.sum()), 256, np.uint64)
    inner = np.ones(len(letters), bool)
    inner[first + lengths - 1] = False
    letters[inner] = np.frombuffer(b"".join(words), np.uint8)
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    context = np.zeros(len(letters), np.uint64)
    for back in range(1, 4):
        earlier = np.roll(letters, back) + np.uint64(1)
        earlier[place < back] = 0
        context = context * np.uint64(521) + earlier
    return first, letters.astype(np.int64), (_mix(4, context) & np.uint64(SPELLING_ROWS - 1)).astype(np.int64)


def _spelling(counted: np.ndarray) -> np.ndarray:
    """Log10 of letters by context, leaning on their share overall where a context is rare."""
    overall = counted.sum(0) + 1.0
    overall /= overall.sum()
    return np.log10((counted + SPELLING_PRIOR * overall) / (counted.sum(1, keepdims=True) + SPELLING_PRIOR)).astype(np.float32)


def _vocabulary(counted: DataFrame) -> tuple[list[tuple[bytes, int]], int, int, int, int]:
    """The most frequent tokens, ties by their bytes; all tokens, distinct ones, those seen once, and ends."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, values in zip(batch.column("tokens").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                words, n = _tokens(tokens), _unpacked(values, "<i8")
                ends = int(n[words.index(END_TOKEN)]) if END_TOKEN in words else 0
                few = sorted(((-c, w) for w, c in zip(words, n.tolist(), strict=True) if w != END_TOKEN))[: VOCABULARY - 2]
                rows = [(w, -c, 0, 0, 0, 0) for c, w in few] + [(None, 0, int(n.sum()), len(words), int((n == 1).sum()), ends)]
                kinds = [pa.binary(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["token", "n", "total", "words", "once", "ends"])

    seen = cut(counted.mapInArrow(look, "token binary, n long, total long, words long, once long, ends long"))
    top = seen.where("token IS NOT NULL").orderBy(F.desc("n"), "token").limit(VOCABULARY - 2).collect()
    sums = seen.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "words", "once", "ends")]).first()
    return [(bytes(r.token), r.n) for r in top], *sums


def start(counted: DataFrame) -> tuple[Model, int, int]:
    """The softmax's tokens, its biases by their counts, and the spelling of the others; all tokens and distinct ones in training."""
    top, total, distinct, once, ends = _vocabulary(counted)
    words = {w: k + 2 for k, (w, _) in enumerate(top)} | {END_TOKEN: END}
    inside = counted.sparkSession.sparkContext.broadcast(set(words))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, values in zip(batch.column("tokens").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                rows = [(t, n) for t, n in zip(_tokens(tokens), _unpacked(values, "<i8").tolist(), strict=True) if t not in inside.value]
                if rows:
                    first, letters, context = _letters([t for t, _ in rows])
                    times = np.repeat([n for _, n in rows], np.diff(np.append(first, len(letters))))
                    keys, of = np.unique(context * 257 + letters, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(of, times).astype(np.int64))], ["key", "n"])

    found = counted.mapInArrow(spell, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most rows x letters
    spelled = np.zeros(SPELLING_ROWS * 257)
    spelled[found.column("key").to_numpy()] = found.column("n").to_numpy()
    spelled = spelled.reshape(SPELLING_ROWS, 257)
    escapes = int(spelled[:, 256].sum())
    once -= sum(n == 1 for _, n in top)
    fresh = min(max((once + 1) / (escapes + 2), 1e-3), 1.0)  # words seen once say how likely unseen ones are
    mass = np.full(VOCABULARY, 0.5)
    mass[ESCAPE] += escapes
    mass[END] += ends
    mass[2 : 2 + len(top)] += [n for _, n in top]
    grid = mass.reshape(CLASSES, SLOTS)
    per_class = grid.sum(1)
    model = Model(words, _spelling(spelled), np.log(per_class / per_class.sum()), np.log(grid / per_class[:, None]), np.zeros((2, ROWS, CLASSES), np.float32), escapes, fresh)
    return model, total, distinct


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    h = np.array([0x9E3779B97F4A7C15], np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p, np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return h


class Features:
    """Of each token: number in the softmax, and hashes of its contexts."""

    def __init__(self, model: Model, s: Stretch):
        hashed = np.array([zlib.crc32(w) for w in s.words], np.uint64)
        number = np.array([model.words.get(w, ESCAPE) for w in s.words], np.int64)
        self.number = number[s.ids]
        before = np.concatenate([[0, 0], hashed[s.ids]])[:-1].astype(np.uint64)
        one, two = before[1:].copy(), before[:-1].copy()
        begins = np.cumsum(s.lengths) - s.lengths
        one[begins] = 0
        two[begins] = 0
        second = begins[s.lengths > 1] + 1
        two[second] = 0
        self.contexts = [_mix(1, one), _mix(2, two), _mix(3, one, two)]

    def rows(self, a: int, b: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        mask = np.uint64(ROWS - 1)
        group = (self.number[a:b] // SLOTS).astype(np.uint64)
        return [(c[a:b] & mask).astype(np.int64) for c in self.contexts], [(_mix(c[a:b], group) & mask).astype(np.int64) for c in self.contexts]


def _softmax(bias: np.ndarray, table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    logits = bias + table[rows[0]]
    for r in rows[1:]:
        logits += table[r]
    np.clip(logits, -60, 60, out=logits)  # float32 holds the powers
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], logits.dtype))[:, None]
    return logits


def token_scores(model: Model, s: Stretch) -> np.ndarray:
    """log10 probability of each token, of the escape for words that the softmax doesn't have."""
    f = Features(model, s)
    out = np.empty(len(s.ids))
    class_bias, word_bias = model.class_bias.astype(np.float32), model.word_bias.astype(np.float32)
    for a in range(0, len(out), MINIBATCH):
        b = min(a + MINIBATCH, len(out))
        by_class, by_word = f.rows(a, b)
        group, slot = f.number[a:b] // SLOTS, f.number[a:b] % SLOTS
        at = np.arange(b - a)
        found = np.log10(_softmax(class_bias, model.tables[0], by_class)[at, group]) + np.log10(_softmax(word_bias[group], model.tables[1], by_word)[at, slot])
        out[a:b] = found
    return out


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their values (a column each), and how many there were."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # 16 bits hold a row and sort by radix
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(np.take(values, order, axis=1), first, axis=1).T, np.diff(first, append=len(rows))


class Learner:
    """Gradient steps on a copy of the tables, with a rate that falls per row (AdaGrad)."""

    def __init__(self, model: Model):
        self.model = replace(model, tables=model.tables.copy())
        self.squares = np.full((2, ROWS), 1e-6, np.float32)
        self.steps = np.zeros((2, ROWS), np.int64)

    def learn(self, s: Stretch) -> None:
        f = Features(self.model, s)
        bias = (self.model.class_bias.astype(np.float32), self.model.word_bias.astype(np.float32))
        for a in range(0, len(s.ids), MINIBATCH):
            b = min(a + MINIBATCH, len(s.ids))
            group, slot = f.number[a:b] // SLOTS, f.number[a:b] % SLOTS
            at = np.arange(b - a)
            for k, (rows, target, base) in enumerate(zip(f.rows(a, b), (group, slot), (bias[0], bias[1][group]), strict=True)):
                table = self.model.tables[k]
                grad = _softmax(base, table, rows)
                grad[at, target] -= 1
                columns = np.ascontiguousarray(grad.T)
                for r in rows:
                    row, total, many = _sums(r, columns)
                    self.squares[k, row] += (total * total).mean(1)
                    self.steps[k, row] += many
                    table[row] -= RATE * total / np.sqrt(self.squares[k, row])[:, None]


_CHANGE = "block int, changes binary, steps binary"


def trained(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Rounds over disjoint shares of the training texts (``text`` and ``share``, a number below ``rounds``)."""
    spark = docs.sparkSession
    blocks = 2 * ROWS // BLOCK
    for share in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            learner = None
            for batch in batches:
                for _, s in _stretches(batch.column("text")):
                    learner = learner or Learner(sent.value)
                    learner.learn(s)
            if learner:
                steps = learner.steps.reshape(blocks, BLOCK)
                change = (learner.model.tables - sent.value.tables).reshape(blocks, BLOCK, CLASSES) * steps[:, :, None]
                some = np.flatnonzero(steps.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([change[k].astype("<f4").tobytes() for k in some], pa.binary()), pa.array([steps[k].astype("<i8").tobytes() for k in some], pa.binary())], names)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for k, change, steps in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    total = totals.setdefault(k, [np.zeros((BLOCK, CLASSES)), np.zeros(BLOCK, np.int64)])
                    total[0] += np.frombuffer(change, "<f4").reshape(BLOCK, CLASSES)
                    total[1] += np.frombuffer(steps, "<i8")
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t[0].astype("<f4").tobytes() for t in totals.values()], pa.binary()), pa.array([t[1].tobytes() for t in totals.values()], pa.binary())], names)

        names = ["block", "changes", "steps"]
        summed = docs.where(F.col("share") == share).select("text").mapInArrow(learn, _CHANGE).repartition("block").mapInArrow(add, _CHANGE)
        tables = model.tables.reshape(blocks, BLOCK, CLASSES).copy()
        for r in summed.collect():  # one row a block of the tables
            steps = np.frombuffer(r.steps, "<i8")
            tables[r.block] += np.frombuffer(r.changes, "<f4").reshape(BLOCK, CLASSES) / np.maximum(steps, 1)[:, None]
        model = replace(model, tables=tables.reshape(2, ROWS, CLASSES))
    return model


def model_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash, held_out, score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.bincount(s.docs, token_scores(sent.value, s), len(s.lengths)) for _, s in _stretches(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "text_hash", "held_out")], pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "text_hash", "held_out", "score"])

    return docs.mapInArrow(work, "doc_id long, text_hash long, held_out boolean, score double")


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each document row."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    posted = cut(postings(given, int(size // BUCKET_BYTES) + 1))
    counted = cut(counts(posted))
    begun, total, distinct = start(counted)
    lessons = docs.where(fold(F.col("doc_id"), FOLDS) != HELD).select("text", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(rounds)).alias("share"))
    model = trained(lessons, begun, rounds)
    base = unigram_scores(posted, counted, model, total, distinct).dropDuplicates(["doc_id", "text_hash"])
    found = model_scores(given, model).withColumnsRenamed({"doc_id": "id", "text_hash": "h"})
    joined = found.join(base, found["id"].eqNullSafe(base["doc_id"]) & (found["h"] == base["text_hash"]))
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.col("escaped")).alias("score"))
