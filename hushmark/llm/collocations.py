"""Phrases whose words stand together more often than their parts would by chance, per language.

Every frequent word starts one window: itself and the four words that follow in its piece, as five columns, padded with nulls. Only these
longest windows are counted from the texts. A phrase occurs as often as windows start with it, so Spark's ROLLUP over the columns
gives the counts of all shorter phrases from those of the windows, and no shorter n-gram is ever cut out of a text.

A phrase is no more frequent than any part of it, so a window ends where a word, a pair or a triple of neighbours occurs too seldom to be in any phrase.
That is found out before, order by order, from hashes alone: tasks send the hashes they have seen with their numbers, packed in numpy arrays by
stretches of the hash, and the frequent ones come back as a bitmap whose size ``MOST_BITS`` bounds. What a bitmap takes for frequent by mistake lengthens
windows and changes no result. All numbers that are returned come from windows.

Null texts are empty, and a null lang counts as ``und``. Repeated rows, and rows of one id, count each for itself. An empty
table gives no rows. Only text and lang are read, so other columns can't clash. Ties of the score go to the shortest first part, ties of the rank to
the larger count and then the phrase by its UTF-8 bytes. Long texts are read in parts that end at a piece's end; a single piece is held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushmark.llm.common import cut
from hushmark.llm.pretokens import mixed, packed, stretches

LONGEST, LEAST, TOP = 5, 100, 2000
#: Words of the windows whose hashes are counted before.
ORDERS = (1, 2, 3)
#: Bits of a bitmap: sixteen for each frequent hash up to this many (32 MB).
MOST_BITS = 1 << 28
_BITMAP = 32_768  # the size of Spark's bitmaps
#: Bytes of text whose windows are counted together before they leave a task, hashes that a task holds, and bytes of all texts to a stretch of the hash.
CHUNK, HELD, STRETCH_BYTES = 4_000_000, 2_000_000, 1 << 25
#: Shares of a language's candidates that are ranked apart before they are ranked together.
SHARES = (4096, 64, 1)
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t")], _KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _spans(kinds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; none goes on into the next text."""
    inside = kinds == 0
    fresh = np.zeros(len(kinds) + 1, bool)
    fresh[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | fresh[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _words(data: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The lower-cased words in order, as a dictionary array; the text of each, and its piece."""
    kinds = _KINDS[data]
    starts, ends = _spans(kinds, at)
    text = np.searchsorted(at, starts, "right") - 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[kinds == 0]])])
    return words.dictionary_encode(), text, np.cumsum(kinds == 2)[starts] + text


def _chunks(batch: pa.RecordBatch):
    """Per chunk: distinct words, and of each occurrence the word, the language and the piece; and the batch's languages."""
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.to_numpy(zero_copy_only=False)
    for rows, data, at in stretches(batch.column("text"), CHUNK, _BREAK):
        words, text, piece = _words(data, at)
        if len(words):
            yield words.dictionary, words.indices.to_numpy().astype(np.int64), codes[rows[text]].astype(np.int64), piece, langs.dictionary


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_totals(docs: DataFrame) -> DataFrame:
    """lang, n: all word occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for rows, data, at in stretches(batch.column("text"), CHUNK, _BREAK):
                starts, _ = _spans(_KINDS[data], at)
                np.add.at(n, rows, np.diff(np.searchsorted(starts, at)))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n)], names=["lang", "n"])

    return _texts(docs).mapInArrow(work, "lang string, n long").where("n > 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _hashes(names: pa.Array, distinct: pa.Array, words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """A hash of the language and word of each occurrence; words that differ only beyond 16 bytes share theirs."""

    def of(texts: pa.Array) -> np.ndarray:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        return mixed(*packed(data, offsets[:-1], np.diff(offsets)), np.diff(offsets))

    hashes = (of(distinct)[words] ^ of(names)[langs] >> np.uint64(1)) * _ODD
    return hashes ^ hashes >> np.uint64(32)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _longer(held: np.ndarray, hashes: np.ndarray, words: np.ndarray, piece: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """From places where windows of ``order`` words may be frequent, and their hashes: places where those of one more may be, and their hashes."""
    more, longer = np.zeros(len(held), bool), np.zeros(len(held), np.uint64)
    n = len(held) - order
    if n > 0:
        more[:n] = held[:n] & held[1 : n + 1] & (piece[order:] == piece[:n])
        longer[:n] = hashes[:n] * _ODD ^ (words[order:] >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
        longer ^= longer >> np.uint64(29)
    return more, longer


def _frequent(words: np.ndarray, piece: np.ndarray, bits: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Places of frequent windows of each order that has a bitmap; then where the next order's may be, and their hashes."""
    found, may, hashes = [], np.ones(len(words), bool), words
    for order, known in enumerate(bits, 1):
        found.append(may & _has(known, hashes))
        may, hashes = _longer(found[-1], hashes, words, piece, order)
    return found, may, hashes


def _summed(hashes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and how often each occurs."""
    if n is None:
        hashes = np.sort(hashes)
    else:
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order]
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[first], np.diff(np.append(first, len(hashes))) if n is None else np.add.reduceat(n, first)


def frequent_hashes(docs: DataFrame, bits: list[np.ndarray], least: int, stretch_bits: int) -> DataFrame:
    """h: hashes of windows one word longer than those the bitmaps know, that occur often enough (or that share 32 bits within a stretch with others).

    A task packs what it has seen into one row for each stretch of the hash, four bytes and a count up to 255 for each; a stretch is added up in one task.
    """
    spread = docs.sparkSession.sparkContext.broadcast(bits)
    top, low = np.uint64(64 - stretch_bits), np.uint64(32 - stretch_bits)

    def sealed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, n = _summed(np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts]))
        stretch = (hashes >> top).astype(np.int64) if stretch_bits else np.zeros(len(hashes), np.int64)
        first = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
        ends = np.append(first[1:], len(hashes))
        keys, counts = ((hashes >> low) & np.uint64(0xFFFFFFFF)).astype("<u4"), np.minimum(n, 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array(stretch[first]), pa.array([keys[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())],
            names=["stretch", "keys", "counts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for distinct, words, langs, piece, names in _chunks(batch):
                _, may, hashes = _frequent(_hashes(names, distinct, words, langs), piece, spread.value)
                found = hashes[may]
                if len(found):
                    parts.append(_summed(found))
                    size += len(parts[-1][0])
                if size > HELD:
                    yield sealed(parts)
                    parts, size = [], 0
        if parts:
            yield sealed(parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, k, c) for b in batches for s, k, c in zip(b["stretch"].to_pylist(), b["keys"], b["counts"], strict=True))
        for stretch, group in groupby(rows, lambda r: r[0]):
            sums, size, limit = [], 0, HELD
            for _, keys, counts in group:
                sums.append((np.frombuffer(keys.as_buffer(), "<u4").astype(np.uint64), np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int64)))
                size += len(sums[-1][0])
                if size > limit:
                    sums = [_summed(np.concatenate([h for h, _ in sums]), np.concatenate([c for _, c in sums]))]
                    size = len(sums[0][0])
                    limit = max(HELD, 2 * size)
            keys, n = _summed(np.concatenate([h for h, _ in sums]), np.concatenate([c for _, c in sums]))
            often = keys[n >= min(least, 255)]
            whole = often << low | np.uint64(stretch) << top if stretch_bits else often << low
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64))], names=["h"])

    sent = _texts(docs).mapInArrow(work, "stretch long, keys binary, counts binary")
    return sent.repartition(1 << min(stretch_bits, 15), "stretch").sortWithinPartitions("stretch").mapInArrow(add, "h long")


def bitmap(often: DataFrame) -> np.ndarray:
    """A bit for each hash, by its highest bits; as bytes, ``MOST_BITS`` at most."""
    often = cut(often)
    bits = min(max(_BITMAP, 1 << (16 * often.count()).bit_length()), MOST_BITS)
    place = f"shiftrightunsigned(h, {64 - bits.bit_length() + 1})"
    rows = often.groupBy(F.expr(f"{place} DIV {_BITMAP}").alias("k")).agg(F.expr(f"bitmap_construct_agg({place} % {_BITMAP})").alias("b")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in rows:
        out[row["k"] * (_BITMAP // 8) : (row["k"] + 1) * (_BITMAP // 8)] = np.frombuffer(row["b"], np.uint8)
    return out


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * _ODD
        h ^= h >> np.uint64(31)
    return h


def _counted(parts: list[np.ndarray], names: pa.Array, distinct: pa.Array, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a chunk (language, words; -1: null) together, with their number. Rows whose hashes are equal by chance just come apart."""
    order = np.argsort(_mixed(parts))
    parts = [p[order] for p in parts]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in parts])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    for a in range(0, len(first), 50_000):
        some = first[a : a + 50_000]
        cells = [distinct.take(pa.array(p[some], mask=p[some] < 0)).cast(pa.binary()).cast(pa.string()) for p in parts[1:]]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(parts[0][some])), *cells, pa.array(n[a : a + 50_000])], names=["lang", *columns, "n"])


def windows(docs: DataFrame, bits: list[np.ndarray], longest: int = LONGEST) -> DataFrame:
    """lang, w1 .. w5, n: the counted windows of all frequent words, padded with nulls; ``bits`` are the bitmaps of words, pairs and so on."""
    spread = docs.sparkSession.sparkContext.broadcast(bits)
    columns = [f"w{j}" for j in range(1, longest + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for distinct, words, langs, piece, names in _chunks(batch):
                found, _, _ = _frequent(_hashes(names, distinct, words, langs), piece, spread.value)
                at = np.flatnonzero(found[0])
                parts, whole = [langs[at], words[at]], np.ones(len(at), bool)
                for j in range(1, longest):  # the j-th following word: the last window of known order that ends with it is frequent
                    order = min(j + 1, len(found))
                    start = np.minimum(at + j + 1 - order, len(words) - 1)
                    end = np.minimum(at + j, len(words) - 1)
                    whole = whole & (at + j < len(words)) & found[order - 1][start] & (piece[end] == piece[at])
                    parts.append(np.where(whole, words[end], -1))
                yield from _counted(parts, names, distinct, columns)

    schema = ", ".join(["lang string", *[f"{c} string" for c in columns], "n long"])
    return _texts(docs).mapInArrow(work, schema).groupBy("lang", *columns).agg(F.sum("n").alias("n"))


def frequent_bits(docs: DataFrame, least: int, orders: tuple[int, ...] = ORDERS) -> list[np.ndarray]:
    """Bitmaps of the words, pairs and triples that may be frequent, each found with those before."""
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))))).first()[0] or 0
    stretch_bits = min(32, max(4, (size // STRETCH_BYTES).bit_length()))
    bits: list[np.ndarray] = []
    for _ in orders:
        bits.append(bitmap(frequent_hashes(docs, bits, least, stretch_bits)))
    return bits


def phrase_counts(counted: DataFrame, least: int, longest: int = LONGEST) -> DataFrame:
    """lang, k, phrase, f of all phrases of 1 to 5 words that occur often enough, summed up from the windows by ROLLUP."""
    columns = [f"w{j}" for j in range(1, longest + 1)]
    size = " + ".join(["1", *[f"1 - grouping({c})" for c in columns[1:]]])
    rolled = counted.sparkSession.sql(
        f"SELECT lang, {', '.join(columns)}, CAST({size} AS INT) AS k, sum(n) AS f FROM {{counted}} GROUP BY lang, w1, ROLLUP({', '.join(columns[1:])}) HAVING sum(n) >= {least}",
        counted=counted)
    words = f"filter(array({', '.join(columns)}), w -> w IS NOT NULL)"
    return rolled.where(f"size({words}) = k").selectExpr("lang", "k", f"array_join({words}, ' ') AS phrase", "f")


def _parts(first: str, size: str) -> str:
    return f"array_join(slice(split(phrase, ' '), {first}, {size}), ' ')"


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of every candidate at its lowest-scoring cut."""
    cuts = phrases.where("k >= 2").selectExpr("lang", "phrase", "k", "f AS a", "explode(sequence(1, k - 1)) AS j").selectExpr(
        "*", f"{_parts('1', 'j')} AS head", f"{_parts('j + 1', 'k - j')} AS tail")
    heads = phrases.selectExpr("lang", "phrase AS head", "f AS l")
    tails = phrases.selectExpr("lang", "phrase AS tail", "f AS r")
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    whole = "CAST({} AS DECIMAL(19, 0))"
    score = f"(CAST(1000 AS DECIMAL(4, 0)) * {whole.format('a')} * {whole.format('n')}) DIV ({whole.format('l')} * {whole.format('r')})"
    best = both.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct(F.expr(score).alias("score"), "j", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "n", "b.score")


def covered(phrases: DataFrame, share: int = 100) -> DataFrame:
    """lang, phrase, longer: the most frequent longer candidate around a phrase, of those that have any."""
    inside = "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    return phrases.where("k >= 3").selectExpr("lang", "f", f"explode({inside}) AS phrase").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def first_of_each(frame: DataFrame, top: int, shares: tuple[int, ...] = SHARES) -> DataFrame:
    """The first rows of each language: first those of small shares, then of larger ones, so no task ranks a whole language."""
    for share in shares:
        order = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(share))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        frame = frame.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return frame


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = 100) -> DataFrame:
    """The first ``top`` phrases of each language; a candidate goes if a longer one around it has ``share`` percent of its count."""
    phrases = cut(phrase_counts(windows(docs, frequent_bits(docs, least)), least))
    kept = scored(phrases, word_totals(docs)).join(covered(phrases), ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {share} * a")
    return first_of_each(kept, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
