"""Vector codes, token counts and collocations against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hushmark.llm import collocations, pretokens, tokencount, vectorcode

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- vector codes --------------------------------------------------------------------------


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, floats, label) -> rows of the result, by plain sums over all entries."""
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    length = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    width = length // parts
    whole = [([math.floor(1024 * c) for c in r[1]] + [0] * length)[:length] for r in kept]
    split = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))[:entries]
    books = [[split[k][p] for k in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            at = defaultdict(list)
            for s in split:
                at[near(p, s[p])[1]].append(s[p])
            books[p] = [[sum(c) // len(at[k]) for c in zip(*at[k])] if at[k] else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[near(p, s[p]) for p in range(parts)] for s in split]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(kept, errors):
        by_label[r[2]] += e
    return sorted(((r[0] is None, r[0] or 0), "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], sha) for r, f, e in zip(kept, found, errors))


def coded(frame, **given):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectorcode.encoded(frame, **given).collect())


def test_codes_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert coded(table, entries=16) == brute_codes(rows, entries=16)


def test_codes_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [0.5, -0.25, 1.0, 2.0, 0.1, 0.2], 1), (1, None, 1), (2, [0.0, None, 1.0, 1.0, 0.0, 0.0], 2), (3, [nan, 0.0, 0.0, 0.0, 0.0, 0.0], 2),
        (4, [inf, 0.0, 0.0, 0.0, 0.0, 0.0], None), (7, [-0.0005] * 6, None), (7, [-0.0005] * 6, None), (7, [3.0, 1.0], None), (None, [9e5, -9e5, 0.0, 0.0, 0.0, 1.0], 3),
        (8, [], 3), (9, [0.5, -0.25, 1.0, 2.0, 0.1, 0.2], 4)]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "vec_id long, embedding array<double>, label int, code string, error int, v string")
    for entries in (2, 3, 256):
        assert coded(frame, entries=entries) == brute_codes(rows, entries=entries)
    # 64 bits no longer hold the transform's sums
    large = [(k, [1e6 * x + k for x in (3.0, -5.0, 7.0, 1.0)] * 9, k % 2) for k in range(9)]
    frame = spark.createDataFrame(large, "vec_id long, embedding array<double>, label int")
    assert coded(frame, entries=4) == brute_codes(large, entries=4)
    assert vectorcode.encoded(frame.limit(0)).count() == 0
    assert vectorcode.encoded(spark.createDataFrame([(1, None, 1), (2, [nan], 1)], frame.schema)).count() == 0
    empty = spark.createDataFrame([(1, [], 1), (2, [], None)], frame.schema)
    assert coded(empty) == brute_codes([(1, [], 1), (2, [], None)])
    with pytest.raises(OverflowError):
        vectorcode.encoded(spark.createDataFrame([(1, [1e300], 1)], frame.schema))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 30), st.integers(1, 9), st.booleans())
def test_nearest_entry(seed, vectors, entries, width, large):
    """Early elimination and the transform give what all plain distances give, ties included."""
    rng = np.random.default_rng(seed)
    span = 1 << 34 if large else 3
    x, e = rng.integers(-span, span, (vectors, width)).astype(object), rng.integers(-span, span, (entries, width)).astype(object)
    kind = object if large else np.int64
    plain = ((x[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
    index, scaled = vectorcode.nearest(vectorcode.walsh(x.astype(kind)), vectorcode.walsh(e.astype(kind)))
    assert [min(range(entries), key=lambda k: (row[k], k)) for row in plain] == index.tolist()
    size = 1 << (width - 1).bit_length()
    assert [d // size for d in scaled.tolist()] == [min(row) for row in plain]


def test_sequency_counts_sign_changes():
    waves = vectorcode.walsh(np.eye(32, dtype=np.int64)).T
    assert [int((np.diff(np.sign(w)) != 0).sum()) for w in waves] == list(range(32))


# --- token counts --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokencount.default_path())


def rows_of(frame):
    return sorted(tuple((v is None, v) for v in r) for r in frame.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())


def expected(texts, library):
    out = []
    for doc_id, text in texts:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        out.append((doc_id, len((text or "").encode()), n, n > 512))
    return sorted(tuple((v is None, v) for v in r) for r in out)


def test_tokens_of_the_table(docs, library):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(tokencount.counted(docs)) == expected(texts, library)
    # The table is for speed alone: next to nothing in it, and the same counts.
    assert rows_of(tokencount.counted(docs, most=3)) == expected(texts, library)


def test_tokens_edges(spark, library):
    texts = [
        (1, None), (2, ""), (3, " "), (3, " "), (None, "no id it's"), (4, "\n\n \t x  y"), (5, "a<|endoftext|> b<|endoftext|><|endoftext|>"), (6, "<|endof"), (7, "text|>"),
        (8, "word " * 60_000), (9, "x" * 30_000), (10, " " * 50_000 + "\n" * 50_000), (11, "Größe 日本語 \U0001f600 it'll 'tis ''s I'M 12 ½ ²"), (12, "word " * 512), (13, " word" * 512), (14, " word" * 513)]
    frame = spark.createDataFrame([(i, t, 1, "x", True, "h") for i, t in texts], "doc_id long, text string, n_tokens int, low string, over_limit boolean, lang string")
    assert rows_of(tokencount.counted(frame)) == expected(texts, library)
    assert tokencount.counted(frame.limit(0)).count() == 0


_SIGNS = ["'", " ", "  ", "\n", "\t", "a", "s", "t", "re", "ll", "ve", "m", "d", "S", "1", "٣", "é", "한", "漢", "!", "<|endoftext|>", "<|endof", " ", " ", "́", "\U0001f600", "²", "\x00", "\x1c", "\x85"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_SIGNS) | st.characters(exclude_categories=["Cs"]), max_size=14).map("".join), max_size=5), st.integers(1, 40))
def test_pretokens_give_the_ids_of_the_library(library, texts, limit):
    vocab = pretokens.vocabulary(tokencount.default_path())
    ids = [[] for _ in texts]
    for rows, data, at in pretokens.stretches(pa.array(texts, pa.string()), limit):
        starts = vocab.starts(data, at)
        for a, b in zip(starts, np.append(starts[1:], len(data))):
            ids[rows[np.searchsorted(at, a, "right") - 1]] += vocab.ids(bytes(data[a:b]))
    assert ids == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_summaries_keep_what_is_frequent():
    rng = random.Random(5)
    counts = {b"the": 5000, b" of": 3000, **{b"w%d" % k: rng.randint(1, 20) for k in range(3000)}}
    total = sum(counts.values())
    parts = []
    for share in range(7):  # the same words in seven summaries of a hundred
        low = np.array([int.from_bytes(w[:8].ljust(8, b"\0"), "little") for w in counts], np.uint64)
        n = np.array([c // 7 + (share < c % 7) for c in counts.values()])
        some = n > 0
        parts.append(tokencount.merged([(low[some], np.zeros(some.sum(), np.uint64), np.array([len(w) for w in counts])[some], n[some])], 100))
    held = tokencount.merged(parts, 100)
    words = {pretokens.unpacked(*k) for k in zip(*held[:3])}
    assert len(held[0]) <= 100 and {w for w, c in counts.items() if c > total / 50} <= words


# --- collocations --------------------------------------------------------------------------


def brute_phrases(rows, least, top, share=100):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    found = defaultdict(list)
    for (lang, *w), a in cands.items():
        score, k = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        longer = [b for (other, *v), b in cands.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= share * a for b in longer):
            found[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def mined(frame, least, top, **given):
    return sorted(tuple(r) for r in collocations.collocations(frame, least, top, **given).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_of_the_table(docs):
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert mined(docs, 40, 2000) == brute_phrases(rows, 40, 2000)


def test_phrases_edges(spark):
    texts = [
        ("A b c a b c, a b. a  b\tc\x0bd", None), ("a b c a b c, a b", "und"), (None, "en"), ("", "en"), (" .,;: ", "en"), ("x", None), ("Éa b Éa b\x85Éa b", "fr"), ("éa b éa b", "fr"),
        ("new york city new york city new york new york", "en"), ("new york city new york city new york new york", "en"), ("z " * 40_000, "en"), ("q q q q q q", "aa"), ("b b b b b b b b", "aa")]
    frame = spark.createDataFrame([(i % 3, t, g, 1, "w", "k") for i, (t, g) in enumerate(texts)], "doc_id long, text string, lang string, n int, w1 string, phrase string")
    for least, top, share in ((1, 2000, 100), (2, 5, 50)):
        assert mined(frame, least, top, share=share) == brute_phrases(texts, least, top, share)
    assert mined(frame.limit(0), 1, 10) == []
    assert mined(frame.where("text IS NULL"), 1, 10) == []


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "B", "cc", "d.", ",", "\n", "é"]), max_size=30).map(" ".join), st.sampled_from(["x", "y", None])), min_size=1, max_size=6), st.integers(1, 4))
def test_phrases_at_random(spark, texts, least):
    assert mined(spark.createDataFrame(texts, "text string, lang string"), least, 4) == brute_phrases(texts, least, 4)


def test_scores_pass_64_bits(spark):
    """1000 * a * n alone has 78 bits here."""
    a, n = 4_000_000_000, 90_000_000_000
    phrases = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", a + 1), ("en", 1, "y", a + 5)], "lang string, k int, phrase string, f long")
    row = collocations.scored(phrases, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row.score == 1000 * a * n // ((a + 1) * (a + 5)) and (row.l, row.r) == (a + 1, a + 5)


def test_bitmaps_change_nothing(spark, docs, monkeypatch):
    full = np.full(8, 255, np.uint8)  # takes all words, pairs and triples for frequent
    want = sorted(map(tuple, collocations.phrase_counts(collocations.windows(docs, [full]), 40).collect()))
    assert len(want) > 100
    monkeypatch.setattr(collocations, "HELD", 5000)  # many packed rows for each stretch
    for orders in ((1, 2, 3), (1, 2, 3, 4, 5)):
        bits = collocations.frequent_bits(docs, 40, orders)
        assert sorted(map(tuple, collocations.phrase_counts(collocations.windows(docs, bits), 40).collect())) == want


def test_frequent_hashes_are_those_that_occur_often(spark, docs):
    words = collocations.bitmap(collocations.frequent_hashes(docs, [], 40, 4))
    texts = [(r.lang or "und", r.text or "") for r in docs.collect()]
    seen = Counter((g, w) for g, t in texts for w in re.findall("[^\x20\x09.,;:!?\x0a-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)))
    often = {k for k, n in seen.items() if n >= 40}
    zero = np.zeros(1, np.int64)
    hashes = {k: collocations._hashes(pa.array([k[0]]), pa.array([k[1]]), zero, zero) for k in seen}
    found = {k for k, h in hashes.items() if collocations._has(words, h)[0]}
    assert often <= found and len(found - often) < 0.1 * len(seen)
