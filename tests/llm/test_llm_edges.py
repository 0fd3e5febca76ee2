"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import pytest

import corpus_pipeline
from hushmark.llm import ann, chat, contamination, html, langid, lm, packing, quality, secrets, simhash

SECRET = "token: abcdefgh12345678"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, component_id long, secrets string, hits int, label int, anchor string, free long, chunk int"
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two three"), (None, "no id here"), (6, "word " * 60_000), (7, "Größe 日本語 \U0001f600 " + SECRET), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), *[None] * 9) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, 1), (6, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "One, two THREE", 0), (3, "one", 0), (None, "no id", 0)], "item_id long, text string, hits int")


def by_id(frame, *columns):
    rows = [tuple(r[c] for c in ("doc_id", *columns)) for r in frame.collect()]
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def test_secrets(odd, none):
    found = by_id(secrets.digest(secrets.find_secrets(odd)), "n_assign", "spans")
    assert len(found) == len(TEXTS) and [r for r in found if r[1]] == [(7, 1, f"assign:12:{12 + len(SECRET)}")]
    clean = secrets.redact_secrets(odd)
    assert clean.columns == odd.columns
    text = {r.doc_id: (r.text, r.n_chars) for r in clean.collect() if r.doc_id}
    assert text[7] == ("Größe 日本語 \U0001f600 [SECRET]", 20) and text[1] == (None, None) and text[2] == ("", 0)
    assert secrets.digest(secrets.find_secrets(none)).count() == 0 and secrets.redact_secrets(none).count() == 0


def test_quality(odd, none, labels):
    model = quality.fit(odd, labels)
    found = {r.doc_id: r for r in quality.classified(odd, model).collect()}
    assert all(0 <= r.score <= 1 for r in found.values()) and found[1].score == found[2].score == found[3].score == pytest.approx(model.prior)
    kept = quality.accepted(odd, model)
    assert kept.columns == odd.columns
    bare = quality.fit(none, labels.limit(0))
    assert quality.accepted(odd, bare).count() == len(TEXTS) and quality.classified(none, bare).count() == 0


def test_lm(odd, none):
    rows = by_id(lm.scored(odd), "n_tokens", "n_known")  # document 5 is held out
    assert len(rows) == len(TEXTS) and (1, 1, 1) in rows and (5, 4, 2) in rows and rows.count((4, 2, 2)) == 2
    assert lm.scored(none).count() == 0


def test_language(odd, none):
    model = langid.fit(odd)  # no lang at all
    assert {r.lang_pred for r in langid.identified(odd, model).collect()} == {"und"}
    taught = langid.fit(odd.selectExpr("doc_id", "text", "'xx' AS lang"))
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(odd, taught).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[5] == ("xx", 1.0) and found[7][0] == "xx"
    assert langid.identified(none, langid.fit(none)).count() == 0


def test_simhash(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(TEXTS)
    component = {r.doc_id: r.component_id for r in rows}
    assert component[1] == component[2] == component[3] == 1 and component[4] == 4
    assert all(r.fp == 0 for r in rows if r.doc_id in (1, 2, 3))
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and by_id(kept) == [(1,), (4,), (5,), (6,), (7,), (None,)]
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicated(none).count() == 0


def test_contamination(odd, none, items):
    rows = by_id(contamination.digest(odd, items), "n_words", "n_hit", "n_items", "contaminated")
    assert len(rows) == len(TEXTS)
    assert (1, 0, 0, 0, False) in rows and rows.count((4, 1, 1, 1, True)) == 2 and (5, 3, 3, 1, True) in rows and (6, 60_000, 0, 0, False) in rows
    assert (None, 3, 2, 0, True) in rows
    kept = contamination.decontaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == 6
    assert contamination.decontaminated(odd, items.limit(0)).count() == len(TEXTS) and contamination.digest(none, items).count() == 0


def test_packing(odd, none):
    rows = packing.packed(odd).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in TEXTS}
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 6)
    assert [p for p, _, _ in long] == list(range(len(long))) and all(n == 2048 for _, _, n in long[1:])
    assert packing.packed(none).count() == 0


def test_pipeline(spark, odd, none, labels, items, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == odd.columns
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert (docs.count() > 0) == (out is not None and spark.read.parquet(f"{tmp_path}/secrets").count() > 0)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [3.0]), (100, [1.0, 0.5]), (2, [0.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    found = {}
    for r in ann.neighbours(frame, frame["vec_id"] % 100 == 0).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, round(r.score, 6))
    assert found == {0: {1: (1, 0.0), 2: (100, 0.5), 3: (2, 1.414214)}, 100: {1: (0, 0.5), 2: (1, 0.5), 3: (2, 1.118034)}}
    assert ann.neighbours(frame.limit(0), frame["vec_id"] % 100 == 0).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "plain &amp; simple"), (4, "http://a.example/x", "<p>x" * 20_000), (4, "http://a.example/x", "<div"), (5, "http://a.example/y", "<!-- open")]
    frame = spark.createDataFrame([(i, u, h, "t", 1, "p") for i, u, h in rows], "page_id long, url string, html string, text string, n_chars int, path string")
    found = [(r.page_id, r.text[:20], r.n_chars) for r in html.extract(frame).orderBy("page_id", "n_chars").collect()]
    assert found[:3] == [(1, "", 0), (2, "", 0), (3, "plain & simple", 14)] and len(found) == 6 and (4, "x\nx\nx\nx\nx\nx\nx\nx\nx\nx\n", 39_999) in found
    assert html.extract(frame.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, None, None, None), (2, 5, "assistant", "</s>"), (2, 1, "odd [TEXT] role", "\\</s>\\\\")]
    frame = spark.createDataFrame([(*r, True, "z") for r in rows], "conv_id long, turn long, role string, text string, valid boolean, segments string")
    found = {r.conv_id: r for r in chat.digest(chat.format_conversations(frame)).collect()}
    assert {k: (r.n_turns, r.loss_chars, r.valid) for k, r in found.items()} == {1: (4, 2, False), None: (1, 0, False), 2: (2, 4, False)}
    assert chat.format_conversations(frame.limit(0)).count() == 0
