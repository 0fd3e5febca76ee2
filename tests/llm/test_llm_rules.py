"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
import corpus_pipeline
from hushmark.llm import ann, chat, contamination, html, langid, lm, packing, secrets, simhash
from tests.harness import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if re.match(r"op\d+_", n)))
def test_sql(spark, name):
    rows, expected, problems, *_ = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert not problems and rows == expected > 0


def test_all_are_registered():
    assert {int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in entry.queries()


# --- secrets -------------------------------------------------------------------------------


def brute_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(secrets.PATTERNS):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    for c in re.finditer(secrets.CANDIDATE, text):
        if any(re.search(p, c[0]) for p in secrets.ALLOWED):
            continue
        for rank, e in enumerate(secrets.ENTROPY, len(secrets.PATTERNS)):
            for run in re.finditer(e.runs(), c[0]):
                hot = []
                for at in range(len(run[0]) - e.window + 1):
                    bits = -sum(n / e.window * math.log2(n / e.window) for n in Counter(run[0][at : at + e.window]).values())
                    if bits >= e.bits - 1e-6:
                        if hot and at <= hot[-1][1]:
                            hot[-1][1] = at + e.window
                        else:
                            hot.append([at, at + e.window])
                found += [(c.start() + run.start() + a, rank, c.start() + run.start() + b, e.kind) for a, b in hot]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secret_spans(spark):
    rng = np.random.default_rng(5)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", "aab", "thes "]
    texts = ["token: token: abcdefgh1", "API_KEY='xyz' apikey=\"0123.456\"", "AKIAAKIAAKIA0000 AKIA AKIA12", "password =  :abcdefghij", "é" * 3 + "secret=" + "=" * 9, "f" * 32 + "é" + "0" * 31,
             "sha256-" + "a1B2" * 12, "123e4567-e89b-12d3-a456-426614174000", "my-example-" + "Zx9" * 10]
    for _ in range(120):
        words = ["".join(rng.choice(list(alphabets[rng.integers(5)]), rng.integers(1, 90))) for _ in range(4)]
        texts.append((" " if rng.random() < 0.6 else "") .join([*words, "token=", "ü", words[0]]))
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in secrets.digest(secrets.find_secrets(frame)).collect():
        assert r.spans == brute_spans(texts[r.doc_id]), texts[r.doc_id]
        base = ",".join(x for x in r.spans.split(",") if not x.startswith("entropy"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


# --- near duplicates -------------------------------------------------------------------------


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k in range(len(prints)):
        for other in np.flatnonzero(np.bitwise_count(prints[k] ^ prints[k + 1 :]) <= 3) + k + 1:
            a, b = find(k), find(int(other))
            parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


def brute_print(text):
    words = (text or "").encode().lower().split()
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_links(spark):
    rng = np.random.default_rng(3)
    made = set()
    crowd = int(rng.integers(1 << 63))
    for _ in range(150):
        x = int(rng.integers(1 << 63))
        for _ in range(int(rng.choice([1, 1, 2, 4, 30]))):
            made.add(x)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
    for _ in range(500):
        x = crowd
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= 1 << int(b)
        made.add(x)
    prints = np.array(sorted(made), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    got = {r.fp: r.label for r in simhash.link(frame).collect()}
    wanted = brute_components(prints)
    pairs = {(w, got[int(x)]) for w, x in zip(wanted, prints.view(np.int64), strict=True)}
    assert len(pairs) == len(set(wanted)) == len({label for _, label in pairs})


def test_near_duplicates(spark, docs):
    rows = entry.queries()["op6_simhash_near_dedup"](spark, SF).collect()
    prints = {i: brute_print(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    ids = sorted(prints)
    root = brute_components(np.array([prints[i] for i in ids], np.uint64))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", ids[root[k]]) for k, i in enumerate(ids)}


# --- contamination, packing, chat ------------------------------------------------------------------


def test_shards_of_patterns_agree(spark):
    documents, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = contamination.digest(documents, items).collect()
    hits = contamination.with_hits(documents.select("doc_id", "text"), items, "h", max_pattern_bytes=30_000)
    many = {r.doc_id: (r.n, r.words, r.ids) for r in hits.selectExpr("doc_id", "aggregate(h.hits, 0L, (a, x) -> a + x.last - x.first + 1) AS n", "h.n_words AS words", "sha2(array_join(h.items, ','), 256) AS ids").collect()}
    assert {r.doc_id: (r.n_hit, r.n_words, r.items_sha256) for r in one} == many and any(r.n_hit for r in one)


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(10_000, "a<|endoftext|>b"), (10_001, " " * 5000 + "x"), (10_002, "é　½ 12345 don't \x00")]
    frame = spark.createDataFrame([*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True), *extra], "doc_id long, text string")
    rows = packing.packed(frame).collect()
    ids = {i: [*coder.encode(t or "", add_special_tokens=False).ids, 0] for i, t in [*zip(docs.doc_id, docs.text, strict=True), *extra]}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for i, whole in ids.items():
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(whole)
        assert len(own) == 1 or all(r.length == 2048 for r in own[1:])
    for parts in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in rows])) + 1
    assert sum(len(r.ids) for r in packing.sequences(frame).collect()) == sum(map(len, ids.values()))


def test_packing_of_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: " " * 2_000_000, 2: "\n" * 2_000_000, 3: "a<|endoftext|>b" + "\u00a0" * 1_200_000 + "c", 4: "short"}
    ids_of = {i: [*coder.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    lengths = defaultdict(int)
    for r in packing.packed(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        lengths[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids_of[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert lengths == {i: len(ids_of[i]) for i in texts}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=9))
def test_bound_and_fit(lengths):
    values = np.array(lengths)

    def fewest(rest, free):
        if not rest:
            return len(free)
        best = len(lengths)
        for room in {f for f in free if f >= rest[0]}:
            left = [*free]
            left.remove(room)
            best = min(best, fewest(rest[1:], [*left, room - rest[0]]))
        if len(free) + 1 < best:
            best = min(best, fewest(rest[1:], [*free, 60 - rest[0]]))
        return best

    bins, offsets, free = packing.best_fit(values, 60)
    assert packing.lower_bound(values, 60) <= fewest(sorted(lengths, reverse=True), []) <= len(free)
    assert all(sum(values[bins == b]) == 60 - free[b] for b in range(len(free)))


def test_gaps_are_repacked(spark):
    lengths = np.random.default_rng(1).integers(300, 1100, 3000).tolist()
    frame = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "k long, length long")
    count = lambda rounds: packing.pack(frame, a_partition=60, rounds=rounds).select("sequence_id").distinct().count()
    assert packing.lower_bound(np.array(lengths)) <= count(3) < count(0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "[TEXT]"]), st.lists(st.sampled_from([*chat.INSTRUCT.controls, "\\", " ", "\n", "x", "ß", "<", "[", "/"]), max_size=8).map("".join)), max_size=6))
def test_chat_round_trip(turns):
    parts = chat.segments(turns)
    assert chat.read_back("".join(t for t, _ in parts)) == turns
    assert [chat.unescape(t) for t, learnt in parts if learnt] == [t for r, t in turns if r == "assistant"]


def test_machine():
    assert chat.check(["system", "user", "assistant"]) == (True, None)
    assert chat.check(["user", "user"]) == (False, 1) and chat.check(["user"]) == (False, 1) and chat.check([]) == (False, 0)


# --- neighbours, pages, models -------------------------------------------------------------------------


def test_neighbours(spark):
    for name in ("sf0.001", "sf0.1"):
        rows = entry.queries()["op9_graph_neighbours"](spark, f"/root/testdata/{name}").toPandas()
        data = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet").toPandas()
        x, ids, hits = np.stack(data.embedding).astype(float), data.vec_id.to_numpy(), 0
        for i in ids[ids % 100 == 0]:
            away = np.sqrt(((x - x[ids == i][0]) ** 2).sum(1))
            best = [k for k in np.lexsort((ids, away)) if ids[k] != i][:10]
            own = rows[rows.query_id == i].sort_values("rank")
            assert own["rank"].tolist() == list(range(1, 11))
            assert np.allclose(own.score, [away[ids == v][0] for v in own.vec_id]) and own.score.is_monotonic_increasing
            hits += len(set(ids[best]) & set(own.vec_id))
        assert hits >= 0.9 * len(rows)


def test_crowd_does_not_fill_the_beam():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (800, 24)), rng.normal(0, 1e-3, (600, 24)) + 0.1])
    leader = ann.lead(x)
    assert len(np.unique(leader[800:])) < 20 and (leader[:800] == np.arange(800)).mean() > 0.9


def test_page_rules(spark):
    page = """<html><head><title>no</title></head><body><header>no <b>head</b></header><div class=sidebar><p>no side</p></div><main><div class="post-12"><h1>Head &amp; line</h1>
    <p>First <i>words</i>\n\t are&nbsp;here<p>second, with <a href=x>a link</a> and much more text to be found<div class="ad-box ad">no ad</div><ul><li>one<li>two</ul><pre>a
    b</pre><form><p>no form</p></form><script>if (a < b) { no }</script></div><section id=comments><p>no comment, however long it may be, and this one is long, it really is</p></section></main><footer>no</footer></body></html>"""
    other = page.replace("post-12", "post-7").replace("First", "Third")
    frame = spark.createDataFrame([(1, "http://h.example/a", page), (2, "http://h.example/b", other), (3, "http://u@H.example:80/c", "<div>just text</div>")], "page_id long, url string, html string")
    assert [r.path for r in html.consensus(html.votes(frame.where("page_id < 3"))).collect()] == ["html/body/main/div.post-"]
    found = {r.page_id: r.text for r in html.extract(frame).collect()}
    assert found[1] == "Head & line\nFirst words are here\nsecond, with a link and much more text to be found\none\ntwo\na b"
    assert found[2] == found[1].replace("First", "Third") and found[3] == "just text"


def test_whole_articles(spark):
    long, quote = "a sentence of the main text, " * 40, "a long quotation, word by word, " * 60
    links = "".join(f"<li><a href=/{k}>link to another page {k}</a></li>" for k in range(9))
    body = {
        "nested": f"<article><h1>Title</h1><p>lead</p><div class='body'>{long}</div></article>",
        "deep": f"<main><h1>Title</h1><article><p>lead</p><div><div class='body'><p>{long}</p></div></div></article><p>end</p></main>",
        "sections": f"<article><h1>Title</h1><section class='a'><p>{long}</p></section><section class='b'><p>{long * 3}</p></section><section class='c'><p>end</p></section></article>",
        "quote": f"<article><h1>Title</h1><p>lead</p><blockquote>{quote}</blockquote><p>between</p><table><tr><td>{quote}</td><td>cell</td></tr></table><p>end</p></article>",
        "plain": f"<div><ul>{links}</ul><div><h1>Title</h1><p>lead</p><div class='body'>{long}</div></div></div>",
        "several": f"<div><article class='a'><p>{long}</p></article><article class='b'><p>{long}</p></article><article class='c'><p>{long}</p></article></div>",
    }
    lines = {"nested": ["Title", "lead", long], "deep": ["Title", "lead", long, "end"], "sections": ["Title", long, long * 3, "end"],
             "quote": ["Title", "lead", quote, "between", quote, "cell", "end"], "plain": ["Title", "lead", long], "several": [long] * 3}
    frame = spark.createDataFrame([(f"{kind} {k}", f"http://{kind}.example/{k}", f"<html><body><nav>no</nav>{html_}<footer>no</footer></body></html>") for kind, html_ in body.items() for k in range(3)], "page_id string, url string, html string")
    rows = html.extract(frame).collect()
    assert len(rows) == 3 * len(body)
    for r in rows:
        assert r.text == "\n".join(x.strip() for x in lines[r.page_id.split()[0]]), r.page_id


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id").html
    import html as entities

    for r in html.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<(b|br)>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_lm(spark, docs):
    rows = {r.doc_id: r for r in entry.queries()["op3_lm_maxent"](spark, SF).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b" "] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    total, below = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    for i, ts in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(counts[t] > 0 for t in ts), total)
        assert r.base_score == pytest.approx(sum(math.log10(counts[t] + 0.5) - below for t in ts)) and r.score < 0


def test_lm_probabilities_add_up(spark):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(["a b a c", "a b", "b a a", "c"] * 5)], "doc_id long, text string")
    posted = lm.postings(frame.selectExpr("doc_id", "xxhash64(text) AS text_hash", "false AS held_out", "text"), 3)
    start, total, distinct = lm.start(lm.counts(posted))
    assert (total, distinct) == (70, 4)
    model = lm.trained(frame.selectExpr("text", "0L AS share"), start, 1)
    stretch = lm.Stretch(np.frombuffer(b"a b a c", np.uint8), np.array([0, 7]))
    rows = lm.Features(model, stretch).rows(0, 5)
    for base, table, of in ((model.class_bias, model.tables[0], rows[0]), (model.word_bias[0], model.tables[1], rows[1])):
        assert np.allclose(lm._softmax(base, table, of).sum(1), 1, atol=1e-5)
    assert lm.token_scores(model, stretch).sum() > lm.token_scores(start, stretch).sum()


def test_language(spark):
    rows = entry.queries()["op4_language_ecoc"](spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id]).all() and (held.lang == held.lang_pred).mean() > 0.98


def test_codewords():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n)
        assert len({tuple(w) for w in code}) == n and all(0 < (column > 0).sum() < n for column in code.T)


def test_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    rows = entry.queries()["op2_quality_crf"](spark, "/root/testdata/sf0.01").toPandas().merge(labels, on="doc_id")
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and held[held.quality == 1].predicted.mean() > 0.97


def test_pipeline(spark, docs):
    """Each stage against brute force on what the one before kept."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, frame, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    assert set(good.doc_id) >= {i for i in docs.doc_id if labels.get(i) == 1}
    frame = spark.createDataFrame(good)
    one = stages["near_dup"](spark, frame, SF).toPandas()
    ids = sorted(good.doc_id)
    texts = good.set_index("doc_id").text
    root = brute_components(np.array([brute_print(texts[i]) for i in ids], np.uint64))
    assert sorted(one.doc_id) == [ids[k] for k in sorted(set(root))]
    clean = stages["leaks"](spark, spark.createDataFrame(one), SF).toPandas()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text
    windows = [w for t in items for w in contamination.item_windows(t.encode())]

    def hit(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        line, marked = " " + " ".join(words) + " ", set()
        for w in windows:
            at = line.find(w)
            while at >= 0:
                first = line.count(" ", 0, at)
                marked.update(range(first, first + w.count(" ") - 1))
                at = line.find(w, at + 1)
        return bool(marked) and 20 * len(marked) >= len(words)

    assert sorted(clean.doc_id) == sorted(i for i, t in zip(one.doc_id, one.text, strict=True) if not hit(t))
    hidden = stages["secrets"](spark, spark.createDataFrame(clean), SF).toPandas()
    assert len(hidden) == len(clean) and (hidden.n_chars == hidden.text.str.len()).all() and not any(re.search("[0-9a-f]{32}", t) for t in hidden.text)
    rows = stages["packing"](spark, spark.createDataFrame(hidden), SF)
    assert rows.select("doc_id").distinct().count() == len(hidden)
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(hidden)
