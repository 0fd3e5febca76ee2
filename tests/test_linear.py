"""Work per unit in proportion to its text: sums, spans, literal search and redaction on long lines."""

import random
import time

import pytest

from hushmark.functions.expr import between, let, running_sums, scan, text_blocks
from hushmark.operators import detect as D
from hushmark.operators import literal
from hushmark.operators.mask import redact_units
from hushmark.operators.pipeline import detect_all, redact_all

TODAY = "2026-01-01"


def unit(spark, text):
    return spark.createDataFrame([(1, 0, "u", text)], "doc_id long, unit_seq int, unit_id string, text string")


def grows_linearly(run, small, large):
    """The larger input takes no longer than its share, with room for what every run has besides."""
    run(small)
    times = []
    for n in (small, large):
        started = time.time()
        run(n)
        times.append(time.time() - started)
    assert times[1] < 2 * (large / small) * times[0] + 3, times


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 513, 70_000])
def test_running_sums(spark, n):
    rng = random.Random(n)
    numbers = [rng.randint(0, 9) for _ in range(n)]
    frame = spark.createDataFrame([(numbers,)], "a array<int>")
    row = frame.selectExpr(f"{running_sums('a')} AS s", f"{scan('a', 'int', '0', 'greatest(s, x)')} AS m").first()
    total, most, sums, maxima = 0, 0, [], []
    for x in numbers:
        total, most = total + x, max(most, x)
        sums.append(total)
        maxima.append(most)
    assert row.s == sums and row.m == maxima


def test_pieces_of_a_long_text(spark):
    text = "".join(chr(random.Random(k).choice([97, 0xAC00, 0x1F600])) for k in range(5000))
    cuts = [(0, 0), (0, 1), (5, 5), (0, 5000), (1023, 1025), (1024, 2048), (1, 4999), (3000, 3001), (2047, 2049), (4999, 5000), (5000, 5000), (1024, 1024)]
    frame = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a int, b int")
    rows = frame.selectExpr("a", "b", f"{let('bs', text_blocks('t'), between('bs', 'a', 'b'))} AS p").collect()
    assert [r.p for r in rows] == [text[r.a : r.b] for r in rows]


def test_a_line_of_very_many_finds(spark):
    """Phones by the ten thousand in one line: found, settled and starred."""
    text = "010-1234-5678 x " * 4000
    found = D.pii_union(unit(spark, text))
    assert found.count() == 4000 and found.selectExpr("max(start)").first()[0] == 16 * 3999
    row = redact_all(unit(spark, text), TODAY).first()
    assert row.n_found == 4000 and row.redacted == "************* x " * 4000
    grows_linearly(lambda n: redact_all(unit(spark, "010-1234-5678 x " * n), TODAY).select("n_found").collect(), 4_000, 32_000)


def test_a_line_of_very_many_fields(spark):
    grows_linearly(lambda n: detect_all(unit(spark, "성명: 김하늘; 비고: 없음; " * n), TODAY).count(), 1_000, 8_000)
    assert detect_all(unit(spark, "성명: 김하늘; 비고: 없음; " * 700), TODAY).count() == 700


def test_edits_of_a_long_line(spark):
    text, n = "가b" * 60_000, 30_000
    edits = spark.range(n).selectExpr("1L AS doc_id", "'u' AS unit_id", "CAST(id * 4 AS INT) AS start", "CAST(id * 4 + 1 AS INT) AS end", "IF(id % 2 = 0, 'full', 'delete') AS method", "true AS located", "CAST(NULL AS array<struct<a:int,b:int>>) AS mask")
    assert redact_units(unit(spark, text), edits).first().redacted == "*b가bb가b" * (n // 2)


def test_hits_of_a_long_unit(spark):
    """One unit of a megabyte with a hundred thousand hits."""
    rows = literal.locate(unit(spark, "ab xyzwvut" * 100_000), spark.createDataFrame([(1, "ab")], "doc_id long, value string"))
    assert rows.count() == 100_000 and rows.selectExpr("sum(start)").first()[0] == sum(range(0, 1_000_000, 10))
    grows_linearly(lambda n: literal.locate(unit(spark, "ab xyzwvut" * n), spark.createDataFrame([(1, "ab")], "doc_id long, value string")).count(), 20_000, 160_000)


def test_many_values_and_a_short_one(spark):
    """Five thousand values of one document, one of them a single character, against brute force."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh가나다") for _ in range(rng.choice([2, 3, 5, 9, 14]))) for _ in range(5000)]
    values = sorted({*words, "x", "가나", "010-1234-5678"})
    texts = [" ".join(rng.choice(words) for _ in range(12)) + rng.choice(["", " x", " 010-1234-5678"]) for _ in range(300)]
    table = spark.createDataFrame([(1, k, f"1#{k}", t) for k, t in enumerate([*texts, texts[0]])] + [(2, 0, "2#0", texts[0])], "doc_id long, unit_seq int, unit_id string, text string")
    wanted = spark.createDataFrame([(1, v) for v in values] + [(2, "x"), (3, "x")], "doc_id long, value string")
    got = sorted((r.unit_seq, r.value, r.start) for r in literal.locate(table.where("doc_id = 1"), wanted).collect())
    assert got == sorted((k, v, at) for k, t in enumerate([*texts, texts[0]]) for v in values for at in range(len(t)) if t.startswith(v, at))
    assert literal.locate(table.where("doc_id = 2"), wanted).count() == texts[0].count("x")


def test_names_of_a_crowded_document(spark):
    """More names than ride along with the units are found again all the same."""
    people = ["김" + a + b for a in "가나다라마바사아자차" for b in "민서준우진현수영호연"][:90]
    lines = [f"성명: {p}" for p in people] + [f"오늘 {p}님은 왔다" for p in people] + ["회의록"]
    table = spark.createDataFrame([(1, k, f"1#{k}", t) for k, t in enumerate(lines)] + [(2, 0, "2#0", "성명: 김가민"), (2, 1, "2#1", "김가민, 김가민씨와 김가민수")], "doc_id long, unit_seq int, unit_id string, text string")
    names = detect_all(table, TODAY).where("type = 'name'")
    assert names.where("doc_id = 1").count() == 180
    assert sorted((r.unit_seq, r.start) for r in names.where("doc_id = 2").collect()) == [(0, 4), (1, 0), (1, 5)]


def test_detection_stores_once_and_moves_text_at_most_once(spark):
    table = spark.createDataFrame([(1, 0, "1#0", "성명: 김하늘"), (1, 1, "1#1", "김하늘, 참석")], "doc_id long, unit_seq int, unit_id string, text string")
    plan = redact_all(table, TODAY)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(moved) <= 3 and "Python" not in plan
