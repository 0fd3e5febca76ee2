"""Spans, ranges and glyphs that meet: sweeps, unions and matchings against brute force, and how they grow."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from hushmark.functions import aggregates
from hushmark.operators import audit, ground, matching, policy

# --- records folded into candidates ----------------------------------------------------------


def fold(olds, records):
    """The rule as it reads: record after record, candidates in order; equal first, then the first that overlaps."""
    kept = [{"start": s, "end": e, "type": t, "value": v, "alts": [], "sources": ["rule"], "fresh": False} for s, e, t, v in sorted(olds)]
    unresolved = []
    for _, s, e, t, v in sorted(records, key=lambda r: (r[0], r[1])):
        met = [k for k in kept if k["start"] < e and s < k["end"]]
        same = [k for k in met if (k["start"], k["end"]) == (s, e)]
        if not met:
            kept.append({"start": s, "end": e, "type": t, "value": v, "alts": [], "sources": ["service"], "fresh": True})
        elif same or met[0]["start"] <= s and e <= met[0]["end"]:
            for k in same or met[:1]:
                k["alts"] += [t] if t != k["type"] and t not in k["alts"] else []
                k["sources"] += ["service"] if "service" not in k["sources"] else []
        else:
            unresolved.append((t, v, s, e))
    return sorted((k["start"], k["end"], k["type"], k["value"], tuple(k["alts"]), tuple(k["sources"]), k["fresh"]) for k in kept), sorted(set(unresolved))


OLD = "doc_id long, unit_id string, start int, end int, type string, value string, alts array<string>, source string, located boolean"
NEW = "doc_id long, unit_id string, rec_no int, start int, end int, type string, raw_value string, context_raw string"


def merged(spark, olds, records):
    """olds and records by unit -> (located, unresolved) by unit."""
    old = spark.createDataFrame([(1, u, s, e, t, v, [], "rule", True) for u, rows in olds.items() for s, e, t, v in rows], OLD)
    new = spark.createDataFrame([(1, u, n, s, e, t, v, "") for u, rows in records.items() for n, s, e, t, v in rows], NEW)
    located, unresolved = ground.merge_overlap(old, new)
    got, left = {u: [] for u in olds}, {u: [] for u in olds}
    for r in located.collect():
        got[r.unit_id].append((r.start, r.end, r.type, r.value, tuple(r.alts), tuple(r.sources), r.fresh))
    for r in unresolved.collect():
        left[r.proposed_unit].append((r.type, r.value, r.proposed_start, r.proposed_end))
    return {u: (sorted(got[u]), sorted(left[u])) for u in olds}


def test_records_are_folded_in_their_order(spark):
    rng = random.Random(4)
    olds, records = {}, {}
    for unit in range(150):
        spans, at = [], 0
        for k in range(rng.randint(0, 4)):  # older candidates are disjoint
            at += rng.randint(0, 4)
            end = at + rng.randint(1, 5)
            spans.append((at, end, rng.choice("xyz"), f"o{k}"))
            at = end
        olds[str(unit)] = spans
        n = rng.choice([0, 1, 3, 10, 25])
        records[str(unit)] = []
        for k in range(n):
            start = rng.randint(0, 24)
            records[str(unit)].append((k // 2, start, start + rng.randint(1, 7), rng.choice("xyz"), f"v{k}"))
    # Two records of one number and start have no order of their own.
    for unit, rows in records.items():
        records[unit] = list({(r[0], r[1]): r for r in rows}.values())
    found = merged(spark, olds, records)
    assert found == {u: fold(olds[u], records[u]) for u in olds}
    assert sum(len(v[1]) for v in found.values()) > 50


def test_many_records_in_one_unit(spark):
    """Twice the records take about twice the time, however they lie: chains of overlaps, equal spans, or long spans over many."""
    def records(n):
        rng = random.Random(n)
        out = []
        for k in range(n):
            start = rng.randint(0, 4 * n)
            long = k % 50 == 0
            out.append((k, start, start + (rng.randint(1, n) if long else rng.randint(1, 9)), "xyz"[k % 3], "v"))
        return out

    times = []
    for n in (5_000, 40_000):
        rows = records(n)
        started = time.time()
        found = merged(spark, {"u": [(5, 9, "x", "o")]}, {"u": rows})["u"]
        times.append(time.time() - started)
        if n == 5_000:
            assert found == fold([(5, 9, "x", "o")], rows)
    assert times[1] < 8 * times[0] + 10


# --- unions of ranges ------------------------------------------------------------------------


def covered(rows):
    out = {}
    for k, a, b in rows:
        if 0 <= a < b:
            out.setdefault(k, set()).update(range(a, b))
    return {(k, p) for k, places in out.items() for p in places}


def disjoint(rows):
    last = {}
    for k, a, b in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        if a <= last.get(k, -1):
            return False
        last[k] = b
    return True


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.integers(-3, 30), st.integers(-3, 30)), max_size=25))
def test_ranges_are_joined(spark, rows):
    import pyarrow as pa

    table = pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["k", "a", "b"])
    out = aggregates.united(table, ["k"])
    got = list(zip(*(c.to_pylist() for c in out.columns)))
    assert covered(got) == covered(rows) and disjoint(got)
    # Parts may be put together in any order.
    half = len(rows) // 2
    parts = pa.concat_tables([aggregates.united(table.slice(half), ["k"]), aggregates.united(table.slice(0, half), ["k"])])
    assert aggregates.united(parts, ["k"]).to_pylist() == out.to_pylist()


def test_a_key_of_a_million_ranges_is_joined_before_the_shuffle(spark):
    ranges = spark.range(0, 1_000_000, 1, 4).selectExpr("IF(id % 1000 = 0, id DIV 1000, -1) AS k", "CAST(pmod(id * 7919, 100000) * 3 AS INT) AS a", "CAST(pmod(id * 7919, 100000) * 3 + 1 + id % 5 AS INT) AS b")
    parts = aggregates.span_partials(ranges, ["k"])
    by_task = parts.groupBy("k").count().where("k = -1").first()["count"]
    whole = aggregates.span_union(ranges, ["k"])
    of_hot = whole.where("k = -1").count()
    # Of 999,000 ranges of the hot key each task sends no more than the union has pieces, plus what it let go of when it was full.
    assert by_task < 250_000 and of_hot <= 100_000
    assert aggregates.span_partials(ranges.selectExpr("k", "a DIV 3000 * 3000 AS a", "a DIV 3000 * 3000 + 2000 AS b"), ["k"]).where("k = -1").count() <= 4 * 100
    small = aggregates.span_union(ranges, ["k"], most=50)
    assert small.exceptAll(whole).count() == 0 and whole.exceptAll(small).count() == 0


def test_the_union_in_sql(spark):
    aggregates.register(spark)
    spark.createDataFrame([(1, 0, 4), (1, 4, 6), (2, 9, 9), (1, 8, 9), (None, 1, 3), (None, 2, 5), (3, -1, 4)], "k int, a int, b int").createOrReplaceTempView("some_ranges")
    rows = spark.sql("SELECT k, inline(span_union(a, b)) FROM span_partials(TABLE(some_ranges)) GROUP BY k").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 0, 6), (1, 8, 9), (None, 1, 5)], key=str)


# --- glyphs ----------------------------------------------------------------------------------

GLYPH = "doc_id long, page int, unit_id string, idx int, c string, x0 double, y0 double, x1 double, y1 double"


def glyphs(spark, boxes, doc=1):
    """Boxes of no width, so that distances are exactly those written."""
    return [(doc, 1, "u", k, c, x, y, x, y) for k, (c, x, y) in enumerate(boxes)]


def check(spark, source, saved, hidden=()):
    frame = spark.createDataFrame([r for d, boxes in enumerate(source) for r in glyphs(spark, boxes, d)], GLYPH)
    out = spark.createDataFrame([r for d, boxes in enumerate(saved) for r in glyphs(spark, boxes, d)], GLYPH).drop("unit_id", "idx")
    gone = spark.createDataFrame(list(hidden), "doc_id long, unit_id string, idx int")
    return {r.doc_id: (r.leaked, r.lost, r.left_over, r.passed) for r in audit.glyph_check(frame, out, gone).collect()}


def test_a_pairing_that_exists_is_found(spark):
    near, far = 0.35, 0.350001
    source = [
        [("a", 0.0, 0.0), ("a", 0.3, 0.0)], [("a", 0.0, 0.0), ("a", 0.3, 0.0)], [("a", 0.0, 0.0)], [("a", 0.0, 0.0)], [("a", 0.0, 0.0), ("b", 0.0, 0.0)],
        [("a", 0.0, 0.0)] * 3, [("a", 8.0 * k, 0.0) for k in range(4)], [("a", 0.3 * k, 0.0) for k in range(40)], [("a", 0.0, 0.0), (" ", 5.0, 5.0)]]
    saved = [
        [("a", -0.3, 0.0), ("a", 0.2, 0.0)], [("a", 0.2, 0.0), ("a", -0.3, 0.0)], [("a", near, 0.0)], [("a", far, 0.0)], [("b", 0.0, 0.0), ("a", 0.0, near)],
        [("a", 0.1, 0.0)] * 2 + [("a", 0.2, 0.0)] * 2, [("a", 8.0 * k - 0.2, 0.0) for k in range(4)], [("a", 0.3 * k - 0.3, 0.0) for k in range(40)], [("a", 0.0, 0.0)]]
    assert check(spark, source, saved) == {
        0: (0, 0, 0, True), 1: (0, 0, 0, True), 2: (0, 0, 0, True), 3: (0, 1, 1, False), 4: (0, 0, 0, True), 5: (0, 0, 1, False), 6: (0, 0, 0, True), 7: (0, 0, 0, True), 8: (0, 0, 0, True)}


def test_hidden_glyphs_must_be_gone(spark):
    source = [[("a", 0.0, 0.0), ("b", 5.0, 0.0)], [("a", 0.0, 0.0), ("a", 0.0, 0.0)], [("a", 0.0, 0.0)]]
    saved = [[("b", 5.0, 0.0)], [("x", 0.35, 0.0)], []]
    hidden = [(0, "u", 0), (1, "u", 0), (1, "u", 1), (2, "u", 0)]
    assert check(spark, source, saved, hidden) == {0: (0, 0, 0, True), 1: (2, 0, 1, False), 2: (0, 0, 0, True)}


def brute_pairs(edges, have, room):
    left = [l for l, n in enumerate(have) for _ in range(n)]
    right = [r for r, n in enumerate(room) for _ in range(n)]
    partner = {}

    def place(k, seen):
        for j, r in enumerate(right):
            if (left[k], r) in edges and j not in seen:
                seen.add(j)
                if j not in partner or place(partner[j], seen):
                    partner[j] = k
                    return True
        return False

    return sum(place(k, set()) for k in range(len(left)))


@settings(max_examples=300, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5))), st.lists(st.integers(1, 3), min_size=6, max_size=6), st.lists(st.integers(1, 3), min_size=6, max_size=6))
def test_most_pairs(edges, have, room):
    assert matching.most_pairs(sorted(edges), have, room) == brute_pairs(edges, have, room)


def test_a_long_chain_is_matched_in_time():
    n = 20_000
    started = time.time()
    edges = [(k, k) for k in range(n)] + [(k, k + 1) for k in range(n - 1)]
    assert matching.most_pairs(edges, [1] * n, [1] * n) == n and time.time() - started < 20


# --- choices as classes ----------------------------------------------------------------------


def test_choices_stay_classes(spark):
    """A thousand choices by type on a hundred thousand spans are a thousand classes and a hundred thousand members."""
    spans = spark.range(100_000).selectExpr(
        "1L AS doc_id", "CAST(id AS STRING) AS cand_id", "'phone' AS type", "CAST(id % 700 AS STRING) AS value", "id % 10 <> 3 AS located", "IF(id % 4 = 0, 'user', NULL) AS decision_source",
        "id % 4 = 0 AS confirmed", "'full' AS method", "CAST(NULL AS STRING) AS origin")
    spans = spans.withColumn("manual", spans.confirmed)
    choices = spark.range(1000).selectExpr("1L AS doc_id", "id AS choice_id", "CAST(id AS STRING) AS cand_id", "CASE id % 4 WHEN 0 THEN 'one' WHEN 1 THEN 'same_value' WHEN 2 THEN 'same_type' ELSE 'following' END AS scope")
    classes, members = policy.spread_choice(spans, choices)
    assert classes.count() == 1000 and members.count() == 90_000
    some = classes.where("choice_id < 40")
    pairs = {r.choice_id: r["count"] for r in policy.reached(some, members).groupBy("choice_id").count().collect()}
    rows = [(r.cand_id, r.value, r.located, r._m) for r in spans.selectExpr("cand_id", "value", "located", f"{policy.MANUAL} AS _m").collect()]
    of = {r[0]: r for r in rows}
    for c in some.collect():
        anchor = of[c.anchor_id]
        inside = [r for r in rows if {"one": r is anchor, "same_value": r[1] == anchor[1], "same_type": True, "following": r[1] == anchor[1] and (r is anchor or not r[3])}[c.scope]]
        assert (c.n_reached, c.excluded) == (sum(r[2] for r in inside), sum(not r[2] for r in inside)) and pairs.get(c.choice_id, 0) == c.n_reached
