"""Evidence is paired and told apart in one pass."""

import random

from hushmark.operators import evidence as E


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_lines_beside_and_above_meet_in_one_join(spark):
    rng, rows = random.Random(7), []
    for doc in range(3):
        for i in range(60):
            x, y, h = rng.randrange(0, 400), rng.randrange(0, 900), rng.choice((0, 6, 12, 40, 150))
            rows.append((doc, rng.choice((1, 2, None)), f"u{i % 55}", i, rng.choice(("1. 기본", "가) 항목", "값", "")), x, y + 0.5 * (i % 2), x + rng.randrange(0, 90), y + 0.5 * (i % 2) + h))
    # Exactly at the reach of a numbered line, just beyond it, and at the reach above.
    rows += [(9, 1, "n", 0, "1. 기본", 0, 0.0, 50, 10.0), (9, 1, "at", 1, "값", 0, 370.0, 50, 380.0), (9, 1, "off", 2, "값", 0, 370.5, 50, 380.5), (9, 1, "up", 3, "값", 0, 82.0, 50, 92.0)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, unit_id string, unit_seq int, text string, x0 int, y0 double, x1 int, y1 double")
    apart = E.left_relations(lines).unionByName(E.above_relations(lines)).unionByName(E.numbered_relations(lines))
    columns = ["doc_id", "unit_id", "relation", "rel_ord", "src_unit_id", "src_text"]
    together = E.line_relations(lines)
    assert sorted(map(tuple, together.select(columns).collect())) == sorted(map(tuple, apart.select(columns).collect()))
    numbered = {(r.unit_id, r.src_unit_id) for r in E.numbered_relations(lines.where("doc_id = 9")).collect()}
    assert numbered == {("at", "n"), ("up", "n")}
    assert plan(together).count("Join") == 2


def test_pieces_and_proofs_are_told_apart_in_one_pass(spark):
    units = spark.createDataFrame([(1, "a", "성명 김"), (1, "b", "성명"), (1, "c", "짧")], "doc_id long, unit_id string, text string")
    relations = spark.createDataFrame([(1, "a", "same_row_left", 30, "b", "성명"), (1, "a", "same_row_left", 31, "b", "성명"), (1, "a", "nearest_above", 32, "b", "성명")],
                                      "doc_id long, unit_id string, relation string, rel_ord long, src_unit_id string, src_text string").where("src_text <> 'marker'")
    # Of unit b: said by a piece already; of unit a: two characters, twice; one without an id, which no piece is compared with; one beyond the text.
    cands = spark.createDataFrame([(1, "a", "x", 0, "b", 0, 2), (1, "a", "y", 0, "a", 0, 2), (1, "a", "y", 0, "a", 0, 2), (1, "b", None, 0, "b", 0, 2), (1, "c", "z", 0, "c", 0, 9)],
                                  "doc_id long, unit_id string, cand_id string, start int, proof_unit string, proof_start int, proof_end int")
    found = E.evidence_top8(units, cands, relations, 3)
    rows = sorted(((r.cand_id or "", r.ord, r.relation, r.src_unit_id, r.rel_ord >> 32, r.over_limit) for r in found.collect()))
    assert [(c, n, relation, src, over) for c, n, relation, src, _, over in rows] == [
        ("", 1, "self", "b", False), ("", 2, "label_proof", "b", False),
        ("x", 1, "self", "a", False), ("x", 2, "same_row_left", "b", False), ("x", 3, "nearest_above", "b", False),
        ("y", 1, "self", "a", False), ("y", 2, "same_row_left", "b", False), ("y", 3, "nearest_above", "b", False), ("y", 4, "label_proof", "a", True), ("y", 5, "label_proof", "a", True),
        ("z", 1, "self", "c", False)]
    assert plan(found).count("marker") == 1
