"""Location evidence: which neighbouring units say something about a candidate's unit.

A relation row is (doc_id, unit_id, relation, rel_ord, src_unit_id, src_text); ``rel_ord`` is
the fixed reading order of evidence. Positioned documents are bounded by the admission gate
(10 MB, 100 pages), and geometric pairs are further limited to bands of the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark import constants as K
from hushmark.functions.expr import lit
from hushmark.functions.validate import label_type, valid_value
from hushmark.operators.detect import settle_rows
from hushmark.operators.joins import carry_last, interval_join

NON_BLANK = "(?U)\\\\S"
_REL = ["doc_id", "unit_id", "relation", "rel_ord", "src_unit_id", "src_text"]


def excerpt(evidence: DataFrame, text: str = "src_text", anchor: str = "0", width: int | None = None) -> DataFrame:
    """The whole text, or ``width`` characters of it around an anchor, flagged if that is less; blank sources are dropped."""
    rows = evidence.where(f"{text} RLIKE '{NON_BLANK}'")
    if width is None:
        return rows.selectExpr("*", "0 AS ev_start", f"length({text}) AS ev_end", f"{text} AS ev_text", "false AS ev_cut")
    return rows.selectExpr(
        "*", f"greatest(0, least({anchor} - 80, length({text}) - {width})) AS ev_start"
    ).selectExpr(
        "*", f"least(length({text}), ev_start + {width}) AS ev_end",
        f"substring({text}, ev_start + 1, {width}) AS ev_text", f"length({text}) > {width} AS ev_cut",
    )


def evidence_self(units: DataFrame, cands: DataFrame, width: int | None = None) -> DataFrame:
    """The candidate's own unit, whole or ``width`` characters around the candidate."""
    joined = cands.join(units.select("doc_id", "unit_id", F.col("text").alias("src_text")), ["doc_id", "unit_id"])
    return excerpt(joined, anchor="start", width=width).selectExpr(
        "doc_id", "cand_id", "0L AS rel_ord", "'self' AS relation", "unit_id AS src_unit_id", "ev_start", "ev_end", "ev_text", "ev_cut"
    )


def stale_spans(units: DataFrame, cands: DataFrame) -> DataFrame:
    """Flags spans that are missing, out of range or no longer spell the value."""
    joined = cands.join(units.select("doc_id", "unit_id", "text"), ["doc_id", "unit_id"], "left")
    fresh = (
        "located AND text IS NOT NULL AND 0 <= start AND start < end AND end <= length(text) "
        "AND substring(text, start + 1, end - start) = value"
    )
    return joined.selectExpr(*cands.columns, f"NOT coalesce({fresh}, false) AS stale")


def paragraph_relations(units: DataFrame) -> DataFrame:
    """Heading above and previous paragraph; needs part, heading and in_cell columns.

    Cells never set a heading, and a table makes the previous paragraph forgotten.
    """
    non_blank = f"text RLIKE '{NON_BLANK}'"
    title = f"CASE WHEN heading AND NOT in_cell AND {non_blank} THEN named_struct('id', unit_id, 'text', text) END"
    before = (
        "CASE WHEN in_cell THEN named_struct('id', CAST(NULL AS STRING), 'text', '') "
        f"WHEN {non_blank} THEN named_struct('id', unit_id, 'text', text) END"
    )
    keys = ["doc_id", "part"]
    scanned = carry_last(carry_last(units, keys, "unit_seq", title, "_head"), keys, "unit_seq", before, "_prev")
    entries = (
        "array(named_struct('relation', 'preceding_heading', 'rel_ord', 10 * 4294967296L, 'src', _head), "
        "named_struct('relation', 'preceding_paragraph', 'rel_ord', 40 * 4294967296L, 'src', "
        "IF(in_cell OR heading OR _prev.id <=> _head.id, NULL, _prev)))"
    )
    return scanned.selectExpr("doc_id", "unit_id", f"inline({entries})").where("src.id IS NOT NULL").selectExpr(
        "doc_id", "unit_id", "relation", "rel_ord", "src.id AS src_unit_id", "src.text AS src_text"
    )


def cell_relations(grid: DataFrame) -> DataFrame:
    """Same cell, first cell of the row, and first-row cell with the same grid start and span.

    ``grid`` is cell_grid output with unit_id, unit_seq and text; every paragraph of a source cell is joined.
    """
    ranked = grid.selectExpr(
        "doc_id", "tbl", "row", "cell_ord", "grid_col", "span", "unit_id", "unit_seq", "text",
        "row_number() OVER (PARTITION BY doc_id, tbl, row, cell_ord ORDER BY unit_seq) AS para",
    )
    src = ranked.select("doc_id", "tbl", "row", "cell_ord", "grid_col", "span", "para",
                        F.col("unit_id").alias("src_unit_id"), F.col("text").alias("src_text"))
    own = grid.select("doc_id", "tbl", "row", "cell_ord", "grid_col", "span", "unit_id")
    parts = [
        ("same_cell", 20, own.join(src.drop("grid_col", "span"), ["doc_id", "tbl", "row", "cell_ord"])),
        ("table_row_first_cell", 21, own.where("grid_col > 1").join(
            src.where("cell_ord = 0").drop("cell_ord", "grid_col", "span"), ["doc_id", "tbl", "row"])),
        ("table_first_row", 22, own.where("row > 0").join(
            src.where("row = 0").drop("row", "cell_ord"), ["doc_id", "tbl", "grid_col", "span"])),
    ]
    out = None
    for relation, order, joined in parts:
        rows = joined.where("src_unit_id <> unit_id").selectExpr(
            "doc_id", "unit_id", f"'{relation}' AS relation", f"{order} * 4294967296L + para AS rel_ord", "src_unit_id", "src_text"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


_BOX = ["doc_id", "page", "unit_id", "unit_seq", "text", "x0", "y0", "x1", "y1"]


def _boxed(lines: DataFrame) -> DataFrame:
    return lines.select(*_BOX).where("x1 > x0 AND y1 > y0 AND page IS NOT NULL")


_SRC = "named_struct('id', r_unit_id, 'text', r_text)"
_LEFT = "r_x1 <= x0 + 1 AND greatest(0, least(y1, r_y1) - greatest(y0, r_y0)) >= least(y1 - y0, r_y1 - r_y0) * 0.5"
_LEFT_PLACE = "struct(r_x0, r_unit_seq)"
_ABOVE_TOP = "y0 - greatest(72, (y1 - y0) * 4)"
_ABOVE = "(least(x1, r_x1) - greatest(x0, r_x0) > 0 OR abs(r_x0 - x0) <= 12)"
_ABOVE_PLACE = "struct(y0 - r_y1, abs(x0 - r_x0), r_unit_seq)"


def left_relations(lines: DataFrame) -> DataFrame:
    """On the same physical row to the left: the farthest unit and the nearest."""
    boxed = _boxed(lines)
    pairs = interval_join(boxed, boxed, ["doc_id", "page"], ("y0", "y1"), ("y0", "y1"), 64, f"r_unit_id <> unit_id AND {_LEFT}")
    ends = pairs.groupBy("doc_id", "unit_id").agg(
        F.expr(f"min_by({_SRC}, {_LEFT_PLACE})").alias("far"), F.expr(f"max_by({_SRC}, {_LEFT_PLACE})").alias("near")
    )
    return ends.selectExpr(
        "doc_id", "unit_id", "posexplode(array_distinct(array(far, near))) AS (n, src)"
    ).selectExpr("doc_id", "unit_id", "'same_row_left' AS relation", "(30 + n) * 4294967296L AS rel_ord", "src.id AS src_unit_id", "src.text AS src_text")


def above_relations(lines: DataFrame) -> DataFrame:
    """Nearest unit above with horizontal overlap or a like left edge."""
    boxed = _boxed(lines)
    pairs = interval_join(
        boxed, boxed, ["doc_id", "page"], (_ABOVE_TOP, "y0"), ("y1", "y1"), 72, f"r_unit_id <> unit_id AND {_ABOVE}")
    nearest = pairs.groupBy("doc_id", "unit_id").agg(F.expr(f"min_by({_SRC}, {_ABOVE_PLACE})").alias("src"))
    return nearest.selectExpr("doc_id", "unit_id", "'nearest_above' AS relation", "32 * 4294967296L AS rel_ord",
                              "src.id AS src_unit_id", "src.text AS src_text")


def numbered_relations(lines: DataFrame) -> DataFrame:
    """Nearest numbered line above, within 360 points and not to the right."""
    boxed = _boxed(lines)
    numbered = boxed.where(f"length(text) <= 80 AND text RLIKE {lit(K.NUMBERED_LINE)}")
    # The few numbered lines reach down over the buckets, so that each line is in one only; the condition says how far.
    pairs = interval_join(
        boxed, numbered, ["doc_id", "page"], ("y0", "y0"), ("y1", "y1 + 361"), 120,
        "r_unit_id <> unit_id AND y0 - r_y1 > 0 AND CAST(y0 - 360 AS DOUBLE) <= r_y1 AND r_x0 <= x0 + 2",
    )
    nearest = pairs.groupBy("doc_id", "unit_id").agg(F.expr(
        "min_by(named_struct('id', r_unit_id, 'text', r_text), struct(y0 - r_y1, r_unit_seq))"
    ).alias("src"))
    return nearest.selectExpr("doc_id", "unit_id", "'preceding_numbered_line' AS relation", "33 * 4294967296L AS rel_ord",
                              "src.id AS src_unit_id", "src.text AS src_text")


def line_relations(lines: DataFrame) -> DataFrame:
    """The rows of ``left_relations``, ``above_relations`` and ``numbered_relations``.

    Lines to the left and above meet in one join: a line's range starts where its reach above does and ends with its own row.
    A bucket is four times that reach, so that few lines are shuffled twice.
    """
    boxed = _boxed(lines)
    above = f"(CAST({_ABOVE_TOP} AS DOUBLE) <= r_y1 AND r_y1 <= y0 AND {_ABOVE})"
    pairs = interval_join(
        boxed, boxed, ["doc_id", "page"], (_ABOVE_TOP, "y1"), ("y0", "y1"), 288, f"r_unit_id <> unit_id AND ({_LEFT} OR {above})")
    met = pairs.groupBy("doc_id", "unit_id").agg(
        F.expr(f"min_by({_SRC}, {_LEFT_PLACE}) FILTER (WHERE {_LEFT})").alias("far"),
        F.expr(f"max_by({_SRC}, {_LEFT_PLACE}) FILTER (WHERE {_LEFT})").alias("near"),
        F.expr(f"min_by({_SRC}, {_ABOVE_PLACE}) FILTER (WHERE {above})").alias("over"),
    )
    entries = (
        "array(named_struct('relation', 'same_row_left', 'rel_ord', 30 * 4294967296L, 'src', far), "
        "named_struct('relation', 'same_row_left', 'rel_ord', 31 * 4294967296L, 'src', IF(near <=> far, NULL, near)), "
        "named_struct('relation', 'nearest_above', 'rel_ord', 32 * 4294967296L, 'src', over))"
    )
    beside = met.selectExpr("doc_id", "unit_id", f"inline({entries})").where("src IS NOT NULL").selectExpr(
        "doc_id", "unit_id", "relation", "rel_ord", "src.id AS src_unit_id", "src.text AS src_text")
    return beside.unionByName(numbered_relations(lines))


#: The place of a label's proof among the pieces: after all others.
PROOF_ORD = 1 << 62


def evidence_top8(units: DataFrame, cands: DataFrame, relations: DataFrame, limit: int | None = None, width: int | None = None) -> DataFrame:
    """All distinct pieces per candidate, own unit first, in the fixed order; those after ``limit`` are flagged. ``width`` as in ``excerpt``.

    Where candidates carry a proof (proof_unit, proof_start, proof_end), the label it spells comes last, if its place is one of the unit's
    text and no piece says the same already.
    """
    near = excerpt(cands.select("doc_id", "cand_id", "unit_id").join(relations, ["doc_id", "unit_id"]), width=width).selectExpr(
        "doc_id", "cand_id", "rel_ord", "relation", "src_unit_id", "ev_start", "ev_end", "ev_text", "ev_cut"
    )
    every = evidence_self(units, cands, width).unionByName(near).withColumn("_proof", F.lit(False))
    if "proof_unit" in cands.columns:
        spelled = cands.where("proof_unit IS NOT NULL").select("doc_id", "cand_id", F.col("proof_unit").alias("src_unit_id"), "proof_start", "proof_end").join(
            units.select("doc_id", F.col("unit_id").alias("src_unit_id"), "text"), ["doc_id", "src_unit_id"]).where(
            "0 <= proof_start AND proof_start < proof_end AND proof_end <= length(text)").selectExpr(
            "doc_id", "cand_id", "src_unit_id", "proof_start AS ev_start", "proof_end AS ev_end", "'label_proof' AS relation", f"{PROOF_ORD}L AS rel_ord",
            "substring(text, proof_start + 1, proof_end - proof_start) AS ev_text", "false AS ev_cut", "true AS _proof")
        every = every.unionByName(spelled)
    # All windows lie within a candidate, so its pieces are brought together once.
    first = every.repartition("doc_id", "cand_id").selectExpr(
        "*", "row_number() OVER (PARTITION BY doc_id, cand_id, src_unit_id, ev_start, ev_end, relation, _proof ORDER BY rel_ord) AS _nth").where("_proof OR _nth = 1")
    if "proof_unit" in cands.columns:
        said = "bool_or(NOT _proof) OVER (PARTITION BY doc_id, cand_id, src_unit_id, ev_text)"
        first = first.selectExpr("*", f"{said} AS _said").where("NOT (_proof AND _said AND cand_id IS NOT NULL)").drop("_said")
    first = first.drop("_proof", "_nth")
    over = "false" if limit is None else f"ord > {limit}"
    return first.selectExpr(
        "*", "row_number() OVER (PARTITION BY doc_id, cand_id ORDER BY rel_ord, src_unit_id) AS ord"
    ).selectExpr("*", f"{over} AS over_limit")


def location_label(cands: DataFrame) -> DataFrame:
    """Readable place; needs region, page, tbl, row and col (NULL outside a table)."""
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.REGION_NAMES.items())
    region = f"CASE region {names} ELSE '본문' END"
    return cands.selectExpr(
        "*",
        f"CASE WHEN page IS NOT NULL THEN concat(CAST(page AS STRING), '쪽') WHEN tbl IS NOT NULL THEN concat({region}, "
        f"' · 표 ', CAST(tbl AS STRING), ' · ', CAST(row AS STRING), '행 ', CAST(col AS STRING), '열') ELSE {region} END AS label",
    )


def neighbour_finds(units: DataFrame, relations: DataFrame, today: str) -> DataFrame:
    """Whole-unit values typed by a label that fills a related unit, as raw finds."""
    from hushmark.functions.expr import stripped, trimmed_start

    kinds = ", ".join(f"'{r}'" for r in K.FIELD_RELATIONS)
    labels = relations.where(f"relation IN ({kinds})").selectExpr(
        "doc_id", "unit_id", "relation", "rel_ord", "src_unit_id", f"{label_type('src_text')} AS kind",
        f"{trimmed_start('src_text')} AS proof_start", f"{trimmed_start('src_text')} + length({stripped('src_text')}) AS proof_end",
    ).where("kind IS NOT NULL")
    keep = [c for c in ("doc_id", "unit_seq", "unit_id", "page") if c in units.columns]
    valued = labels.join(units.select(*keep, "text"), ["doc_id", "unit_id"]).selectExpr(
        *keep, "kind", "relation", "rel_ord", "src_unit_id", "proof_start", "proof_end",
        f"{trimmed_start('text')} AS start", f"{stripped('text')} AS value",
    )
    return valued.where(valid_value("kind", "value", today)).selectExpr(
        *keep, "6 AS prio", "CAST(rel_ord AS BIGINT) AS ord", "start", "start + length(value) AS end", "kind AS type", "value",
        "CAST(array() AS array<string>) AS alts", "relation", "src_unit_id AS proof_unit", "proof_start", "proof_end",
    )


def neighbour_fields(units: DataFrame, relations: DataFrame, today: str) -> DataFrame:
    return settle_rows(neighbour_finds(units, relations, today))
