"""Masking of units: edits from decided spans, visible pieces, boxes to black out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark.functions.expr import between, let, text_blocks
from hushmark.functions.masking import automatic_presets, mask_value, merge_ranges

_EDIT = "array<struct<start:int,end:int,repl:string>>"


def _edits() -> str:
    """Replacements of one decided candidate."""
    return (
        "CASE method WHEN 'full' THEN array(named_struct('start', start, 'end', end, 'repl', repeat('*', end - start))) "
        "WHEN 'delete' THEN array(named_struct('start', start, 'end', end, 'repl', '')) "
        f"WHEN 'partial' THEN transform({merge_ranges('mask')}, r -> named_struct('start', start + r.a, 'end', start + r.b, "
        f"'repl', repeat('*', r.b - r.a))) ELSE CAST(array() AS {_EDIT}) END"
    )


def spliced(text: str, edits: str, repl: str) -> str:
    """A text with sorted, disjoint ranges replaced, joined once from its pieces."""
    start = f"IF(i = 0, 0, get({edits}, i - 1).end)"
    stop = f"IF(i = size({edits}), tl, get({edits}, i).start)"
    pieces = f"transform(sequence(0, size({edits})), i -> concat({between('bs', start, stop)}, IF(i = size({edits}), '', get({edits}, i).{repl})))"
    return let("bs", text_blocks(text), let("tl", f"length({text})", f"array_join({pieces}, '')"))


def starred(text: str, finds: str) -> str:
    """A text with disjoint finds starred."""
    edits = f"transform(array_sort({finds}, (l, r) -> l.start - r.start), k -> named_struct('start', k.start, 'end', k.end, 'repl', repeat('*', k.end - k.start)))"
    return f"IF(size({finds}) = 0, {text}, {let('es', edits, spliced(text, 'es', 'repl'))})"


def redact_units(units: DataFrame, decided: DataFrame) -> DataFrame:
    """Every unit with its edits applied; untouched units pass through.

    The text is put together once from the pieces between the sorted, disjoint edits.
    """
    edits = decided.where("located AND method <> 'keep'").groupBy("doc_id", "unit_id").agg(
        F.expr(f"flatten(collect_list({_edits()}))").alias("edits")
    )
    apply = let("es", "array_sort(edits, (l, r) -> l.start - r.start)", spliced("text", "es", "repl"))
    return units.join(edits, ["doc_id", "unit_id"], "left").withColumn(
        "redacted", F.expr(f"IF(edits IS NULL, text, {apply})")
    ).drop("edits")


def visible_segments(units: DataFrame, decided: DataFrame) -> DataFrame:
    """Pieces of each unit between all span and mask borders, marked hidden or visible."""
    spans = decided.where("located").groupBy("doc_id", "unit_id").agg(
        F.collect_list(F.struct("start", "end", "method", "mask")).alias("spans")
    )
    borders = (
        "array_sort(array_distinct(filter(concat(array(0, length(text)), flatten(transform(spans, s -> concat(array(s.start, s.end), "
        "IF(s.method = 'partial', flatten(transform(s.mask, m -> array(s.start + m.a, s.start + m.b))), CAST(array() AS array<int>)))))), "
        "n -> n BETWEEN 0 AND length(text))))"
    )
    hides = (
        "exists(spans, s -> seg.start >= s.start AND seg.end <= s.end AND (s.method IN ('full', 'delete') OR (s.method = 'partial' "
        "AND exists(s.mask, m -> seg.start >= s.start + m.a AND seg.end <= s.start + m.b))))"
    )
    return (
        units.join(spans, ["doc_id", "unit_id"])
        .withColumn("b", F.expr(borders))
        .selectExpr("doc_id", "unit_id", "spans", "explode(transform(slice(b, 1, size(b) - 1), (x, i) -> named_struct('start', x, 'end', b[i + 1]))) AS seg")
        .selectExpr("doc_id", "unit_id", "seg.start AS start", "seg.end AS end", f"{hides} AS hidden")
    )


def hidden_positions(decided: DataFrame) -> DataFrame:
    """One row per character that a decision hides."""
    ranges = (
        "CASE WHEN method IN ('full', 'delete') THEN array(named_struct('a', start, 'b', end)) "
        f"WHEN method = 'partial' THEN transform({merge_ranges('mask')}, m -> named_struct('a', start + m.a, 'b', start + m.b)) END"
    )
    return decided.where("located AND method <> 'keep'").selectExpr("doc_id", "unit_id", "method", f"inline({ranges})").selectExpr(
        "doc_id", "unit_id", "method", "explode(sequence(a, b - 1)) AS idx"
    )


def redact_boxes(chars: DataFrame, decided: DataFrame) -> DataFrame:
    """Box of each hidden character, inset by a hundredth, black when starred, white when deleted."""
    hit = chars.join(hidden_positions(decided), ["doc_id", "unit_id", "idx"])
    inset = lambda lo, hi, out, sign: f"IF({hi} - {lo} > 0.02, {out} {sign} 0.01, {out}) AS {out}"
    return hit.selectExpr(
        "doc_id", "page", "unit_id", "idx", inset("x0", "x1", "x0", "+"), inset("y0", "y1", "y0", "+"),
        inset("x0", "x1", "x1", "-"), inset("y0", "y1", "y1", "-"), "IF(method = 'delete', 'white', 'black') AS colour",
    )


STRETCH = 65536


def islands(ranges: DataFrame, keys: list[str], width: int = STRETCH) -> DataFrame:
    """Ranges of each key joined where they touch or overlap; rows, not arrays.

    Ranges are scanned in stretches of ``width`` positions, of which only the furthest end and the last start are carried on, so
    a key with very many ranges is no task's whole work. Ranges with one start count as the longest of them.
    """
    key = ", ".join(keys)
    longest = ranges.where("0 <= a AND a < b").groupBy(*keys, "a").agg(F.max("b").alias("b"))
    rows = longest.withColumn("_stretch", F.expr(f"CAST(floor(a / {width}) AS BIGINT)"))
    here = f"OVER (PARTITION BY {key}, _stretch ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND"
    before = f"OVER (PARTITION BY {key} ORDER BY _stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ends = rows.groupBy(*keys, "_stretch").agg(F.max("b").alias("_end")).selectExpr(*keys, "_stretch", f"max(_end) {before} AS _carried")
    begun = rows.selectExpr("*", f"max(b) {here} 1 PRECEDING) AS _near").join(ends, [*keys, "_stretch"]).selectExpr(
        *keys, "_stretch", "a", "b", "IF(greatest(_near, _carried) IS NULL OR a > greatest(_near, _carried), a, NULL) AS _begins")
    starts = begun.groupBy(*keys, "_stretch").agg(F.max("_begins").alias("_last")).selectExpr(*keys, "_stretch", f"max(_last) {before} AS _open")
    named = begun.selectExpr("*", f"max(_begins) {here} CURRENT ROW) AS _own").join(starts, [*keys, "_stretch"]).withColumn("_island", F.coalesce("_own", "_open"))
    return named.groupBy(*keys, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")


def position_islands(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Contiguous ranges of character positions."""
    return islands(positions.where("pos >= 0").selectExpr(*keys, "pos AS a", "pos + 1 AS b"), keys)


def preset_previews(cands: DataFrame) -> DataFrame:
    """Every automatic preset of every candidate, rendered."""
    return cands.selectExpr("doc_id", "cand_id", "type", "value", f"explode({automatic_presets('type', 'value')}) AS (preset, ranges)").selectExpr(
        "doc_id", "cand_id", "type", "preset", "ranges", f"{mask_value('value', lit_partial(), 'ranges')} AS preview"
    )


def lit_partial() -> str:
    return "'partial'"
