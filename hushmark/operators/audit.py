"""Proof that masking worked, and accuracy against known truth."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hushmark import constants as K
from hushmark.functions.expr import lit, stripped
from hushmark.operators.literal import pairs
from hushmark.operators.matching import by_key, most_pairs


def verify_units(expected: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved text equals expected text for every unit; one failing row per broken unit."""
    left = expected.select("doc_id", "unit_id", F.col("text").alias("want"), F.lit(True).alias("wanted"))
    right = saved.select("doc_id", "unit_id", F.col("text").alias("got"), F.lit(True).alias("present"))
    joined = left.join(right, ["doc_id", "unit_id"], "full_outer")
    return joined.selectExpr(
        "doc_id", "unit_id",
        "CASE WHEN present IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'unexpected' WHEN NOT want <=> got THEN 'different' END AS fault",
    ).where("fault IS NOT NULL")


def verify_metadata(expected: DataFrame, saved: DataFrame) -> DataFrame:
    """Kept items equal, deleted ones gone, nothing new, item by item in both directions."""
    kept = expected.where("action = 'keep'").select("doc_id", "meta_id", "value")
    got = saved.select("doc_id", "meta_id", "value")
    lost = kept.exceptAll(got).selectExpr("doc_id", "meta_id", "'not_kept' AS fault")
    extra = got.exceptAll(kept).selectExpr("doc_id", "meta_id", "'left_over' AS fault")
    return lost.unionByName(extra)


def leak_scan(saved: DataFrame, decided: DataFrame) -> DataFrame:
    """Values masked in whole or in part that still stand whole anywhere in the saved copy, reported by hash."""
    masked = decided.where("located AND method IN ('full', 'delete', 'partial')").select("doc_id", "type", "value").distinct()
    found = pairs(saved, masked).select("doc_id", "unit_id", "value")
    return found.join(masked, ["doc_id", "value"]).selectExpr("doc_id", "unit_id", "type", "sha2(value, 256) AS value_hash")


def _cells(x: str, y: str, size: float, around: str) -> str:
    """Grid cells of a point; where ``around`` holds, every cell the tolerance can reach."""
    reach = lambda c: (f"IF({around}, sequence(CAST(floor(({c} - 0.35) / {size}) AS BIGINT), CAST(floor(({c} + 0.35) / {size}) AS BIGINT)), "  # noqa: E731
                       f"array(CAST(floor({c} / {size}) AS BIGINT)))")
    return f"flatten(transform({reach(x)}, gx -> transform({reach(y)}, gy -> struct(gx, gy))))"


_BOX = ["x0", "y0", "x1", "y1"]
_GIVEN = "side = 'source'"


def _most_matched(near: DataFrame) -> DataFrame:
    """doc_id, page, matched: most pairs of equal glyphs that are near each other, where rows are pairs of boxes with how many glyphs have each.

    A box that is near one other only, and that one near no third, gives a pair at once. Where several are near each other, a maximum matching
    decides, page by page and character by character, so a pairing that exists is never missed.
    """
    keys = ["doc_id", "page", "c"]
    here = f"OVER (PARTITION BY {', '.join(keys)}"
    told = near.selectExpr("*", f"count(*) {here}, {', '.join(_BOX)}) AS _outs", f"count(*) {here}, {', '.join('o' + b for b in _BOX)}) AS _ins")
    single = told.where("_outs = 1 AND _ins = 1").selectExpr("doc_id", "page", "least(n, n_out) AS matched")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for (doc_id, page, _), rows in by_key(batches, keys):
            left: dict[tuple, int] = {}
            right: dict[tuple, int] = {}
            have, room, edges = [], [], []
            for row in rows:
                ends = []
                for index, counts, n, names in ((left, have, row["n"], _BOX), (right, room, row["n_out"], ["o" + b for b in _BOX])):
                    box = tuple(row[b] for b in names)
                    if box not in index:
                        index[box] = len(counts)
                        counts.append(n)
                    ends.append(index[box])
                edges.append(tuple(ends))
            found.append((doc_id, page, most_pairs(edges, have, room)))
        columns = list(zip(*found, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "page", "matched"])

    kinds = [to_arrow_type(single.schema[c].dataType) for c in ("doc_id", "page", "matched")]
    tangled = told.where("_outs > 1 OR _ins > 1").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(match, single.schema)
    return single.unionByName(tangled).groupBy("doc_id", "page").agg(F.sum("matched").alias("matched"))


def glyph_check(source: DataFrame, saved: DataFrame, hidden: DataFrame) -> DataFrame:
    """Every hidden glyph is gone and every other glyph is there exactly once, per page.

    ``hidden`` holds (doc_id, unit_id, idx). Glyphs of one box count together, and boxes meet in grid cells, so a page is never
    compared with itself pair by pair. Glyphs and marks of a document, which the admission gate bounds, are brought together once; all
    that follows is grouped within that partitioning, so no glyph is shuffled again.
    """
    ink = f"NOT c RLIKE {lit('(?U)^' + chr(92) + 's$')}"
    given = source.where(ink).select("doc_id", "page", "unit_id", "idx", "c", *_BOX, F.lit("source").alias("side"))
    found = saved.where(ink).select("doc_id", "page", "c", *_BOX, F.lit("saved").alias("side"))
    marks = hidden.select("doc_id", "unit_id", "idx", F.lit("mark").alias("side")).where("unit_id IS NOT NULL AND idx IS NOT NULL")
    every = given.unionByName(found, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True).where("doc_id IS NOT NULL").repartition("doc_id")
    told = every.selectExpr("*", "side = 'source' AND bool_or(side = 'mark') OVER (PARTITION BY doc_id, unit_id, idx) AS hide").where("side <> 'mark'")
    boxes = told.groupBy("doc_id", "page", "c", *_BOX, "side", "hide").agg(F.count(F.lit(1)).alias("n"))
    pages = ["doc_id", "page"]

    centred = boxes.where("page IS NOT NULL").selectExpr(*pages, "hide", "side", "n", "(x0 + x1) / 2.0 AS cx", "(y0 + y1) / 2.0 AS cy").where("hide OR side = 'saved'").groupBy(
        *pages, "hide", "cx", "cy").agg(F.sum("n").alias("n"))
    centres = centred.selectExpr(*pages, "hide", "cx", "cy", "n", f"inline({_cells('cx', 'cy', 8, 'hide')})").groupBy(*pages, "gx", "gy").agg(
        F.expr("collect_list(struct(cx, cy, n)) FILTER (WHERE hide)").alias("gone"), F.expr("collect_list(struct(cx AS ocx, cy AS ocy)) FILTER (WHERE NOT hide)").alias("there"))
    leaks = centres.where("size(gone) > 0 AND size(there) > 0").selectExpr(*pages, "there", "inline(gone)").selectExpr(*pages, "cx", "cy", "n", "inline(there)").where(
        "abs(cx - ocx) <= 0.35 AND abs(cy - ocy) <= 0.35")
    leaked = leaks.groupBy(*pages, "cx", "cy").agg(F.first("n").alias("n")).groupBy(*pages).agg(F.sum("n").alias("leaked"))

    out = ", ".join(f"{b} AS o{b}" for b in _BOX)
    here = boxes.where("NOT hide AND page IS NOT NULL").selectExpr(*pages, "c", *_BOX, "side", "n", f"inline({_cells('x0', 'y0', 8, _GIVEN)})").groupBy(
        *pages, "c", "gx", "gy").agg(
        F.expr(f"collect_list(struct({', '.join(_BOX)}, n)) FILTER (WHERE side = 'source')").alias("given"),
        F.expr(f"collect_list(struct({out}, n AS n_out)) FILTER (WHERE side = 'saved')").alias("found"))
    near = here.where("size(given) > 0 AND size(found) > 0").selectExpr(*pages, "c", "found", "inline(given)").selectExpr(
        *pages, "c", *_BOX, "n", "inline(found)").where(" AND ".join(f"abs({b} - o{b}) <= 0.35" for b in _BOX))
    paired = _most_matched(near)

    totals = boxes.groupBy(*pages).agg(F.expr("sum(n) FILTER (WHERE side = 'source' AND NOT hide) AS wanted"), F.expr("sum(n) FILTER (WHERE side = 'saved') AS present"),
                                       F.expr("bool_or(side = 'source') AS has_source"))
    # A page without a number, or of no document, is no other page's: what is wanted there and what is present stand apart.
    apart = "filter(array(IF(has_source, struct(wanted, 0L AS present), NULL), IF(present IS NOT NULL, struct(0L AS wanted, present), NULL)), s -> s IS NOT NULL)"
    counted = totals.selectExpr(*pages, f"inline(IF(page IS NOT NULL, array(struct(wanted, present)), {apart}))")
    for side, wanted, present in ((given, "count(*)", "0L"), (found, "0L", "count(*)")):
        lone = side.where("doc_id IS NULL").groupBy(*pages).agg(F.expr(f"{wanted} AS wanted"), F.expr(f"{present} AS present"))
        counted = counted.unionByName(lone)
    return counted.join(leaked, pages, "left").join(paired, pages, "left").selectExpr(
        *pages, "coalesce(leaked, 0) AS leaked", "coalesce(wanted, 0) - coalesce(matched, 0) AS lost",
        "coalesce(present, 0) - coalesce(matched, 0) AS left_over").withColumn("passed", F.expr("leaked = 0 AND lost = 0 AND left_over = 0"))


def copy_review(found: DataFrame, decided: DataFrame) -> DataFrame:
    """Finds on the redacted copy, all-mask spans ignored, planned keeps marked."""
    real = found.where(f"translate({stripped('value')}, {lit(K.OPAQUE_GLYPHS)}, '') <> ''")
    keeps = decided.where("method = 'keep'").select("doc_id", "type", "value").distinct().withColumn("_keep", F.lit(True))
    return real.join(keeps, ["doc_id", "type", "value"], "left").withColumn("planned_keep", F.expr("coalesce(_keep, false)")).drop("_keep")


def bare_account(value: str) -> str:
    """Account truth without the bank's name in front."""
    return f"regexp_replace({value}, '(?U)^[가-힣]+\\\\s+', '')"


def detection_audit(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Expected, detected, matched, missed and extra as multisets, by type, document and in total.

    Both sides are counted before they meet, so repeated values cost one row.
    """
    wanted = truth.selectExpr("doc_id", "type", f"IF(type = 'account', {bare_account('value')}, value) AS value").groupBy(
        "doc_id", "type", "value").agg(F.count(F.lit(1)).alias("w"))
    got = found.groupBy("doc_id", "type", "value").agg(F.count(F.lit(1)).alias("g"))
    met = wanted.join(got, ["doc_id", "type", "value"], "full_outer").selectExpr(
        "doc_id", "type", "coalesce(w, 0) AS w", "coalesce(g, 0) AS g")
    return met.rollup("type", "doc_id").agg(
        F.sum("w").alias("expected"), F.sum("g").alias("detected"), F.expr("sum(least(w, g)) AS matched"),
        F.expr("sum(greatest(w - g, 0)) AS missed"), F.expr("sum(greatest(g - w, 0)) AS extra"))


def negative_controls(found: DataFrame, negatives: DataFrame) -> DataFrame:
    """Detections that equal a listed value that is not personal."""
    return found.join(negatives.select("doc_id", "value").distinct(), ["doc_id", "value"], "left_semi")


def hash_manifest(manifest: DataFrame, content: DataFrame) -> DataFrame:
    """Recorded against recomputed content hashes; missing and unlisted paths fail."""
    actual = content.selectExpr("path", "sha2(text, 256) AS actual")
    return manifest.select("path", "sha256").join(actual, "path", "full_outer").selectExpr(
        "path", "CASE WHEN actual IS NULL THEN 'missing' WHEN sha256 IS NULL THEN 'unlisted' WHEN sha256 <> actual THEN 'changed' ELSE 'ok' END AS outcome")


def checks_rollup(artifacts: DataFrame, checks: DataFrame) -> DataFrame:
    """A copy is valid when all its checks pass and its versions agree with the document's."""
    every = checks.groupBy("doc_id", "version").agg(F.expr("bool_and(passed) AS passed"), F.count(F.lit(1)).alias("n_checks"))
    return artifacts.join(every, ["doc_id", "version"], "left").selectExpr(
        "doc_id", "version", "coalesce(n_checks, 0) AS n_checks",
        "coalesce(passed, false) AND version = doc_version AND validation_version = doc_version AS valid")


def verify_geometry(source: DataFrame, saved: DataFrame) -> DataFrame:
    """Page count, page box and rotation unchanged, per document."""
    box = ["width", "height", "rotation"]
    left = source.select("doc_id", "page", F.struct(*box).alias("a"))
    right = saved.select("doc_id", "page", F.struct(*box).alias("b"))
    return left.join(right, ["doc_id", "page"], "full_outer").groupBy("doc_id").agg(
        F.expr("count(a) = count(b) AS same_pages"), F.expr("bool_and(a <=> b) AS same_geometry"))
