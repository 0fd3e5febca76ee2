"""Tables of text units, and which documents are let in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushmark import constants as K
from hushmark.functions.expr import squeezed

BODY = "word/document.xml"


def spread(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal documents to so many partitions, for an input of few splits; without a number it is left where it lies."""
    return docs if partitions is None else docs.repartition(partitions)


def units_from_text(docs: DataFrame, part: str = BODY) -> DataFrame:
    """One row per line of a document, empty lines kept; narrow, no shuffle."""
    return docs.select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("unit_seq", "text")
    ).select(
        "doc_id",
        "unit_seq",
        F.concat(F.lit(f"/{part}#"), F.col("unit_seq").cast("string")).alias("unit_id"),
        F.lit(part).alias("part"),
        "text",
    )


def units_from_turns(conversations: DataFrame) -> DataFrame:
    """One unit per conversation turn."""
    return conversations.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").cast("int").alias("unit_seq"),
        F.concat(F.lit("/turn#"), F.col("turn").cast("string")).alias("unit_id"),
        F.lit("turn").alias("part"),
        "text",
    )


def with_region(units: DataFrame) -> DataFrame:
    """Header, body or footer by part name, and the part's place in reading order."""
    part = F.col("part")
    region = F.when(part.startswith("word/header"), "header").when(part.startswith("word/footer"), "footer").otherwise("body")
    return units.withColumn("region", region).withColumn(
        "part_ord", F.when(F.col("region") == "header", 0).when(F.col("region") == "body", 1).otherwise(2)
    )


def cell_grid(cells: DataFrame) -> DataFrame:
    """Grid column of each table cell from the spans before it in its row.

    A cell counts once, however many paragraphs (rows) it has: rows of a cell are peers of the window's range, which
    ends before them, and only the first of them adds the span. The window runs inside one table row.
    """
    return cells.selectExpr(
        "*",
        "greatest(1, least(100, colspan)) AS span",
        "lag(cell_ord) OVER (PARTITION BY doc_id, tbl, row ORDER BY cell_ord, unit_id) <=> cell_ord AS _again",
    ).selectExpr(
        "*",
        "1 + coalesce(sum(IF(_again, 0, span)) OVER (PARTITION BY doc_id, tbl, row ORDER BY cell_ord "
        "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grid_col",
    ).drop("_again")


def lines_from_chars(chars: DataFrame) -> DataFrame:
    """Box and text of each line from its characters (a line is one group, bounded by the page)."""
    ordered = "array_sort(collect_list(struct(idx, c)))"
    return chars.groupBy("doc_id", "page", "unit_id").agg(
        F.expr(f"array_join(transform({ordered}, x -> x.c), '')").alias("text"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.expr("count_if(NOT c RLIKE '(?U)^\\\\s$')").alias("n_nonspace"),
    )


def chars_from_lines(lines: DataFrame, width: int = 10) -> DataFrame:
    """Characters of fixed width for lines that carry only a box."""
    return lines.selectExpr(
        "doc_id", "page", "unit_id", "y0", "y1", "x0 AS lx", "posexplode(regexp_extract_all(text, '(?s).', 0)) AS (idx, c)"
    ).selectExpr(
        "doc_id", "page", "unit_id", "idx", "c", f"lx + {width} * idx AS x0", "y0", f"lx + {width} * (idx + 1) AS x1", "y1"
    )


def reject_reason(size: str, text: str, pages: str, fmt: str, max_bytes: int = K.MAX_BYTES) -> Column:
    """First reason to refuse a document, NULL when it is let in."""
    return F.expr(
        f"CASE WHEN coalesce({size}, 0) = 0 THEN 'empty' WHEN {size} > {max_bytes} THEN 'too_large' "
        f"WHEN {fmt} IS NULL OR {fmt} NOT IN ('pdf', 'docx') THEN 'bad_format' "
        f"WHEN {pages} < 1 OR {pages} > {K.MAX_PAGES} THEN 'page_range' "
        f"WHEN {squeezed(text)} = '' THEN 'no_text' END"
    )


def admission_gate(docs: DataFrame, max_bytes: int = K.MAX_BYTES) -> DataFrame:
    """Adds reject_reason; needs text, pages and format columns."""
    return docs.withColumn("reject_reason", reject_reason("octet_length(text)", "text", "pages", "format", max_bytes))


def uninspected_report(pages: DataFrame) -> DataFrame:
    """Counts of the things in a page that text detection does not look into."""
    items = {"comment": "<!--", "image": "(?i)<img\\\\b", "link": "(?i)<a\\\\s", "script": "(?i)<script\\\\b", "style": "(?i)<style\\\\b"}
    entries = ", ".join(
        f"named_struct('item', '{name}', 'n', size(regexp_extract_all(html, '{mark}', 0)))" for name, mark in items.items()
    )
    return pages.selectExpr("page_id", f"inline(array({entries}))").where("n > 0")


def hash_allowlist(docs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Documents whose content hash is approved; names play no part.

    No hint: the optimizer broadcasts a small list by its size and shuffles a large one.
    """
    hashed = docs.withColumn("sha256", F.expr("sha2(text, 256)"))
    return hashed.join(allowed.select("sha256").distinct(), "sha256", "left_semi")
