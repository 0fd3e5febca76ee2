"""Queries over units, admission and outputs, with their SQL statements of the rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushmark.plans import fixtures as fx
from hushmark.sources import units as U


def kr_docs(spark, d):
    return fx.derive(spark, d, fx.DOCS)


def own_docs(spark, d):
    """The supplied documents under negative ids."""
    return fx.table(spark, d, "documents").selectExpr("-1 - doc_id AS doc_id", "text")


def kr_units(spark, d):
    return U.units_from_text(kr_docs(spark, d))


def all_units(spark, d):
    """Korean units plus the supplied documents, whose ids are made negative.

    The supplied documents stay in the splits that they have, unless the session says to deal them out (local sessions do).
    """
    wanted = spark.conf.get("spark.hushmark.inputPartitions", None)
    own = U.spread(own_docs(spark, d), int(wanted) if wanted else None)
    return U.units_from_text(kr_docs(spark, d).unionByName(own))


def parted_units(spark, d):
    """First line as page header, last as page footer."""
    return kr_units(spark, d).withColumn(
        "part",
        F.expr(f"CASE unit_seq WHEN 0 THEN 'word/header1.xml' WHEN {fx.N_LINES - 1} THEN 'word/footer1.xml' ELSE part END"),
    )


def a1(spark, d):
    turns = U.units_from_turns(fx.table(spark, d, "conversations")).selectExpr("'turn' AS origin", "*")
    lines = U.units_from_text(fx.table(spark, d, "documents")).selectExpr("'line' AS origin", "*")
    return lines.unionByName(turns).select("origin", "doc_id", "unit_seq", "unit_id", "text")


def a2(spark, d):
    return U.with_region(parted_units(spark, d)).select("doc_id", "unit_seq", "part", "region", "part_ord")


def a3(spark, d):
    return U.cell_grid(fx.derive(spark, d, fx.CELLS)).selectExpr("doc_id", "tbl", "row", "cell_ord", "span", "grid_col")


def a4(spark, d):
    chars = U.chars_from_lines(fx.derive(spark, d, fx.FORMS))
    return U.lines_from_chars(chars)


ADMIT = (
    "SELECT d.doc_id, CASE WHEN d.doc_id % 50 = 3 THEN '   ' WHEN d.doc_id % 50 = 4 THEN '' ELSE d.text END AS text, "
    "CAST(d.n_chars AS BIGINT) - 30 * (CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END) AS pages, "
    "CASE WHEN d.source = 'src2' THEN 'hwp' WHEN d.lang = 'fr' THEN 'docx' ELSE 'pdf' END AS format FROM documents d"
)


def a5(spark, d):
    return U.admission_gate(fx.derive(spark, d, ADMIT), 6000).selectExpr("doc_id", "coalesce(reject_reason, 'accepted') AS outcome")


def a6(spark, d):
    """The supplied pages, and for each one a page with capitals, a line feed inside a tag, and a longer tag name."""
    pages = fx.table(spark, d, "pages").select("page_id", "html")
    odd = pages.selectExpr("-1 - page_id AS page_id", "concat('<IMG SRC=x><a', chr(10), 'href=y><imgx><A name=z>') AS html")
    return U.uninspected_report(pages.unionByName(odd))


def a7(spark, d):
    docs = fx.table(spark, d, "documents")
    good = fx.table(spark, d, "labels").where("quality = 1").select("doc_id")
    allowed = docs.join(good, "doc_id").selectExpr("sha2(text, 256) AS sha256")
    return U.hash_allowlist(docs, allowed).select("doc_id", "sha256")


QUERIES = {
    "units_from_text": a1, "unit_region": a2, "cell_grid": a3, "line_bbox": a4, "admission_gate": a5,
    "uninspected_report": a6, "hash_allowlist": a7,
}

ORACLE = {
    "units_from_text": f"SELECT 'line' AS origin, * FROM ({fx.DOCUMENT_UNITS_DUCK}) UNION ALL "
                       "SELECT 'turn', conv_id, turn, '/turn#' || turn, text FROM conversations",
    "unit_region": f"""
        WITH p AS (SELECT doc_id, unit_seq, CASE WHEN unit_seq = 0 THEN 'word/header1.xml'
                     WHEN unit_seq = {fx.N_LINES - 1} THEN 'word/footer1.xml' ELSE 'word/document.xml' END AS part
                   FROM ({fx.KR_UNITS_DUCK}))
        SELECT doc_id, unit_seq, part, r.region, r.part_ord FROM p JOIN (VALUES ('word/header1.xml', 'header', 0),
            ('word/document.xml', 'body', 1), ('word/footer1.xml', 'footer', 2)) r(name, region, part_ord) ON part = name""",
    "cell_grid": f"""
        WITH c AS ({fx.CELLS}), s AS (SELECT *, CASE WHEN colspan < 1 THEN 1 WHEN colspan > 100 THEN 100 ELSE colspan END AS span FROM c)
        SELECT a.doc_id, a.tbl, a.row, a.cell_ord, a.span, 1 + coalesce(sum(b.span), 0) AS grid_col
        FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND a.tbl = b.tbl AND a.row = b.row AND b.cell_ord < a.cell_ord
        GROUP BY 1, 2, 3, 4, 5""",
    "line_bbox": f"SELECT doc_id, page, unit_id, text, x0, y0, x1, y1, length(replace(text, ' ', '')) AS n_nonspace FROM ({fx.FORMS})",
    "admission_gate": f"""
        WITH r AS (SELECT * FROM ({ADMIT})), t AS (
            SELECT doc_id, 1 AS o, 'empty' AS why FROM r WHERE strlen(text) = 0
            UNION ALL SELECT doc_id, 2, 'too_large' FROM r WHERE strlen(text) > 6000
            UNION ALL SELECT doc_id, 3, 'bad_format' FROM r WHERE format = 'hwp'
            UNION ALL SELECT doc_id, 4, 'page_range' FROM r WHERE pages NOT BETWEEN 1 AND 100
            UNION ALL SELECT doc_id, 5, 'no_text' FROM r WHERE trim(text) = ''
            UNION ALL SELECT doc_id, 6, 'accepted' FROM r)
        SELECT doc_id, arg_min(why, o) AS outcome FROM t GROUP BY doc_id""",
    "uninspected_report": """
        WITH p AS (SELECT page_id, replace(lower(html), chr(10), ' ') AS h FROM pages UNION ALL SELECT -1 - page_id, '<IMG SRC=x><a' || chr(10) || 'href=y><imgx><A name=z>' FROM pages)
        SELECT * FROM (SELECT page_id, item, CASE WHEN page_id < 0 THEN CASE item WHEN 'image' THEN 1 WHEN 'link' THEN 2 ELSE 0 END ELSE len(string_split(h, mark)) - 1 END AS n FROM p,
            (VALUES ('comment', '<!--'), ('image', '<img'), ('link', '<a '), ('script', '<script'), ('style', '<style')) v(item, mark))
        WHERE n > 0""",
    "hash_allowlist": """
        SELECT doc_id, sha256(text) AS sha256 FROM documents
        WHERE text IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 1)""",
}
