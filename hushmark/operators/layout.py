"""Fields found through page layout: address blocks, table columns, wrapped addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark import constants as K
from hushmark.functions.expr import lit, squeezed, stripped, trimmed_start
from hushmark.functions.validate import column_kind, label_type, valid_column, valid_value
from hushmark.operators.joins import interval_join

_NO_ALTS = "CAST(array() AS array<string>) AS alts"


def address_row_label(lines: DataFrame, today: str) -> DataFrame:
    """Address lines beside a label whose centre lies within one line height (raw finds)."""
    values = lines.selectExpr("*", f"{stripped('text')} AS value", f"{trimmed_start('text')} AS start").where(
        valid_value(lit("address"), "value", today)
    )
    labels = lines.where(f"{label_type('text')} = 'address'").selectExpr(
        "doc_id", "page", "unit_id", "unit_seq", f"{trimmed_start('text')} AS ps",
        f"{trimmed_start('text')} + length({stripped('text')}) AS pe", "x1", "y0", "y1",
    )
    centre = "(y0 + y1) / 2.0"
    pairs = interval_join(
        values, labels, ["doc_id", "page"], (f"{centre} - (y1 - y0)", f"{centre} + (y1 - y0)"),
        (f"{centre} - (y1 - y0)", f"{centre} + (y1 - y0)"), 64,
        "r_x1 < x0 AND abs((r_y0 + r_y1 - y0 - y1) / 2.0) <= greatest(y1 - y0, r_y1 - r_y0)",
    )
    first = pairs.groupBy("doc_id", "unit_seq", "unit_id", "page", "start", "value").agg(
        F.expr("min_by(named_struct('u', r_unit_id, 'a', r_ps, 'b', r_pe), r_unit_seq)").alias("p")
    )
    return first.selectExpr(
        "doc_id", "unit_seq", "unit_id", "page", "7 AS prio", "0L AS ord", "start", "start + length(value) AS end",
        "'address' AS type", "value", _NO_ALTS, "'same_row_label_multiline' AS relation", "p.u AS proof_unit",
        "p.a AS proof_start", "p.b AS proof_end",
    )


def address_continuation(lines: DataFrame, addresses: DataFrame) -> DataFrame:
    """The detail line right under a found address, linked to it (raw finds plus group_id)."""
    found = addresses.where("type = 'address'").select(
        "doc_id", "unit_id", "cand_id", "start", "proof_unit", "proof_start", "proof_end"
    )
    boxes = lines.select("doc_id", "page", "unit_id", "unit_seq", "text", "x0", "y0", "x1", "y1")
    heads = found.join(boxes.drop("text"), ["doc_id", "unit_id"])
    pairs = interval_join(
        heads, boxes, ["doc_id", "page"], ("y1", "y1 + (y1 - y0) * 1.5"), ("y0", "y0"), 64, "abs(r_x0 - x0) <= 2"
    )
    below = pairs.groupBy("doc_id", "page", "unit_seq", "cand_id", "start", "proof_unit", "proof_start", "proof_end").agg(
        F.expr("min_by(named_struct('u', r_unit_id, 's', r_unit_seq, 't', r_text), struct(r_y0, r_unit_seq))").alias("n")
    )
    value = stripped("n.t")
    return below.selectExpr(
        "doc_id", "n.s AS unit_seq", "n.u AS unit_id", "page", "8 AS prio",
        "CAST(unit_seq AS BIGINT) * 4294967296L + start AS ord", f"{trimmed_start('n.t')} AS start",
        f"{value} AS value", "proof_unit", "proof_start", "proof_end", "cand_id AS group_id",
    ).where(
        f"length(value) BETWEEN 4 AND 100 AND value RLIKE {lit(K.ADDRESS_DETAIL)} AND {label_type('value')} IS NULL"
    ).selectExpr(
        "doc_id", "unit_seq", "unit_id", "page", "prio", "ord", "start", "start + length(value) AS end", "'address' AS type",
        "value", _NO_ALTS, "'address_continuation' AS relation", "proof_unit", "proof_start", "proof_end", "group_id",
    )


def layout_rows(lines: DataFrame) -> DataFrame:
    """Physical rows: a new row starts more than 3 points below the row's first line.

    Only the distinct heights of a page are gathered, after partial aggregation.
    """
    fold = (
        "aggregate(array_sort(ys), named_struct('top', CAST(NULL AS DOUBLE), 'n', 0, 'rows', "
        "CAST(array() AS array<struct<y:double,row_no:int,top:double>>)), (acc, y) -> "
        "IF(acc.top IS NULL OR abs(y - acc.top) > 3, "
        "named_struct('top', y, 'n', acc.n + 1, 'rows', concat(acc.rows, array(named_struct('y', y, 'row_no', acc.n + 1, 'top', y)))), "
        "named_struct('top', acc.top, 'n', acc.n, 'rows', concat(acc.rows, array(named_struct('y', y, 'row_no', acc.n, 'top', acc.top))))), "
        "acc -> acc.rows)"
    )
    tops = lines.groupBy("doc_id", "page").agg(F.collect_set(F.col("y0").cast("double")).alias("ys"))
    placed = tops.selectExpr("doc_id", "page", f"map_from_entries(transform({fold}, r -> struct(r.y, struct(r.row_no, r.top)))) AS _rows")
    # The join keeps the rows of a page together, so that the rules on rows need no further exchange.
    return lines.join(placed, ["doc_id", "page"]).withColumn("_row", F.expr("_rows[CAST(y0 AS DOUBLE)]")).selectExpr(
        *[c for c in lines.columns], "_row.row_no AS row_no", "_row.top AS top")


_ROW = "PARTITION BY doc_id, page, row_no"


def _with_headers(rows: DataFrame) -> DataFrame:
    """Adds kind, is_header (of the row), col_no and left_edge."""
    return rows.withColumn("kind", F.expr(column_kind("text"))).selectExpr(
        "*", f"count(*) OVER ({_ROW}) AS _n", f"count(kind) OVER ({_ROW}) AS _known", f"size(collect_set(kind) OVER ({_ROW})) AS _kinds",
        f"row_number() OVER ({_ROW} ORDER BY x0, unit_seq) AS col_no", "x0 - 2 AS left_edge",
    ).withColumn("is_header", F.expr("_n >= 3 AND _n = _known AND _n = _kinds")).drop("_n", "_known", "_kinds")


def table_headers(rows: DataFrame) -> DataFrame:
    """Rows of at least three cells, all recognised and all different."""
    return _with_headers(rows).where("is_header").drop("is_header")


def table_column_fields(lines: DataFrame, today: str, chars: DataFrame | None = None) -> DataFrame:
    """Values of rows that keep to the columns of an unbroken table (raw finds).

    All steps are windows within a page, on rows that ``layout_rows`` has already brought together. Characters, where
    given, are put into one array a line beforehand; a line without characters is placed by its box.
    """
    if chars is not None:
        ink = chars.where(f"NOT c RLIKE '(?U)^{chr(92) * 2}s$'").groupBy("doc_id", "page", "unit_id").agg(
            F.expr("collect_list(struct(idx, (x0 + x1) / 2.0 AS centre))").alias("ink"))
        lines = lines.join(ink, ["doc_id", "page", "unit_id"], "left")
    else:
        lines = lines.withColumn("ink", F.lit(None).cast("array<struct<idx:int,centre:double>>"))
    headed = _with_headers(layout_rows(lines))
    column = "named_struct('col_no', col_no, 'left_edge', CAST(left_edge AS DOUBLE), 'kind', kind, 'head_unit', unit_id, 'head_text', text)"
    shaped = headed.selectExpr(
        "*", f"IF(is_header, array_sort(collect_list(IF(is_header, {column}, NULL)) OVER ({_ROW})), NULL) AS own_columns",
        f"max(y1 - y0) OVER ({_ROW}) AS height", f"max(y1) OVER ({_ROW}) AS bottom",
    )
    page = "PARTITION BY doc_id, page ORDER BY row_no"
    under = shaped.selectExpr(
        "*", f"last(IF(is_header, named_struct('row_no', row_no, 'cols', own_columns, 'height', height), NULL), true) OVER ({page}) AS head",
        f"max(bottom) OVER ({page} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev_bottom",
    ).where("NOT is_header AND head IS NOT NULL").selectExpr(
        "doc_id", "page", "row_no", "unit_id", "unit_seq", "text", "x0", "x1", "ink", "head.row_no AS head_row", "head.cols AS cols",
        "top - prev_bottom > greatest(24, head.height * 3) AS gap")
    cell = "struct<col_no:int,start:int,end:int,value:string>"
    by_ink = (
        "transform(filter(transform(sequence(1, size(cols)), n -> named_struct('n', n, 'own', filter(ink, c -> size(filter(cols, h -> h.left_edge <= c.centre)) = n))), g -> size(g.own) > 0), "
        "g -> named_struct('col_no', g.n, 'start', array_min(transform(g.own, c -> c.idx)), 'end', array_max(transform(g.own, c -> c.idx)) + 1, "
        "'value', substring(text, array_min(transform(g.own, c -> c.idx)) + 1, array_max(transform(g.own, c -> c.idx)) + 1 - array_min(transform(g.own, c -> c.idx)))))"
    )
    nth = "size(filter(cols, h -> h.left_edge <= x0))"
    by_box = (
        f"IF({nth} > 0 AND ({nth} = size(cols) OR x1 <= get(cols, {nth}).left_edge), array(named_struct('col_no', {nth}, 'start', {trimmed_start('text')}, "
        f"'end', {trimmed_start('text')} + length({stripped('text')}), 'value', {stripped('text')})), CAST(array() AS array<{cell}>))"
    )
    cells = under.withColumn("cells", F.expr(f"IF(ink IS NULL, {by_box}, {by_ink})")).selectExpr(
        "* EXCEPT (ink, cells, x0, x1)", "explode_outer(cells) AS cell")
    typed = cells.selectExpr("*", "cols[cell.col_no - 1] AS head", "size(cols) AS n_cols").selectExpr(
        "*", f"cell IS NULL OR coalesce({valid_column('head.kind', 'cell.value', today)}, false) AS fits")
    judged = typed.selectExpr(
        "*", f"bool_and(fits) OVER ({_ROW}) AND count(cell) OVER ({_ROW}) = n_cols AND size(collect_set(cell.col_no) OVER ({_ROW})) = n_cols AS good")
    kept = judged.selectExpr(
        "*", "bool_or(gap OR NOT good) OVER (PARTITION BY doc_id, page, head_row ORDER BY row_no) AS stopped"
    ).where("NOT stopped AND cell IS NOT NULL AND head.kind NOT IN ('number', 'phone', 'email')")
    return kept.selectExpr(
        "doc_id", "unit_seq", "unit_id", "page", "9 AS prio", "CAST(row_no AS BIGINT) * 4294967296L + cell.col_no AS ord", "cell.start AS start", "cell.end AS end",
        "head.kind AS type", "cell.value AS value", _NO_ALTS, "'table_column_header' AS relation", "head.head_unit AS proof_unit",
        f"{trimmed_start('head.head_text')} AS proof_start",
        f"{trimmed_start('head.head_text')} + length({stripped('head.head_text')}) AS proof_end",
    )


def readable_lines(lines: DataFrame, chars: DataFrame) -> DataFrame:
    """Lines of pages where every non-blank line agrees with its characters, and all boxes have an inside."""
    spelled = chars.groupBy("doc_id", "page", "unit_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(idx, c))), x -> x.c), '')").alias("spelled"),
        F.min("x0").alias("cx0"), F.min("y0").alias("cy0"), F.max("x1").alias("cx1"), F.max("y1").alias("cy1"),
        F.expr("bool_and(coalesce(x0 < x1 AND y0 < y1, false)) AS solid"),
    )
    checked = lines.where("text RLIKE '(?U)\\\\S'").join(spelled, ["doc_id", "page", "unit_id"], "left").withColumn(
        "ok", F.expr("coalesce(spelled = text AND solid AND x0 < x1 AND y0 < y1 AND cx0 >= x0 - 0.01 AND cy0 >= y0 - 0.01 AND cx1 <= x1 + 0.01 AND cy1 <= y1 + 0.01, false)")
    )
    bad = checked.where("NOT ok").select("doc_id", "page").distinct()
    return checked.drop("spelled", "solid", "cx0", "cy0", "cx1", "cy1", "ok").join(bad, ["doc_id", "page"], "left_anti")


def _follow(chains: DataFrame, lines: DataFrame) -> DataFrame:
    """Append the only next line under each chain; rival lines within a point end the chain."""
    nexts = lines.selectExpr("doc_id", "page", "unit_id", "unit_seq", "x0", "y0", "y1", "norm", "value", "lead")
    pairs = interval_join(
        chains, nexts, ["doc_id", "page"], ("last_y1 - 0.01", "last_y1 + least(24, last_h * 1.6)"), ("y0", "y0"), 64,
        "NOT array_contains(ids, r_unit_id) AND abs(r_x0 - x0) <= greatest(2, least(last_h, r_y1 - r_y0) * 0.4)",
    )
    keys = ["doc_id", "page", "unit_id"]
    near = pairs.groupBy(*keys).agg(F.expr(
        "slice(array_sort(collect_list(struct(r_y0 AS y0, r_unit_seq AS seq, r_unit_id AS id, r_y1 AS y1, r_norm AS norm, r_value AS value, r_lead AS lead))), 1, 2)"
    ).alias("nx")).where("size(nx) = 1 OR abs(nx[0].y0 - nx[1].y0) > 1")
    return chains.join(near, keys).selectExpr(
        *keys, "x0", "nx[0].y1 AS last_y1", "nx[0].y1 - nx[0].y0 AS last_h", "concat(norm, nx[0].norm) AS norm",
        "concat(ids, array(nx[0].id)) AS ids",
        "concat(parts, array(named_struct('unit_id', nx[0].id, 'start', nx[0].lead, 'end', nx[0].lead + length(nx[0].value), 'value', nx[0].value))) AS parts",
    )


def ground_multiline(lines: DataFrame, chars: DataFrame, records: DataFrame) -> DataFrame:
    """Spans of addresses wrapped over two or three aligned lines; any ambiguity yields none.

    Chains depend on the page only, so they are built once and joined to the records by text.
    """
    clean = readable_lines(lines, chars).selectExpr(
        "*", f"{squeezed('text')} AS norm", f"{stripped('text')} AS value", f"{trimmed_start('text')} AS lead"
    )
    ones = clean.selectExpr(
        "doc_id", "page", "unit_id", "x0", "y1 AS last_y1", "y1 - y0 AS last_h", "norm", "array(unit_id) AS ids",
        "array(named_struct('unit_id', unit_id, 'start', lead, 'end', lead + length(value), 'value', value)) AS parts",
    )
    twos = _follow(ones, clean)
    threes = _follow(twos, clean)
    chains = twos.unionByName(threes).select("doc_id", "norm", "parts")
    wanted = records.select("doc_id", "value").distinct().selectExpr("doc_id", "value AS linked_value", f"{squeezed('value')} AS norm")
    matched = wanted.join(chains, ["doc_id", "norm"])
    unique = matched.groupBy("doc_id", "linked_value").agg(F.count(F.lit(1)).alias("n"), F.first("parts").alias("parts")).where("n = 1")
    identity = (
        "concat('[', array_join(transform(parts, p -> concat('[\"', p.unit_id, '\",', CAST(p.start AS STRING), ',', CAST(p.end AS STRING), ']')), ','), ']')"
    )
    return unique.selectExpr(
        "doc_id", "linked_value", f"concat('address_', substr(sha2({identity}, 256), 1, 24)) AS link_group",
        "size(parts) AS link_count", "posexplode(parts) AS (i, part)",
    ).selectExpr("doc_id", "linked_value", "link_group", "i + 1 AS link_index", "link_count", "part.unit_id AS unit_id",
                 "part.start AS start", "part.end AS end", "part.value AS value")
