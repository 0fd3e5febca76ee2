"""Find values literally in the units of their own document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark.functions.expr import let, lit, running_sums
from hushmark.session import stored

#: A document with so many distinct values at most hands them to its units; beyond that, values are looked up by keys.
FEW = 64
#: Characters of a key: those of long values, and of values shorter than that. Values below the second are looked for one by one.
GRAMS = (8, 3)
#: Bits of a document's key filter, the size of Spark's bitmaps.
FILTER_BITS = 32768
#: Shares that the values and units of a document of many values are dealt to, so that no task has all of them.
SHARES = 64
_QUOTED = "concat('\\\\Q', replace({v}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')"


def occurrences(text: str, value: str, disjoint: bool = False, before: str = "", after: str = "") -> str:
    """Start offsets of a value in a text: every one, or left to right without overlap.

    ``before`` and ``after`` are patterns of what must stand around it, for every one only. The text is cut at the hits and piece lengths are
    summed: linear in the text and the hits. A value that stands there once, as most do, is found without a pattern, which each row would compile anew.
    """
    quoted = _QUOTED.format(v=value)
    pattern = quoted if disjoint else f"concat({lit(before + '(?=')}, {quoted}, {lit(after + ')')})"
    pieces = f"split(regexp_replace(translate({text}, '\u0001', ' '), {pattern}, '\u0001'), '\u0001', -1)"
    starts = let("ls", "transform(slice(p, 1, size(p) - 1), y -> length(y))", running_sums("ls"))
    if disjoint:
        starts = f"transform({starts}, (y, k) -> y + k * length({value}))"
    every = let("p", pieces, f"IF(size(p) = 1, CAST(array() AS array<int>), {starts})")
    if before or after:
        return every
    once = f"lc > 0 AND locate({value}, {text}, lc + 1) = 0 AND NOT contains({text}, '\u0001')"
    return let("lc", f"locate({value}, {text})", f"IF({once}, array(lc - 1), {every})")


def _grams(text: str, width: int) -> str:
    return f"array_distinct(transform(regexp_extract_all({text}, '(?s)(?=(.{{{width}}}))', 1), g -> xxhash64(g)))"


def _shares(docs: DataFrame) -> DataFrame:
    """doc_id, _share: every share of these documents."""
    return docs.selectExpr("doc_id", f"explode(sequence(0, {SHARES - 1})) AS _share")


def _keyed(values: DataFrame) -> DataFrame:
    """The columns of the values, width, _h: the hash of the piece of each value that the fewest values of its document share.

    Pieces are counted before they are shuffled and dealt by their hashes: a window over a document's pieces would hold all of them in one task.
    """
    parts = None
    for width, test in zip(GRAMS, (f"length(value) >= {GRAMS[0]}", f"length(value) >= {GRAMS[1]} AND length(value) < {GRAMS[0]}"), strict=True):
        part = values.where(test).selectExpr("*", f"{width} AS width", f"explode({_grams('value', width)}) AS _h")
        parts = part if parts is None else parts.unionByName(part)
    shared = parts.groupBy("doc_id", "width", "_h").agg(F.count(F.lit(1)).alias("_n"))
    carried = [c for c in values.columns if c not in ("doc_id", "value")]
    return parts.join(shared, ["doc_id", "width", "_h"]).groupBy("doc_id", "value", "width").agg(
        F.expr("min_by(_h, struct(_n, _h))").alias("_h"), *[F.first(c).alias(c) for c in carried])


def _by_key(rows: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, _row, _item: what units (doc_id, _row, text) may contain of very many values (doc_id, value, _item).

    A bitmap of the document's keys, of fixed size, rides along with its units, so only hashes of text that may be a key leave their
    row and meet the values by key. Values too short to have one meet all units of their document.
    """
    keyed = stored(_keyed(values), "keys")
    bits = keyed.groupBy("doc_id").pivot("width", list(GRAMS)).agg(F.expr(f"bitmap_construct_agg(pmod(_h, {FILTER_BITS}))"))
    # As whole numbers of four bytes, the first byte uppermost, made once a document: a test of a bit is no text then.
    number = "transform(sequence(0, octet_length({0}) DIV 4 - 1), i -> CAST(conv(hex(substring({0}, i * 4 + 1, 4)), 16, 10) AS BIGINT))"
    bits = bits.select("doc_id", *[F.expr(number.format(f"`{w}`")).alias(f"_bits{w}") for w in GRAMS])
    place = f"CAST(pmod(h, {FILTER_BITS}) AS INT)"
    listed = f"bit_get({{bits}}[{place} DIV 32], 24 - {place} DIV 8 % 4 * 8 + {place} % 8) = 1"
    found = [
        f"transform(IF(_bits{w} IS NULL, CAST(array() AS array<bigint>), filter({_grams('text', w)}, h -> {listed.format(bits=f'_bits{w}')})), h -> named_struct('width', {w}, '_h', h))"
        for w in GRAMS
    ]
    may = rows.join(bits, "doc_id").selectExpr("doc_id", "_row", f"inline(concat({', '.join(found)}))")
    short = values.where(f"length(value) < {GRAMS[1]}").groupBy("doc_id").agg(F.collect_list("_item").alias("_short"))
    beside = rows.join(short, "doc_id").selectExpr("doc_id", "_row", "explode(filter(_short, v -> contains(text, v.value))) AS _item")
    return may.join(keyed, ["doc_id", "width", "_h"]).select("doc_id", "_row", "_item").unionByName(beside)


def with_values(units: DataFrame, values: DataFrame, carried: list[str] | None = None, keep_all: bool = False) -> DataFrame:
    """Units with ``_values``: structs of the values of their document, and the columns carried with each, that they may contain.

    ``values`` has a row per doc_id and value. Where a document has few, they all ride along with its units; where it has many, a unit gets those that it meets by keys of the
    rarest piece of each value. Each way brings all that it contains. ``keep_all`` keeps units without any.
    """
    items = values.select("doc_id", "value", F.struct("value", *(carried or [])).alias("_item"))
    counts = values.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    crowded = counts.where(f"_n > {FEW}").select("doc_id")
    if crowded.isEmpty():
        return units.join(items.groupBy("doc_id").agg(F.collect_list("_item").alias("_values")), "doc_id", "left" if keep_all else "inner")
    crowded = stored(crowded, "crowded")
    shares = _shares(crowded)
    lists = items.join(crowded, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_list("_item").alias("_values"))
    many = items.withColumn("_share", F.expr(f"pmod(xxhash64(value), {SHARES})")).join(shares, ["doc_id", "_share"], "left_semi").drop("_share")
    named = [f.name for f in units.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    apart = units.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in named])).withColumn("_share", F.expr(f"pmod(_row, {SHARES})")).join(
        shares, ["doc_id", "_share"], "left_semi").drop("_share")
    met = _by_key(apart.select("doc_id", "_row", "text"), many)
    by_row = met.groupBy("doc_id", "_row").agg(F.collect_set("_item").alias("_values"))
    rest = units.join(crowded, "doc_id", "left_anti").join(lists, "doc_id", "left" if keep_all else "inner")
    return rest.unionByName(apart.join(by_row, ["doc_id", "_row"], "left" if keep_all else "inner").drop("_row").select(*rest.columns))


def pairs(units: DataFrame, values: DataFrame) -> DataFrame:
    """Units with each distinct value of their document that they contain."""
    distinct = stored(values.select("doc_id", "value").where("value <> ''").distinct(), "values")
    return with_values(units, distinct).selectExpr(*[f"`{c}`" for c in units.columns], "explode(filter(transform(_values, v -> v.value), v -> contains(text, v))) AS value")


def locate(units: DataFrame, values: DataFrame, disjoint: bool = False) -> DataFrame:
    """Every place of each distinct value in the units of its document."""
    found = pairs(units, values)
    return found.selectExpr("*", f"explode({occurrences('text', 'value', disjoint)}) AS start").selectExpr(
        "*", "start + length(value) AS end"
    )
