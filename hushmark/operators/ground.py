"""Records of an outside extraction service, tied to literal spans of the units."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark import constants as K
from hushmark.functions.expr import full_match, let, squeezed, stripped, words
from hushmark.functions.ids import candidate_id, json_text, unresolved_id
from hushmark.operators.joins import block_rank
from hushmark.operators.literal import locate, pairs
from hushmark.operators.matching import Taken
from hushmark.session import cut, stored

SERVICE = "service"


def _items(kind: str) -> str:
    return f"try_variant_get(v, '$.{kind}', 'array<variant>')"


def _is(path_value: str, kind: str) -> str:
    return f"coalesce(schema_of_variant({path_value}) LIKE '{kind}%', false)"


def _item_fault(rank: int, kind: str) -> str:
    """The first fault among the items ``a[rank]`` of a kind; what is wrong is only told apart where something is."""
    def text(field: str) -> str:
        return _is(f"variant_get(x, '$.{field}')", "STRING")

    checks = [
        (f"NOT {_is('x', 'OBJECT')}", "item_not_object"),
        (f"NOT ({text('raw_value')} AND variant_get(x, '$.raw_value', 'string') <> '')", "raw_value"),
        (f"NOT {text('role_raw')}", "role_raw"),
        (f"NOT {text('context_raw')}", "context_raw"),
    ]
    right = " AND ".join(f"NOT ({test})" for test, _ in checks[1:])
    cases = " ".join(f"WHEN {test} THEN '{kind}:{fault}'" for test, fault in checks)
    return (
        f"CASE WHEN a[{rank}] IS NULL THEN '{kind}:not_array' "
        f"ELSE get(filter(transform(a[{rank}], x -> CASE WHEN {right} THEN NULL {cases} END), f -> f IS NOT NULL), 0) END"
    )


_RECORD = "struct<type:string,rec_no:bigint,raw_value:string,role_raw:string,context_raw:string,fault:string>"


def parsed(payloads: DataFrame) -> DataFrame:
    """Records of each payload; a payload with any part of the wrong type yields one row with its first fault.

    The payload is parsed once per row and the rows leave through one generator, so that later
    filters do not repeat the parsing.
    """
    missing = " OR ".join(f"try_variant_get(v, '$.{k}', 'variant') IS NULL" for k in K.TYPES)
    faults = ", ".join(_item_fault(i, k) for i, k in enumerate(K.TYPES))
    # Only an object has arrays by all names: what else a payload is, is asked where one is missing.
    shape = (
        f"CASE WHEN forall(a, i -> i IS NOT NULL) THEN NULL WHEN v IS NULL THEN 'invalid_json' WHEN NOT {_is('v', 'OBJECT')} THEN 'not_object' "
        f"WHEN {missing} THEN 'missing_key' END"
    )
    fault = let("sh", shape, f"coalesce(sh, {faults})")
    item = (
        "transform({items}, (x, i) -> named_struct('type', '{kind}', 'rec_no', {rank} * 4294967296L + i, "
        "'raw_value', variant_get(x, '$.raw_value', 'string'), 'role_raw', variant_get(x, '$.role_raw', 'string'), "
        "'context_raw', variant_get(x, '$.context_raw', 'string'), 'fault', CAST(NULL AS STRING)))"
    )
    rows = ", ".join(item.format(items=f"a[{i}]", kind=k, rank=i) for i, k in enumerate(K.TYPES))
    items = f"array({', '.join(_items(k) for k in K.TYPES)})"
    refused = f"array(CAST(named_struct('type', NULL, 'rec_no', NULL, 'raw_value', NULL, 'role_raw', NULL, 'context_raw', NULL, 'fault', bad) AS {_RECORD}))"
    body = let("v", "try_parse_json(payload)", let("a", items, let("bad", fault, f"IF(bad IS NULL, concat({rows}), {refused})")))
    return payloads.selectExpr("doc_id", f"inline({body})")


def parse_extractions(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the valid payloads, and the refused documents with a reason; payloads are parsed once for both."""
    checked = stored(parsed(payloads), "records")
    return checked.where("fault IS NULL").drop("fault"), checked.where("fault IS NOT NULL").select("doc_id", "fault")


def is_absent(kind: str, value: str) -> str:
    return f"({kind} IN ({words(K.NUMBER_TYPES)}) AND lower({squeezed(value)}) IN ({words(K.ABSENCE_WORDS)}))"


def drop_non_values(records: DataFrame) -> DataFrame:
    """Records without explicit absence markers."""
    return records.where(f"NOT {is_absent('type', 'raw_value')}")


def omitted_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("doc_id").agg(F.expr(f"count_if({is_absent('type', 'raw_value')}) AS omitted"))


def drop_absent_candidates(cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Older candidates without those of the service that only say that there is no value, and how many went by document.

    What a person confirmed or decided stays, whatever it says.
    """
    gone = f"source = '{SERVICE}' AND NOT confirmed AND coalesce(decision_source, '') <> 'user' AND {is_absent('type', 'value')}"
    return cands.where(f"NOT ({gone})"), cands.groupBy("doc_id").agg(F.expr(f"count_if({gone}) AS removed"))


def ground_literal(units: DataFrame, records: DataFrame) -> DataFrame:
    """Span of every literal place of each record in its own document."""
    places = locate(units.select("doc_id", "unit_seq", "unit_id", "text"), records.selectExpr("doc_id", "raw_value AS value"))
    return records.join(places.withColumnRenamed("value", "raw_value"), ["doc_id", "raw_value"])


def ground_passport(grounded: DataFrame) -> DataFrame:
    """Passport spans that are whole: right shape and no identifier character beside them."""
    beside = "'[A-Za-z0-9_-]'"
    whole = (
        f"{full_match('raw_value', K.PASSPORT_SHAPE)} AND NOT (start > 0 AND substring(text, start, 1) RLIKE {beside}) "
        f"AND NOT substring(text, end + 1, 1) RLIKE {beside}"
    )
    return grounded.where(f"type <> 'passport' OR ({whole})")


def ungrounded(records: DataFrame, grounded: DataFrame) -> DataFrame:
    hit = grounded.select("doc_id", "type", "raw_value").distinct()
    return records.join(hit, ["doc_id", "type", "raw_value"], "left_anti")


def _reconcile(records: DataFrame, cands: DataFrame, key_of_record: str, key_of_cand: str, unique: bool) -> DataFrame:
    """Records whose normalised value equals that of located candidates of the same type.

    With ``unique`` the candidates of a key must all spell the value alike.
    """
    keyed = cands.where("located").selectExpr("doc_id", "type", f"{key_of_cand} AS _key", "cand_id", "value", "unit_id")
    if unique:
        agreed = keyed.groupBy("doc_id", "type", "_key").agg(F.expr("min(value) = max(value) AS _one")).where("_one").drop("_one")
        keyed = keyed.join(agreed, ["doc_id", "type", "_key"], "left_semi")
    wanted = records.withColumn("_key", F.expr(key_of_record))
    return wanted.join(keyed, ["doc_id", "type", "_key"]).where("value <> raw_value").drop("_key", "value")


def reconcile_email(records: DataFrame, cands: DataFrame) -> DataFrame:
    bare = r"regexp_replace(raw_value, '[\\t\\n\\r\\f\\x0B ]+', '')"
    fit = records.where(f"type = 'email' AND {bare} <> raw_value AND {full_match(bare, K.WRAPPED_EMAIL)}")
    return _reconcile(fit, cands, bare, "value", False)


def collapsed(text: str) -> str:
    return stripped(f"regexp_replace({text}, '(?U)\\\\s+', ' ')")


def reconcile_address(records: DataFrame, cands: DataFrame) -> DataFrame:
    """Only white-space runs may differ, and only one spelling may be known."""
    fit = records.where(f"type = 'address' AND {collapsed('raw_value')} <> ''")
    return _reconcile(fit, cands.where("type = 'address'"), collapsed("raw_value"), collapsed("value"), True)


def reconcile_whitespace(records: DataFrame, cands: DataFrame) -> DataFrame:
    """Numbers and dates split by white space in the record."""
    kinds = f"type IN ({words(K.NUMBER_TYPES)})"
    fit = records.where(f"{kinds} AND {squeezed('raw_value')} <> '' AND {squeezed('raw_value')} <> raw_value")
    return _reconcile(fit, cands.where(kinds), squeezed("raw_value"), squeezed("value"), True)


def with_variants(cands: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Candidates with the service among their sources, and the spellings that reconciled records gave for them, in record order.

    ``reconciled`` are rows of the ``reconcile_`` rules: doc_id, cand_id, rec_no, raw_value. Candidates that no record met keep their one source.
    """
    spelled = reconciled.groupBy("doc_id", "cand_id", "raw_value").agg(F.min("rec_no").alias("rec_no")).groupBy("doc_id", "cand_id").agg(
        F.expr("transform(array_sort(collect_list(struct(rec_no, raw_value))), v -> v.raw_value) AS _spelled"))
    return cands.join(spelled, ["doc_id", "cand_id"], "left").selectExpr(
        *cands.columns, f"IF(_spelled IS NULL, array(source), array_union(array(source), array('{SERVICE}'))) AS sources",
        "coalesce(_spelled, CAST(array() AS array<string>)) AS variants")


def merge_same_span(cands: DataFrame, grounded: DataFrame) -> DataFrame:
    """Candidates with the service as extra source and other types of the same span as alternatives."""
    hits = grounded.groupBy("doc_id", "unit_id", "start", "end").agg(
        F.expr("array_sort(collect_set(type))").alias("kinds")
    )
    joined = cands.join(hits, ["doc_id", "unit_id", "start", "end"], "left")
    return joined.selectExpr(
        *[c for c in cands.columns if c != "alts"],
        "IF(kinds IS NULL, alts, array_union(alts, filter(kinds, k -> k <> type))) AS alts",
        f"IF(kinds IS NULL, array(source), array(source, '{SERVICE}')) AS sources",
    )


def _fates(records: DataFrame) -> DataFrame:
    """The records with what becomes of them: ``new``, ``in`` an older candidate or a record before (k_start, k_end), or ``open``.

    Those that meet older candidates are decided by ``_old``, the first of them, or ``_exact``. The others form clusters, which a sweep over the unit tells apart: one
    ends where none of its spans goes on. In a cluster of equal spans the first is taken and the others lie in it. What remains
    entangled is decided in the order of the records, cluster by cluster, with a binary search each.
    """
    group = "PARTITION BY doc_id, unit_id, _free"
    swept = records.withColumn("_free", F.expr("_exact IS NULL AND _old IS NULL")).selectExpr(
        "*", f"max(end) OVER ({group} ORDER BY start, end, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _reach")
    named = swept.selectExpr("*", f"sum(IF(_reach > start, 0, 1)) OVER ({group} ORDER BY start, end, ord ROWS UNBOUNDED PRECEDING) AS _cluster")
    own = f"OVER ({group}, _cluster"
    told = named.selectExpr(
        "*", f"min(start) {own}) = max(start) {own}) AND min(end) {own}) = max(end) {own}) AS _equal", f"row_number() {own} ORDER BY ord, start) = 1 AS _first")
    columns = [c for c in records.columns if c not in ("_old", "_exact")]
    fate = "CASE WHEN _free THEN IF(_first, 'new', 'in') WHEN _exact OR (_old.start <= start AND end <= _old.end) THEN 'in' ELSE 'open' END AS fate"
    keeper = "IF(_free OR _exact, {0}, _old.{0}) AS k_{0}"
    plain = told.where("_equal OR NOT _free").selectExpr(*columns, fate, keeper.format("start"), keeper.format("end"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, taken = None, Taken()
        for batch in batches:
            fates = []
            for *now, start, end in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "unit_id", "_cluster", "start", "end")), strict=True):
                if now != key:
                    key, taken = now, Taken()
                fates.append(taken.add(start, end))
            out = batch.select(columns)
            for k, (name, kind) in enumerate((("fate", pa.string()), ("k_start", pa.int32()), ("k_end", pa.int32()))):
                out = out.append_column(name, pa.array([f[k] for f in fates], kind))
            yield out

    tangled = told.where("_free AND NOT _equal").select(*columns, "_cluster").repartition("doc_id", "unit_id").sortWithinPartitions(
        "doc_id", "unit_id", "_cluster", "ord", "start").mapInArrow(decide, plain.schema)
    return plain.unionByName(tangled)


def merge_overlap(cands: DataFrame, grounded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grounded records folded into the candidates, unit by unit, in record order.

    Later records meet what earlier ones added. A record equal to or inside a candidate adds a source and an alternative type; one that
    reaches outside stays unresolved with a proposed place; any other becomes a candidate. Of several candidates an equal one comes first, then older ones by
    their start. Spans are not empty, and a record's number is its own within a unit and start. Returns (located, unresolved).

    What a record does hangs on older candidates alone if it meets any: that is a window over the unit's spans. The others
    meet only each other (see ``_fates``). Rows are windowed and joined by unit, so work grows as n log n with a unit's records.
    """
    page = "CAST(page AS INT)" if "page" in grounded.columns else "CAST(NULL AS INT)"
    unit = ["doc_id", "unit_id"]
    old = cands.where("located").selectExpr(*unit, "CAST(start AS INT) AS start", "CAST(end AS INT) AS end", "type", "value", "alts", "source")
    new = grounded.selectExpr(*unit, "CAST(rec_no AS BIGINT) AS ord", "CAST(start AS INT) AS start", "CAST(end AS INT) AS end", "type", "raw_value AS value", f"{page} AS page", "context_raw AS context")
    # The first older candidate that ends behind a record's start is the first whose end tops all before it.
    spans = old.select(*unit, "start", "end").distinct()
    tops = spans.selectExpr("*", "max(end) OVER (PARTITION BY doc_id, unit_id ORDER BY start, end DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before").where(
        "_before IS NULL OR end > _before").selectExpr(*unit, "end AS _at", "1 AS _side", "named_struct('start', start, 'end', end) AS _top")
    asked = new.selectExpr(*unit, "start AS _at", "0 AS _side", "struct(ord, start, end, type, value, page, context) AS _x")
    behind = "last_value(_top, true) OVER (PARTITION BY doc_id, unit_id ORDER BY _at DESC, _side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    met = asked.unionByName(tops, allowMissingColumns=True).selectExpr(*unit, "_x", f"{behind} AS _next").where("_x IS NOT NULL").selectExpr(
        *unit, "_x.*", "IF(_next.start < _x.end, _next, NULL) AS _old")
    exact = spans.selectExpr(*unit, "start", "end", "true AS _exact")
    every = cut(_fates(met.join(exact, [*unit, "start", "end"], "left")))

    touches = every.where("fate = 'in'").groupBy(*unit, F.col("k_start").alias("start"), F.col("k_end").alias("end"), F.col("type").alias("_type")).agg(F.min("ord").alias("ord")).groupBy(
        *unit, "start", "end").agg(F.expr("transform(array_sort(collect_list(struct(ord, _type))), t -> t._type) AS _types"))
    fresh = every.where("fate = 'new'").selectExpr(*unit, "start", "end", "type", "value", "CAST(array() AS array<string>) AS alts", f"'{SERVICE}' AS source", "true AS fresh")
    kept = old.selectExpr(*unit, "start", "end", "type", "value", "alts", "source", "false AS fresh").unionByName(fresh).join(touches, [*unit, "start", "end"], "left")
    located = kept.selectExpr(
        *unit, f"{candidate_id('type', 'unit_id', 'start', 'end')} AS cand_id", "start", "end", "type", "value",
        "IF(_types IS NULL, alts, array_union(alts, filter(_types, t -> t <> type))) AS alts",
        f"IF(_types IS NULL, array(source), array_union(array(source), array('{SERVICE}'))) AS sources", "fresh")
    place = (
        "concat('[{\"end\": ', CAST(end AS STRING), ', \"page\": ', coalesce(CAST(page AS STRING), 'null'), ', \"start\": ', CAST(start AS STRING), "
        f"', \"unitId\": ', {json_text('unit_id')}, '}}]')"
    )
    unresolved = every.where("fate = 'open'").selectExpr(
        "doc_id", f"{unresolved_id('type', 'value', 'context', place)} AS cand_id", "type", "value", "unit_id AS proposed_unit",
        "start AS proposed_start", "end AS proposed_end",
    ).dropDuplicates(["doc_id", "cand_id"])
    return located, unresolved


def unresolved_candidates(records: DataFrame) -> DataFrame:
    """Ungrounded records as candidates without a place, one per id."""
    return records.selectExpr(
        "doc_id", f"{unresolved_id('type', 'raw_value', 'context_raw')} AS cand_id", "type", "raw_value AS value",
        "CAST(NULL AS STRING) AS unit_id", "CAST(NULL AS INT) AS start", "CAST(NULL AS INT) AS end", "false AS located",
        f"'{SERVICE}' AS source", "'full' AS method",
    ).dropDuplicates(["doc_id", "cand_id"])


def dedupe_candidates(runs: DataFrame) -> DataFrame:
    """One row per id across runs; the earliest row and its decision win (combined map-side)."""
    rest = [c for c in runs.columns if c not in ("doc_id", "cand_id")]
    picked = runs.groupBy("doc_id", "cand_id").agg(F.expr(f"min_by(struct({', '.join(rest)}), struct(run, seq))").alias("r"))
    return picked.select("doc_id", "cand_id", "r.*")


def cap_candidates(cands: DataFrame, limit: int | None = None) -> DataFrame:
    """All candidates; those after the first ``limit`` of a document are flagged ``over_limit``, and the document ``incomplete``.

    Without a limit nothing is over it. Ranks are counted block by block, so no document is held in one task.
    """
    if limit is None:
        return cands.withColumns({"over_limit": F.lit(False), "incomplete": F.lit(False)})
    totals = cands.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    ranked = block_rank(cands, ["doc_id"], "unit_seq", ["unit_seq", "start", "cand_id"], "rn")
    return ranked.join(totals, "doc_id").withColumns({"over_limit": F.expr(f"rn > {limit}"), "incomplete": F.expr(f"total > {limit}")}).drop("total", "rn")


def structure_evidence(cands: DataFrame, elements: DataFrame, by_page: bool, limit: int | None = None) -> DataFrame:
    """Layout elements, in order, whose text contains the candidate's value; those after the first ``limit`` are flagged."""
    located = cands.where("located AND value <> ''")
    found = pairs(elements, located)
    key = ["doc_id", "value"] + (["page"] if by_page else [])
    numbered = block_rank(found, key, "element_ord", ["element_ord"], "n")
    over = "false" if limit is None else f"n > {limit}"
    side = numbered.selectExpr(*key, "n", "element_id", "category", *([] if by_page else ["page"]), f"{over} AS over_limit")
    own = located.select("doc_id", "cand_id", "value", *(["page"] if by_page else []))
    return own.join(side, key)


def confidence_evidence(cands: DataFrame, additional: DataFrame) -> DataFrame:
    """First confidence record with exactly the candidate's type and value: how sure, on which page and where on it."""
    first = additional.groupBy("doc_id", "type", "value").agg(
        F.expr("min_by(struct(coalesce(confidence, 'low') AS confidence, page, coordinates), ord)").alias("e")
    )
    return cands.join(first, ["doc_id", "type", "value"], "left").withColumns(
        {"confidence": F.col("e.confidence"), "confidence_page": F.col("e.page"), "coordinates": F.col("e.coordinates")}).drop("e")


def quote_guard(grounded: DataFrame) -> DataFrame:
    """Role and context are quoted only when the unit spells them."""
    quoted = "IF({c} <> '' AND contains(text, {c}), {c}, NULL) AS {c}"
    rest = [c for c in grounded.columns if c not in ("role_raw", "context_raw")]
    return grounded.selectExpr(*rest, quoted.format(c="role_raw"), quoted.format(c="context_raw"))


def repair_unresolved(cands: DataFrame, explained: DataFrame) -> DataFrame:
    """Drop unplaced, unconfirmed service rows that a grounded row now explains.

    Confirmed rows, user decisions and rows with a proposed place always stay.
    """
    open_row = (
        f"source = '{SERVICE}' AND NOT confirmed AND NOT located AND coalesce(decision_source, '') <> 'user' AND NOT has_proposal"
    )
    marked = explained.select("doc_id", "type", "value").distinct().withColumn("_explained", F.lit(True))
    return cands.join(marked, ["doc_id", "type", "value"], "left").where(
        f"NOT (coalesce(_explained, false) AND {open_row})"
    ).drop("_explained")


def repaired_addresses(linked: DataFrame, cands: DataFrame) -> DataFrame:
    """Wrapped addresses of which every line is now a located address candidate."""
    exact = cands.where("type = 'address' AND located").select("doc_id", "unit_id", "start", "end", "value").distinct()
    hits = linked.join(exact, ["doc_id", "unit_id", "start", "end", "value"], "left_semi")
    return hits.groupBy("doc_id", "linked_value").agg(
        F.count(F.lit(1)).alias("n"), F.first("link_count").alias("want")
    ).where("n = want").selectExpr("doc_id", "'address' AS type", "linked_value AS value")


def final_doc_type(docs: DataFrame, manual: DataFrame, service: DataFrame) -> DataFrame:
    """Manual class first, then the service's, with where it came from."""
    joined = docs.select("doc_id").join(manual.selectExpr("doc_id", "class AS m"), "doc_id", "left").join(
        service.selectExpr("doc_id", "class AS s"), "doc_id", "left")
    return joined.selectExpr(
        "doc_id", "coalesce(m, s) AS class", "CASE WHEN m IS NOT NULL THEN 'user' WHEN s IS NOT NULL THEN 'service' END AS source"
    )


