"""Decisions over candidate tables: validity, plans, keep policy, consensus, review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark import constants as K
from hushmark.functions.expr import let, lit, words
from hushmark.functions.ids import candidate_id
from hushmark.functions.masking import automatic_presets
from hushmark.operators.joins import block_rank

MANUAL = f"(confirmed AND coalesce(decision_source, '') NOT IN ({words(K.AUTOMATIC_SOURCES)}))"


# --- plans ---------------------------------------------------------------------------------

def decision_error(method: str, confirmed: str, located: str, mask: str, value: str) -> str:
    """First rule a decision breaks, NULL when it holds."""
    sorted_mask = f"array_sort({mask})"
    clash = let("sm", sorted_mask, "exists(sequence(1, greatest(size(sm) - 1, 1)), i -> i < size(sm) AND sm[i - 1].b > sm[i].a)")
    covered = f"aggregate({mask}, 0, (n, r) -> n + r.b - r.a)"
    return (
        f"CASE WHEN {method} IS NULL OR {method} NOT IN ({words(K.METHODS)}) THEN 'method' WHEN {confirmed} IS NULL THEN 'confirmed' "
        f"WHEN {confirmed} AND NOT coalesce({located}, false) THEN 'location' WHEN {mask} IS NULL THEN 'mask' "
        f"WHEN exists({mask}, r -> r IS NULL OR r.a IS NULL OR r.b IS NULL OR NOT (0 <= r.a AND r.a < r.b AND r.b <= length({value}))) THEN 'range' "
        f"WHEN size({mask}) > 1 AND {clash} THEN 'overlap' "
        f"WHEN {method} = 'partial' AND ({covered} = 0 OR {covered} = length({value})) THEN 'partial' "
        f"WHEN {method} <> 'partial' AND size({mask}) > 0 THEN 'unused_mask' END"
    )


def validate_decisions(decisions: DataFrame, cands: DataFrame) -> DataFrame:
    """Every decision with the first rule it breaks; one on a candidate that doesn't exist is ``unknown``."""
    known = cands.select("doc_id", "cand_id", "value", "located", F.lit(True).alias("known"))
    joined = decisions.join(known, ["doc_id", "cand_id"], "left")
    error = decision_error("method", "confirmed", "located", "mask", "value")
    return joined.withColumn("error", F.expr(f"CASE WHEN known IS NULL THEN 'unknown' ELSE {error} END")).drop("known")


def apply_plan(cands: DataFrame, decisions: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge decision sets into the candidates; one bad row refuses its document's whole set.

    ``decisions`` carry the version they were made for. Returns (candidates, refused documents).
    """
    checked = decisions.join(versions.select("doc_id", F.col("version").alias("current")), "doc_id", "left").join(
        cands.select("doc_id", "cand_id", "value", "located", F.lit(True).alias("known")), ["doc_id", "cand_id"], "left"
    )
    row_fault = (
        "CASE WHEN NOT version <=> current THEN '1 conflict' WHEN known IS NULL THEN '3 unknown' "
        f"WHEN {decision_error('method', 'confirmed', 'located', 'mask', 'value')} IS NOT NULL THEN '4 invalid' END"
    )
    faults = checked.selectExpr("doc_id", f"{row_fault} AS fault").where("fault IS NOT NULL")
    doubles = decisions.groupBy("doc_id", "cand_id").count().where("count > 1").selectExpr("doc_id", "'2 duplicate' AS fault")
    refused = faults.unionByName(doubles).groupBy("doc_id").agg(F.expr("substring(min(fault), 3) AS reason"))
    good = decisions.join(refused, "doc_id", "left_anti").selectExpr(
        "doc_id", "cand_id", "method AS new_method", "mask AS new_mask", "confirmed AS new_confirmed")
    rest = [c for c in cands.columns if c not in ("method", "mask", "confirmed", "decision_source")]
    merged = cands.join(good, ["doc_id", "cand_id"], "left").selectExpr(
        *rest, "coalesce(new_method, method) AS method", "coalesce(new_mask, mask) AS mask",
        "coalesce(new_confirmed, confirmed) AS confirmed", "IF(new_method IS NULL, decision_source, 'user') AS decision_source",
    )
    return merged, refused


_PLACES = "array<struct<start:int,end:int,cand_id:string>>"
_OUT = "array<struct<pick_no:bigint,outcome:string,target:string>>"


def _place(cands: DataFrame, picks: DataFrame, alias_exact: bool) -> DataFrame:
    """Outcome of each pick against the located spans and the picks before it, unit by unit."""
    spans = cands.where("located").selectExpr("doc_id", "unit_id", "named_struct('no', CAST(-1 AS BIGINT), 'start', start, 'end', end, 'id', cand_id) AS x")
    wishes = picks.selectExpr("doc_id", "unit_id", "named_struct('no', CAST(pick_no AS BIGINT), 'start', start, 'end', end, 'id', pick_cand) AS x")
    grouped = spans.unionByName(wishes).groupBy("doc_id", "unit_id").agg(F.collect_list("x").alias("xs"))
    meets = "k.start < x.end AND x.start < k.end"
    same = "k.start = x.start AND k.end = x.end"
    state = "named_struct('kept', {k}, 'out', {o})"
    added = "concat(acc.kept, array(named_struct('start', x.start, 'end', x.end, 'cand_id', x.id)))"
    note = "concat(acc.out, array(named_struct('pick_no', x.no, 'outcome', {r}, 'target', {t})))"
    exact = f"size(filter(acc.kept, k -> {same}))"
    aliased = (
        f"WHEN {exact} = 1 THEN " + state.format(k="acc.kept", o=note.format(r="'alias'", t=f"filter(acc.kept, k -> {same})[0].cand_id"))
        if alias_exact else ""
    )
    step = (
        f"CASE WHEN x.no < 0 THEN {state.format(k=added, o='acc.out')} {aliased} WHEN exists(acc.kept, k -> {meets}) THEN "
        + state.format(k="acc.kept", o=note.format(r="'overlap'", t="CAST(NULL AS STRING)"))
        + " ELSE " + state.format(k=added, o=note.format(r="'placed'", t="x.id")) + " END"
    )
    fold = (
        "aggregate(array_sort(xs, (l, r) -> CASE WHEN l.no < r.no THEN -1 WHEN l.no > r.no THEN 1 ELSE l.start - r.start END), "
        f"named_struct('kept', CAST(array() AS {_PLACES}), 'out', CAST(array() AS {_OUT})), (acc, x) -> {step}, acc -> acc.out)"
    )
    return grouped.selectExpr("doc_id", f"inline({fold})")


def _range_fault(kind: str, longest: int | None = None) -> str:
    long = "" if longest is None else f" WHEN end - start > {longest} THEN 'too_long'"
    return (
        f"CASE WHEN {kind} NOT IN ({words(K.TYPES)}) THEN 'type' WHEN text IS NULL THEN 'unit' "
        f"WHEN NOT (0 <= start AND start < end AND end <= length(text)) THEN 'range'{long} END"
    )


def add_manual(cands: DataFrame, units: DataFrame, picks: DataFrame, limit: int | None = None, longest: int | None = None) -> DataFrame:
    """User picks with an outcome: placed, overlap, or the broken range rule; ``limit`` beyond so many spans of a document, if given.

    ``picks``: doc_id, pick_no, type, unit_id, start, end. Picks are taken in pick_no order.
    """
    checked = picks.join(units.select("doc_id", "unit_id", "text"), ["doc_id", "unit_id"], "left").withColumn(
        "fault", F.expr(_range_fault("type", longest))).withColumn("pick_cand", F.expr(candidate_id("type", "unit_id", "start", "end")))
    good = checked.where("fault IS NULL")
    placed = _place(cands, good, False)
    outcome = checked.join(placed.select("doc_id", "pick_no", "outcome"), ["doc_id", "pick_no"], "left").withColumn("over", F.lit(False))
    if limit is not None:
        counts = cands.groupBy("doc_id").agg(F.count(F.lit(1)).alias("have"))
        ranked = block_rank(placed.where("outcome = 'placed'"), ["doc_id"], "pick_no", ["pick_no"], "nth").join(counts, "doc_id", "left")
        over = ranked.where(f"coalesce(have, 0) + nth > {limit}").select("doc_id", "pick_no", F.lit(True).alias("over"))
        outcome = outcome.drop("over").join(over, ["doc_id", "pick_no"], "left")
    return outcome.selectExpr(
        "doc_id", "pick_no", "type", "unit_id", "start", "end", "pick_cand AS cand_id",
        "CASE WHEN over THEN 'limit' ELSE coalesce(fault, outcome) END AS outcome",
        "IF(fault IS NULL, substring(text, start + 1, end - start), NULL) AS value",
    )


def resolve_locations(cands: DataFrame, units: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give unplaced candidates a span. Returns (candidates, outcome per pick).

    A pick equal to exactly one located span becomes its alternative type and puts it back to
    review; one that overlaps is refused.
    """
    open_rows = cands.where("NOT located").select("doc_id", "cand_id", F.col("type").alias("open_type"))
    checked = picks.join(units.select("doc_id", "unit_id", "text"), ["doc_id", "unit_id"], "left").join(
        open_rows, ["doc_id", "cand_id"], "left").withColumn(
        "fault", F.expr(f"CASE WHEN open_type IS NULL THEN 'not_open' ELSE {_range_fault('open_type')} END"))
    good = checked.where("fault IS NULL").withColumnRenamed("cand_id", "pick_cand")
    placed = _place(cands, good, True)
    outcome = checked.join(placed, ["doc_id", "pick_no"], "left").selectExpr(
        "doc_id", "pick_no", "cand_id", "open_type", "unit_id", "start", "end", "coalesce(fault, outcome) AS outcome", "target",
        "substring(text, start + 1, end - start) AS new_value")
    moved = outcome.where("outcome = 'placed'").selectExpr(
        "doc_id", "cand_id", "unit_id AS new_unit", "start AS new_start", "end AS new_end", "new_value")
    gone = outcome.where("outcome = 'alias'").select("doc_id", "cand_id")
    extra = outcome.where("outcome = 'alias'").groupBy("doc_id", F.col("target").alias("cand_id")).agg(
        F.array_sort(F.collect_set("open_type")).alias("more"))
    rest = [c for c in cands.columns if c not in ("doc_id", "cand_id", "unit_id", "start", "end", "value", "alts", "confirmed", "located", "source")]
    out = cands.join(gone, ["doc_id", "cand_id"], "left_anti").join(moved, ["doc_id", "cand_id"], "left").join(
        extra, ["doc_id", "cand_id"], "left").selectExpr(
        "doc_id", "cand_id", *rest, "coalesce(new_unit, unit_id) AS unit_id", "coalesce(new_start, start) AS start",
        "coalesce(new_end, end) AS end", "coalesce(new_value, value) AS value",
        "IF(more IS NULL, alts, array_union(alts, more)) AS alts", "confirmed AND more IS NULL AND new_unit IS NULL AS confirmed",
        "located OR new_unit IS NOT NULL AS located", "IF(new_unit IS NULL, source, 'manual_resolution') AS source",
    )
    return out, outcome


def readiness_gate(docs: DataFrame, cands: DataFrame, units: DataFrame, metadata: DataFrame, limit: int | None = None) -> DataFrame:
    """First reason why a document may not be rendered yet; needs metadata_reviewed and incomplete. ``limit``: most spans, if any."""
    many = "" if limit is None else f"WHEN coalesce(n, 0) > {limit} THEN 'too_many' "
    read = cands.join(units.select("doc_id", "unit_id", "text"), ["doc_id", "unit_id"], "left").withColumn(
        "next_start", F.expr("lead(start) OVER (PARTITION BY doc_id, coalesce(unit_id, cand_id) ORDER BY start, end)"))
    broken = decision_error("method", "confirmed", "located", "mask", "value")
    flags = read.groupBy("doc_id").agg(
        F.expr("count(*) AS n"), F.expr("bool_or(NOT confirmed) AS open"), F.expr("bool_or(NOT located) AS lost"),
        F.expr(f"bool_or(type NOT IN ({words(K.TYPES)})) AS odd_type"), F.expr(f"bool_or({broken} IS NOT NULL) AS broken"),
        F.expr("bool_or(located AND NOT substring(text, start + 1, end - start) <=> value) AS changed"),
        F.expr("bool_or(located AND end > next_start) AS clash"),
    )
    meta = metadata.groupBy("doc_id").agg(F.expr("bool_or(coalesce(action, '') NOT IN ('delete', 'keep')) AS bad_meta"))
    return docs.join(flags, "doc_id", "left").join(meta, "doc_id", "left").selectExpr(
        "doc_id",
        "CASE WHEN NOT metadata_reviewed THEN 'metadata_not_reviewed' "
        f"{many}WHEN incomplete THEN 'incomplete' WHEN coalesce(bad_meta, false) THEN 'metadata_action' "
        "WHEN coalesce(open, false) THEN 'unconfirmed' WHEN coalesce(lost, false) THEN 'unlocated' WHEN coalesce(odd_type, false) THEN 'type' "
        "WHEN coalesce(broken, false) THEN 'decision' WHEN coalesce(changed, false) THEN 'value_changed' "
        "WHEN coalesce(clash, false) THEN 'overlap' END AS reason",
    ).withColumn("ready", F.expr("reason IS NULL"))


def force_full(cands: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents under the full-redaction switch: every span full, confirmed where located."""
    rest = [c for c in cands.columns if c not in ("method", "mask", "confirmed", "decision_source")]
    switch = docs.where("full_redaction").select("doc_id", F.lit(True).alias("_full"))
    return cands.join(switch, "doc_id", "left").selectExpr(
        *rest, "IF(_full, 'full', method) AS method", "IF(_full, CAST(array() AS array<struct<a:int,b:int>>), mask) AS mask",
        "IF(_full, located, confirmed) AS confirmed", "IF(_full, 'user', decision_source) AS decision_source")


def force_full_metadata(metadata: DataFrame, docs: DataFrame) -> DataFrame:
    switch = docs.where("full_redaction").select("doc_id", F.lit(True).alias("_full"))
    rest = [c for c in metadata.columns if c != "action"]
    return metadata.join(switch, "doc_id", "left").selectExpr(*rest, "IF(_full, 'delete', action) AS action")


def full_violations(cands: DataFrame, metadata: DataFrame, docs: DataFrame) -> DataFrame:
    """What still breaks the switch, per document."""
    switch = docs.where("full_redaction")
    spans = cands.join(switch.select("doc_id"), "doc_id", "left_semi").where(
        "method <> 'full' OR size(mask) > 0 OR NOT located OR NOT confirmed").groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"))
    meta = metadata.join(switch.select("doc_id"), "doc_id", "left_semi").where("NOT action <=> 'delete'").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("metadata"))
    return switch.select("doc_id").join(spans, "doc_id", "left").join(meta, "doc_id", "left").selectExpr(
        "doc_id", "coalesce(spans, 0) AS spans", "coalesce(metadata, 0) AS metadata").where("spans > 0 OR metadata > 0")


# --- keep policy -----------------------------------------------------------------------------

_TRIM = "regexp_replace({0}, '(?U)^\\\\s+|\\\\s+$', '')"


def _segments(text: str, value: str) -> str:
    return f"transform(filter(split({text}, '[\\\\n;|]', -1), s -> {value} <> '' AND contains(s, {value})), s -> {_TRIM.format('s')})"


def public_contact(text: str, value: str) -> str:
    """Does this text say that the value is an organisation's public contact?

    The role counts for its own field only: before the value, no private word, one contact.
    """
    public, private, contact = lit(K.PUBLIC_CONTACT), lit(K.PRIVATE_CONTACT), lit(K.CONTACT_SHAPE)
    own = (
        f"exists(g, s -> NOT s RLIKE {private} AND size(regexp_extract_all(s, {contact}, 0)) <= 1 "
        f"AND substring(s, 1, locate({value}, s) - 1) RLIKE {public})"
    )
    label = (
        f"length({text}) <= 80 AND {text} RLIKE {public} AND NOT {text} RLIKE {private} AND NOT {text} RLIKE '(?U)[\\\\d@|;\\\\n]'"
    )
    return let("g", _segments(text, value), f"IF(size(g) > 0, {own}, {label})")


def _direct(facts: str) -> str:
    return f"transform(filter({facts}, f -> f.relation IN ({words(K.DIRECT_RELATIONS)})), f -> f.text)"


def with_public(judged: DataFrame, asked: str = "true") -> DataFrame:
    """Adds ``_public``: the role, context and direct facts that call the value a public contact, unless its own unit calls it private.

    The patterns run once a candidate here, and only where ``asked`` holds; whatever is asked about its evidence afterwards is a search in these texts.
    """
    private = (
        f"exists(filter(facts, f -> f.relation = 'self'), f -> exists({_segments('f.text', 'value')}, s -> s RLIKE {lit(K.PRIVATE_CONTACT)}))"
    )
    texts = f"filter(concat(array(role_raw, context_raw), {_direct('facts')}), t -> {public_contact('t', 'value')})"
    return judged.withColumn("_public", F.expr(f"IF({asked} AND type IN ('phone', 'email') AND NOT {private}, {texts}, CAST(array() AS array<string>))"))


def keep_allowed(evidence: str) -> str:
    """Keep rule for a candidate row with value, keep_text and _public."""
    return f"(exists(_public, t -> contains(t, {evidence})) OR (keep_text <> '' AND contains(keep_text, value) AND contains(keep_text, {evidence})))"


def suggestion_error() -> str:
    """First rule a suggestion breaks; needs the candidate's columns beside the suggestion's."""
    grounded = (
        "contains(role_raw, evidence) OR contains(context_raw, evidence) OR exists(facts, f -> contains(f.text, evidence)) "
        "OR (keep_text <> '' AND contains(keep_text, evidence))"
    )
    return (
        "CASE WHEN value IS NULL THEN 'unknown_candidate' WHEN kind IS NULL OR kind NOT IN ('question', 'recommendation') THEN 'type' "
        "WHEN content IS NULL OR length(content) NOT BETWEEN 1 AND 1000 THEN 'content' WHEN reason IS NULL OR length(reason) > 1000 THEN 'reason' "
        "WHEN recommendation IS NULL OR recommendation NOT IN ('full', 'keep') THEN 'recommendation' "
        "WHEN evidence IS NULL OR length(evidence) > 600 THEN 'evidence' "
        "WHEN question IS NOT NULL AND (NOT question RLIKE '(?U)\\\\S' OR length(question) > 120 OR kind <> 'question' OR recommendation <> 'full' "
        "OR evidence = '') THEN 'question' "
        "WHEN evidence = '' AND NOT (kind = 'question' AND recommendation = 'full') THEN 'empty_evidence' "
        f"WHEN evidence <> '' AND NOT ({grounded}) THEN 'not_literal' "
        "WHEN recommendation = 'keep' AND evidence = '' THEN 'empty_evidence' "
        f"WHEN recommendation = 'keep' AND NOT {keep_allowed('evidence')} THEN 'keep_not_grounded' END"
    )


def validate_suggestions(suggestions: DataFrame, judged: DataFrame) -> DataFrame:
    """Suggestions with an error or a stable id; a preset that does not apply is dropped."""
    joined = with_public(suggestions.join(judged, ["doc_id", "cand_id"], "left"), "recommendation = 'keep' AND evidence <> ''")
    allowed = f"recommendation = 'full' AND map_contains_key({automatic_presets('type', 'value')}, preset_id)"
    return joined.selectExpr(
        "doc_id", "cand_id", "kind", "content", "recommendation", "evidence", "question",
        f"IF(value IS NOT NULL AND preset_id IS NOT NULL AND {allowed}, preset_id, NULL) AS preset_id",
        f"{suggestion_error()} AS error",
        "substr(sha2(concat(cand_id, kind, content), 256), 1, 16) AS suggestion_id",
    )


def _within(text: str, longest: int | None) -> str:
    return "" if longest is None else f" AND length({text}) <= {longest}"


def keep_grounds(judged: DataFrame, longest: int | None = None) -> DataFrame:
    """Texts that would permit to keep each candidate; ``longest``: only those of so many characters, if given."""
    texts = (
        f"array_distinct(concat(array(role_raw, context_raw), {_direct('facts')}, "
        "IF(keep_text <> '' AND value <> '' AND contains(keep_text, value), array(value), CAST(array() AS array<string>))))"
    )
    return with_public(judged).selectExpr(*judged.columns, "_public", f"explode({texts}) AS ground").where(
        f"ground <> ''{_within('ground', longest)}").where(keep_allowed("ground")).select("doc_id", "cand_id", "ground")


def local_recommend(judged: DataFrame, longest: int | None = None) -> DataFrame:
    """Full by default, without any fact too; keep when a direct fact (of at most ``longest`` characters, if given) proves a public contact."""
    plain = with_public(judged.withColumn("keep_text", F.lit("")))
    keep = f"filter({_direct('facts')}, g -> g <> ''{_within('g', longest)} AND {keep_allowed('g')})"
    evidence = f"coalesce(get({_direct('facts')}, 0), nullif(context_raw, ''), nullif(role_raw, ''))"
    return plain.where("located").selectExpr("doc_id", "cand_id", "type", f"get({keep}, 0) AS kept", f"{evidence} AS first_fact").selectExpr(
        "doc_id", "cand_id", "IF(kept IS NULL, 'full', 'keep') AS recommendation", "coalesce(kept, first_fact, '') AS evidence")


def suggestion_coverage(batches: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Per batch: candidates without an answer, with several, and answers to nothing asked."""
    answers = suggestions.groupBy("batch", "cand_id").agg(F.count(F.lit(1)).alias("n"))
    joined = batches.select("batch", "cand_id", F.lit(1).alias("asked")).join(answers, ["batch", "cand_id"], "full_outer")
    return joined.groupBy("batch").agg(
        F.expr("count_if(asked IS NOT NULL AND n IS NULL) AS missing"), F.expr("count_if(asked IS NOT NULL AND n > 1) AS duplicate"),
        F.expr("count_if(asked IS NULL) AS unknown"))


def batch_assign(cands: DataFrame, size: int = K.BATCH_SIZE) -> DataFrame:
    """Batches of ``size`` in document order, each with a key over its content."""
    ranked = block_rank(cands, ["doc_id"], "unit_seq", ["unit_seq", "start", "end"], "rn")
    rows = ranked.selectExpr("*", f"CAST(floor((rn - 1) / {size}) AS BIGINT) AS batch")
    keys = rows.groupBy("doc_id", "batch").agg(F.expr(
        "sha2(to_json(transform(array_sort(collect_list(struct(rn, cand_id, type, value))), x -> named_struct('id', x.cand_id, 'type', x.type, 'value', x.value))), 256)"
    ).alias("batch_key"))
    return rows.join(keys, ["doc_id", "batch"]).drop("rn")


def consensus_decision(cands: DataFrame, votes: DataFrame) -> DataFrame:
    """All valid votes keep: keep. All full with one preset: partial. Else full. User decisions stay.

    ``votes``: valid recommendations with doc_id, cand_id, recommendation, preset_id.
    """
    tally = votes.groupBy("doc_id", "cand_id").agg(
        F.expr("min(recommendation) AS low"), F.expr("max(recommendation) AS high"),
        F.expr("count(preset_id) = count(*) AND min(preset_id) = max(preset_id) AS agreed"), F.expr("min(preset_id) AS preset"))
    rest = [c for c in cands.columns if c not in ("method", "mask", "confirmed")]
    empty = "CAST(array() AS array<struct<a:int,b:int>>)"
    joined = cands.join(tally, ["doc_id", "cand_id"], "left").withColumn("_manual", F.expr(MANUAL)).withColumn("_ranges", F.expr(
        f"IF(low = 'full' AND high = 'full' AND agreed, try_element_at({automatic_presets('type', 'value')}, preset), NULL)"))
    return joined.selectExpr(
        *rest,
        "CASE WHEN _manual THEN method WHEN low = 'keep' AND high = 'keep' THEN 'keep' WHEN _ranges IS NOT NULL THEN 'partial' ELSE 'full' END AS method",
        f"CASE WHEN _manual THEN mask WHEN _ranges IS NOT NULL THEN _ranges ELSE {empty} END AS mask", "true AS confirmed", "_manual AS preserved",
    )


def export_summary(decided: DataFrame) -> DataFrame:
    counts = [F.expr(f"count_if(confirmed AND method = '{m}') AS {m}_count") for m in ("full", "partial", "keep")]
    return decided.groupBy("doc_id").agg(*counts, F.expr("count_if(preserved) AS manual_preserved"))


# --- stages, metadata, views -------------------------------------------------------------------

def stage_gate(docs: DataFrame, stages: DataFrame, model: str) -> DataFrame:
    """First reason a document is blocked; needs ai_enabled and incomplete in ``docs``."""
    wanted = ["parse", "classify", "extract", "judge"]
    wide = stages.groupBy("doc_id").agg(*[F.expr(f"max(CASE WHEN stage = '{s}' THEN status END) AS {s}") for s in wanted],
                                        F.expr("max(CASE WHEN stage = 'judge' THEN model END) AS judge_model"),
                                        F.expr("bool_or(stage = 'judge' AND required) AS judge_required"))
    return docs.join(wide, "doc_id", "left").selectExpr(
        "doc_id",
        "CASE WHEN NOT coalesce(ai_enabled, false) THEN 'analysis_off' WHEN coalesce(parse, '') <> 'completed' THEN 'parse' "
        "WHEN coalesce(classify, '') <> 'completed' THEN 'classify' WHEN coalesce(extract, '') <> 'completed' THEN 'extract' "
        f"WHEN judge IS NULL THEN 'judge_unknown' WHEN judge = 'completed' AND NOT judge_model <=> '{model}' THEN 'judge_model' "
        "WHEN judge <> 'completed' AND (judge <> 'not_needed' OR coalesce(judge_required, true)) THEN 'judge' WHEN incomplete THEN 'incomplete' END AS reason",
    )


def metadata_policy(metadata: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen action else delete; documents with unknown ids, odd actions or doubled tags are refused."""
    unknown = choices.join(metadata.select("doc_id", "meta_id"), ["doc_id", "meta_id"], "left_anti").selectExpr("doc_id", "'1 unknown_id' AS fault")
    odd = choices.where("coalesce(action, '') NOT IN ('keep', 'delete')").selectExpr("doc_id", "'2 action' AS fault")
    doubled = metadata.groupBy("doc_id", "source", "label").count().where("source = 'XMP' AND count > 1").selectExpr("doc_id", "'3 duplicate_tag' AS fault")
    refused = unknown.unionByName(odd).unionByName(doubled).groupBy("doc_id").agg(F.expr("substring(min(fault), 3) AS reason"))
    picked = choices.groupBy("doc_id", "meta_id").agg(F.min("action").alias("choice"))
    rest = [c for c in metadata.columns if c != "action"]
    out = metadata.join(refused, "doc_id", "left_anti").join(picked, ["doc_id", "meta_id"], "left").selectExpr(
        *rest, "coalesce(choice, 'delete') AS action")
    return out, refused


def repeat_groups(cands: DataFrame) -> DataFrame:
    """Occurrences of a value under one group number, groups in first-seen order."""
    firsts = cands.groupBy("doc_id", "type", "value").agg(F.expr("min(struct(unit_seq, start)) AS f")).selectExpr(
        "doc_id", "type", "value", "f.unit_seq AS unit_seq", "f.start AS start")
    numbered = block_rank(firsts, ["doc_id"], "unit_seq", ["unit_seq", "start", "type", "value"], "group_no").drop("unit_seq", "start")
    return cands.join(numbered, ["doc_id", "type", "value"])


def inherit_choice(cands: DataFrame) -> DataFrame:
    """Unconfirmed occurrences with the one choice a person made for the same value before."""
    choice = "struct(method, to_json(mask) AS mask)"
    agreed = cands.where(MANUAL).groupBy("doc_id", "type", "value").agg(
        F.expr(f"min({choice}) AS low"), F.expr(f"max({choice}) AS high")).where("low = high").selectExpr(
        "doc_id", "type", "value", "low.method AS suggested_method", "low.mask AS suggested_mask")
    return cands.where(f"NOT {MANUAL}").join(agreed, ["doc_id", "type", "value"], "left")


def spread_choice(cands: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each choice reaches, as classes and their members: one row a choice and one a span, never one for each pair of them.

    ``choices``: doc_id, choice_id, cand_id, scope (one, same_value, same_type, following). A class is the rule of a choice (scope, anchor, type, value) with
    how many spans it reaches and how many it leaves out as unlocated, both from counts by value and by type. Members
    are the located spans of the types chosen from; ``reached`` shows which belong to which class.
    """
    spans = cands.withColumn("manual", F.expr(MANUAL)).select("doc_id", "cand_id", "type", "value", "located", "manual")
    by_value = spans.groupBy("doc_id", "type", "value").agg(
        F.expr("count_if(located) AS v_in"), F.expr("count_if(NOT located) AS v_out"), F.expr("count_if(located AND NOT manual) AS f_in"), F.expr("count_if(NOT located AND NOT manual) AS f_out"))
    by_type = by_value.groupBy("doc_id", "type").agg(F.sum("v_in").alias("t_in"), F.sum("v_out").alias("t_out"))
    own = "IF({0}located, 1, 0)"
    count = "CASE scope WHEN 'one' THEN {own} WHEN 'same_value' THEN v_{side} WHEN 'same_type' THEN t_{side} ELSE f_{side} + IF(manual, {own}, 0) END"
    classes = choices.join(spans, ["doc_id", "cand_id"]).join(by_value, ["doc_id", "type", "value"]).join(by_type, ["doc_id", "type"]).selectExpr(
        "doc_id", "choice_id", "scope", "cand_id AS anchor_id", "type", "IF(scope = 'same_type', NULL, value) AS value",
        count.format(own=own.format(""), side="in") + " AS n_reached", count.format(own=own.format("NOT "), side="out") + " AS excluded")
    members = spans.where("located").drop("located").join(choices.join(spans, ["doc_id", "cand_id"]).select("doc_id", "type").distinct(), ["doc_id", "type"], "left_semi")
    return classes, members


def reached(classes: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, choice_id, cand_id of every span that a choice reaches; a view, as long as all pairs of them."""
    own = classes.where("scope = 'one'").select("doc_id", "choice_id", F.col("anchor_id").alias("cand_id")).join(members.select("doc_id", "cand_id"), ["doc_id", "cand_id"])
    same = classes.where("scope IN ('same_value', 'following')").join(members, ["doc_id", "type", "value"]).where("scope = 'same_value' OR cand_id = anchor_id OR NOT manual")
    kind = classes.where("scope = 'same_type'").drop("value").join(members, ["doc_id", "type"])
    columns = ["doc_id", "choice_id", "cand_id"]
    return own.select(*columns).unionByName(same.select(*columns)).unionByName(kind.select(*columns))


def review_queue(cands: DataFrame, suggestions: DataFrame, wanted: str = "all", search: str = "") -> DataFrame:
    """Value groups with a matching occurrence, their pending counts and open questions."""
    test = {"all": "true", "unconfirmed": "NOT confirmed", "keep": "method = 'keep'", "mask": "method <> 'keep'"}[wanted]
    if search:
        test += f" AND contains(lower(concat(value, ' ', type)), lower({lit(search)}))"
    asked = suggestions.where("question IS NOT NULL").select("doc_id", "cand_id", F.lit(1).alias("_asked")).distinct()
    grouped = cands.join(asked, ["doc_id", "cand_id"], "left").groupBy("doc_id", "type", "value").agg(
        F.expr("count(*) AS n"), F.expr("count_if(NOT confirmed) AS pending"), F.expr("count_if(NOT confirmed AND _asked = 1) AS questions"),
        F.expr(f"count_if({test}) AS matching"), F.expr("min(struct(unit_seq, start)) AS first_place"))
    return grouped.where("matching > 0")


def _cut(text: str, longest: int | None) -> str:
    return text if longest is None else f"substring({text}, 1, {longest})"


def judge_payload(judged: DataFrame, with_presets: bool = True, most_facts: int | None = None, longest: int | None = None) -> DataFrame:
    """View of a candidate for a judge, as JSON, known fields only; ``most_facts`` and ``longest`` bound it, if given."""
    few = "facts" if most_facts is None else f"slice(facts, 1, {most_facts})"
    facts = f"transform({few}, f -> named_struct('relation', f.relation, 'text', {_cut('f.text', longest)}))"
    texts = f"array_distinct(concat(array(role_raw, context_raw), {_direct('facts')}, IF(keep_text <> '' AND contains(keep_text, value), array(value), CAST(array() AS array<string>))))"
    grounds = f"filter({texts}, g -> g <> '' AND {keep_allowed('g')})"
    chosen = automatic_presets("type", "value") if with_presets else "CAST(map() AS map<string,array<struct<a:int,b:int>>>)"
    shown = "aggregate(r, value, (t, x) -> overlay(t PLACING repeat('*', x.b - x.a) FROM x.a + 1 FOR x.b - x.a))"
    return with_public(judged).selectExpr("doc_id", "cand_id", "type", "value", f"{_cut('role_raw', longest)} AS role_raw", f"{_cut('context_raw', longest)} AS context_raw",
                             f"{facts} AS evidence", f"{grounds} AS grounds", f"{chosen} AS presets").selectExpr(
        "doc_id", "cand_id",
        "to_json(struct(cand_id AS id, type, value, role_raw, context_raw, 'mask_or_keep' AS decisionTask, evidence, grounds AS allowedKeepEvidence, "
        "IF(size(grounds) > 0, array('full', 'keep'), array('full')) AS allowedRecommendations, array_sort(map_keys(presets)) AS selectablePresets, "
        f"transform_values(presets, (p, r) -> {shown}) AS presetPreviews)) AS payload")


_ANSWER = "struct<cand_id:string,recommendation:string,evidence:string,question:string,preset_id:string,kind:string,content:string,fault:string>"


def normalize_suggestions(answers: DataFrame) -> DataFrame:
    """Rows of each batch's raw answer; one bad part refuses the batch (one row with a fault)."""
    bare = _TRIM.format("answer")
    body_text = f"coalesce(try_parse_json({bare}), try_parse_json(regexp_extract({bare}, '(?s)^```json(.*)```$', 1)))"
    isa = "coalesce(schema_of_variant({0}) LIKE '{1}%', false)"
    get = lambda name: f"try_variant_get(x, '$.{name}', 'string')"
    fields = "map_keys(try_variant_get(x, '$', 'map<string,variant>'))"
    allowed = "array('candidateId', 'recommendation', 'evidence', 'question', 'presetId')"
    item_ok = (
        f"{isa.format('x', 'OBJECT')} AND size(array_except({fields}, {allowed})) = 0 "
        f"AND size(array_except(array('candidateId', 'recommendation', 'evidence'), {fields})) = 0 "
        f"AND forall(map_values(try_variant_get(x, '$', 'map<string,variant>')), w -> {isa.format('w', 'STRING')}) "
        f"AND {get('recommendation')} IN ('full', 'keep') AND length({get('evidence')}) <= 600 "
        f"AND NOT ({get('recommendation')} = 'keep' AND {get('evidence')} = '') "
        f"AND ({get('question')} IS NULL OR ({get('question')} RLIKE '(?U)\\\\S' AND length({get('question')}) <= 120 AND {get('recommendation')} = 'full' AND {get('evidence')} <> '')) "
        f"AND ({get('presetId')} IS NULL OR ({get('presetId')} RLIKE '(?U)\\\\S' AND length({get('presetId')}) <= 60 AND {get('recommendation')} = 'full'))"
    )
    items = "try_variant_get(v, '$.suggestions', 'array<variant>')"
    tools = "size(coalesce(try_variant_get(v, '$.toolcalls', 'array<variant>'), array()))"
    fault = (
        f"CASE WHEN v IS NULL OR NOT {isa.format('v', 'OBJECT')} THEN 'not_json' WHEN {items} IS NULL THEN 'no_suggestions' "
        f"WHEN {tools} > 0 THEN 'tool_calls' WHEN exists({items}, x -> NOT coalesce({item_ok}, false)) THEN 'item' END"
    )
    # --- fixed values: the two sentences shown for a plain answer ---
    keep_words, full_words = "공유본에서 유지합니다.", "공유본에서 전체 가림합니다."
    row = (
        f"named_struct('cand_id', {get('candidateId')}, 'recommendation', {get('recommendation')}, 'evidence', {get('evidence')}, 'question', {get('question')}, "
        f"'preset_id', {get('presetId')}, 'kind', IF({get('question')} IS NOT NULL OR {get('evidence')} = '', 'question', 'recommendation'), "
        f"'content', coalesce({get('question')}, IF({get('recommendation')} = 'keep', {lit(keep_words)}, {lit(full_words)})), 'fault', CAST(NULL AS STRING))"
    )
    refused = (
        "array(CAST(named_struct('cand_id', NULL, 'recommendation', NULL, 'evidence', NULL, 'question', NULL, 'preset_id', NULL, 'kind', NULL, "
        f"'content', NULL, 'fault', bad) AS {_ANSWER}))"
    )
    body = let("v", body_text, let("bad", fault, f"IF(bad IS NULL, transform({items}, x -> {row}), {refused})"))
    return answers.selectExpr("batch", f"inline({body})")


def public_view(docs: DataFrame, stages: DataFrame, batches: DataFrame, model: str) -> DataFrame:
    """Outward view of a document: private columns dropped, a blocked one never shown as validated."""
    blocked = stage_gate(docs, stages, model)
    done = stages.where("status = 'completed' AND stage IN ('parse', 'classify', 'extract')").groupBy("doc_id").agg(
        F.countDistinct("stage").alias("completed_stages"))
    saved = batches.groupBy("doc_id").agg(F.countDistinct("batch").alias("saved_batches"))
    public = [c for c in docs.columns if not c.startswith("_") and c not in ("doc_id", "status")]
    return docs.join(blocked, "doc_id").join(done, "doc_id", "left").join(saved, "doc_id", "left").selectExpr(
        "doc_id", *public, "IF(reason IS NOT NULL AND status = 'validated', 'review', status) AS status", "reason AS blocked",
        "coalesce(completed_stages, 0) AS completed_stages", "coalesce(saved_batches, 0) AS saved_batches")
