"""Detectors inside one unit, and the rules that settle overlapping finds.

Every detector is an array expression on the unit's own row, so a scan of the units yields
all of them at once and nothing is shuffled until finds of other units are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark import constants as K
from hushmark.functions.expr import let, lit, mentions, running_sums, runs, scan, span_array, stripped, trimmed_start, unmarked
from hushmark.functions.ids import candidate_id
from hushmark.functions.validate import label_type, person_name, valid_value
from hushmark.operators.mask import starred

# One find before overlaps are settled. ``prio``/``ord`` say which find was made first.
RAW = (
    "struct<prio:int,ord:bigint,start:int,end:int,type:string,value:string,alts:array<string>,"
    "relation:string,proof_unit:string,proof_start:int,proof_end:int>"
)
# An order key of two parts: positions and offsets are 32-bit, so the lower part never reaches into the upper one.
WIDE = "4294967296L"
NONE = f"CAST(array() AS array<{RAW}>)"


def _raw(prio, ord_, s, kind, relation="NULL", unit="NULL", pstart="NULL", pend="NULL") -> str:
    return (
        f"named_struct('prio', {prio}, 'ord', CAST({ord_} AS BIGINT), 'start', {s}.start, 'end', {s}.end, 'type', {kind}, "
        f"'value', {s}.value, 'alts', CAST(array() AS array<string>), 'relation', CAST({relation} AS STRING), "
        f"'proof_unit', CAST({unit} AS STRING), 'proof_start', CAST({pstart} AS INT), 'proof_end', CAST({pend} AS INT))"
    )


def format_spans(kind: str, text: str = "text") -> str:
    """Spans of one of the four formats."""
    pattern = dict(K.FORMATS)[kind]
    return span_array(text, pattern)


#: Whether finds sorted by start leave each other alone, so that all of them stay as they are.
_APART = "NOT exists(sequence(1, size(o) - 1), i -> o[i].start < o[i - 1].end)"


def _settle_by_start(raw: str) -> str:
    """Keep the first of overlapping finds in start order; later ones become its alternatives.

    Kept spans are disjoint and sorted, so only the last one can meet the next find: one sweep says where the next kept one is.
    """
    ordered = (
        f"array_sort({raw}, (l, r) -> CASE WHEN l.start <> r.start THEN l.start - r.start WHEN l.ord < r.ord THEN -1 WHEN l.ord > r.ord THEN 1 ELSE 0 END)"
    )
    # State: the end of the kept find, and whether this one is it.
    ends = scan("o", "struct<reach:int,own:boolean>", "named_struct('reach', 0, 'own', false)", "IF(x.start >= s.reach, named_struct('reach', x.end, 'own', true), named_struct('reach', s.reach, 'own', false))")
    kept = (
        "named_struct('prio', g[0].prio, 'ord', g[0].ord, 'start', g[0].start, 'end', g[0].end, 'type', g[0].type, 'value', g[0].value, "
        "'alts', IF(size(g) = 1, g[0].alts, array_union(g[0].alts, transform(slice(g, 2, size(g) - 1), y -> y.type))), "
        "'relation', g[0].relation, 'proof_unit', g[0].proof_unit, 'proof_start', g[0].proof_start, 'proof_end', g[0].proof_end)"
    )
    firsts = let("e", ends, "filter(sequence(0, size(o) - 1), i -> e[i].own)")
    return let("o", ordered, f"IF({_APART}, o, {let('f', firsts, f"transform({runs('o', 'f')}, g -> {kept})")})")


def format_candidates(text: str = "text") -> str:
    """All format finds of a unit, overlaps settled: one expression, one pass over the text."""
    cheap = {"phone": [f"contains({text}, '0')"], "email": [f"contains({text}, '@')"]}
    parts = []
    for rank, (kind, pattern) in enumerate(K.FORMATS):
        test = " AND ".join([*cheap.get(kind, []), f"{text} RLIKE {lit(pattern)}"])
        parts.append(f"IF({test}, transform({span_array(text, pattern, guard='true')}, s -> {_raw(0, rank, 's', lit(kind))}), {NONE})")
    # Every format has a digit or an at sign; most units stop here.
    found = let("r", f"concat({', '.join(parts)})", f"IF(size(r) < 2, r, {_settle_by_start('r')})")
    return f"IF({text} RLIKE '[@\\\\p{{Nd}}]', {found}, {NONE})"


def role_names(text: str = "text", unit: str = "unit_id", has_phone: str = "has_phone") -> str:
    parts = []
    for rank, (pattern, needs_phone) in enumerate(K.ROLE_NAMES):
        contact = "true" if needs_phone else "s.value RLIKE '문의|급여담당'"
        keep = f"{person_name('s.value')} AND ({has_phone} OR NOT ({contact}))"
        parts.append(
            f"IF({mentions(text, K.ROLE_WORDS[rank])}, transform(filter({span_array(text, pattern, True)}, s -> {keep}), "
            f"(s, i) -> {_raw(1, f'{rank} * {WIDE} + i', 's', lit('name'), lit('inline_label'), unit, 's.pstart', 's.start')}), {NONE})"
        )
    return "concat(" + ", ".join(parts) + ")"


def _trim_span(s: str, text: str) -> str:
    """A span without the white space at its ends."""
    return (
        f"named_struct('pstart', {s}.pstart, 'start', {s}.start + {trimmed_start(s + '.value')}, 'end', "
        f"{s}.start + {trimmed_start(s + '.value')} + length({stripped(s + '.value')}), 'value', {stripped(s + '.value')})"
    )


def residence_addresses(today: str, text: str = "text", unit: str = "unit_id") -> str:
    spans = f"transform({span_array(text, K.RESIDENCE, True, 'true')}, s -> {_trim_span('s', text)})"
    return (
        f"IF({mentions(text, K.RESIDENCE_WORDS)}, transform(filter({spans}, s -> {valid_value(lit('address'), 's.value', today)}), "
        f"(s, i) -> {_raw(2, 'i', 's', lit('address'), lit('inline_label'), unit, 's.pstart', 's.start')}), {NONE})"
    )


def care_receipts(today: str, text: str = "text", unit: str = "unit_id") -> str:
    """A receipt number is a person's identifier only in a counselling or care record."""
    spans = span_array(text, K.RECEIPT, True, f"{text} RLIKE {lit(K.CARE_RECORD)}")
    return (
        f"IF({mentions(text, K.RECEIPT_WORDS)}, transform(filter({spans}, s -> {valid_value(lit('management_id'), 's.value', today)}), "
        f"(s, i) -> {_raw(3, 'i', 's', lit('management_id'), lit('inline_label'), unit, '0', 's.start')}), {NONE})"
    )


def labelled(kind: str, today: str, text: str = "text", unit: str = "unit_id") -> str:
    """Numbers and dates right after their label, colon or not."""
    rank = [k for k, _ in K.LABELLED].index(kind)
    pattern = dict(K.LABELLED)[kind]
    return (
        f"IF({mentions(text, K.LABELLED_WORDS[kind])}, transform(filter({span_array(text, pattern, True, 'true')}, s -> {valid_value(lit(kind), 's.value', today)}), "
        f"(s, i) -> {_raw(4, f'{rank} * {WIDE} + i', 's', lit(kind), lit('inline_label'), unit, 's.pstart', 's.start')}), {NONE})"
    )


_KNOWN = r"(?<!\S)(?:" + "|".join(
    r"\s*".join("\\" + c if c in "()" else c for c in w)
    for w in sorted({w for ws in K.LABELS.values() for w in ws if w not in K.PARTY_ADDRESS} | set(K.HEADER_ONLY),
                    key=lambda w: (-len(w), w))
) + r")\s*[:：]"
_GENERIC = r"(?:^|[\n;|\t])\s*[^:\n;|\t]{1,30}\s*[:：]"
_FIELD = f"(?iuU)(?:{_KNOWN}|{_GENERIC})"


def inline_fields(today: str, text: str = "text", unit: str = "unit_id") -> str:
    """``label: value`` pairs; a value runs to the next label."""
    clean = unmarked(text, "\u0001", "\u0002")
    pieces = f"split(regexp_replace({clean}, {lit(_FIELD)}, '\u0001$0\u0001'), '\u0001', -1)"
    cuts = let("ls", "transform(p, x -> length(x))", running_sums("ls"))
    label = "regexp_replace(p[2*i+1], '(?U)^[\\\\n;|\\\\t]?\\\\s*|\\\\s*[:：]$', '')"
    # The colon stays part of a known label's proof, as in the source rule; generic ones drop it.
    lead = "(length(p[2*i+1]) - length(regexp_replace(p[2*i+1], '(?U)^[\\\\n;|\\\\t]?\\\\s*', '')))"
    # Places are worked out for the fields that stand, each part once.
    placed = let("ld", lead, let("at", f"e[2*i+1] + {trimmed_start('p[2*i+2]')}", (
        f"named_struct('kind', kd, 'pstart', e[2*i] + ld, 'pend', e[2*i] + ld + length({stripped('lb')}), 'start', at, 'end', at + length(v), 'value', v)")))
    field = let("lb", label, let("kd", label_type("lb"), f"IF(kd IS NULL, NULL, {let('v', stripped('p[2*i+2]'), f'IF({valid_value("kd", "v", today)}, {placed}, NULL)')})"))
    fields = let("e", cuts, f"transform(sequence(0, CAST((size(p) - 1) / 2 AS INT) - 1), i -> {field})")
    empty = "CAST(array() AS array<struct<kind:string,pstart:int,pend:int,start:int,end:int,value:string>>)"
    found = let("p", pieces, f"IF(size(p) > 1, {fields}, {empty})")
    return (
        f"IF({mentions(text, [':', '：'])}, transform(filter({found}, s -> s IS NOT NULL), "
        f"(s, i) -> {_raw(5, 'i', 's', 's.kind', lit('inline_label'), unit, 's.pstart', 's.pend')}), {NONE})"
    )


def in_unit(units: DataFrame, today: str) -> DataFrame:
    """Adds ``finds``: format and label finds of each unit, overlaps not yet settled."""
    with_format = units.withColumn("fmt", F.expr(format_candidates()))
    has_phone = "exists(fmt, f -> f.type = 'phone')"
    parts = [role_names(has_phone=has_phone), residence_addresses(today), care_receipts(today)]
    parts += [labelled(kind, today) for kind, _ in K.LABELLED]
    parts.append(inline_fields(today))
    # Every label rule needs Hangul or a colon.
    local = f"IF(text RLIKE '[가-힣:：]', concat({', '.join(parts)}), {NONE})"
    return with_format.withColumn("finds", F.expr(f"concat(fmt, {local})")).drop("fmt")


def settle(finds: str = "finds") -> str:
    """Keep earlier finds; a labelled account, card or licence replaces the phones inside it.

    Finds are first put into groups that touch, in one sweep by start; finds of different groups never meet, so only those of
    a group are folded against each other, in (prio, ord) order. A long unit costs its finds, not their square.
    """
    by_start = f"array_sort({finds}, (l, r) -> l.start - r.start)"
    state = "named_struct('reach', {0}, 'own', {1})"
    reach = scan("o", "struct<reach:int,own:boolean>", state.format("-1", "false"),
                 f"IF(x.start < s.reach, {state.format('greatest(s.reach, x.end)', 'false')}, {state.format('x.end', 'true')})")
    groups = let("f", let("e", reach, "filter(sequence(0, size(o) - 1), i -> e[i].own)"), runs("o", "f"))
    ordered = f"array_sort(own, (l, r) -> CASE WHEN l.prio <> r.prio THEN l.prio - r.prio WHEN l.ord < r.ord THEN -1 WHEN l.ord > r.ord THEN 1 ELSE l.start - r.start END)"
    meets = "k.start < x.end AND x.start < k.end"
    replaced = (
        "named_struct('prio', x.prio, 'ord', x.ord, 'start', x.start, 'end', x.end, 'type', x.type, 'value', x.value, "
        "'alts', array_union(x.alts, sort_array(array_distinct(transform(ov, k -> k.type)))), 'relation', x.relation, "
        "'proof_unit', x.proof_unit, 'proof_start', x.proof_start, 'proof_end', x.proof_end)"
    )
    step = let(
        "ov", f"filter(kept, k -> {meets})",
        "CASE WHEN size(ov) = 0 THEN array_append(kept, x) "
        "WHEN exists(ov, k -> k.type = x.type AND k.start = x.start AND k.end = x.end) THEN kept "
        "WHEN x.type IN ('account', 'card', 'driver_license') "
        "AND forall(ov, k -> k.type = 'phone' AND x.start <= k.start AND k.end <= x.end) "
        f"THEN concat(filter(kept, k -> NOT ({meets})), array({replaced})) ELSE kept END",
    )
    folded = f"flatten(transform({groups}, own -> IF(size(own) < 2, own, aggregate({ordered}, {NONE}, (kept, x) -> {step}))))"
    return f"IF(size({finds}) < 2, {finds}, {let('o', by_start, f'IF({_APART}, o, {folded})')})"


def as_rows(units: DataFrame, finds: str) -> DataFrame:
    """One row per find, flat columns."""
    keep = [c for c in ("doc_id", "unit_seq", "unit_id", "page") if c in units.columns]
    return units.selectExpr(*keep, f"inline({finds})")


def settle_rows(finds: DataFrame) -> DataFrame:
    """Settle finds that came from several sources, per unit.

    A unit's finds are bounded by its text, so the one group never outgrows a row.
    """
    keys = [c for c in ("doc_id", "unit_seq", "unit_id", "page") if c in finds.columns]
    fields = ["prio", "ord", "start", "end", "type", "value", "alts", "relation", "proof_unit", "proof_start", "proof_end"]
    grouped = finds.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("finds"))
    return grouped.selectExpr(*keys, f"inline({settle()})")


def finish(found: DataFrame) -> DataFrame:
    """Candidate rows with the defaults of a new find."""
    source = "IF(prio = 0, 'rule', 'local_label')"
    return found.selectExpr(
        *[c for c in ("doc_id", "unit_seq", "unit_id", "page") if c in found.columns],
        f"{candidate_id('type', 'unit_id', 'start', 'end')} AS cand_id",
        "type", "start", "end", "value", "alts", f"{source} AS source", "relation", "proof_unit", "proof_start", "proof_end",
        "'full' AS method", "CAST(array() AS array<struct<a:int,b:int>>) AS mask",
        "false AS confirmed", "true AS located", "prio",
    )


def pii_union(units: DataFrame) -> DataFrame:
    """Candidates of the four formats: one scan, no shuffle."""
    return finish(as_rows(units, format_candidates()))


def detect_formats(units: DataFrame, kind: str) -> DataFrame:
    """Spans of one format, before overlaps are settled."""
    return units.selectExpr("doc_id", "unit_id", f"inline({format_spans(kind)})").drop("pstart")


def detect_in_unit(units: DataFrame, today: str) -> DataFrame:
    """Format and label candidates that need no other unit: narrow, no shuffle."""
    return finish(as_rows(in_unit(units, today), settle()))


def redact_in_unit(units: DataFrame, today: str) -> DataFrame:
    """Detect in each unit and star every find, within the unit's own row.

    No shuffle and no state, so batch and stream run the same plan. Adds redacted and n_found.
    """
    found = in_unit(units, today).withColumn("finds", F.expr(settle()))
    return found.selectExpr(*units.columns, f"{starred('text', 'finds')} AS redacted", "size(finds) AS n_found")


def classify_documents(units: DataFrame, lines: int = 4) -> DataFrame:
    """Class of a document from its first ``lines`` non-empty body lines, else ``other``; how many is the rule itself.

    Lines are ranked before the shuffle by the window group limit; the class is then the
    one of the earliest matching line.
    """
    cases = " ".join(f"WHEN text RLIKE {lit(p)} THEN '{c}'" for c, p in K.TITLE_CLASSES)
    body = units.where("NOT part RLIKE 'header|footer' AND text RLIKE '(?U)\\\\S'")
    first = body.selectExpr(
        "doc_id", "unit_seq", "text",
        "row_number() OVER (PARTITION BY doc_id ORDER BY unit_seq) AS rn",
    ).where(f"rn <= {lines}")
    classed = first.selectExpr("doc_id", "unit_seq", f"CASE {cases} END AS class").where("class IS NOT NULL")
    best = classed.groupBy("doc_id").agg(F.min_by("class", "unit_seq").alias("class"))
    every = units.select("doc_id").distinct()
    return every.join(best, "doc_id", "left").selectExpr("doc_id", "coalesce(class, 'other') AS class")
