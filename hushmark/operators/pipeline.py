"""All detectors together, in the order in which finds may claim a span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark import constants as K
from hushmark.functions.expr import let
from hushmark.operators import detect as D
from hushmark.operators import evidence as E
from hushmark.operators import layout as L
from hushmark.operators.literal import occurrences, with_values
from hushmark.operators.mask import starred
from hushmark.session import stored

_FIELDS = ["prio", "ord", "start", "end", "type", "value", "alts", "relation", "proof_unit", "proof_start", "proof_end"]


#: Boundary of a repeated name: a clean left side; what follows is checked by the pattern of particles and punctuation.
_LEFT = "(?<![\\p{L}\\p{N}_'@-])"


def _proofs(names: DataFrame) -> DataFrame:
    """One row per document and proven name, with its first proof."""
    rank = "struct(unit_seq, prio, start)"
    return names.where("type = 'name' AND relation IS NOT NULL AND value <> ''").groupBy("doc_id", "value").agg(
        F.expr(f"min_by(struct(proof_unit, proof_start, proof_end, unit_seq, start), {rank})").alias("p"))


def _repeated(start: str, end: str, value: str, proof: str) -> str:
    """A raw find of a repeated name. Names are tried in the order in which they were proven."""
    return (
        f"named_struct('prio', 10, 'ord', CAST({proof}.unit_seq AS BIGINT) * 4294967296L + {proof}.start, 'start', {start}, 'end', {end}, 'type', 'name', 'value', {value}, "
        f"'alts', CAST(array() AS array<string>), 'relation', 'repeated_name', 'proof_unit', {proof}.proof_unit, 'proof_start', {proof}.proof_start, 'proof_end', {proof}.proof_end)"
    )


def _repeats() -> str:
    """Raw finds of all names in ``_values`` that the unit's text repeats."""
    follow = K.NAME_FOLLOW.removeprefix("(?U)^")
    places = occurrences("text", "n.value", before="(?U)" + _LEFT, after=follow)
    each = f"transform({places}, y -> {_repeated('y', 'y + length(n.value)', 'n.value', 'n.p')})"
    return f"flatten(transform(filter(coalesce(_values, array()), n -> contains(text, n.value)), n -> {each}))"


def propagate_names(units: DataFrame, names: DataFrame) -> DataFrame:
    """Every other place of a proven name in its document (raw finds)."""
    keep = [c for c in ("doc_id", "unit_seq", "unit_id", "page") if c in units.columns]
    return with_values(units, stored(_proofs(names), "names"), ["p"]).selectExpr(*keep, f"inline({_repeats()})")


def found_in_documents(units: DataFrame, today: str) -> DataFrame:
    """Units with ``finds``, settled, those of names repeated elsewhere in their document among them.

    In-unit finds are made once and stored with their units; only the finds are read for the names. A document's names then come to its
    units, where they are looked for and settled with the unit's own finds: a text leaves its row at most once, for that join.
    """
    kept = [c for c in ("doc_id", "unit_seq", "unit_id", "page", "part", "text") if c in units.columns]
    local = stored(D.in_unit(units.select(*kept), today).withColumn("finds", F.expr(D.settle())), "finds")
    names = local.where("exists(finds, f -> f.type = 'name')").selectExpr("doc_id", "unit_seq", "inline(finds)")
    met = with_values(local, stored(_proofs(names), "names"), ["p"], keep_all=True)
    settled = let("r", _repeats(), f"IF(size(r) = 0, finds, {let('every', 'concat(finds, r)', D.settle('every'))})")
    return met.selectExpr(*kept, f"IF(_values IS NULL, finds, {settled}) AS finds")


def redact_all(units: DataFrame, today: str) -> DataFrame:
    """Units with every find starred, redacted, and how many there are, n_found; detection and redaction share a row."""
    found = found_in_documents(units, today)
    return found.selectExpr(*[c for c in found.columns if c not in ("finds", "text")], f"{starred('text', 'finds')} AS redacted", "size(finds) AS n_found")


def detect_all(
    units: DataFrame, today: str, relations: DataFrame | None = None, lines: DataFrame | None = None,
    chars: DataFrame | None = None,
) -> DataFrame:
    """Candidates of every type, settled per unit.

    ``relations`` are evidence relations of the units; ``lines`` and ``chars`` add the layout
    rules of positioned documents. Later rules see what earlier ones kept, so finds are
    settled three times at most; each settling groups by unit only.
    """
    if relations is None and lines is None:
        return D.finish(D.as_rows(found_in_documents(units, today), "finds"))
    keys = ["doc_id", "unit_seq", "unit_id"]
    units = units.select(*keys, *[c for c in ("part", "text") if c in units.columns])
    parts = [D.as_rows(D.in_unit(units, today), "finds").select(*keys, *_FIELDS)]
    if relations is not None:
        parts.append(E.neighbour_finds(units, relations, today).select(*keys, *_FIELDS))
    if lines is not None:
        parts.append(L.address_row_label(lines, today).select(*keys, *_FIELDS))
    first = D.settle_rows(_union(parts))
    first = stored(first, "first")
    if lines is not None:
        addresses = D.finish(first)
        later = [
            first.select(*keys, *_FIELDS),
            L.address_continuation(lines, addresses).select(*keys, *_FIELDS),
            L.table_column_fields(lines, today, chars).select(*keys, *_FIELDS),
        ]
        first = stored(D.settle_rows(_union(later)), "settled")
    names = propagate_names(units, first).select(*keys, *_FIELDS)
    return D.finish(D.settle_rows(first.select(*keys, *_FIELDS).unionByName(names)))


def _union(parts):
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
