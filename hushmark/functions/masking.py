"""Masking of one value: ranges, presets and rendered text, as SQL expressions."""

from __future__ import annotations

from hushmark import constants as K
from hushmark.functions.expr import full_match, let, lit, overlay_ranges, span_array, words

RANGES = "array<struct<a:int,b:int>>"
EMPTY = f"CAST(array() AS {RANGES})"
NO_PRESETS = f"CAST(map() AS map<string,{RANGES}>)"


def rng(a: str, b: str) -> str:
    return f"named_struct('a', CAST({a} AS INT), 'b', CAST({b} AS INT))"


def merge_ranges(ranges: str) -> str:
    """Sorted ranges with touching and overlapping ones joined."""
    last = "element_at(m, -1)"
    return (
        f"aggregate(array_sort({ranges}), {EMPTY}, (m, r) -> IF(size(m) > 0 AND r.a <= {last}.b, "
        f"concat(slice(m, 1, size(m) - 1), array({rng(last + '.a', f'greatest({last}.b, r.b)')})), concat(m, array({rng('r.a', 'r.b')}))))"
    )


def merge_positions(positions: str) -> str:
    """Contiguous ranges of sorted character positions."""
    return merge_ranges(f"transform({positions}, q -> {rng('q', 'q + 1')})")


def mask_value(value: str, method: str, ranges: str) -> str:
    """Rendered value: same length when starred, empty when deleted."""
    return (
        f"CASE {method} WHEN 'full' THEN repeat('*', length({value})) WHEN 'delete' THEN '' WHEN 'keep' THEN {value} "
        f"WHEN 'partial' THEN {overlay_ranges(value, merge_ranges(ranges))} END"
    )


def suffix_range(value: str, count: int) -> str:
    """Everything before the last ``count`` letters or digits."""
    tail = f"regexp_extract({value}, '((?:[A-Za-z0-9][^A-Za-z0-9]*){{{count}}})$', 1)"
    enough = f"length(regexp_replace({value}, '[^A-Za-z0-9]', '')) > {count}"
    return f"IF({enough}, array({rng('0', f'length({value}) - length({tail})')}), {EMPTY})"


def _suffixes(value: str, prefix: str) -> str:
    return f"'{prefix}2', {suffix_range(value, 2)}, '{prefix}4', {suffix_range(value, 4)}"


def phone_presets(value: str) -> str:
    digits = f"length(regexp_replace({value}, '[^0-9]', ''))"
    groups = let(
        "g", span_array(value, "[0-9]+"),
        f"IF(size(g) = 3, map('phone_middle', array({rng('g[1].start', 'g[1].end')}), 'phone_tail', "
        f"array({rng('g[2].start', 'g[2].end')})), {NO_PRESETS})",
    )
    shape = full_match(value, r"\+?[0-9 ()-]+")
    return f"IF({shape} AND {digits} BETWEEN 9 AND 15, map_concat(map({_suffixes(value, 'phone_suffix')}), {groups}), {NO_PRESETS})"


def email_presets(value: str) -> str:
    at = f"(locate('@', {value}) - 1)"
    shape = full_match(value, r"(?U)[^@\s]+@[^@\s]+")
    return (
        f"IF({shape} AND NOT {value} RLIKE {lit(K.UNSAFE_EMAIL)}, map('email_first_and_domain', IF({at} > 1, array({rng('1', at)}), {EMPTY}), "
        f"'email_keep2', IF({at} > 2, array({rng('2', at)}), {EMPTY}), 'email_local_part', array({rng('0', at)})), {NO_PRESETS})"
    )


def resident_presets(value: str) -> str:
    g, n = f"(length({value}) - 7)", f"length({value})"
    return (
        f"IF({full_match(value, '[0-9]{6}[- ]?[0-9][0-9]{6}')}, map('rrn_birth_gender', array({rng(g + ' + 1', n)}), "
        f"'rrn_birth_only', array({rng(g, n)}), 'rrn_gender_only', array({rng('0', '6')}, {rng(g + ' + 1', n)}), "
        f"'rrn_year_only', array({rng('2', '6')}, {rng(g, n)})), {NO_PRESETS})"
    )


def address_presets(value: str) -> str:
    """Cut after region, city, district or locality, read from the shape of the words."""
    word = "t[{i}].value"
    city = f"(size(t) > 1 AND {full_match(word.format(i=1), '[가-힣]+[시군구]')})"
    district = (
        f"({city} AND size(t) > 2 AND {word.format(i=1)} RLIKE '[시군]$' AND {full_match(word.format(i=2), '[가-힣]+구')})"
    )

    def after(index: str, condition: str) -> str:
        return f"IF({condition} AND {index} + 1 < size(t), array({rng(f't[{index}].end', f'length({value})')}), {EMPTY})"

    nth = f"(1 + IF({city}, 1, 0) + IF({district}, 1, 0))"
    local = f"size(t) > {nth} AND {full_match(f'get(t, {nth}).value', '[가-힣][가-힣0-9·]*[읍면동]')}"
    cuts = (
        f"map('address_region', {after('0', 'true')}, 'address_city', {after('1', city)}, 'address_district', {after('2', district)}, "
        f"'address_locality', IF({local} AND {nth} + 1 < size(t), array({rng(f'get(t, {nth}).end', f'length({value})')}), {EMPTY}))"
    )
    known = f"size(t) > 0 AND t[0].start = 0 AND t[0].value IN ({words(K.PRESET_REGIONS)})"
    return let("t", span_array(value, r"(?U)\S+"), f"IF({known}, {cuts}, {NO_PRESETS})")


_DOB_SHAPES = [r"([0-9]{4})([-./])([0-9]{1,2})\2([0-9]{1,2})", r"(?U)([0-9]{4})(년\s*)([0-9]{1,2})월\s*([0-9]{1,2})일",
               r"([0-9]{4})()([0-9]{2})([0-9]{2})"]


def dob_presets(value: str) -> str:
    def real(shape: str) -> str:
        part = lambda i, w: f"lpad(regexp_extract({value}, {lit(shape)}, {i}), {w}, '0')"
        return f"try_to_date(concat({part(1, 4)}, '-', {part(3, 2)}, '-', {part(4, 2)}), 'yyyy-MM-dd') IS NOT NULL"

    tests = " ".join(f"WHEN {full_match(value, s)} THEN {real(s)}" for s in _DOB_SHAPES)
    begin = f"IF(substring({value}, 5, 1) = '년', 5, 4)"
    return f"IF(CASE {tests} ELSE false END, map('dob_year_only', array({rng(begin, f'length({value})')})), {NO_PRESETS})"


def id_presets(value: str) -> str:
    return f"IF({full_match(value, '[A-Za-z0-9 ._/-]+')}, map({_suffixes(value, 'id_suffix')}), {NO_PRESETS})"


def card_presets(value: str) -> str:
    positions = f"slice(filter(sequence(0, length({value}) - 1), i -> substring({value}, i + 1, 1) RLIKE '[0-9]'), 7, 6)"
    middle = f"IF({full_match(value, '[0-9]{4}(?:[- ]?[0-9]{4}){3}')}, map('card_isms', {merge_positions(positions)}), {NO_PRESETS})"
    return f"map_concat({id_presets(value)}, {middle})"


def name_presets(value: str) -> str:
    n = f"length({value})"
    return (
        f"IF({full_match(value, '[가-힣]{2,4}')}, map('name_initial', array({rng('1', n)}), "
        f"'name_middle', IF({n} > 2, array({rng('1', n + ' - 1')}), {EMPTY})), {NO_PRESETS})"
    )


_BY_TYPE = {
    "phone": phone_presets, "email": email_presets, "resident_id": resident_presets, "foreign_id": resident_presets,
    "address": address_presets, "dob": dob_presets, "account": id_presets, "card": card_presets,
    "management_id": id_presets, "name": name_presets,
}


def safe_value(value: str) -> str:
    """Values whose characters can be counted alike everywhere."""
    return f"({value} <> '' AND NOT {value} RLIKE {lit(K.UNSAFE_VALUE)})"


def presets(kind: str, value: str) -> str:
    """Preset name to ranges; presets that hide nothing or everything are dropped."""
    cases = " ".join(f"WHEN '{k}' THEN {build(value)}" for k, build in _BY_TYPE.items())
    covered = "aggregate(r, 0, (n, x) -> n + x.b - x.a)"
    return (
        f"map_filter(IF({safe_value(value)}, CASE {kind} {cases} ELSE {NO_PRESETS} END, {NO_PRESETS}), (p, r) -> "
        f"{covered} > 0 AND {covered} < length({value}) AND forall(r, x -> 0 <= x.a AND x.a < x.b AND x.b <= length({value})))"
    )


def automatic_presets(kind: str, value: str) -> str:
    return f"IF({kind} IN ({words(K.NEVER_AUTOMATIC)}), {NO_PRESETS}, {presets(kind, value)})"


def mask_text_chain(text: str) -> str:
    """Blanket masking of raw text by five replacements in a fixed order."""
    swaps = [
        (r"01[016789]-[0-9]{3,4}-[0-9]{4}|0[2-9]-[0-9]{3,4}-[0-9]{4}", "\u0001$0\u0002"),
        # Inside one marked number the first group that stands before four digits is hidden.
        ("\u0001[0-9]{3}-([0-9]{4}-[0-9]{4})\u0002", "****-$1"),
        ("\u0001([0-9]{2,3})-[0-9]{3,4}-([0-9]{4})\u0002", "$1-****-$2"),
        (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "****@*****.***"),
        (r"(?<![A-Za-z0-9_])[0-9]{6}-[0-9]{7}(?![A-Za-z0-9_])", "******-*******"),
        (r"(?<![A-Za-z0-9_])((?:19|20)[0-9]{2}[-.])[0-9]{2}[-.][0-9]{2}(?![A-Za-z0-9_])", "$1-**-**"),
        (r"[가-힣]{2,4}", "***"),
    ]
    out = f"translate({text}, '\u0001\u0002', '  ')"
    for pattern, swap in swaps:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(swap)})"
    return out
