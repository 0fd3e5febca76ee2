"""Labels and value shapes as SQL expressions: which field a label names, whether a value fits."""

from __future__ import annotations

from hushmark import constants as K
from hushmark.functions.expr import any_of, full_match, let, lit, squeezed, words


def label_key(text: str) -> str:
    return f"lower(btrim({squeezed(text)}, {lit(K.LABEL_EDGE)}))"


def label_type(text: str) -> str:
    """Type named by a label cell, or NULL."""
    cases = " ".join(f"WHEN lk IN ({words(labels)}) THEN '{kind}'" for kind, labels in K.LABELS.items())
    return let("lk", label_key(text), f"CASE {cases} END")


def column_kind(text: str) -> str:
    """Like label_type, with contact and numbering columns of a table added."""
    cases = " ".join(f"WHEN ck IN ({words(ws)}) THEN '{kind}'" for kind, ws in K.COLUMN_KINDS.items())
    return f"coalesce({label_type(text)}, {let('ck', f'lower({squeezed(text)})', f'CASE {cases} END')})"


def _date(value: str, pattern: str) -> str:
    parts = [f"lpad(regexp_extract({value}, {lit(pattern)}, {i}), {w}, '0')" for i, w in ((1, 4), (2, 2), (3, 2))]
    return f"try_to_date(concat({parts[0]}, '-', {parts[1]}, '-', {parts[2]}), 'yyyy-MM-dd')"


def valid_dob(value: str, today: str) -> str:
    limits = f"BETWEEN DATE'1900-01-01' AND DATE'{today}'"
    year = today[:4]
    return (
        f"CASE WHEN {full_match(value, '(?U)' + chr(92) + 'd{4}')} THEN CAST({value} AS INT) BETWEEN 1900 AND {year} "
        f"WHEN {full_match(value, K.DATE_SPLIT)} THEN coalesce({_date(value, K.DATE_SPLIT)} {limits}, false) "
        f"WHEN {full_match(value, K.DATE_JOINED)} THEN coalesce({_date(value, K.DATE_JOINED)} {limits}, false) "
        "ELSE false END"
    )


def valid_value(kind: str, value: str, today: str) -> str:
    """Whether a value has the shape its type demands. ``today`` is a date text."""
    digits = f"length(regexp_replace({value}, '[^0-9]', ''))"
    street = lit(r"(?iU)\b(?:" + "|".join(K.STREET_WORDS) + r")\b")
    start = lit(r"^(?:\(\d{5}\)\s*)?(?:" + "|".join(K.REGION_STEMS) + ")")
    shape = (
        f"CASE {kind} "
        f"WHEN 'name' THEN length({value}) <= 80 AND {full_match(value, K.NAME_SHAPE)} "
        f"AND btrim({squeezed(value)}, {lit(K.LABEL_EDGE)}) NOT IN ({words(K.HEADER_ONLY)}) "
        f"WHEN 'address' THEN length({value}) >= 8 AND {value} RLIKE {lit('(?U)' + chr(92) + 'd')} "
        f"AND ({value} RLIKE {start} OR {value} RLIKE {street}) "
        f"WHEN 'dob' THEN {valid_dob(value, today)} "
        f"WHEN 'passport' THEN {full_match(value, K.PASSPORT_SHAPE)} "
        f"WHEN 'driver_license' THEN {full_match(value, K.LICENSE_SHAPE)} "
        f"WHEN 'account' THEN {full_match(value, K.DIGIT_GROUPS)} AND {digits} BETWEEN 8 AND 18 "
        f"WHEN 'card' THEN {full_match(value, K.DIGIT_GROUPS)} AND {digits} BETWEEN 13 AND 19 "
        f"WHEN 'management_id' THEN {full_match(value, K.MANAGEMENT_SHAPE)} "
        "ELSE false END"
    )
    labels = words(sorted({label for kind in K.LABELS.values() for label in kind}))
    known = f"lower(btrim(sq, {lit(K.LABEL_EDGE)})) IN ({labels}) OR sq IN ({words(K.EMPTY_MARKERS)})"
    return f"({value} <> '' AND {let('sq', squeezed(value), f'NOT ({known})')} AND {shape})"


def valid_column(kind: str, value: str, today: str) -> str:
    """Validity of a table cell, contact and numbering columns included."""
    return (
        f"CASE {kind} WHEN 'number' THEN {full_match(value, K.NUMBER_CELL)} "
        f"WHEN 'phone' THEN {full_match(value, K.PHONE_CELL)} "
        f"WHEN 'email' THEN {full_match(value, K.EMAIL)} ELSE {valid_value(kind, value, today)} END"
    )


def person_name(value: str) -> str:
    endings = lit("(?:" + any_of(K.ORGANISATION_ENDINGS) + r")\z")
    return (
        f"({full_match(value, K.PERSON)} AND {value} NOT IN ({words(K.NOT_A_PERSON)}) "
        f"AND NOT {value} RLIKE {endings})"
    )
