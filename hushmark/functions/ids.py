"""Stable identifiers of spans and unresolved records."""

from __future__ import annotations

from hushmark.functions.expr import lit


def _unicode(code: str) -> str:
    return f"concat({lit(chr(92) + 'u')}, lower(lpad(hex({code}), 4, '0')))"


def _escape_ascii(text: str) -> str:
    """JSON string body in ASCII: short escapes where JSON has them, else four hex digits, two such above the BMP."""
    plain = f"replace(replace({text}, {lit(chr(92))}, {lit(chr(92) * 2)}), '\"', {lit(chr(92) + chr(34))})"
    short = " ".join(f"WHEN {code} THEN {lit(chr(92) + name)}" for code, name in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r")))
    above = f"concat({_unicode('55296 + shiftright(ascii(c) - 65536, 10)')}, {_unicode('56320 + (ascii(c) - 65536) % 1024')})"
    odd = f"CASE ascii(c) {short} ELSE CASE WHEN ascii(c) > 65535 THEN {above} WHEN ascii(c) > 126 OR ascii(c) < 32 THEN {_unicode('ascii(c)')} ELSE c END END"
    return f"IF({text} RLIKE '[^ -~]', array_join(transform(split({plain}, ''), c -> {odd}), ''), {plain})"


def candidate_id(kind: str, unit_id: str, start: str, end: str) -> str:
    """``c_`` and 24 hex digits over the compact JSON list of type, unit and range."""
    body = (
        f"concat('[\"', {_escape_ascii(kind)}, '\",\"', {_escape_ascii(unit_id)}, '\",', "
        f"CAST({start} AS STRING), ',', CAST({end} AS STRING), ']')"
    )
    return f"concat('c_', substr(sha2({body}, 256), 1, 24))"


def json_text(text: str) -> str:
    """A JSON string as written with raw Unicode: the writer of to_json, unwrapped."""
    return f"substr(to_json(named_struct('v', {text})), 6, length(to_json(named_struct('v', {text}))) - 6)"


def unresolved_id(kind: str, value: str, context: str, proposed: str = "'[]'") -> str:
    """``u_`` and 24 hex digits over sorted, spaced JSON of the record.

    ``proposed`` is the JSON text of the proposed location list.
    """
    body = (
        f"concat('{{\"context\": ', {json_text(context)}, ', \"proposedLocation\": ', {proposed}, "
        f"', \"type\": ', {json_text(kind)}, ', \"value\": ', {json_text(value)}, '}}')"
    )
    return f"concat('u_', substr(sha2({body}, 256), 1, 24))"
