"""Small Catalyst expression builders shared by every operator.

All of them return SQL expression text or Columns made of built-in functions, so the
work stays inside the JVM and visible to the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks around a hit while a text is cut up; removed from the input first.
_OPEN, _MID, _CLOSE = "\u0001", "\u0002", "\u0003"
SPAN_TYPE = "array<struct<pstart:int,start:int,end:int,value:string>>"
NO_SPANS = f"CAST(array() AS {SPAN_TYPE})"


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(items) -> str:
    return ", ".join(lit(i) for i in items)


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def full_match(value: str, shape: str) -> str:
    flags = ""
    while shape.startswith("(?") and shape[2] in "Uiu":
        close = shape.index(")")
        flags, shape = flags + shape[: close + 1], shape[close + 1:]
    return f"({value} RLIKE {lit(flags + '^(?:' + shape + ')' + chr(92) + 'z')})"


def any_of(items) -> str:
    """Alternation of literal words, longest first."""
    import re

    return "|".join(re.escape(i) for i in sorted(items, key=lambda w: (-len(w), w)))


def scan(items: str, kind: str, init: str, step: str) -> str:
    """The state after each element of an array: ``step`` makes it from the state before, ``s``, and the element, ``x``.

    An array that grows by one element at a time is copied each time, so states are collected by blocks of 256 and the blocks put together at
    the end: work in proportion to the array, for any that fits a row.
    """
    inner = (
        f"aggregate(sc_b, named_struct('s', sc_g.s, 'out', CAST(array() AS array<{kind}>)), (sc_a, x) -> "
        + let("s", "sc_a.s", let("sc_n", step, "named_struct('s', sc_n, 'out', array_append(sc_a.out, sc_n))")) + ")"
    )
    blocks = f"transform(sequence(0, (size({items}) - 1) DIV 256), sc_i -> slice({items}, sc_i * 256 + 1, 256))"
    return (
        f"aggregate({blocks}, named_struct('s', {init}, 'out', CAST(array() AS array<array<{kind}>>)), (sc_g, sc_b) -> "
        + let("sc_r", inner, "named_struct('s', sc_r.s, 'out', array_append(sc_g.out, sc_r.out))") + ", sc_g -> flatten(sc_g.out))"
    )


def running_sums(lengths: str) -> str:
    """Sums of an integer array up to and with each element. Most texts have few pieces: sums of up to 8 are made one by one."""
    few = f"transform({lengths}, (rs_l, rs_k) -> aggregate(slice({lengths}, 1, rs_k + 1), 0, (rs_s, rs_x) -> rs_s + rs_x))"
    return f"IF(size({lengths}) <= 8, {few}, {scan(lengths, 'int', '0', 's + x')})"


def unmarked(text: str, *marks: str) -> str:
    """A text with marks replaced by spaces; texts without any, nearly all, are only searched."""
    return f"IF({mentions(text, list(marks))}, translate({text}, '{''.join(marks)}', '{' ' * len(marks)}'), {text})"


def runs(items: str, firsts: str) -> str:
    """An array cut into runs that start at the given indexes, of which 0 is the first."""
    return f"transform({firsts}, (rn_a, rn_k) -> slice({items}, rn_a + 1, coalesce(get({firsts}, rn_k + 1), size({items})) - rn_a))"


def text_blocks(text: str) -> str:
    """A text as blocks of 1024 characters. A place in a long text is found by walking to it, in a block by a short walk."""
    return f"regexp_extract_all({text}, '(?s).{{1,1024}}', 0)"


def between(blocks: str, start: str, end: str) -> str:
    """The characters from ``start`` up to ``end`` of a text in blocks."""
    def part(place: str, rest: str) -> str:
        return f"substring(coalesce(get({blocks}, CAST(({place}) DIV 1024 AS INT)), ''), {rest})"

    whole = f"array_join(slice({blocks}, CAST(({start}) DIV 1024 AS INT) + 2, CAST(({end}) DIV 1024 - ({start}) DIV 1024 AS INT) - 1), '')"
    return (
        f"IF(({start}) DIV 1024 = ({end}) DIV 1024, {part(start, f'({start}) % 1024 + 1, ({end}) - ({start})')}, "
        f"concat({part(start, f'({start}) % 1024 + 1')}, {whole}, {part(end, f'1, ({end}) % 1024')}))"
    )


def span_array(text: str, pattern: str, prefixed: bool = False, guard: str | None = None) -> str:
    """Every hit of a pattern as (prefix start, start, end, value), code-point offsets.

    The text is cut at marks placed around each hit and the piece lengths are summed,
    which keeps lookarounds and needs no offset function. ``prefixed`` patterns have two
    groups: the label part and the value.
    """
    if prefixed:
        marked = pattern
        swap = f"{_OPEN}$1{_OPEN}$2{_OPEN}"
    else:
        flags = "(?U)" if pattern.startswith("(?U)") else ""
        marked = f"{flags}({pattern[len(flags):]})"
        swap = f"{_OPEN}{_OPEN}$1{_OPEN}"
    # One mark for all three cuts: a single character is no pattern that each row would compile anew.
    pieces = f"split(regexp_replace({unmarked(text, _OPEN, _MID, _CLOSE)}, {lit(marked)}, {lit(swap)}), '{_OPEN}', -1)"
    body = let(
        "e",
        let("ls", "transform(p, x -> length(x))", running_sums("ls")),
        "transform(sequence(0, CAST((size(p) - 1) / 3 AS INT) - 1), "
        "i -> named_struct('pstart', e[3*i], 'start', e[3*i+1], 'end', e[3*i+2], 'value', p[3*i+2]))",
    )
    ends = ["length(p[0])", "length(p[0]) + length(p[1])", "length(p[0]) + length(p[1]) + length(p[2])"]
    single = f"array(named_struct('pstart', {ends[0]}, 'start', {ends[1]}, 'end', {ends[2]}, 'value', p[2]))"
    hits = let("p", pieces, f"CASE WHEN size(p) = 4 THEN {single} WHEN size(p) > 1 THEN {body} ELSE {NO_SPANS} END")
    test = guard or f"{text} RLIKE {lit(pattern)}"
    return hits if test == "true" else f"IF({test}, {hits}, {NO_SPANS})"


def mentions(text: str, words_: list[str]) -> str:
    """Cheap byte search for words without which a rule cannot apply; runs before any pattern."""
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words_) + ")"


def overlay_ranges(value: str, ranges: str, base: str = "0") -> str:
    """Star the given [a, b) ranges of a value; lengths never change."""
    return (
        f"aggregate({ranges}, {value}, (t, r) -> "
        f"overlay(t PLACING repeat('*', r.b - r.a) FROM r.a + 1 + {base} FOR r.b - r.a))"
    )


def col(expression: str) -> Column:
    return F.expr(expression)


def trimmed_start(text: str) -> str:
    """Number of leading white-space characters."""
    return f"(length({text}) - length(regexp_replace({text}, '(?U)^\\\\s+', '')))"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '(?U)^\\\\s+|\\\\s+$', '')"


def squeezed(text: str) -> str:
    """All white space removed."""
    return f"regexp_replace({text}, '(?U)\\\\s+', '')"
