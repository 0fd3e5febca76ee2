"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template.

A template gives each role its opening, its closing and whether its text is learnt, and the
transitions that are valid. A conversation is formatted whatever its order; one that breaks
the order says at which turn. Texts may hold the template's control strings: each gets one more backslash
before it, and reading takes one away, so that every text comes back as it was.

Turns are ordered by turn, then role, then text (null turns first). A null text is empty; a null role is
the empty role; a role the template doesn't know is written in the general form and breaks the order.
Repeated rows are repeated turns. Rows without conv_id are one conversation. An empty table gives no rows.

A conversation's turns meet in one row, as they leave in one row: it is the unit of output. Nothing beyond it is
gathered; the rows are grouped by Spark's sort-based aggregation, which spills.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    opening: str
    closing: str
    learnt: bool = False


@dataclass(frozen=True)
class Template:
    """Openings of known roles and the general one, ``{role}`` standing for any other role, are told apart by control strings."""

    roles: dict[str, Role]
    other: Role
    controls: tuple[str, ...]
    start: str
    moves: dict[tuple[str, str], str]
    ends: frozenset[str] = field(default_factory=frozenset)

    def pattern(self) -> str:
        return "|".join(re.escape(c) for c in sorted(self.controls, key=lambda c: (-len(c), c)))


INSTRUCT = Template(
    roles={
        "system": Role("<<SYS>> ", " <</SYS>>\n"),
        "user": Role("<s>[INST] ", " [/INST]\n"),
        "assistant": Role("[ANS] ", " </s>\n", learnt=True),
    },
    other=Role("[ROLE] {role} [TEXT] ", " [/ROLE]\n"),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ANS]", "[ROLE]", "[/ROLE]", "[TEXT]"),
    start="start",
    moves={("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    ends=frozenset({"answered"}),
)


def escape(text: str, template: Template = INSTRUCT) -> str:
    return re.sub(rf"\\*(?:{template.pattern()})", lambda m: "\\" + m[0], text)


def unescape(text: str, template: Template = INSTRUCT) -> str:
    return re.sub(rf"\\+(?:{template.pattern()})", lambda m: m[0][1:], text)


def check(roles: list[str], template: Template = INSTRUCT) -> tuple[bool, int | None]:
    """Whether the machine accepts the roles, and the first turn (from 0) that it refuses; an early end has the number of turns."""
    state = template.start
    for k, role in enumerate(roles):
        state = template.moves.get((state, role))
        if state is None:
            return False, k
    return (True, None) if state in template.ends else (False, len(roles))


def segments(turns: list[tuple[str, str]], template: Template = INSTRUCT) -> list[tuple[str, bool]]:
    """(text, learnt) in order; joined texts are the formatted conversation."""
    out = []
    for role, text in turns:
        form = template.roles.get(role, template.other)
        out += [(form.opening.replace("{role}", escape(role, template)), False), (escape(text, template), form.learnt), (form.closing, False)]
    return out


def read_back(formatted: str, template: Template = INSTRUCT) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises ValueError on a text that no conversation gives."""
    general, middle = template.other.opening.split("{role}")
    openings = {form.opening: role for role, form in template.roles.items()}
    marks = re.compile(rf"(\\*)({template.pattern()})")
    turns, at = [], 0

    def until(closing: str, begin: int) -> int:
        """Where the closing stands whose control string isn't escaped."""
        control = next(c for c in template.controls if c in closing)
        for m in marks.finditer(formatted, begin):
            if not m[1] and m[2] == control:
                place = m.start(2) - closing.index(control)
                if place >= begin and formatted.startswith(closing, place):
                    return place
        raise ValueError(f"no {closing!r} after {begin}")

    while at < len(formatted):
        known = next((o for o in openings if formatted.startswith(o, at)), None)
        if known is not None:
            role, form, at = openings[known], template.roles[openings[known]], at + len(known)
        elif formatted.startswith(general, at):
            end = until(middle, at + len(general))
            role, form, at = unescape(formatted[at + len(general) : end], template), template.other, end + len(middle)
        else:
            raise ValueError(f"no turn at {at}")
        end = until(form.closing, at)
        turns.append((role, unescape(formatted[at:end], template)))
        at = end + len(form.closing)
    return turns


SEGMENT = "array<struct<text:string,learnt:boolean>>"
_SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("learnt", pa.bool_())]))


def format_conversations(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, segments (text, learnt), valid, broken_at: one row per conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: long conversations don't add up
                turns = [(t["role"], t["text"]) for t in batch.column("turns")[k].as_py()]
                valid, broken = check([r for r, _ in turns], template)
                parts = [{"text": t, "learnt": flag} for t, flag in segments(turns, template)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id").slice(k, 1), pa.array([parts], _SEGMENT), pa.array([valid]), pa.array([broken], pa.int32())],
                    ["conv_id", "segments", "valid", "broken_at"],
                )

    kind = rows.schema["conv_id"].dataType.simpleString()
    return grouped.mapInArrow(form, f"conv_id {kind}, segments {SEGMENT}, valid boolean, broken_at int")


def digest(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What a reader of the formatted text and its loss flags gets back, as digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("segments"):
                parts = parts.as_py()
                text = "".join(p["text"] for p in parts)
                turns = read_back(text, template)
                learnt = "".join(unescape(p["text"], template) for p in parts if p["learnt"])
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], batch.column("valid")],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"],
            )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
