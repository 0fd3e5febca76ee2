"""Secret scans: fixed patterns, and windows of high entropy inside candidate strings. Expressions only.

A document's spans are found on its own row, so nothing is shuffled. Null text counts as empty; an
empty text, or one without finds, gives an empty list; repeated rows are scanned each for itself;
columns of the input other than ``text`` are left alone.

Entropy: within each run of one character class inside a candidate string, a window of fixed length
moves on by one character. The counts of the characters in it are changed by the one that enters and
the one that leaves, and with them the sum of ``c * log2 c``, kept as an integer of millionths so
that results do not hang on rounding. Windows at or above the class's limit are joined into spans.
Candidates that match the allow-list have no entropy spans; pattern finds stand in any case.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, the part that carries the secret, and its least length.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: A text without a match of these has no find of that kind.
HINTS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}


@dataclass(frozen=True)
class EntropyClass:
    kind: str
    alphabet: str
    window: int
    bits: float

    def limit(self) -> int:
        """Largest sum of c*log2(c), in millionths, of a window with at least ``bits`` of entropy."""
        return math.floor(1e6 * self.window * (math.log2(self.window) - self.bits))

    def terms(self) -> list[int]:
        return [0] + [round(1e6 * c * math.log2(c)) for c in range(1, self.window + 1)]

    def runs(self) -> str:
        inside = "".join("\\" + c if c in "-]^\\" else c for c in self.alphabet)
        return f"[{inside}]{{{self.window},}}"


ENTROPY = (
    EntropyClass("entropy_hex", "0123456789abcdef", 24, 3.2),
    EntropyClass("entropy_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 3.9),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
#: Whole candidates that are no secrets: identifiers in UUID form, plain words or numbers, placeholders.
ALLOWED = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[A-Za-z_-]+$",
    r"^[0-9_-]+$",
    r"(?i)example|sample|placeholder|changeme|dummy",
    r"^sha(256|384|512)-",
)
SPAN = "array<struct<start:int,end:int,kind:string>>"


def _ends(lengths: Column) -> Column:
    """Running sums of an array of lengths."""
    none = F.array().cast("array<int>")
    return F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), none.alias("ends")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["ends"], F.array(a["at"] + n)).alias("ends")),
        lambda a: a["ends"],
    )


def located(text: Column, pattern: str) -> Column:
    """Leftmost, non-overlapping matches as (start, end, value), from the lengths of what lies between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    steps = F.zip_with(gaps, found, lambda g, v: F.coalesce(g, F.lit(0)) + F.coalesce(F.length(v), F.lit(0)))
    return F.zip_with(found, F.slice(_ends(steps), 1, F.size(found)), lambda v, end: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value")))


def pattern_spans(text: Column) -> Column:
    def of(kind: str, pattern: str, group: int, least: int) -> Column:
        kept = F.filter(located(text, pattern), lambda m: F.length(F.regexp_extract(m["value"], pattern, group) if group else m["value"]) >= least)
        spans = F.transform(kept, lambda m: F.struct(m["start"], m["end"], F.lit(kind).alias("kind")))
        return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(SPAN))

    return F.concat(*[of(*p) for p in PATTERNS])


def _hot_windows(run: Column, kind: EntropyClass) -> Column:
    """Joined windows of one run of the class that reach its entropy, as (start, end) within the run."""
    codes = F.transform(F.split(run, ""), lambda c: F.call_function("locate", c, F.lit(kind.alphabet)))
    leaving = F.concat(F.array_repeat(F.lit(0), kind.window), codes)
    moves = F.zip_with(codes, F.slice(leaving, 1, F.length(run)), lambda enters, leaves: F.struct(enters.alias("enters"), leaves.alias("leaves")))
    terms = F.array(*[F.lit(t) for t in kind.terms()])
    spans = F.array().cast("array<struct<start:int,end:int>>")

    def term(count: Column) -> Column:
        return F.element_at(terms, count + 1)

    def count_of(counts: Column, code: Column) -> Column:
        return F.element_at(counts, F.greatest(code, F.lit(1)))

    def closed(a: Column) -> Column:
        return F.when(a["end"] > 0, F.concat(a["spans"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))).otherwise(a["spans"])

    def count(a: Column, m: Column) -> Column:
        enters, leaves = m["enters"], m["leaves"]
        gain = term(count_of(a["counts"], enters) + 1) - term(count_of(a["counts"], enters))
        left = F.greatest(count_of(a["counts"], leaves), F.lit(1))
        loss = F.when(leaves > 0, term(left) - term(left - 1)).otherwise(0)
        counts = F.transform(a["counts"], lambda c, k: c + (k + 1 == enters).cast("int") - (k + 1 == leaves).cast("int"))
        return F.struct(
            (a["at"] + 1).alias("at"),
            F.when(enters == leaves, a["counts"]).otherwise(counts).alias("counts"),
            F.when(enters == leaves, a["total"]).otherwise(a["total"] + gain - loss).alias("total"),
            a["start"].alias("start"), a["end"].alias("end"), a["spans"].alias("spans"),
        )

    def join(a: Column) -> Column:
        first = a["at"] - kind.window
        hot = (first >= 0) & (a["total"] <= kind.limit())
        apart = hot & (first > a["end"])
        return F.struct(
            a["at"].alias("at"), a["counts"].alias("counts"), a["total"].alias("total"),
            F.when(apart | (hot & (a["end"] == 0)), first).otherwise(a["start"]).alias("start"),
            F.when(hot, a["at"]).otherwise(a["end"]).alias("end"),
            F.when(apart, closed(a)).otherwise(a["spans"]).alias("spans"),
        )

    nothing = F.struct(F.lit(0).alias("at"), F.array_repeat(F.lit(0), len(kind.alphabet)).alias("counts"), F.lit(0).alias("total"), F.lit(0).alias("start"), F.lit(0).alias("end"), spans.alias("spans"))
    # The inner transform binds the counted state, so that it is worked out once a step.
    return F.aggregate(moves, nothing, lambda a, m: F.element_at(F.transform(F.array(count(a, m)), join), 1), closed)


def entropy_spans(text: Column) -> Column:
    candidates = F.filter(located(text, CANDIDATE), lambda c: ~c["value"].rlike("|".join(f"(?:{p})" for p in ALLOWED)))

    def of(c: Column, kind: EntropyClass) -> Column:
        runs = located(c["value"], kind.runs())
        return F.flatten(F.transform(runs, lambda r: F.transform(_hot_windows(r["value"], kind), lambda w: F.struct(
            (c["start"] + r["start"] + w["start"]).alias("start"), (c["start"] + r["start"] + w["end"]).alias("end"), F.lit(kind.kind).alias("kind")))))

    found = F.flatten(F.transform(candidates, lambda c: F.concat(*[of(c, kind) for kind in ENTROPY])))
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast(SPAN))


def _ordered(spans: Column) -> Column:
    """By start, then by kind as listed, then by end."""
    kinds = F.array(*[F.lit(k) for k in [p[0] for p in PATTERNS] + [e.kind for e in ENTROPY]])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"], s["end"], s["kind"]))


def secret_spans(text: Column) -> Column:
    """All finds of a text as ordered (start, end, kind) in code points, end exclusive."""
    whole = F.coalesce(text, F.lit(""))
    return _ordered(F.concat(pattern_spans(whole), entropy_spans(whole)))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows' ids with their finds: doc_id, secrets (array of start, end, kind)."""
    return docs.select("doc_id", secret_spans(F.col(text)).alias("secrets"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of touching or overlapping finds replaced by the mark."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(a: Column, s: Column) -> Column:
        meets = (F.size(a) > 0) & (s["start"] <= F.get(F.transform(F.slice(a, -1, 1), lambda x: x["end"]), F.lit(0)))
        joined = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.transform(F.slice(a, -1, 1), lambda x: F.struct(x["start"].alias("start"), F.greatest(x["end"], s["end"]).alias("end"))))
        return F.when(F.size(a) == 0, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).when(meets, joined).otherwise(
            F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    merged = F.aggregate(spans, none, add)
    kept_from = F.concat(F.array(F.lit(0)), F.transform(merged, lambda m: m["end"]))
    kept_to = F.concat(F.transform(merged, lambda m: m["start"]), F.array(F.length(text)))
    pieces = F.zip_with(kept_from, kept_to, lambda a, b: F.substring(text, a + 1, b - a))
    return F.when(F.size(spans) > 0, F.array_join(pieces, mark)).otherwise(text)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Documents with secrets marked and ``n_chars`` (where there is one) set anew; all rows and columns stay.

    A null text stays null.
    """
    spans, clean = "__hushmark_secrets", "__hushmark_clean"
    found = docs.withColumn(spans, secret_spans(F.col("text"))).withColumn(clean, redacted(F.col("text"), F.col(spans)))

    def result(name: str) -> Column:
        if name == "text":
            return F.col(clean)
        if name == "n_chars":
            length = F.length(clean).cast(docs.schema["n_chars"].dataType)
            return F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars"))
        return F.col(f"`{name}`")

    return found.select(*[result(c).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of pattern finds, and all finds as text."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin(*[p[0] for p in PATTERNS]))
    counts = [F.size(F.array_remove(F.transform("secrets", lambda s: s["kind"]), k)) for k, *_ in PATTERNS]
    counts = [(F.size("secrets") - n).cast("long").alias(f"n_{k}") for n, (k, *_) in zip(counts, PATTERNS, strict=True)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
