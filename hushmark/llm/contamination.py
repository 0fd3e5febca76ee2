"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once.

Normalised: A-Z to lower case, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by one space, one space
at both ends. Patterns are the items' windows of 13 words (the whole item if it has fewer, but some), so
that a hit in a normalised text is a run of whole words; word offsets map hits back to the text.

The automaton holds the test items only, whose bytes are counted before it is broadcast; beyond
``max_pattern_bytes`` the windows are dealt by hash to several automata, with which the texts are scanned one
after the other in the same rows. A null text has no words. An item without words has no window. Items that share an id are
one item; windows of an item without id hit, but it is listed in no document. Repeated documents are each judged
for themselves; an empty table of items hits nothing.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark.llm.common import binary, per_batch

WINDOW = 13
MAX_PATTERN_BYTES = 64_000_000
HIT = "struct<n_words:bigint,hits:array<struct<first:int,last:int>>,items:array<string>>"
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def item_windows(text: bytes, window: int = WINDOW) -> set[str]:
    parts = words(text)
    return {" " + b" ".join(parts[i : i + window]).decode("utf-8", "replace") + " " for i in range(max(len(parts) - window, 0) + 1)} if parts else set()


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows with the ids of their items as text: pattern, item_ids."""

    def make():
        return lambda texts: pa.array([sorted(item_windows(t, window)) for t in binary(texts).to_pylist()], pa.list_(pa.string()))

    cut_up = items.select(F.col("item_id").cast("string").alias("item_id"), F.explode(per_batch(make, "array<string>")("text")).alias("pattern"))
    return cut_up.groupBy("pattern").agg(F.collect_set("item_id").alias("item_ids"))


def automaton(patterns: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for pattern, ids in patterns:
        found.add_word(pattern, (pattern.count(" ") - 1, tuple(ids)))
    if patterns:
        found.make_automaton()
    return found


def scan(machine: ahocorasick.Automaton, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, hit stretches of words (first, last) in order and disjoint, ids of the items hit."""
    parts = words(text)
    stretches: list[list[int]] = []
    items: set[str] = set()
    if parts and len(machine):
        line = " " + b" ".join(parts).decode("utf-8", "replace") + " "
        ends = None
        for at, (count, ids) in machine.iter(line):
            if ends is None:
                codes = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32)
                ends = np.flatnonzero(codes == 32)
            last = int(np.searchsorted(ends, at)) - 1
            first = last - count + 1
            items.update(ids)
            # Hits come by their ends; a longer window may reach back over earlier stretches.
            while stretches and first <= stretches[-1][1] + 1:
                first = min(first, stretches.pop()[0])
            stretches.append([first, last])
    return len(parts), [(a, b) for a, b in stretches], items


def with_hits(docs: DataFrame, items: DataFrame, column: str, window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with a struct of words, hit stretches and item ids."""
    spark = docs.sparkSession
    patterns = windows(items, window)
    total = patterns.agg(F.sum(F.octet_length("pattern") + 16 * F.size("item_ids"))).first()[0] or 0
    shards = int(total // max_pattern_bytes) + 1
    names = [f"{column}_{k}" for k in range(shards)]
    for k, name in enumerate(names):
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == k)
        sent = spark.sparkContext.broadcast([(r.pattern, r.item_ids) for r in part.collect()])

        def make(sent=sent):
            machine = automaton(sent.value)

            def work(texts: pa.Array) -> pa.Array:
                rows = []
                for text in binary(texts):
                    n, stretches, found = scan(machine, text.as_py())
                    rows.append({"n_words": n, "hits": [{"first": a, "last": b} for a, b in stretches], "items": sorted(found)})
                kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))])
                return pa.array(rows, kind)

            return work

        docs = docs.withColumn(name, per_batch(make, HIT)("text"))
    if shards == 1:
        return docs.withColumnRenamed(names[0], column)
    hits = F.array_sort(F.concat(*[F.col(n)["hits"] for n in names]))
    merged = F.aggregate(hits, F.array().cast("array<struct<first:int,last:int>>"), lambda a, h: F.when(
        (F.size(a) > 0) & (h["first"] <= F.coalesce(F.get(F.transform(a, lambda x: x["last"]), F.size(a) - 1), F.lit(-2)) + 1),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.transform(F.slice(a, -1, 1), lambda x: F.struct(x["first"].alias("first"), F.greatest(x["last"], h["last"]).alias("last"))))
    ).otherwise(F.concat(a, F.array(h))))
    ids = F.array_sort(reduce(F.array_union, [F.col(n)["items"] for n in names]))
    whole = F.struct(F.col(names[0])["n_words"].alias("n_words"), merged.alias("hits"), ids.alias("items"))
    return docs.withColumn(column, whole).drop(*names)


def n_hit(hits):
    return F.aggregate(hits["hits"], F.lit(0).cast("long"), lambda a, h: a + (h["last"] - h["first"] + 1).cast("long"))


def is_contaminated(hits):
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= hits["n_words"])


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents of which less than a twentieth of the words is hit; columns as they were."""
    name = "__hushmark_hits"
    return with_hits(docs, items, name).where(~is_contaminated(F.col(name))).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    hits = F.col("__hushmark_hits")
    found = with_hits(docs.select("doc_id", "text"), items, "__hushmark_hits").select("doc_id", "__hushmark_hits")
    return found.select(
        "doc_id", hits["n_words"].alias("n_words"), n_hit(hits).alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"), is_contaminated(hits).alias("contaminated"),
    )

