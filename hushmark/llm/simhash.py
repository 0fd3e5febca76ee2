"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits, each by majority over the XXH64 values (seed 42) of the text's 3-word shingles.
Fingerprints link at 3 or fewer differing bits. Of the two halves of such a pair, one differs in at
most one bit. The anchors of a half are the words of the perfect Hamming code on 31 of its bits,
which covers every half within radius 1. A fingerprint is at home at its nearest anchor; any half within 1 of it lies
within 1 + 1 of that anchor. So each fingerprint is replicated to all anchors within 2 of its halves
(at most 16 each), and those at home there are compared with those replicated there. No pair is missed.

Equal fingerprints are one node. Families of near copies are contracted first: at each anchor, the smallest
fingerprint at home is compared with all others there, which gives links in proportion to the rows; only fingerprints
that are still in different components are then compared with each other, so that few pairs come out of large families.

A null text, like one without words, has fingerprint zero and is linked as any other. Repeated rows
are equal fingerprints. Rows without doc_id never give a component its id, unless it has no other. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushmark.llm.common import binary, cut, per_batch
from hushmark.llm.components import components

SHINGLE = 3
SEED = 42
THRESHOLD = 3
CODE_BITS = 31
PRINTS_A_PARTITION = 10_000


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(line)]
    last = min(SHINGLE, len(words)) - 1
    hashed = xxhash.xxh64_digest
    total, n = np.zeros(64, np.int64), len(words) - last
    for a in range(0, n, 50_000):
        values = b"".join([hashed(line[s:e], SEED) for s, e in zip(starts[a : min(n, a + 50_000)], ends[a + last : last + min(n, a + 50_000)], strict=True)])
        total += np.unpackbits(np.frombuffer(values, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(text: Column) -> Column:
    """The fingerprint as a long (its 64 bits)."""

    def make():
        return lambda texts: pa.array(np.array([fingerprint(t.as_py()) for t in binary(texts)], np.uint64).view(np.int64), pa.int64())

    return per_batch(make, "long")(text)


def _half(fp: Column, half: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit((1 << CODE_BITS) - 1).cast("long"))


def _syndrome(word: Column) -> Column:
    """0 at an anchor, else the place (from 1) of the bit to turn to reach it."""
    masks = [sum(1 << (place - 1) for place in range(1, CODE_BITS + 1) if place >> j & 1) for j in range(5)]
    return sum((F.bit_count(word.bitwiseAND(F.lit(m).cast("long"))) % 2 * (1 << j) for j, m in enumerate(masks)), F.lit(0))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place - 1)


def home(fp: Column, half: int) -> Column:
    """The nearest anchor of a half, as a key that tells the halves apart."""
    word, s = _half(fp, half), _syndrome(_half(fp, half))
    return F.when(s == 0, word).otherwise(word.bitwiseXOR(_bit(F.greatest(s, F.lit(1))))) + F.lit(half << CODE_BITS).cast("long")


def anchors(fp: Column, half: int) -> Column:
    """All anchors within radius 1 plus threshold 1 of a half: itself, or the bit at the syndrome or two bits that add up to it turned."""
    word, s = _half(fp, half), _syndrome(_half(fp, half))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(CODE_BITS)), lambda i: (i.bitwiseXOR(s) == 0) | (i < i.bitwiseXOR(s)))
    turned = F.transform(pairs, lambda i: word.bitwiseXOR(_bit(i)).bitwiseXOR(F.when(i == s, F.lit(0).cast("long")).otherwise(_bit(F.greatest(i.bitwiseXOR(s), F.lit(1))))))
    found = F.when(s == 0, F.array(word)).otherwise(turned)
    return F.transform(found, lambda a: a + F.lit(half << CODE_BITS).cast("long"))


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= THRESHOLD


def _dealt(prints: DataFrame) -> DataFrame:
    """Few bytes make many rows at the anchors: partitions by the number of fingerprints, not by their size."""
    return cut(prints.repartition(-(-max(prints.count(), 1) // PRINTS_A_PARTITION)))


def link(prints: DataFrame) -> DataFrame:
    """(fp, label) of distinct fingerprints ``fp``; equal labels are one component."""
    prints = _dealt(prints)
    homes = prints.select("*", F.explode(F.array(home(F.col("fp"), 0), home(F.col("fp"), 1))).alias("anchor"))
    guests = prints.select("*", F.explode(F.concat(anchors(F.col("fp"), 0), anchors(F.col("fp"), 1))).alias("anchor"))
    hubs = homes.groupBy("anchor").agg(F.min("fp").alias("hub"))
    first = guests.join(hubs, "anchor").where((F.col("fp") != F.col("hub")) & _near("fp", "hub")).select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    labels = components(first).withColumnRenamed("node", "fp")
    labelled = _dealt(cut(prints.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))))
    homes = labelled.select(F.col("fp").alias("fp1"), F.col("label").alias("label1"), F.explode(F.array(home(F.col("fp"), 0), home(F.col("fp"), 1))).alias("anchor"))
    guests = labelled.select("fp", "label", F.explode(F.concat(anchors(F.col("fp"), 0), anchors(F.col("fp"), 1))).alias("anchor"))
    rest = homes.join(guests, "anchor").where((F.col("label1") != F.col("label")) & _near("fp1", "fp")).select(F.col("label1").alias("u"), F.col("label").alias("v"))
    merged = components(rest).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    return labelled.join(merged, "label", "left").select("fp", F.coalesce("whole", "label").alias("label"))


def near_duplicates(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, fp (long), component_id, and ``more`` columns of the documents under their aliases; a row for each row."""
    rows = cut(docs.select("doc_id", fingerprints(F.col("text")).alias("fp"), *more))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = cut(prints.join(link(prints.select("fp")), "fp"))
    ids = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows.join(labels.join(ids, "label").select("fp", "component_id"), "fp")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id (with repeated ids, the smallest hash of its text). Columns as they were."""
    rows = near_duplicates(docs, F.xxhash64("text").alias("text_hash"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    # Without any doc_id in it, a component is told apart by its fingerprint alone.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("only")]
    best = rows.groupBy(*group).agg(F.min(order).alias("best")).select("best.doc_id", "best.text_hash").distinct()
    kept, names = best.select(F.col("doc_id").alias("__hushmark_id"), F.col("text_hash").alias("__hushmark_hash")), docs.columns
    keyed = docs.withColumns({"__hushmark_id": F.col("doc_id"), "__hushmark_hash": F.xxhash64("text")})
    same = keyed["__hushmark_id"].eqNullSafe(kept["__hushmark_id"]) & (keyed["__hushmark_hash"] == kept["__hushmark_hash"])
    found = keyed.join(kept, same, "left_semi")
    return found.dropDuplicates(["__hushmark_hash", "__hushmark_id"]).select(*[F.col(f"`{c}`") for c in names])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
