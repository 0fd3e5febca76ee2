"""From raw documents to packed training sequences, a stage an operator.

quality   documents that the classifier rejects go
near_dup  one document of each SimHash group stays, that of the smallest doc_id
leaks     documents of which benchmark items cover a twentieth or more go
secrets   finds are replaced by a mark, and n_chars is set anew; no document goes
packing   the rest, tokenised and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset

Every stage works on all that the one before kept, and all but the last return the columns of documents, in their order. Nulls,
empty texts, repeated rows, empty tables and further columns are treated as the operators' modules say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hushmark.llm import contamination, packing, quality, secrets, simhash
from hushmark.llm.common import shared_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("quality", keep_good), ("near_dup", keep_one_of_each), ("leaks", keep_clean), ("secrets", hide_secrets), ("packing", pack)]
#: SQL has no random field, XXH64 or tokenizer; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written to the shared folder and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
