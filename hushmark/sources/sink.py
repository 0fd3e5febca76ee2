"""The redacted copy, written only after it is proven."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def redacted_sink(redacted: DataFrame, checks: DataFrame, version: int, folder: str, run: str) -> DataFrame:
    """Write copies and their manifest under ``version=n/run=r``; a failed check leaves no copy.

    ``redacted``: doc_id, unit_seq, unit_id, text. ``checks``: doc_id, name, passed. ``run`` names the batch: batches of a version lie
    beside each other, and a batch that is repeated after a crash replaces only itself. A document
    that fails is left out before anything is written. The manifest comes last, and readers go through it, so that copies of a
    run that broke off are never read. Hashes are taken from the files read back:
    units are hashed where they lie and only the hashes are ordered per document. Returns the
    manifest of the run as written.
    """
    spark = redacted.sparkSession
    failed = checks.where("NOT passed").select("doc_id").distinct()
    checked = checks.select("doc_id").distinct().join(failed, "doc_id", "left_anti")
    good = redacted.join(checked, "doc_id", "left_semi")
    part = f"version={version}/run={run}"
    good.select("doc_id", "unit_seq", "unit_id", "text").write.mode("overwrite").parquet(f"{folder}/copies/{part}")
    saved = spark.read.parquet(f"{folder}/copies/{part}")
    counts = checks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_checks"))
    manifest = content_hash(saved).join(counts, "doc_id")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest/{part}")
    return spark.read.parquet(f"{folder}/manifest/{part}").withColumns({"version": F.lit(version), "run": F.lit(run)})


def read_manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """What is listed of a version, by all its runs."""
    return spark.read.parquet(f"{folder}/manifest").where(F.col("version") == version)


def read_copies(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """Units of a version's copies, of listed documents only."""
    listed = read_manifest(spark, folder, version).select("doc_id", "run")
    return spark.read.parquet(f"{folder}/copies").where(F.col("version") == version).join(listed, ["doc_id", "run"], "left_semi")


BLOCK = 4096


def content_hash(units: DataFrame) -> DataFrame:
    """Hash of a document's units: hash of block hashes, a block being 4096 consecutive units.

    No document is ever gathered whole; only fixed-size hashes of its blocks are.
    """
    blocks = units.selectExpr("doc_id", f"CAST(floor(unit_seq / {BLOCK}) AS BIGINT) AS block", "unit_seq", "sha2(text, 256) AS h").groupBy(
        "doc_id", "block").agg(
        F.expr("sha2(array_join(transform(array_sort(collect_list(struct(unit_seq, h))), x -> x.h), ''), 256)").alias("h"),
        F.count(F.lit(1)).alias("n"))
    return blocks.groupBy("doc_id").agg(
        F.expr("sha2(array_join(transform(array_sort(collect_list(struct(block, h))), x -> x.h), ''), 256)").alias("sha256"),
        F.sum("n").alias("n_units"))
