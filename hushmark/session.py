"""Session settings the jobs rely on; a cluster's own settings are left alone."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hushmark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.hushmark.inputPartitions", str(shuffle_partitions))
        # Small shuffles still feed costly expressions: keep them on all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one runtime setting that changes results, and let only measured sizes lead to a broadcast.

    Before a job runs Spark knows no more than the size of the files. Units, finds and records are many times what they were made from, so a plan made by
    that guess would bring all of them to the driver. The session's own limit stays, for what adaptive execution has measured.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if str(limit) != "-1" and spark.conf.get("spark.sql.adaptive.enabled") == "true":
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, removed when Python ends; on a cluster it is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="hushmark-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
        folder = context.getCheckpointDir()
    return folder


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run's files below the shared one."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Write a result that several later steps read, so they neither recompute nor re-plan it; always, wherever it runs."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The same as a table in the shared folder, where later steps read only the columns they need."""
    folder = work_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
