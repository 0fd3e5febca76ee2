"""Streams: redaction on arrival, versioned decisions, lifetimes, resumption, late results, progress.

Stateless jobs reuse the batch expressions. Stateful ones keep typed state per document that event-time timers end; tables that
outlive a stream are keyed logs. Sources set a rate limit (maxFilesPerTrigger or maxBytesPerTrigger), which bounds a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hushmark import constants as K
from hushmark.operators.pipeline import redact_all
from hushmark.session import cut
from hushmark.sources.units import units_from_text
from hushmark.streaming.keyed import KeyedLog
from hushmark.streaming.processors import Lifetime, VersionFold

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def typed_state(spark: SparkSession) -> None:
    """Processors keep their state in RocksDB, which the session has to name before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into parquet, and return what it wrote."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_batches(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def stream_redact(docs: DataFrame, today: str, folder: str) -> DataFrame:
    """Arriving documents to redacted units, by the batch job itself, micro-batch by micro-batch.

    A document arrives whole, so what its lines tell about each other, repeated names among them, is known in its
    micro-batch. A repeated micro-batch replaces its own files. Returns what was written.
    """
    out = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        done = redact_all(units_from_text(batch), today).selectExpr("doc_id", "unit_id", "redacted", "CAST(n_found AS BIGINT) AS n_found")
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain_batches(docs, folder, write)
    return docs.sparkSession.read.parquet(out).drop("batch")


def versioned_state(events: DataFrame, delay: str) -> DataFrame:
    """Accept only decisions made for the current version, which each accepted one raises by one; decisions count in the order of their time.

    ``events``: doc_id, event_id, ts, version, in any order; ``delay`` is how late one may be and still find its place. Emits a
    document's state whenever the watermark passes events of it. A null doc_id is a heartbeat, which only moves the watermark.
    """
    typed_state(events.sparkSession)
    timed = events.withWatermark("ts", delay).selectExpr("doc_id", "event_id", "unix_micros(ts) AS ts", "version")
    return timed.groupBy("doc_id").transformWithState(VersionFold(), "doc_id long, version long, conflicts long", "update", "eventTime")


def lifetime(events: DataFrame, seconds: int = K.TTL_SECONDS, delay: str | None = None) -> DataFrame:
    """Events within ``seconds`` of their document's creation are accepted, all others are expired; every event comes out once.

    The time runs from creation and does not slide. ``events``: doc_id, event_id, ts, creates; out come doc_id, event_id, ts (microseconds), created
    (of creations) and accepted. State ends when the watermark, ``delay`` (a lifetime, if not given) behind, has passed the lifetime. An event
    behind the watermark that finds no state comes out with accepted null: see ``lifetimes``.
    """
    typed_state(events.sparkSession)
    timed = events.withWatermark("ts", delay or f"{seconds} seconds").selectExpr("doc_id", "event_id", "unix_micros(ts) AS ts", "creates")
    return timed.groupBy("doc_id").transformWithState(
        Lifetime(seconds), "doc_id long, event_id long, ts long, created long, accepted boolean", "append", "eventTime")


def lifetimes(events: DataFrame, folder: str, seconds: int = K.TTL_SECONDS, delay: str | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Run ``lifetime`` over what is there: what was judged so far (doc_id, event_id, accepted), and the ended query.

    Events that found neither their creation nor its state are judged against the table of creations, of which only files that may hold their
    documents are opened. So the result depends neither on the order of arrival nor on the micro-batches, as long as a creation is
    no later than ``delay``.
    """
    spark = events.sparkSession
    judged = lifetime(events, seconds, delay)
    creations = KeyedLog(spark, f"{folder}/creations", ["doc_id"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/judged/batch={number}")
        rows = spark.read.schema(judged.schema).parquet(f"{folder}/judged/batch={number}")
        creations.append(rows.where("created IS NOT NULL").groupBy("doc_id").agg(F.min("created").alias("created")), "stream", number)
        late = rows.where("accepted IS NULL").select("doc_id", "event_id", "ts")
        if late.isEmpty():
            return
        known = creations.lookup(late.select("doc_id"))
        begun = known.select("doc_id", "created") if known is not None else late.selectExpr("doc_id", "CAST(NULL AS BIGINT) AS created").limit(0)
        alive = f"coalesce(ts BETWEEN created AND created + {seconds * 1_000_000}L, false)"
        late.join(begun, "doc_id", "left").selectExpr("doc_id", "event_id", f"{alive} AS accepted").write.mode("overwrite").parquet(f"{folder}/late/batch={number}")

    query = drain_batches(judged, folder, write)
    out = spark.read.schema(judged.schema).parquet(f"{folder}/judged").where("accepted IS NOT NULL").select("doc_id", "event_id", "accepted")
    late = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/late")
    if late.getFileSystem(spark._jsc.hadoopConfiguration()).exists(late):
        out = out.unionByName(spark.read.schema(out.schema).parquet(f"{folder}/late").select(*out.columns))
    return out, query


def ledger(spark: SparkSession, folder: str) -> KeyedLog:
    """The redacted rows of finished contents: a content is done when, and only when, its rows count."""
    return KeyedLog(spark, folder, ["content_key"], newest=False)


def dedupe_resume(docs: DataFrame, folder: str, ledger_folder: str, run: str, today: str) -> None:
    """Redact each content once, across retries, restarts and lost checkpoints.

    A micro-batch opens only those files of the ledger that may hold one of its contents. A repeated micro-batch finds itself
    finished. A null text is a content of its own, done with a row without units.
    """
    done = ledger(docs.sparkSession, ledger_folder)

    def write(batch: DataFrame, number: int) -> None:
        if done.finished(run, number):
            return
        fresh = batch.groupBy(F.expr("coalesce(sha2(text, 256), '')").alias("content_key")).agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
        fresh = cut(done.absent(fresh))
        redacted = redact_all(units_from_text(fresh.selectExpr("content_key AS doc_id", "text")), today).selectExpr("doc_id AS content_key", "unit_id", "redacted")
        rows = fresh.select("content_key", "doc_id").join(redacted, "content_key", "left")
        done.append(rows.withColumns({"run": F.lit(run), "batch": F.lit(number)}), run, number)

    drain_batches(docs, folder, write)


def stale_guard(results: DataFrame, current: DataFrame) -> DataFrame:
    """Late results whose request, version and hash still match the document's current row."""
    return results.join(current, ["doc_id", "request_id", "version", "sha256"])


def stale_guard_streams(results: DataFrame, states: DataFrame, seconds: int, delay: str) -> DataFrame:
    """The same where a document's rows come as a stream themselves: a result counts if it came while the row it was made for was in force.

    ``results``: result_id, doc_id, request_id, version, sha256, ts. ``states``: doc_id, request_id, version, sha256, since, until (null: to the end of the
    lifetime), each in force for ``seconds`` at most. Both sides carry a watermark and a state lasts no longer than that, so neither
    results that come too late nor rows that never meet one stay in memory.
    """
    left = results.withWatermark("ts", delay).alias("l")
    right = states.withWatermark("since", delay).alias("r")
    same = " AND ".join(f"l.{k} = r.{k}" for k in ("doc_id", "request_id", "version", "sha256"))
    held = f"ts >= since AND ts < since + INTERVAL {seconds} SECONDS AND (until IS NULL OR ts < until)"
    return left.join(right, F.expr(f"{same} AND {held}")).selectExpr("l.result_id", "l.doc_id", "l.version")


def progress(stages: DataFrame) -> DataFrame:
    """Latest status and counts per document and stage; emits changed rows only."""
    return stages.groupBy("doc_id", "stage").agg(
        F.expr("max_by(status, struct(ts, event_id))").alias("status"), F.expr("count_if(status = 'completed')").alias("done"),
        F.count(F.lit(1)).alias("total"))


def latest_rows(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Keep an update stream as a keyed log and read the newest row per key; reading opens a few merged runs, not every micro-batch."""
    table = KeyedLog(stream.sparkSession, f"{folder}/table", keys, lookups=False)
    drain_batches(stream, folder, lambda batch, number: table.append(batch, "stream", number), "update")
    rows = table.rows()
    return rows if rows is not None else stream.sparkSession.createDataFrame([], stream.schema)
