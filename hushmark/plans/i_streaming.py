"""Queries over streams; each reads a table as a stream, runs to the end and returns the result."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from hushmark.plans import fixtures as fx
from hushmark.plans.b_formats import settled
from hushmark.plans.c_labels import EVERYTHING, T, made
from hushmark.session import work_folder
from hushmark.streaming import jobs as J


def stream(spark, d, name):
    """A table as a stream of one file a micro-batch; the bracket makes the path a pattern, which single files need."""
    schema = fx.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}.parque[t]")


def derived(spark, d, sql, name):
    """One of the derived inputs over a stream of its table."""
    text = fx._protect(re.sub(rf"\bFROM {name}\b", f"FROM {{{name}}}", sql), {name: None})
    return spark.sql(text, **{name: fx.dealt(stream(spark, d, name))})


#: Each turn is a document of its own, apart from the others.
TURN_ID = "1000000000 + conv_id * 1000 + turn"


def i1(spark, d):
    korean = derived(spark, d, fx.DOCS, "customer")
    given = fx.dealt(stream(spark, d, "documents")).selectExpr("-1 - doc_id AS doc_id", "text")
    turns = fx.dealt(stream(spark, d, "conversations")).selectExpr(f"{TURN_ID} AS doc_id", "text")
    out = None
    for docs in (korean, given, turns):
        done = J.stream_redact(docs, T, work_folder(spark, "redact"))
        out = done if out is None else out.unionByName(done)
    return out


# Decisions claim the version they saw; errors claim one too old, signups one too new.
_BAD = "event_type IN ('error', 'signup')"
DECISIONS = (
    f"SELECT user_id AS doc_id, event_id, ts, CASE event_type WHEN 'error' THEN seen - 1 WHEN 'signup' THEN seen + 1 ELSE seen END AS version FROM (SELECT *, "
    f"1 + coalesce(sum(CASE WHEN {_BAD} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM events) e"
)
LIVES = "SELECT user_id AS doc_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS creates FROM events"
#: Days by which events of the topics arrive late at most, and rows of a file: of events, and of documents, of which each is a whole text.
LATE_DAYS, FILE_ROWS, FILE_DOCS = 3, 1_000_000, 10_000


def _topic(spark, rows, slices, arrival="unix_micros(ts)", heartbeat=None, file_rows=FILE_ROWS):
    """Rows as the files of a topic, slice by slice in the order of ``arrival`` and in none within a slice, read as a stream of one slice a micro-batch."""
    folder = work_folder(spark, "topic")
    timed = rows.withColumn("_at", F.expr(arrival))
    first, last, n = timed.agg(F.min("_at"), F.max("_at"), F.count(F.lit(1))).first()
    files = max(1, -(-n // (slices * file_rows)))
    place = F.expr(f"CAST(least(floor({slices} * ((_at - {first}) / CAST({last} - {first} + 1 AS DOUBLE))), {slices - 1}) AS INT)")
    for part in range(slices):
        timed.where(place == part).drop("_at").repartition(files).write.mode("append").parquet(folder)
    if heartbeat is not None:
        heartbeat.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def shuffled(spark, rows, slices):
    """Events that arrive up to LATE_DAYS after their time, and a heartbeat that moves the watermark past the last of them."""
    last = rows.agg(F.max("ts")).first()[0]
    beat = spark.range(1).select(*[(F.lit(last) + F.expr(f"INTERVAL {2 * LATE_DAYS} DAYS") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    late = f"unix_micros(ts) + pmod(xxhash64(event_id), {LATE_DAYS * 86_400_000_000}L)"
    return _topic(spark, rows, slices, late, beat)


def _events(spark, d, sql):
    return fx.derive(spark, d, sql).withColumn("ts", F.col("ts").cast("timestamp"))


def i2(spark, d):
    events = shuffled(spark, _events(spark, d, DECISIONS), 7)
    return J.latest_rows(J.versioned_state(events, f"{LATE_DAYS} days"), work_folder(spark, "versions"), ["doc_id"])


def i3(spark, d):
    events = shuffled(spark, _events(spark, d, LIVES), 7)
    return J.lifetimes(events, work_folder(spark, "lifetime"), delay=f"{LATE_DAYS} days")[0]


def i4(spark, d):
    """The same documents arrive again, in other micro-batches, after a restart that lost its checkpoint."""
    folder = work_folder(spark, "ledger")
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    for run, slices in (("first", 3), ("second", 2)):
        J.dedupe_resume(_topic(spark, docs, slices, "doc_id", file_rows=FILE_DOCS), work_folder(spark, "resume"), folder, run, T)
    done = J.ledger(spark, folder).rows()
    return done.groupBy("content_key").agg(
        F.countDistinct("run", "batch").alias("times"), F.min("doc_id").alias("doc_id"), F.count("unit_id").alias("n_units"),
        F.coalesce(F.sum(F.length("redacted")), F.lit(0)).alias("n_chars"))


RESULTS = (
    "SELECT o_orderkey AS result_id, o_custkey AS doc_id, o_orderkey % 3 AS request_id, 1 + o_orderkey % 2 AS version, CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE 'h' || CAST(o_custkey AS STRING) END AS sha256 FROM orders"
)
CURRENT = "SELECT c_custkey AS doc_id, c_custkey % 3 AS request_id, 1 + c_custkey % 2 AS version, 'h' || CAST(c_custkey AS STRING) AS sha256 FROM customer"


def i5(spark, d):
    accepted = J.stale_guard(derived(spark, d, RESULTS, "orders"), fx.derive(spark, d, CURRENT))
    return J.drain(accepted, work_folder(spark, "results")).select("result_id", "doc_id", "version")


# Two rows a document: the first in force until the second comes, each for 500 days at most.
FORCE_DAYS = 500
TIMED = RESULTS.replace(" FROM orders", ", CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders")
STATES = """SELECT doc_id, doc_id % 3 AS request_id, n AS version, 'h' || CAST(doc_id AS STRING) AS sha256, since, CASE WHEN n = 1 THEN replaced END AS until FROM (
    SELECT doc_id, n, CASE WHEN n = 1 THEN begun ELSE replaced END AS since, replaced FROM (
        SELECT c_custkey AS doc_id, 1 AS n, CAST('1995-01-01' AS TIMESTAMP) + c_custkey % 700 * INTERVAL '1' DAY AS begun, CAST('1995-11-01' AS TIMESTAMP) + c_custkey % 900 * INTERVAL '1' DAY AS replaced FROM customer
        UNION ALL SELECT c_custkey, 2, CAST('1995-01-01' AS TIMESTAMP), CAST('1995-11-01' AS TIMESTAMP) + c_custkey % 900 * INTERVAL '1' DAY FROM customer) x) y"""


def i5_streams(spark, d):
    """Results and the documents' rows both as streams, in the order of time."""
    results = _topic(spark, fx.derive(spark, d, TIMED), 5)
    states = _topic(spark, fx.derive(spark, d, STATES), 5, "unix_micros(since)")
    return J.drain(J.stale_guard_streams(results, states, FORCE_DAYS * 86_400, "1 day"), work_folder(spark, "guard"))


def i6(spark, d):
    stages = fx.table(spark, d, "events").selectExpr(
        "user_id AS doc_id", "event_type AS stage", "CASE WHEN value > 20 THEN 'completed' ELSE 'running' END AS status", "CAST(ts AS TIMESTAMP) AS ts", "event_id")
    return J.latest_rows(J.progress(shuffled(spark, stages, 7).where("doc_id IS NOT NULL")), work_folder(spark, "progress"), ["doc_id", "stage"])


QUERIES = {
    "stream_redact": i1, "stream_versioned_state": i2, "stream_ttl": i3, "stream_dedupe_resume": i4, "stream_stale_guard": i5,
    "stream_stale_guard_streams": i5_streams, "stream_progress": i6,
}

_TURNS = f"SELECT * FROM ({fx.DOCUMENT_UNITS_DUCK.replace('FROM documents d', f'FROM (SELECT {TURN_ID} AS doc_id, text FROM conversations) d')}) t"
_FOUND = f"""
    WITH people AS ({fx.PEOPLE}) SELECT doc_id, unit_id, start, "end" FROM ({made(*EVERYTHING)})
    UNION ALL SELECT doc_id, unit_id, start, "end" FROM ({settled(f"SELECT -1 - doc_id AS doc_id, unit_seq, unit_id, text FROM ({fx.DOCUMENT_UNITS_DUCK}) x UNION ALL {_TURNS}")})"""
ORACLE = {
    "stream_redact": f"""
        WITH c AS ({_FOUND}), u AS ({fx.ALL_UNITS_DUCK} UNION ALL {_TURNS}),
        o AS (SELECT *, lag("end", 1, 0) OVER (PARTITION BY doc_id, unit_id ORDER BY start) AS prev FROM c),
        j AS (SELECT o.doc_id, o.unit_id, string_agg(substr(u.text, o.prev + 1, o.start - o.prev) || repeat('*', o."end" - o.start), '' ORDER BY o.start) AS head, max(o."end") AS tail, count(*) AS n
              FROM o JOIN u ON o.doc_id = u.doc_id AND o.unit_id = u.unit_id GROUP BY 1, 2)
        SELECT u.doc_id, u.unit_id, CASE WHEN j.tail IS NULL THEN u.text ELSE j.head || substr(u.text, j.tail + 1) END AS redacted, coalesce(j.n, 0) AS n_found
        FROM u LEFT JOIN j ON u.doc_id = j.doc_id AND u.unit_id = j.unit_id""",
    "stream_versioned_state": f"SELECT user_id AS doc_id, 1 + count(*) FILTER (WHERE NOT {_BAD}) AS version, count(*) FILTER (WHERE {_BAD}) AS conflicts FROM events GROUP BY 1",
    "stream_ttl": "SELECT user_id AS doc_id, event_id, ts <= min(ts) OVER (PARTITION BY user_id) + INTERVAL 3600 SECOND AS accepted FROM events",
    "stream_dedupe_resume": "SELECT coalesce(sha256(text), '') AS content_key, 1 AS times, min(doc_id) AS doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_units, coalesce(length(replace(text, chr(10), '')), 0) AS n_chars FROM documents GROUP BY 1, 4, 5",
    "stream_stale_guard": "SELECT o_orderkey AS result_id, o_custkey AS doc_id, 1 + o_orderkey % 2 AS version FROM orders WHERE o_orderkey % 3 = o_custkey % 3 AND o_orderkey % 2 = o_custkey % 2 AND o_orderkey % 5 <> 0",
    "stream_stale_guard_streams": f"""SELECT l.result_id, l.doc_id, l.version FROM ({TIMED}) l JOIN ({STATES}) r USING (doc_id, request_id, version, sha256)
        WHERE ts >= since AND ts < since + INTERVAL {FORCE_DAYS} DAY AND (until IS NULL OR ts < until)""",
    "stream_progress": """SELECT user_id AS doc_id, event_type AS stage, CASE WHEN arg_max(value, ts) > 20 THEN 'completed' ELSE 'running' END AS status,
        count(*) FILTER (WHERE value > 20) AS done, count(*) AS total FROM events GROUP BY 1, 2""",
}
