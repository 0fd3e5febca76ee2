"""Streams over many shuffled micro-batches, with restarts; and the keyed table that outlives them."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from hushmark.streaming import jobs as J
from hushmark.streaming.keyed import KeyedLog

START = datetime.datetime(2024, 5, 1)
EVENTS = "doc_id long, event_id long, ts timestamp, version long"
LIVES = "doc_id long, event_id long, ts timestamp, creates boolean"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every micro-batch commits the state of every partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def by_arrival(rows, late, files, seed):
    """Rows dealt to files by their time plus a delay; unordered within a file."""
    rng = random.Random(seed)
    timed = sorted((row[2] + datetime.timedelta(seconds=rng.uniform(0, late)), rng.random(), row) for row in rows)
    size = -(-len(timed) // files)
    return [[row for _, _, row in timed[k : k + size]] for k in range(0, len(timed), size)]


def ordered_fold(rows):
    state = {}
    for doc, _, _, claimed in sorted(rows, key=lambda r: (r[2], r[1])):
        version, conflicts = state.get(doc, (1, 0))
        state[doc] = (version + 1, conflicts) if claimed == version else (version, conflicts + 1)
    return state


def decisions(seed, n=600, docs=9):
    rng, state, rows = random.Random(seed), {}, []
    for k in range(n):
        doc = rng.choice([0] * 5 + list(range(docs)))  # document 0 has a third of all events and more
        version = state.get(doc, 1)
        claimed = version + rng.choice([0, 0, 0, -1, 1])
        state[doc] = version + (claimed == version)
        rows.append((doc, k, at(60 * k + rng.random()), claimed))
    return rows


def test_versions_from_shuffled_batches_with_a_restart(spark, tmp_path):
    """Twenty micro-batches whose events are up to an hour late; the stream ends after ten and starts again from its checkpoint."""
    rows = decisions(3)
    files = by_arrival(rows, 3600, 20, 5)
    assert len(files) == 20 and any(a[2] > b[2] for f in files for a, b in zip(f, f[1:]))
    files.append([(None, None, at(10**6), None)])  # the heartbeat
    for half in (files[:10], files[10:]):
        for f in half:
            put(spark, f, EVENTS, f"{tmp_path}/in")
        done = J.latest_rows(J.versioned_state(source(spark, EVENTS, f"{tmp_path}/in"), "1 hour"), f"{tmp_path}/work", ["doc_id"])
    assert {r.doc_id: (r.version, r.conflicts) for r in done.collect()} == ordered_fold(rows)
    table = KeyedLog(spark, f"{tmp_path}/work/table", ["doc_id"])
    assert len(table.manifest()["runs"]) <= 2 * table.fan < 20


def test_a_version_behind_the_watermark_is_judged_when_it_comes(spark, tmp_path):
    files = [[(1, 1, at(0), 1)], [(1, 2, at(7200), 2)], [(None, None, at(90_000), None)], [(1, 3, at(60), 2)], [(1, 4, at(90), 3)]]
    for f in files:
        put(spark, f, EVENTS, f"{tmp_path}/in")
    done = J.latest_rows(J.versioned_state(source(spark, EVENTS, f"{tmp_path}/in"), "1 hour"), f"{tmp_path}/work", ["doc_id"])
    assert [tuple(r) for r in done.select("doc_id", "version", "conflicts").collect()] == [(1, 4, 1)]


def lives(seed, docs=40):
    rng, rows = random.Random(seed), []
    for doc in range(docs):
        born = rng.uniform(0, 40_000)
        rows.append((doc, 100 * doc, at(born), True))
        rows += [(doc, 100 * doc + k, at(born + rng.choice([rng.uniform(0, 4000), 3600.0, 3600.001, rng.uniform(-900, 9000)])), False) for k in range(1, 9)]
    return rows


def expected_lives(rows):
    born = {r[0]: r[2] for r in rows if r[3]}
    return {r[1]: datetime.timedelta(0) <= r[2] - born[r[0]] <= datetime.timedelta(seconds=3600) for r in rows}


@pytest.mark.parametrize(("files", "seed"), [(12, 1), (3, 2)])
def test_lifetimes_do_not_depend_on_arrival(spark, tmp_path, files, seed):
    rows = lives(11)
    for f in [*by_arrival(rows, 1800, files, seed), [(None, None, at(10**6), None)]]:
        put(spark, f, LIVES, f"{tmp_path}/in")
    done, query = J.lifetimes(source(spark, LIVES, f"{tmp_path}/in"), f"{tmp_path}/work", 3600, "30 minutes")
    found = [(r.event_id, r.accepted) for r in done.collect()]
    assert len(found) == len(rows) and dict(found) == expected_lives(rows)
    states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    # When all lifetimes have passed, nothing is kept; a document's rows before that are its creation, its timers and what waits.
    assert states[-1] == 0 and max(states) < len(rows)


def test_lifetimes_of_late_events_come_from_the_table(spark, tmp_path):
    """Events long behind the watermark, of a document whose state has ended, of one that still waits and of one never created."""
    files = [
        [(1, 10, at(0), True), (2, 20, at(5), False)], [(1, 11, at(3600), False)], [(9, 90, at(50_000), True)], [(9, 91, at(50_001), False)],
        [(1, 12, at(3599), False), (1, 13, at(3601), False), (3, 30, at(10), False), (1, 14, at(49_990), False)], [(None, None, at(10**6), None)]]
    for f in files:
        put(spark, f, LIVES, f"{tmp_path}/in")
    done, query = J.lifetimes(source(spark, LIVES, f"{tmp_path}/in"), f"{tmp_path}/work", 3600, "10 minutes")
    assert {r.event_id: r.accepted for r in done.collect()} == {10: True, 11: True, 12: True, 13: False, 14: False, 20: False, 30: False, 90: True, 91: True}
    assert query.lastProgress.stateOperators[0].numRowsTotal == 0


def test_a_keyed_log_opens_few_runs_and_survives_its_writer(spark, tmp_path, monkeypatch):
    table = KeyedLog(spark, f"{tmp_path}/t", ["k"], buckets=4, fan=3)
    assert table.rows() is None and table.absent(spark.range(3).toDF("k")).count() == 3
    want = {}
    for batch in range(14):
        rows = [(k, batch) for k in range(batch, batch + 6)] + [(None, batch)]
        want |= dict(rows)
        table.append(spark.createDataFrame(rows, "k long, v int"), "w", batch)
        assert len(table.manifest()["runs"]) <= 2 * 3
    assert {r.k: r.v for r in table.rows().collect()} == want
    assert len(table.opened) < 7 and {r["tier"] for r in table.manifest()["runs"]} == {0, 1, 2}

    def dies(self, state):
        raise KeyboardInterrupt

    for at_step in ("append", "merge"):
        before = table.manifest()
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            if at_step == "append":
                m.setattr(KeyedLog, "_commit", dies)
            else:
                m.setattr(KeyedLog, "_write", lambda self, rows, tier, write=KeyedLog._write: dies(self, None) if tier else write(self, rows, tier))
                while True:  # until a merge is due
                    n = table.manifest()["done"]["w"] + 1
                    want[100] = n
                    table.append(spark.createDataFrame([(100, n)], "k long, v int"), "w", n)
            table.append(spark.createDataFrame([(0, -1)], "k long, v int"), "w", 99)
        assert {r.k: r.v for r in table.rows().collect()} == want
        assert before["number"] <= table.manifest()["number"]
    table.append(spark.createDataFrame([(0, 99)], "k long, v int"), "w", 99)
    table.append(spark.createDataFrame([(0, -5)], "k long, v int"), "w", 99)  # the same batch again
    table.append(spark.createDataFrame([], "k long, v int"), "w", 100)
    assert {r.k: r.v for r in table.rows().collect()} == want | {0: 99}


def test_lookups_open_only_files_that_may_hold_a_key(spark, tmp_path):
    table = KeyedLog(spark, f"{tmp_path}/t", ["k"], buckets=8, fan=4, newest=False)
    for batch in range(3):
        table.append(spark.range(batch * 1000, batch * 1000 + 1000).selectExpr("CAST(id AS STRING) AS k", "id AS v"), "w", batch)
    asked = spark.createDataFrame([("1500",), ("never",)], "k string")
    assert [r.v for r in table.lookup(asked).collect()] == [1500]
    assert len(table.opened) <= 2  # of 24 files
    assert [r.k for r in table.absent(asked).collect()] == ["never"]
    assert table.lookup(spark.createDataFrame([("1500",)], "k string")).count() == 1 and len(table.opened) == 1


def test_contents_are_done_once_across_lost_checkpoints(spark, tmp_path, monkeypatch):
    texts = [(1, "전화 010-1234-5678"), (2, None), (3, ""), (4, "전화 010-1234-5678"), (5, "a\nb"), (6, None)]
    for k in range(0, 6, 2):
        put(spark, texts[k : k + 2], "doc_id long, text string", f"{tmp_path}/in")

    def run(name):
        J.dedupe_resume(source(spark, "doc_id long, text string", f"{tmp_path}/in"), f"{tmp_path}/{name}", f"{tmp_path}/ledger", name, "2026-01-01")

    commit, died = KeyedLog._commit, []

    def once(self, state):
        if state["number"] == 1 and not died:
            died.append(1)
            raise RuntimeError("the driver dies before the second micro-batch counts")
        commit(self, state)

    monkeypatch.setattr(KeyedLog, "_commit", once)
    with pytest.raises(Exception, match="driver dies"):
        run("first")
    run("first")
    run("second")  # its checkpoint is a new one
    rows = J.ledger(spark, f"{tmp_path}/ledger").rows()
    done = {r.content_key: (r.times, r.units) for r in rows.groupBy("content_key").agg(F.countDistinct("run", "batch").alias("times"), F.count("unit_id").alias("units")).collect()}
    assert len(done) == 4 and {t for t, _ in done.values()} == {1} and done[""] == (1, 0)
    assert {r.run for r in rows.select("run").collect()} == {"first"}


def test_the_guard_of_two_streams_forgets(spark, tmp_path):
    """Results that come too late, rows replaced in between, and rows that never meet a result; in the end no state is left."""
    results = "result_id long, doc_id long, request_id long, version long, sha256 string, ts timestamp"
    states = "doc_id long, request_id long, version long, sha256 string, since timestamp, until timestamp"
    day = 86_400
    for d in range(8):
        put(spark, [(100 * d + n, n, 0, 1 + (d > 3), "h", at(d * day + 10)) for n in range(3)] + [(1000 + d, 77, 0, 1, "h", at(d * day))], results, f"{tmp_path}/r")
        now = [(n, 0, 1, "h", at(0), at(4 * day) if n else at(2 * day)) for n in range(3)] if d == 0 else [(n, 0, 2, "h", at(4 * day), None) for n in range(3)] if d == 4 else []
        put(spark, [*now, (50 + d, 0, 1, "h", at(d * day), None)], states, f"{tmp_path}/s")
    for d in (60, 61):  # the second meets the watermark of the first
        put(spark, [(-1, -1, 0, 0, "left", at(d * day))], results, f"{tmp_path}/r")
        put(spark, [(-1, 0, 0, "right", at(d * day), None)], states, f"{tmp_path}/s")
    left, right = source(spark, results, f"{tmp_path}/r"), source(spark, states, f"{tmp_path}/s")
    found = []
    query = J.drain_batches(J.stale_guard_streams(left, right, 3 * day, "1 hour"), f"{tmp_path}/w", lambda b, n: found.extend(r.result_id for r in b.collect()))
    # Version 1 for three days (document 0: two), version 2 from day four for three days.
    assert sorted(found) == [0, 1, 2, 100, 101, 102, 201, 202, 400, 401, 402, 500, 501, 502, 600, 601, 602]
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert kept[-1] <= 4 and max(kept) < 30  # at the end the heartbeats
