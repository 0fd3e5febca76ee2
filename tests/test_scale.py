"""What keeps plans within bounds as tables grow: broadcasts by measured size, values carried over blocks."""

from pyspark.sql import functions as F

from hushmark.operators.joins import carry_last
from hushmark.session import prepare


def _plan(frame):
    return frame._jdf.queryExecution().sparkPlan().toString()


def test_only_measured_sizes_lead_to_a_broadcast(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    other.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    few = other.range(50).selectExpr("id AS doc_id", "explode(sequence(1, 100)) AS unit_seq")
    joined = few.join(few.groupBy("doc_id").agg(F.max("unit_seq").alias("m")), "doc_id")
    assert "BroadcastHashJoin" in _plan(joined.select("*"))
    prepare(prepare(other))
    assert "BroadcastHashJoin" not in _plan(joined.select("*"))
    assert other.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold").rstrip("b") in ("10m", "10485760")
    assert joined.count() == 5000


def test_a_session_that_forbids_broadcasts_is_left_alone(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    other.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    prepare(other)
    assert other.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def test_the_last_value_comes_from_any_block_before(spark):
    rows = spark.createDataFrame([(1, n, "h" if n in (2, 11) else None) for n in range(30)], "doc_id int, n int, v string")
    got = {r.n: r.out for r in carry_last(rows.withColumn("v", F.expr("v || n")), ["doc_id"], "n", "v", "out", block=4).collect()}
    assert got == {n: None if n <= 2 else "h2" if n <= 11 else "h11" for n in range(30)}
