"""No task of a keyed log holds a share that only grows."""

from hushmark.streaming.keyed import KeyedLog


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "8")
    log = KeyedLog(other, str(tmp_path), ["k"], buckets=2, lookups=True)
    log.append(other.range(200).selectExpr("id AS k", "id * 2 AS v"), "w", 0)
    run = log.manifest()["runs"][0]["name"]
    assert max(len(list((tmp_path / "rows" / run / f"bucket={b}").glob("*.parquet"))) for b in (0, 1)) > 1
    assert log.rows().count() == 200 and log.lookup(other.range(7).selectExpr("id AS k")).where("k = 3").first().v == 6
