"""Texts are made by all tasks, however few splits their table has."""

from hushmark.plans import fixtures as fx


def test_texts_are_made_by_all_tasks(spark, tmp_path):
    spark.range(40).selectExpr("id AS c_custkey", "'n' AS c_name", "'s' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = fx.derive(spark, str(tmp_path), fx.PEOPLE)
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert made.count() == 40
