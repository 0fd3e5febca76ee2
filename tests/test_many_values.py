"""A document of many values is searched by all tasks: none has all of its pieces or lines."""

from hushmark.operators import literal


def test_pieces_of_one_document_are_dealt_out(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    other.conf.set("spark.sql.shuffle.partitions", "8")
    values = other.range(3000).selectExpr("1L AS doc_id", "concat('Customer#', lpad(id, 9, '0')) AS value")
    keyed = literal._keyed(values)
    assert "Window" not in keyed._jdf.queryExecution().optimizedPlan().toString()
    parts = keyed.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 1500
    assert keyed.select("value").distinct().count() == keyed.count() == 3000
    # The piece of each value is one that the fewest values share.
    pieces = values.selectExpr("value", f"explode({literal._grams('value', 8)}) AS _h")
    shared = pieces.groupBy("_h").count()
    least = pieces.join(shared, "_h").groupBy("value").agg({"count": "min"})
    assert keyed.join(shared, "_h").join(least, "value").where("count <> `min(count)`").count() == 0


def test_every_value_is_found_at_any_place_of_the_filter(spark):
    values = spark.range(5000).selectExpr("id % 2 AS doc_id", "IF(id % 5 = 0, concat('v', id), concat('name of ', id, ' x')) AS value")
    units = values.selectExpr("doc_id", "CAST(hash(value) AS INT) AS unit_seq", "value AS unit_id", "concat('가 ', value, ' / ', value) AS text")
    found = literal.with_values(units, values.selectExpr("*", "length(value) AS n"), ["n"]).selectExpr("unit_id", "inline(_values)")
    assert found.where("unit_id = value AND n = length(value)").count() == 5000
    assert found.where("NOT contains(concat('가 ', unit_id, ' / ', unit_id), value)").count() < 50_000
