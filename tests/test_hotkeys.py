from pyspark.sql import functions as F

from plexaform.operators.hotkeys import heavy_keys, keyed_states


def test_repeats_nulls_ties(spark):
    rows = [("a", 1, 5, 2.0), ("a", 1, 5, 2.0), ("a", 2, 7, None), (None, 3, None, 1.0), ("a", None, 1, 4.0), ("a", None, 1, 4.0), ("b", 9, None, None)]
    df = spark.createDataFrame(rows, "k string, id int, depth int, x double").withColumn("rows", F.lit("clash")).withColumn("key", F.lit(0))
    got = {r["key"]: r for r in keyed_states(df, F.col("k"), [F.col("id")], {"deepest": F.col("depth")}, {"total": F.col("x")}, {"mean": F.col("x")}).collect()}
    assert (got["a"]["rows"], got["a"]["records"], got["a"]["deepest"], got["a"]["total"]) == (5, 4, 7, 10.0)
    assert (got[None]["records"], got[None]["deepest"], got[None]["mean"]) == (1, None, 1.0)
    assert (got["b"]["total"], got["b"]["mean"]) == (None, None)


def test_heavy(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] * 2 + [(None,)] * 3 + [("c",)], "k string")
    assert {(r["key"], r["rows"]) for r in heavy_keys(df, "k", 0.2).collect()} == {("a", 4), ("b", 2)}
    assert heavy_keys(df.limit(0), "k", 0.04).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "k string, id int")
    assert keyed_states(df, F.col("k"), [F.col("id")]).count() == 0
