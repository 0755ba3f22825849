"""Workflows return every row, however long it is under way."""

from pyspark.sql import functions as F

from lodestone import plugins


def test_rows_come_back_after_many_rounds(spark):
    rows = spark.createDataFrame([(1, 60), (2, 3), (3, 1)], "id long, need int").withColumn("n", F.lit(0))
    flow = plugins.Workflow({"a": plugins.Step(lambda r: r.withColumn("n", F.col("n") + 1), [("a", "n < need")])}, "a")
    assert {r["id"]: (r["visits"], r["state"], r["ended"]) for r in flow(rows).collect()} == {1: (60, "a", True), 2: (3, "a", True), 3: (1, "a", True)}
    assert {r["id"]: (r["visits"], r["state"], r["ended"]) for r in flow(rows, 2).collect()} == {1: (2, "a", False), 2: (2, "a", False), 3: (1, "a", True)}
