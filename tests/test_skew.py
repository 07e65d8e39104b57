from pyspark.sql import functions as F

from strideflow.plans.skew import lookup
from tests.conftest import rows


def test_hot_keys_are_looked_up_by_broadcast(spark):
    t = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("v"))
    table = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")).unionByName(spark.createDataFrame([(1, 10)], "k long, w long"))
    for how in ("inner", "left"):
        got = lookup(t, table, "k", how, hot_rows=100)
        assert got.columns == ["k", "v", "w"] and rows(got.fillna(-1)) == rows(t.join(table, "k", how).fillna(-1))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
    assert lookup(t.limit(0), table, "k").count() == 0
