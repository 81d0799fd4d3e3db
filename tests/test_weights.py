"""Class weights: joined by broadcasting the few weights, never the rows."""

import re

from pyspark.sql import functions as F

from geotally.operators import learn


def test_weights_go_to_the_rows(spark):
    df = spark.range(0, 20000, 1, 4).select("id", F.when(F.col("id") % 9 != 0, F.col("id") % 3).alias("c"), F.rand(1).alias("f"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")  # less than the rows, more than the weights
    try:
        out = learn.balanced_weights(df, "c")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"BroadcastHashJoin .*BuildRight", plan) and "SortMergeJoin" not in plan
        got = {r["c"]: (r["n"], r["w"]) for r in out.groupBy("c").agg(F.count("*").alias("n"), F.max("weight").alias("w")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(n for n, _ in got.values()) == 20000 and all(abs(w - 20000 / (len(got) * n)) < 1e-12 for n, w in got.values())
