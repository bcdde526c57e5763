import pytest
from pyspark.sql import functions as F

from freshet.operators.skew import find_hot_keys, spread_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows_per_task", [10_000, 100])
def test_spread_join_equals_a_plain_join(spark, how, rows_per_task):
    hot = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
    left = spark.range(2000).select("id", hot.otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    right = spark.range(0, 50, 2).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    right = right.unionByName(spark.createDataFrame([("hot", -1)], "k string, v bigint"))
    found = find_hot_keys(left, "k", rows_per_task)
    parts = {str(r["k"]): r["_salts"] for r in found.keys.collect()}
    assert parts == ({} if rows_per_task == 10_000 else {"hot": 7, "None": 2})
    got = spread_join(left, right, "k", how, ["id"], found)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
