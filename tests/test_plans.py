"""Queries without SQL read whole tables."""

from gridloom.plans import catalog


def test_samples_of_high_order_keys(spark, tmp_path):
    high = 2 * 10**9
    lines = [(k, 2 * k + n, "ARN"[k % 3]) for k in range(5) for n in range(2)] + [(high, n, "R") for n in range(10)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [r.key for r in catalog.QUERIES["covisibility_sample"](spark, str(tmp_path)).collect()]
    assert got[0] == high  # the only order with all objects
    assert sorted(got) == [0, 1, 2, 3, 4, high]
    balanced = catalog.QUERIES["balanced_sample"](spark, str(tmp_path)).collect()
    assert sorted(r.key for r in balanced) == [0, 1, 2, 3, 4, high]
