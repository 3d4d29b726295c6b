import os

from pyspark.sql import functions as F

from tidewire.plans.catalogue import QUERIES


def test_uptime_of_zero_in_milliseconds(spark, tmp_path):
    rows = spark.createDataFrame([(100_000, 1), (1, 1)], "o_orderkey long, o_custkey long").withColumn("o_orderdate", F.lit("2024-01-01").cast("date"))
    rows.write.parquet(os.path.join(tmp_path, "orders.parquet"))
    assert {r.sample_id: (r.battery_mv, r.uptime_secs, r.raw_only) for r in QUERIES["s07_status_fields"](spark, str(tmp_path)).collect()} == {100_000: (3200, 0.0, False), 1: (3201, 37.0, False)}
