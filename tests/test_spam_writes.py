import os

from pyspark.sql import functions as F

from tidewire.operators import spam
from tidewire.sources.sinks import shared_folder


def test_clusters_write_no_texts_for_pairs(spark):
    """100 texts that share their trigrams make 4,950 pairs, of which numbers alone are written."""

    def written():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared_folder(spark).removeprefix("file:")) for f in files)

    words = " ".join(f"word{k}" for k in range(60))
    rows = spark.range(100).select(F.lit("n").alias("network"), F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("2024-01-01 00:01:00").cast("timestamp_ntz").alias("time"), F.lit("me").alias("sender"), F.concat(F.lit(words), F.lit(" "), F.col("id").cast("string")).alias("text"))
    before = written()
    found = spam.clusters(rows).select("cluster", "size").distinct().collect()
    assert [(r.cluster, r.size) for r in found] == [("0:0", 100)]
    assert written() - before < 1_500_000
