from pyspark.sql import functions as F

from tidewire.streaming.ingest import MergeSink, deduplicated, hourly, packet_stream, run_available, sessions

SCHEMA = "packet_hash string, rx_node_id string, src_node_id string, network string, hop_count int, rssi double, time timestamp"


def write(spark, folder):
    rows = spark.range(400).selectExpr(
        "concat('p', id div 4) AS packet_hash", "concat('r', id % 2) AS rx_node_id", "concat('s', id % 3) AS src_node_id", "if(id % 5 = 0, 'north', 'south') AS network",
        "1 AS hop_count", "double(id % 50) AS rssi", "timestamp_seconds(1704067200 + (id div 4) * 600 + (id % 4) * 11) AS time",
    )
    rows.repartition(5).write.parquet(folder)
    return spark.read.parquet(folder)


def drain(df, mode, name):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_dedup_keeps_one_of_each_observation(spark, tmp_path):
    batch = write(spark, str(tmp_path / "in"))
    got = drain(deduplicated(packet_stream(spark, str(tmp_path / "in"), batch.schema, 100)), "append", "dedup")
    keys = ["packet_hash", "rx_node_id", "hop_count"]
    assert got.count() == got.dropDuplicates(keys).count() == batch.dropDuplicates(keys).count()


def test_hourly_and_sessions(spark, tmp_path):
    batch = write(spark, str(tmp_path / "in"))
    got = drain(hourly(packet_stream(spark, str(tmp_path / "in"), batch.schema, 100)), "complete", "hours")
    want = batch.groupBy(F.date_trunc("hour", "time").alias("hour"), "network").agg(F.count("*").alias("packets"))
    assert {(r.hour, r.network, r.packets) for r in got.collect()} == {(r.hour, r.network, r.packets) for r in want.collect()}
    ended = drain(sessions(packet_stream(spark, str(tmp_path / "in"), batch.schema, 100), gap="5 minutes"), "append", "bursts")
    assert 0 < ended.count() <= batch.count()


def test_merge_sink_equals_batch_and_ignores_repeats(spark, tmp_path):
    batch = write(spark, str(tmp_path / "in"))
    summarise = lambda b: b.groupBy("network").agg(F.count("*").alias("n"), F.min("time").alias("first"))
    sink = MergeSink(str(tmp_path / "table"), ["network"], {"n": "sum", "first": "min"}, summarise)
    run_available(packet_stream(spark, str(tmp_path / "in"), batch.schema, 2), sink, str(tmp_path / "checkpoint")).awaitTermination()
    want = sorted(map(tuple, summarise(batch).collect()))
    assert sorted(map(tuple, sink.read(spark).collect())) == want
    sink(batch, 0)  # a retry of a merged batch changes nothing
    assert sorted(map(tuple, sink.read(spark).collect())) == want
