"""Streaming forms of the batch operators; on the same rows both give the same tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import merge_aggregate


def packet_stream(spark: SparkSession, folder: str, schema, files_a_trigger: int = 8) -> DataFrame:
    """New Parquet files of a folder, at most ``files_a_trigger`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def deduplicated(stream: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """The first of the observations of a packet by the same observer over the same hops, within the watermark."""
    return stream.withWatermark("time", delay).dropDuplicatesWithinWatermark(["packet_hash", "rx_node_id", "hop_count"])


#: Prefixes that have a bit of their own.
CODE = "^[0-9A-F]{4}$"


def with_privacy(stream: DataFrame, prefixes: DataFrame, size: int = 4) -> DataFrame:
    """Adds visible: false for a packet with a private hop, or whose source is private. prefixes: network and prefix of private
    nodes; they are read anew with each batch. Those of four hex digits, any number of them, are bits of 1,024 words, so a
    hop costs one look; others are compared one by one. A packet without a network fails closed."""
    code = lambda c: F.conv(c, 16, 10).cast("int")
    bit = F.expr("shiftleft(1L, cast(conv(prefix, 16, 10) AS int) & 63)")
    words = prefixes.where(F.col("prefix").rlike(CODE)).groupBy("network", F.shiftright(code("prefix"), 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    words = words.groupBy("network").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    words = words.select("network", F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda w: F.coalesce(F.element_at("held", w), F.lit(0).cast("long"))).alias("words"))
    others = prefixes.groupBy("network").agg(F.collect_set(F.when(~F.col("prefix").rlike(CODE), F.col("prefix"))).alias("others"))
    private = F.broadcast(others.join(words, "network", "left").withColumnRenamed("network", "of_network"))
    joined = stream.join(private, F.col("network") == F.col("of_network"), "left")
    hops = F.concat(F.col("path_hashes"), F.when(F.col("src_node_id").isNotNull(), F.array(F.substring("src_node_id", 1, size))).otherwise(F.array().cast("array<string>")))
    coded = F.exists(hops, lambda h: h.rlike(CODE) & (F.getbit(F.get("words", F.shiftright(code(h), 6)), code(h).bitwiseAND(63)) == 1))
    hidden = F.coalesce(coded, F.lit(False)) | F.coalesce(F.arrays_overlap(hops, F.col("others")), F.lit(False))
    return joined.withColumn("visible", F.col("network").isNotNull() & ~hidden).drop("of_network", "others", "words")


def latest_per_key(batch: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key in a batch: what is shown when many come at once."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def hourly(stream: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Packets, distinct radios (approximate, as streams allow) and mergeable sums for each network and hour."""
    windowed = stream.withWatermark("time", delay).groupBy(F.window("time", "1 hour"), "network")
    counted = windowed.agg(F.count("*").alias("packets"), F.approx_count_distinct("src_node_id").alias("radios"), F.sum("rssi").alias("rssi_sum"), F.count("rssi").alias("rssi_n"))
    return counted.select(F.col("window.start").alias("hour"), "network", "packets", "radios", "rssi_sum", "rssi_n")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "2 minutes") -> DataFrame:
    """Bursts of each source: sessions that end after ``gap`` without a packet, emitted once complete."""
    s = stream.withWatermark("time", delay).groupBy(F.session_window("time", gap), "src_node_id").agg(F.count("*").alias("packets"))
    return s.select("src_node_id", F.col("session_window.start").alias("first"), "packets")


class MergeSink:
    """A folder of numbered versions of an aggregate; a batch that was merged already is left out, so retries are safe."""

    def __init__(self, folder: str, keys: list[str], rules: dict[str, str], summarise):
        self.folder, self.keys, self.rules, self.summarise = folder, keys, rules, summarise

    def _versions(self, spark: SparkSession) -> list[int]:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = []
        if fs.exists(path):
            for status in fs.listStatus(path):
                name = status.getPath().getName()
                if name.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    done.append(int(name))
        return sorted(done)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(os.path.join(self.folder, str(self._versions(spark)[-1])))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = self._versions(spark)
        if done and done[-1] >= batch_id:
            return
        new = self.summarise(batch)
        old = self.read(spark) if done else new.limit(0)
        merge_aggregate(old, new, self.keys, self.rules).write.mode("overwrite").parquet(os.path.join(self.folder, str(batch_id)))
        for version in done[:-1]:  # the last version stays, for those who read it now
            path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, str(version)))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Sinks:
    """Several merges of one batch, which is computed once. Each leaves out what it has merged already, so a batch that
    failed between two of them is done in full when it is tried again."""

    def __init__(self, sinks: list[MergeSink]):
        self.sinks = sinks

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for sink in self.sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()


def run_available(stream: DataFrame, sink: MergeSink, checkpoint: str) -> StreamingQuery:
    """Everything available now through the sink, then stop."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
