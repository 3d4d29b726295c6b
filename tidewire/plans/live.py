"""Streams run over all events and read back: their tables equal the batch ones."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..sources.domain import nodes, observations, read
from ..sources.sinks import shared_folder
from ..streaming.ingest import MergeSink, Sinks, run_available, with_privacy
from .registry import query


def _stream(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema  # a glob, as a table may be one file or a folder of files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(os.path.join(sf_dir, "events.parquet*"))


def _merged(spark, stream, keys, rules, summarise):
    folder = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    sink = MergeSink(os.path.join(folder, "table"), keys, rules, summarise)
    run_available(stream, sink, os.path.join(folder, "checkpoint")).awaitTermination()
    return sink.read(spark)


@query("SELECT network, region, date_trunc('hour', time) AS hour, count(*) AS packets, count(rssi) AS rssi_n, round(sum(rssi), 4) AS rssi_sum, min(time) AS first, max(time) AS last FROM packets GROUP BY 1, 2, 3")
def t03_stream_rollup(spark, sf_dir):
    keys = ["network", "region", "hour"]

    def summarise(batch):
        hour = F.date_trunc("hour", "time").cast("timestamp_ntz")
        return batch.withColumn("hour", hour).groupBy(*keys).agg(F.count("*").alias("packets"), F.count("rssi").alias("rssi_n"), F.sum("rssi").alias("rssi_sum"), F.min("time").alias("first"), F.max("time").alias("last"))

    table = _merged(spark, observations(_stream(spark, sf_dir)), keys, {"packets": "sum", "rssi_n": "sum", "rssi_sum": "sum", "first": "min", "last": "max"}, summarise)
    return table.withColumn("rssi_sum", F.round("rssi_sum", 4))


@query("SELECT rx_node_id, min(time) AS first, max(time) AS last, max({'t': time, 'r': region}).r AS region FROM packets WHERE rx_node_id IS NOT NULL GROUP BY 1")
def t05_stream_last_seen(spark, sf_dir):
    """First and last sign of each observer, with the region of the last; of two at once the later name."""

    def summarise(batch):
        return batch.where("rx_node_id is not null").groupBy("rx_node_id").agg(F.min("time").alias("first"), F.max(F.struct("time", "region")).alias("seen"))

    table = _merged(spark, observations(_stream(spark, sf_dir)), ["rx_node_id"], {"first": "min", "seen": "max"}, summarise)
    return table.select("rx_node_id", "first", F.col("seen.time").alias("last"), "seen.region")


@query("""
    SELECT 'sightings' AS sink, network || '|' || src_node_id AS key, min(time) AS first, max(time) AS last, NULL AS most FROM packets WHERE src_node_id IS NOT NULL AND network <> 'test' GROUP BY 2
    UNION ALL SELECT 'days', network || '|' || CAST(time::DATE AS VARCHAR), NULL, NULL, max(hop_count) FROM packets WHERE NOT is_private GROUP BY 2
    UNION ALL SELECT 'packets', network || '|' || region || '|' || packet_hash, min(time), max(time), NULL FROM packets WHERE NOT is_private AND network <> 'test' AND rx_node_id IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'observers', network || '|' || region || '|' || rx_node_id, min(time), max(time), NULL FROM packets WHERE NOT is_private AND network <> 'test' AND rx_node_id IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'latest', rx_node_id, NULL, max(time), NULL FROM packets WHERE rx_node_id IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'paths', packet_hash || '|' || coalesce(rx_node_id, ''), min(time), NULL, max(len(path_hashes)) FROM packets WHERE len(path_hashes) > 1 GROUP BY 2
""")
def t03_stream_sinks(spark, sf_dir):
    """One stream into six tables, each with its own filter, key and merge; every batch is computed once."""
    folder = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    public = (F.col("network") != "test") & F.col("rx_node_id").isNotNull() & ~F.col("is_private")
    span = {"first": "min", "last": "max"}
    rows = {
        "sightings": (F.col("src_node_id").isNotNull() & (F.col("network") != "test"), ["network", "src_node_id"], span),
        "days": (~F.col("is_private"), ["network", "day"], {"most": "max"}),
        "packets": (public, ["network", "region", "packet_hash"], span),
        "observers": (public, ["network", "region", "rx_node_id"], span),
        "latest": (F.col("rx_node_id").isNotNull(), ["rx_node_id"], {"last": "max"}),
        "paths": (F.size("path_hashes") > 1, ["packet_hash", "rx"], {"first": "min", "most": "max"}),
    }

    def sink(name):
        keep, keys, rules = rows[name]
        value = {"first": F.min("time"), "last": F.max("time"), "most": F.max(F.size("path_hashes") if name == "paths" else F.col("hop_count"))}

        def summarise(batch):
            made = batch.withColumns({"day": F.to_date("time").cast("string"), "rx": F.coalesce("rx_node_id", F.lit(""))})
            return made.where(keep).groupBy(*keys).agg(*[value[r].alias(r) for r in rules])

        return MergeSink(os.path.join(folder, name), keys, rules, summarise)

    sinks = {name: sink(name) for name in rows}
    run_available(observations(_stream(spark, sf_dir)), Sinks(list(sinks.values())), os.path.join(folder, "checkpoint")).awaitTermination()
    out = None
    for name, s in sinks.items():
        column = lambda c: F.col(c) if c in s.rules else F.lit(None).cast("int" if c == "most" else "timestamp_ntz")  # noqa: B023, E731
        t = s.read(spark).select(F.lit(name).alias("sink"), F.concat_ws("|", *s.keys).alias("key"), *[column(c).alias(c) for c in ("first", "last", "most")])
        out = t if out is None else out.unionByName(t)
    return out


@query("""
    WITH v AS (SELECT network, substr(node_id, 1, 4) AS prefix FROM nodes WHERE n % 9 = 0)
    SELECT observation_id, NOT EXISTS (SELECT 1 FROM v WHERE v.network = p.network AND (list_contains(p.path_hashes, v.prefix) OR starts_with(coalesce(p.src_node_id, ''), v.prefix))) AS visible FROM packets p
""")
def t06_stream_privacy(spark, sf_dir):
    """Packets of a stream with whether they may be shown, from a small table of private nodes."""
    prefixes = nodes(spark, sf_dir).where("n % 9 = 0").select("network", F.substring("node_id", 1, 4).alias("prefix"))
    folder = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    made = with_privacy(observations(_stream(spark, sf_dir)), prefixes).select("observation_id", "visible")
    made.writeStream.format("parquet").option("path", os.path.join(folder, "table")).option("checkpointLocation", os.path.join(folder, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(os.path.join(folder, "table"))


@query("""
    WITH a AS (SELECT *, CASE WHEN observation_id % 3 <> 0 THEN 50 + CAST(pk % 5 AS DOUBLE) / 10 WHEN observation_id % 2 = 0 THEN 0 END AS lat FROM packets WHERE src_node_id IS NOT NULL AND packet_type = 4)
    SELECT src_node_id, count(*) AS adverts, coalesce(max(network) FILTER (WHERE network <> 'test'), 'test') AS network, max({'t': time, 'i': observation_id, 'v': lat}) FILTER (WHERE lat <> 0).v AS lat, count(DISTINCT lat) FILTER (WHERE lat <> 0) > 1 AS moved FROM a GROUP BY 1
""")
def t07_stream_nodes(spark, sf_dir):
    """A table of nodes from their adverts: what a new one lacks, or has as zero, stays; a test network never replaces
    another; and whether a node has moved, so that what hangs on its place is to be computed again."""
    i = F.col("observation_id")
    lat = F.when(i % 3 != 0, 50 + (F.col("pk") % 5) / 10).when(i % 2 == 0, 0.0)

    def summarise(batch):
        known = F.when(F.col("lat") != 0, F.col("lat"))
        place = F.when(known.isNotNull(), F.struct(F.col("time").alias("t"), i.alias("i"), known.alias("v")))
        name = F.struct((F.col("network") != "test").alias("real"), F.col("network").alias("v"))
        made = batch.where("src_node_id is not null and packet_type = 4").withColumn("lat", lat)
        return made.groupBy("src_node_id").agg(F.count("*").alias("adverts"), F.max(name).alias("network"), F.max(place).alias("place"), F.min(known).alias("south"), F.max(known).alias("north"))

    rules = {"adverts": "sum", "network": "max", "place": "max", "south": "min", "north": "max"}
    t = _merged(spark, observations(_stream(spark, sf_dir)), ["src_node_id"], rules, summarise)
    return t.select("src_node_id", "adverts", "network.v", F.col("place.v").alias("lat"), F.coalesce(F.col("south") < F.col("north"), F.lit(False)).alias("moved")).withColumnRenamed("v", "network")
