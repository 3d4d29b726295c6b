"""Keyed state over streams of all events; SQL says the same of the whole table, up to the last watermark."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..sources.domain import node_id, observations, read
from ..sources.sinks import shared_folder
from ..streaming import stateful
from .registry import query

_START = "2024-01-01 00:00:00"


def _told(spark, sf_dir, made, form):
    """The stream's rows, run over all events in a session of its own and read back."""
    own = stateful.state_session(spark)
    folder = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    events = own.readStream.schema(read(spark, sf_dir, "events").schema).parquet(os.path.join(sf_dir, "events.parquet*"))
    out = form(made(events)).writeStream.format("parquet").option("path", os.path.join(folder, "table")).option("checkpointLocation", os.path.join(folder, "checkpoint"))
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(os.path.join(folder, "table"))


def _at(seconds):
    return F.timestamp_add("SECOND", seconds.cast("int"), F.lit(_START).cast("timestamp_ntz"))


def sightings(e):
    """A packet's four observations 25 seconds apart, give or take; each tenth is repeated."""
    o = observations(e).withColumn("time", _at(F.col("pk") * 97 + F.col("observation_id") % 4 * 25 + F.col("observation_id") * 7 % 13))
    return o.withColumn("copy", F.explode(F.when(F.col("observation_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


_SEEN = f"""
    s AS (SELECT network, packet_hash, TIMESTAMP '{_START}' + (pk * 97 + observation_id % 4 * 25 + observation_id * 7 % 13) * INTERVAL 1 SECOND AS time, rx_node_id, hop_count, path_hashes, observation_id
        FROM (SELECT * FROM packets UNION ALL SELECT * FROM packets WHERE observation_id % 10 = 0))
"""


@query(f"""
    WITH {_SEEN}, w AS (SELECT *, min(time) OVER (PARTITION BY network, packet_hash) AS first FROM s WHERE rx_node_id IS NOT NULL)
    SELECT network, packet_hash, epoch_ms(first) AS first_ms, array_to_string(list_sort(list(DISTINCT rx_node_id)), ',') AS observers, count(*) AS sightings, max(hop_count) AS most_hops
    FROM w WHERE time <= first + INTERVAL 60 SECOND AND first + INTERVAL 60 SECOND <= (SELECT max(time) - INTERVAL 2 MINUTE FROM w) GROUP BY 1, 2, 3
""")
def t10_propagation(spark, sf_dir):
    """One row for each packet, a minute after its first sighting."""
    told = _told(spark, sf_dir, sightings, stateful.propagation)
    return told.withColumn("observers", F.array_join("observers", ","))


def adverts(e):
    """200 adverts in a row of one sender, one to five seconds apart, under one to six names."""
    i = F.col("event_id")
    block = F.floor(i / 200).cast("long")
    return e.select(node_id(block % 60).alias("sender"), i.alias("id"), F.concat(F.lit("N"), (i % (1 + block % 6)).cast("string")).alias("name"), _at(block * 1200 + i % 200 * (1 + block % 5)).alias("time"))


@query(f"""
    WITH b AS (SELECT event_id AS id, event_id // 200 AS block FROM events),
    a AS (SELECT id, upper(md5('n' || CAST(block % 60 AS VARCHAR)) || md5('m' || CAST(block % 60 AS VARCHAR))) AS sender, 'N' || CAST(id % (1 + block % 6) AS VARCHAR) AS name,
        TIMESTAMP '{_START}' + (block * 1200 + id % 200 * (1 + block % 5)) * INTERVAL 1 SECOND AS time FROM b),
    w AS (SELECT sender, id, time, count(*) OVER (PARTITION BY sender ORDER BY time RANGE BETWEEN INTERVAL 59999 MILLISECOND PRECEDING AND CURRENT ROW) AS in_minute,
        len(list_distinct(list(name) OVER (PARTITION BY sender ORDER BY time RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW))) AS names FROM a)
    SELECT sender, id, in_minute, CAST(names AS BIGINT) AS names, in_minute > 30 AS flood, names > 3 AS rotation FROM w WHERE time <= (SELECT max(time) - INTERVAL 2 MINUTE FROM a)
""")
def t09_stream_rates(spark, sf_dir):
    """Floods of adverts and rotations of names, each sender's in its own state."""
    return _told(spark, sf_dir, adverts, stateful.advert_rates)


@query(f"""
    WITH {_SEEN}, h AS (SELECT network, packet_hash, time, unnest(path_hashes) AS hash, unnest(range(len(path_hashes))) AS k, observation_id FROM s WHERE len(path_hashes) > 0),
    d AS (SELECT network, packet_hash, hash, hash || CAST(observation_id % 4 AS VARCHAR) AS node, time + (observation_id % 4) * INTERVAL 20 MINUTE AS time FROM h WHERE (observation_id * 31 + k * 17) % 10 >= 4),
    g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY network, packet_hash ORDER BY time, hash, node) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM d),
    l AS (SELECT *, sum(cut) OVER (PARTITION BY network, packet_hash ORDER BY time, hash, node ROWS UNBOUNDED PRECEDING) AS life FROM g),
    p AS (SELECT network, packet_hash, life, hash, max({{'t': time, 'n': node}}).n AS node FROM l GROUP BY 1, 2, 3, 4),
    n AS (SELECT network, packet_hash, life, array_to_string(list_sort(list(hash || '=' || node)), ',') AS hops FROM p GROUP BY 1, 2, 3),
    f AS (SELECT network, packet_hash, life, min(time) AS first, max(time) AS last, count(*) AS refinements FROM l GROUP BY 1, 2, 3)
    SELECT network, packet_hash, epoch_ms(first) AS first_ms, epoch_ms(last) AS last_ms, refinements, hops FROM f JOIN n USING (network, packet_hash, life)
    WHERE last + INTERVAL 30 MINUTE < (SELECT max(time) - INTERVAL 2 MINUTE FROM d)
""")
def t11_held_results(spark, sf_dir):
    """What is held of each packet's hops, until half an hour after the last refinement."""

    def results(e):
        h = sightings(e).select("network", "packet_hash", "time", "observation_id", F.posexplode("path_hashes").alias("k", "hash"))
        later = F.timestamp_add("MINUTE", (F.col("observation_id") % 4 * 20).cast("int"), F.col("time"))
        sure = ((F.col("observation_id") * 31 + F.col("k") * 17) % 10 + 2) / 10.0
        return h.select("network", "packet_hash", later.alias("time"), "hash", F.concat("hash", (F.col("observation_id") % 4).cast("string")).alias("node"), sure.alias("confidence"))

    return _told(spark, sf_dir, results, stateful.held_results).withColumn("hops", F.array_join("hops", ","))
