"""Losses along whole rays, ground in sight, origins of floods, stored incidents and published versions."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import incident_store, learning, origins, rf, spam
from ..operators.relational import shuffled, spread, within_km
from ..sources.domain import campaigns, nodes, packets, read
from ..sources.publication import Publication
from ..sources.sinks import shared_folder
from .registry import query


@query("""
    WITH p AS (SELECT p_partkey AS id, list_transform(range(25), lambda i: CAST(50 + (p_partkey * 7 + i * i * 13) % 97 AS DOUBLE)) AS h, CAST(100 + p_size * 10 AS DOUBLE) AS step FROM part),
    e AS (SELECT id, h, step, i, i * step AS d, h[1] + 5.0 AS a, h[i + 1] + 1.5 AS b, 299792458.0 / 868e6 AS wave FROM p, (SELECT unnest(range(1, 25)) AS i)),
    r AS (SELECT *, list_max(list_transform(range(1, i), lambda j: (h[j + 1] + j * step * (d - j * step) / (2 * 6371000.0 * 4 / 3) - (a + (b - a) * (j * step) / d)) * sqrt(2 * d / (wave * (j * step) * (d - j * step))))) AS v,
        list_aggregate(list_transform(range(1, i + 1), lambda j: abs(h[j + 1] - h[j])), 'quantile_cont', 0.75) AS p75 FROM e),
    l AS (SELECT *, 20 * log10(4 * pi() * d / wave) + CASE WHEN v > -0.78 THEN greatest(0, 6.9 + 20 * log10(sqrt(pow(v - 0.1, 2) + 1) + v - 0.1)) ELSE 0 END + CASE WHEN i > 2 THEN least(6, 0.08 * ln(1 + p75)) ELSE 0 END AS loss FROM r)
    SELECT id, CAST(i AS INTEGER) AS pos, round(v, 6) AS v, round(loss, 6) AS loss_db, loss < 140 AND coalesce(v, -999) <= 1.12 AS viable FROM l
""", domain=False)
def f02_prefix_losses(spark, sf_dir):
    """The loss at every point of every profile, as of a path that ends there."""
    made = rf.prefix_losses(rf.synthetic_profiles(spread(read(spark, sf_dir, "part"), "p_partkey")))
    return made.where("pos > 0").select("id", "pos", F.round("v", 6).alias("v"), F.round("loss_db", 6).alias("loss_db"), "viable")


@query("""
    WITH g AS (SELECT s_suppkey AS site_id, ray, step, CAST((s_suppkey * 31 + (ray * 40 + step - 1) * 7) % 41 + CASE WHEN step % 9 = s_suppkey % 9 THEN 30 ELSE 0 END AS DOUBLE) AS h, CAST(s_suppkey % 50 AS DOUBLE) + 20.0 AS eye, step * 500.0 AS m
        FROM supplier, (SELECT unnest(range(720)) AS ray), (SELECT unnest(range(1, 41)) AS step)),
    a AS (SELECT *, (h - eye - m * m / (2 * 6371000.0 * 4 / 3)) / m AS ground, (h + 2.0 - eye - m * m / (2 * 6371000.0 * 4 / 3)) / m AS target FROM g),
    s AS (SELECT *, target + 1e-9 >= coalesce(max(ground) OVER (PARTITION BY site_id, ray ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS seen FROM a),
    i AS (SELECT *, step - row_number() OVER (PARTITION BY site_id, ray, seen ORDER BY step) AS island FROM s),
    r AS (SELECT site_id, ray, island, min(step) AS lo, max(step) AS hi FROM i WHERE seen GROUP BY 1, 2, 3),
    t AS (SELECT site_id, ray, string_agg(CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR), ',' ORDER BY lo) AS runs FROM r GROUP BY 1, 2)
    SELECT s.site_id, CAST(s.ray AS INTEGER) AS ray, CAST(coalesce(min(step) FILTER (WHERE NOT seen), 41) - 1 AS DOUBLE) / 2 AS reach_km, max(t.runs) AS runs FROM s JOIN t ON t.site_id = s.site_id AND t.ray = s.ray GROUP BY 1, 2
""", domain=False)
def f05_line_of_sight(spark, sf_dir):
    """Ground in sight of a mast at each supplier, along 720 rays."""
    key, n = F.col("s_suppkey"), 720 * 40
    ridge = lambda k: F.when((k % 40 + 1) % 9 == key % 9, 30).otherwise(0)
    first = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: ((key * 31 + k * 7) % 41 + ridge(k)).cast("double"))
    # heights recur after 40 x 41 steps, but for keys below zero, whose remainders change their sign
    heights = F.when(key >= 0, F.slice(F.flatten(F.array_repeat(first(40 * 41), n // (40 * 41) + 1)), 1, n)).otherwise(first(n))
    sites = spread(read(spark, sf_dir, "supplier"), "s_suppkey").select(key.cast("long").alias("site_id"), F.lit(20.0).alias("mast_m"), (key % 50).cast("double").alias("ground_m"), heights.alias("heights"))
    return rf.line_of_sight(sites)


@query()
def k05_origins(spark, sf_dir):
    """Where each incident's messages started, from the paths by which they came."""
    shared_folder(spark)
    m, n = campaigns(spark, sf_dir), nodes(spark, sf_dir)
    stored = incident_store.merged(None, m).checkpoint()
    found = spam.incidents(stored.select("network", "conv_id", "turn", "cluster", "size"), stored).select("network", "cluster")
    of = stored.join(shuffled(found), ["network", "cluster"]).select(F.concat_ws("|", "network", "cluster").alias("incident"), F.floor(F.col("conv_id") / 6).cast("long").alias("pk")).distinct()
    heard = packets(spark, sf_dir).where("rx_node_id is not null").select("pk", "observation_id", "rx_node_id", "hop_count", "path_hashes").join(shuffled(of), "pk")
    ways = heard.select("path_hashes", "rx_node_id").distinct().checkpoint()
    return origins.origins(heard, n, within_km(learning.on_paths(n, ways, origins.SIZES), 30))


@query()
def k07_incident_store(spark, sf_dir):
    """Incidents of messages that came in two runs, by the stored table."""
    shared_folder(spark)
    m = campaigns(spark, sf_dir)
    store = Publication(spark, os.path.join(shared_folder(spark), f"incidents-{uuid.uuid4().hex}"))
    half = F.col("time") < F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")
    incident_store.update(store, m.where(half), 1)
    incident_store.update(store, m.where(~half), 2)
    return incident_store.incidents(store.read(), F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))


@query("""
    SELECT network, region, count(*) AS packets, count(DISTINCT packet_hash) AS distinct_packets, max(time) AS last FROM packets GROUP BY 1, 2
""")
def s19_publication(spark, sf_dir):
    """A summary published twice, the late writer's of fewer rows after the newer one: readers see the newer one."""
    store = Publication(spark, os.path.join(shared_folder(spark), f"published-{uuid.uuid4().hex}"))
    p = packets(spark, sf_dir)
    summary = lambda rows: rows.groupBy("network", "region").agg(F.count("*").alias("packets"), F.count_distinct("packet_hash").alias("distinct_packets"), F.max("time").alias("last"))
    store.publish(summary(p), 2)
    store.publish(summary(p.where("observation_id % 2 = 0")), 1)
    return store.read()
