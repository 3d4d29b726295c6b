"""Devices, links, owners and maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import csv_safe, flat_km, has_position
from ..operators import identity, learning, paths
from ..operators.relational import first_by, shuffled, small
from ..sources import wire
from ..sources.domain import AS_OF, as_of, campaigns, links, messages, nodes, packets, read, status_samples
from ..sources.sinks import page_after
from .registry import query
from .traffic import _since, recent

#: Ids of one first byte that a row holds, about.
BLOCK_IDS = 1000

_NOW = f"TIMESTAMP '{AS_OF}'"
_UNIQUE = "(SELECT substr(node_id, 1, 4) AS hash, min(node_id) AS node_id, min(lat) AS lat, min(lon) AS lon FROM nodes WHERE role = 2 GROUP BY 1 HAVING count(*) = 1)"


def _unique(spark, sf_dir):
    """Prefixes that name one repeater."""
    r = nodes(spark, sf_dir).where("role = 2")
    return r.groupBy(F.substring("node_id", 1, 4).alias("hash")).agg(F.min("node_id").alias("node_id"), F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.count("*").alias("c")).where("c = 1").drop("c")


def frames(spark, sf_dir):
    """Packets as hex frames, with malformed ones among them."""
    p = packets(spark, sf_dir)
    head = F.lpad(F.hex(F.shiftleft("packet_type", 2).bitwiseOR(F.col("route_type"))), 2, "0")
    length = F.lpad(F.hex(F.col("hop_count").bitwiseOR(F.lit(64))), 2, "0")
    body = F.md5(F.col("pk").cast("string").cast("binary"))
    raw = F.concat(head, F.coalesce("transport_codes", F.lit("")), length, F.array_join("path_hashes", ""), body)
    broken = F.when(F.col("observation_id") % 50 == 0, F.substring(raw, 1, 7)).when(F.col("observation_id") % 50 == 1, F.lit("zz")).otherwise(raw)
    return p.withColumns({"raw_hex": broken, "topic": F.concat_ws("/", F.lit("mesh"), F.when(F.col("observation_id") % 30 == 0, "bad region").otherwise(F.col("region")), F.col("rx_node_id"), F.lit("packets"))})


@query("""
    SELECT observation_id, CASE WHEN ok THEN route_type END AS route, CASE WHEN ok THEN packet_type END AS payload_type, CASE WHEN ok THEN transport_codes END AS transport,
        CASE WHEN ok THEN 2 END AS hash_size, CASE WHEN ok THEN hop_count END AS hop_count, CASE WHEN ok THEN array_to_string(path_hashes, '') END AS path
    FROM (SELECT *, observation_id % 50 > 1 AS ok FROM packets)
""")
def s04_wire_frames(spark, sf_dir):
    d = wire.decode_frame(frames(spark, sf_dir).select("observation_id", "raw_hex"))
    return d.select("observation_id", "route", "payload_type", "transport", "hash_size", "hop_count", F.array_join("path_hashes", "").alias("path"))


@query("SELECT count(*) AS frames, count(DISTINCT (pk, packet_type)) AS ids FROM packets WHERE observation_id % 50 > 1")
def s05_packet_ids(spark, sf_dir):
    """A packet's id doesn't depend on the route and path of its copies."""
    d = wire.decode_frame(frames(spark, sf_dir)).where("packet_id is not null")
    return d.agg(F.count("*").alias("frames"), F.count_distinct("packet_id").alias("ids"))


@query("""
    SELECT region, network, suffix, count(*) AS messages FROM (
        SELECT CASE WHEN ok THEN region END AS region, CASE WHEN ok THEN CASE WHEN observation_id % 7 = 0 OR region = 'MAN' THEN 'test' ELSE 'main' END END AS network,
            CASE WHEN ok THEN ['packets', 'status', 'neighbors', 'neighbours'][observation_id % 4 + 1] END AS suffix
        FROM (SELECT *, observation_id % 30 <> 0 AND rx_node_id IS NOT NULL AS ok FROM packets)
    ) GROUP BY 1, 2, 3
""")
def s02_topics(spark, sf_dir):
    """Topics in any case and with blanks around their parts; a prefix of its own, or a test region, is the test network."""
    i = F.col("observation_id")
    prefix = F.when(i % 7 == 0, "Lab ").when(i % 2 == 0, " MESH").otherwise("mesh")
    suffix = F.element_at(F.array(*map(F.lit, ["packets", " Status", "NEIGHBORS", "neighbours "])), (i % 4 + 1).cast("int"))
    region = F.when(i % 30 == 0, "bad region").when(i % 3 == 0, F.lower("region")).otherwise(F.col("region"))
    topic = F.concat_ws("/", prefix, region, F.lower("rx_node_id"), suffix)
    parsed = wire.parse_topic(packets(spark, sf_dir).select(topic.alias("topic")), prefixes={"mesh": "main", "lab": "test"}, test_regions=["MAN"])
    return parsed.groupBy("region", "network", "suffix").agg(F.count("*").alias("messages"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def s03_envelopes(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", wire.number_field(F.col("props"), "missing", "k").alias("k"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) > (100, 500) ORDER BY o_custkey, o_orderkey LIMIT 21", domain=False)
def s11_keyset_page(spark, sf_dir):
    return page_after(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", "o_orderkey"], [100, 500], 20)


@query("SELECT p_partkey, CASE WHEN regexp_matches(v, '^[=+@-]') THEN '''' || v ELSE v END AS v FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '=' || p_name ELSE p_name END AS v FROM part)", domain=False)
def s14_csv_guard(spark, sf_dir):
    v = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("="), F.col("p_name"))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", csv_safe(v).alias("v"))


@query(f"""
    WITH d AS (SELECT h.observation_id, count(*) AS n, count(u.node_id) AS k, count(DISTINCT u.node_id) AS dk FROM hops h LEFT JOIN {_UNIQUE} u ON h.hash = u.hash GROUP BY 1)
    SELECT p.network, count(*) AS paths, max(d.n) AS longest, count(DISTINCT p.packet_hash) AS packets FROM d JOIN packets p ON d.observation_id = p.observation_id WHERE d.k = d.n AND d.n >= 2 AND d.dk = d.n GROUP BY 1
""")
def q11_decode_summary(spark, sf_dir):
    p = packets(spark, sf_dir)
    found = paths.exact_paths(p, nodes(spark, sf_dir))
    return found.join(p.select("observation_id", "network", "packet_hash"), "observation_id").groupBy("network").agg(F.count("*").alias("paths"), F.max("hops").alias("longest"), F.count_distinct("packet_hash").alias("packets"))


@query(f"""
    SELECT (SELECT count(DISTINCT rx_node_id) FROM packets WHERE {_since(6)}) AS active_observers, (SELECT count(*) FROM packets WHERE {_since(24)}) AS packets_day,
        (SELECT max(hop_count) FROM packets WHERE {_since(168)}) AS longest, (SELECT count(*) FROM nodes) AS total_nodes,
        (SELECT count(*) FROM nodes WHERE last_seen < {_NOW} - INTERVAL 14 DAY AND last_seen >= {_NOW} - INTERVAL 28 DAY) AS stale,
        (SELECT count(*) FROM nodes WHERE lat IS NOT NULL AND coalesce(role, 2) NOT IN (1, 3) AND last_seen >= {_NOW} - INTERVAL 28 DAY) AS map_nodes
""")
def q20_summary(spark, sf_dir):
    age = lambda d: as_of() - F.expr(f"INTERVAL {d} DAYS")
    week = recent(spark, sf_dir, 168)
    within = lambda h: F.col("time") >= as_of() - F.expr(f"INTERVAL {h} HOURS")
    traffic = week.agg(F.count_distinct(F.when(within(6), F.col("rx_node_id"))).alias("active_observers"), F.count_if(within(24)).alias("packets_day"), F.max("hop_count").alias("longest"))
    shown = has_position(F.col("lat"), F.col("lon"), 5.0) & ~F.coalesce("role", F.lit(2)).isin(1, 3) & (F.col("last_seen") >= age(28))
    known = nodes(spark, sf_dir).agg(F.count("*").alias("total_nodes"), F.count_if((F.col("last_seen") < age(14)) & (F.col("last_seen") >= age(28))).alias("stale"), F.count_if(shown).alias("map_nodes"))
    return traffic.join(F.broadcast(known))


@query(f"""
    WITH l AS (SELECT l.*, x.node_id AS ida, y.node_id AS idb FROM links l JOIN {_UNIQUE} x ON l.a = x.hash JOIN {_UNIQUE} y ON l.b = y.hash WHERE l.last_observed >= {_NOW} - INTERVAL 30 DAY),
    t AS (SELECT * FROM l ORDER BY observed DESC, a, b LIMIT 20)
    SELECT 'link' AS kind, ida AS id, idb AS peer, observed FROM t UNION ALL
    SELECT 'node', n.node_id, NULL, NULL FROM nodes n WHERE n.role = 2 AND n.lat IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.ida = n.node_id OR t.idb = n.node_id)
""")
def q23_topology(spark, sf_dir):
    u, l = _unique(spark, sf_dir), links(packets(spark, sf_dir)).where(F.col("last_observed") >= as_of() - F.expr("INTERVAL 30 DAYS"))
    l = l.join(small(u.select(F.col("hash").alias("a"), F.col("node_id").alias("ida"))), "a").join(small(u.select(F.col("hash").alias("b"), F.col("node_id").alias("idb"))), "b")
    top = l.orderBy(F.desc("observed"), "a", "b").limit(20).select(F.lit("link").alias("kind"), F.col("ida").alias("id"), F.col("idb").alias("peer"), "observed")
    ends = top.select("id").union(top.select("peer")).distinct()
    alone = nodes(spark, sf_dir).where("role = 2 and lat is not null").select(F.col("node_id").alias("id")).join(ends, "id", "left_anti")
    return top.union(alone.select(F.lit("node"), "id", F.lit(None).cast("string"), F.lit(None).cast("long")))


@query(f"""
    SELECT a, b, CASE WHEN observed >= 500 THEN 'override' WHEN km > 150 AND observed >= 10 THEN 'unexpected' WHEN observed <= 2 AND last_observed < {_NOW} - INTERVAL 7 DAY THEN 'weak' ELSE 'match' END AS verdict
    FROM (SELECT l.*, sqrt(pow(y.lat - x.lat, 2) + pow((y.lon - x.lon) * cos(radians((x.lat + y.lat) / 2)), 2)) * 111.32 AS km FROM links l JOIN {_UNIQUE} x ON l.a = x.hash JOIN {_UNIQUE} y ON l.b = y.hash WHERE x.lat IS NOT NULL AND y.lat IS NOT NULL)
""")
def q25_rf_validation(spark, sf_dir):
    return _placed_links(spark, sf_dir).select("a", "b", F.when(F.col("observed") >= 500, "override").when((F.col("km") > 150) & (F.col("observed") >= 10), "unexpected").when((F.col("observed") <= 2) & (F.col("last_observed") < as_of() - F.expr("INTERVAL 7 DAYS")), "weak").otherwise("match").alias("verdict"))


def _placed_links(spark, sf_dir):
    u = _unique(spark, sf_dir).where("lat is not null")
    side = lambda s: small(u.select(F.col("hash").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}")))
    l = links(packets(spark, sf_dir)).join(side("a"), "a").join(side("b"), "b")
    return l.withColumn("km", flat_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))


@query(f"""
    SELECT count(*) AS segments, max(observed) AS most FROM (SELECT l.observed, sqrt(pow(y.lat - x.lat, 2) + pow((y.lon - x.lon) * cos(radians((x.lat + y.lat) / 2)), 2)) * 111.32 AS km
    FROM links l JOIN {_UNIQUE} x ON l.a = x.hash JOIN {_UNIQUE} y ON l.b = y.hash) WHERE km <= 400
""")
def q27_segments(spark, sf_dir):
    return _placed_links(spark, sf_dir).where("km <= 400").agg(F.count("*").alias("segments"), F.max("observed").alias("most"))


@query("""
    SELECT conv_id, turn, sender, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY network, text ORDER BY time, conv_id, turn) AS r FROM messages) WHERE r = 1 ORDER BY time DESC, conv_id, turn LIMIT 50
""")
def q29_recent_messages(spark, sf_dir):
    m = first_by(messages(spark, sf_dir), ["network", "text"], F.col("time"), F.col("conv_id"), F.col("turn"))
    return m.orderBy(F.desc("time"), "conv_id", "turn").limit(50).select("conv_id", "turn", "sender", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""
    SELECT n.node_id, coalesce(p.seen, n.last_seen) AS seen, coalesce(greatest(p.seen, n.last_seen) >= {_NOW} - INTERVAL 1 HOUR, false) AS online
    FROM nodes n LEFT JOIN (SELECT rx_node_id, max(time) AS seen FROM packets GROUP BY 1) p ON p.rx_node_id = n.node_id
""")
def q31_presence(spark, sf_dir):
    seen = packets(spark, sf_dir).groupBy(F.col("rx_node_id").alias("node_id")).agg(F.max("time").alias("heard"))
    n = nodes(spark, sf_dir).join(seen, "node_id", "left")
    return n.select("node_id", F.coalesce("heard", "last_seen").alias("seen"), F.coalesce(F.greatest("heard", "last_seen") >= as_of() - F.expr("INTERVAL 1 HOUR"), F.lit(False)).alias("online"))


@query("""
    WITH e AS (SELECT a AS node, b AS peer, observed, a_to_b AS sent FROM links UNION ALL SELECT b, a, observed, b_to_a FROM links)
    SELECT node, peer, observed, sent FROM e WHERE node IN (SELECT substr(node_id, 1, 4) FROM nodes)
""")
def q32_node_links(spark, sf_dir):
    l = links(packets(spark, sf_dir))
    e = l.select(F.col("a").alias("node"), F.col("b").alias("peer"), "observed", F.col("a_to_b").alias("sent")).union(l.select("b", "a", "observed", "b_to_a"))
    return e.join(nodes(spark, sf_dir).select(F.substring("node_id", 1, 4).alias("node")).distinct(), "node", "left_semi").select("node", "peer", "observed", "sent")


@query(f"""
    WITH m AS (SELECT x.hash AS before, y.hash AS hash, z.hash AS after FROM hops x JOIN hops y ON x.observation_id = y.observation_id AND y.pos = x.pos + 1 JOIN hops z ON x.observation_id = z.observation_id AND z.pos = x.pos + 2),
    u AS (SELECT * FROM {_UNIQUE} WHERE lat IS NOT NULL)
    SELECT m.hash, count(*) AS sightings, round(avg((p.lat + q.lat) / 2), 6) AS lat, round(avg((p.lon + q.lon) / 2), 6) AS lon FROM m JOIN u p ON m.before = p.hash JOIN u q ON m.after = q.hash WHERE m.hash NOT IN (SELECT hash FROM {_UNIQUE}) GROUP BY 1
""")
def q33_inferred_nodes(spark, sf_dir):
    n = F.size("path_hashes")
    runs = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.get("path_hashes", i).alias("before"), F.get("path_hashes", i + 1).alias("hash"), F.get("path_hashes", i + 2).alias("after")))
    m = packets(spark, sf_dir).where(n >= 3).select(F.explode(runs).alias("m")).select("m.*")
    known = _unique(spark, sf_dir)
    placed = known.where("lat is not null")
    side = lambda s: placed.select(F.col("hash").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
    found = m.join(known.select("hash"), "hash", "left_anti").join(small(side("before")), "before").join(small(side("after")), "after")
    mean = lambda c: F.round(F.avg((F.col(f"{c}_before") + F.col(f"{c}_after")) / 2), 6).alias(c)
    return found.groupBy("hash").agg(F.count("*").alias("sightings"), mean("lat"), mean("lon"))


@query("SELECT firmware, coalesce(role, 0) AS role, count(*) AS nodes FROM nodes GROUP BY 1, 2")
def q38_firmware(spark, sf_dir):
    return nodes(spark, sf_dir).groupBy("firmware", F.coalesce("role", F.lit(0)).alias("role")).agg(F.count("*").alias("nodes"))


@query(f"""
    WITH h AS (SELECT rx_node_id, date_trunc('hour', time) AS hour, rssi, path_hashes[len(path_hashes)] AS last FROM packets WHERE {_since(168)} AND rx_node_id IS NOT NULL)
    SELECT rx_node_id, hour, CASE WHEN last IS NULL THEN 'direct' WHEN u.node_id IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS kind, count(*) AS packets, round(avg(rssi), 6) AS rssi
    FROM h LEFT JOIN {_UNIQUE} u ON h.last = u.hash GROUP BY 1, 2, 3
""")
def q41_last_hop(spark, sf_dir):
    p = recent(spark, sf_dir, 168).where("rx_node_id is not null").withColumn("last", F.when(F.size("path_hashes") > 0, F.element_at("path_hashes", -1)))
    h = p.join(small(_unique(spark, sf_dir).select(F.col("hash").alias("last"), "node_id")), "last", "left")
    kind = F.when(F.col("last").isNull(), "direct").when(F.col("node_id").isNotNull(), "resolved").otherwise("unresolved")
    return h.groupBy("rx_node_id", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("hour"), kind.alias("kind")).agg(F.count("*").alias("packets"), F.round(F.avg("rssi"), 6).alias("rssi"))


@query(f"""
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY time DESC, sample_id DESC) AS r FROM status)
    SELECT node_id, time < {_NOW} - INTERVAL 900 DAY AS silent, battery_mv < 3500 AS low_battery, CAST(battery_mv - 3200 AS DOUBLE) / 10 AS battery_pct FROM s WHERE r = 1
""")
def q42_alerts(spark, sf_dir):
    s = status_samples(spark, sf_dir).groupBy("node_id").agg(F.max_by("battery_mv", F.struct("time", "sample_id")).alias("battery_mv"), F.max("time").alias("seen"))
    return s.select("node_id", (F.col("seen") < as_of() - F.expr("INTERVAL 900 DAYS")).alias("silent"), (F.col("battery_mv") < 3500).alias("low_battery"), ((F.col("battery_mv") - 3200) / 10.0).alias("battery_pct"))


@query("""
    SELECT regexp_replace(lower(name), ' (repeater|node)$', '') AS label, count(*) AS members, max(advert_count) AS adverts, arg_max(node_id, advert_count * 1000 - n) AS best FROM nodes GROUP BY 1
""")
def q45_name_groups(spark, sf_dir):
    label = F.regexp_replace(F.lower("name"), " (repeater|node)$", "")
    return nodes(spark, sf_dir).groupBy(label.alias("label")).agg(F.count("*").alias("members"), F.max("advert_count").alias("adverts"), F.max_by("node_id", F.struct("advert_count", -F.col("n"))).alias("best"))


@query("""
    SELECT src_node_id, rx_node_id, count(*) AS samples, round(quantile_cont(snr, 0.5), 6) AS median_snr FROM packets WHERE snr IS NOT NULL AND src_node_id IS NOT NULL AND rx_node_id IS NOT NULL AND src_node_id <> rx_node_id
    GROUP BY 1, 2 HAVING count(*) >= 3
""")
def q53_calibration_pairs(spark, sf_dir):
    p = packets(spark, sf_dir).where("snr is not null and src_node_id is not null and rx_node_id is not null and src_node_id != rx_node_id")
    return p.groupBy("src_node_id", "rx_node_id").agg(F.count("*").alias("samples"), F.round(F.median("snr"), 6).alias("median_snr")).where("samples >= 3")


@query(f"SELECT u.node_id, max(h.time) AS last_evidence, count(DISTINCT h.observation_id) AS observations FROM hops h JOIN {_UNIQUE} u ON h.hash = u.hash GROUP BY 1")
def q54_path_evidence(spark, sf_dir):
    h = packets(spark, sf_dir).select("observation_id", "time", F.explode("path_hashes").alias("hash"))
    return h.join(small(_unique(spark, sf_dir).select("hash", "node_id")), "hash").groupBy("node_id").agg(F.max("time").alias("last_evidence"), F.count_distinct("observation_id").alias("observations"))


@query()
def q55_content_hash(spark, sf_dir):
    return learning.content_hash(nodes(spark, sf_dir))


@query(f"SELECT date_trunc('day', time)::DATE AS day, count(*) AS rows, time_class FROM (SELECT time, CASE WHEN time < {_NOW} - INTERVAL 14 DAY THEN 'drop' ELSE 'keep' END AS time_class FROM packets) GROUP BY 1, 3")
def q56_retention(spark, sf_dir):
    kind = F.when(F.col("time") < as_of() - F.expr("INTERVAL 14 DAYS"), "drop").otherwise("keep")
    return packets(spark, sf_dir).groupBy(F.to_date("time").alias("day"), kind.alias("time_class")).agg(F.count("*").alias("rows"))


@query("""
    SELECT x.node_id AS a, y.node_id AS b FROM nodes x JOIN nodes y ON substr(x.node_id, 1, 2) = substr(y.node_id, 1, 2) AND x.node_id < y.node_id
""")
def q57_prefix_clashes(spark, sf_dir):
    """Pairs by blocks of ids in their order. A byte's blocks are one task's and a block's pairs follow each other, so that files name
    the ids in a dictionary; joined row by row, tasks of many bytes write each pair's 128 digits."""
    r = nodes(spark, sf_dir).select("node_id", F.substring("node_id", 1, 2).alias("p"))
    parts = F.ceil(F.count("*").over(Window.partitionBy("p")) / BLOCK_IDS)
    r = r.withColumn("part", F.floor(F.conv(F.substring("node_id", 3, 4), 16, 10).cast("long") * parts / 65536))
    r = r.groupBy("p", "part").agg(F.sort_array(F.collect_list("node_id")).alias("ids"))
    x, y = (r.select("p", F.col("part").alias(f"part_{s}"), F.col("ids").alias(s)) for s in "xy")
    met = x.repartition(256, "p").join(shuffled(y.repartition(256, "p")), "p").where("part_x <= part_y")
    return met.select(F.explode("x").alias("a"), "y").select("a", F.explode("y").alias("b")).where("a < b")


@query("""
    SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS bin, least(20, count(*)) AS errors FROM events WHERE event_type = 'error' GROUP BY 1, 2
""", domain=False)
def o05_error_bins(spark, sf_dir):
    from ..functions.columns import time_bin

    e = read(spark, sf_dir, "events").where("event_type = 'error'")
    return e.groupBy("event_type", time_bin(F.col("ts"), 10).alias("bin")).agg(F.least(F.lit(20), F.count("*")).alias("errors"))


@query()
def k03_incidents(spark, sf_dir):
    from ..operators import spam

    m = campaigns(spark, sf_dir)
    return spam.incidents(spam.clusters(m), m)


@query()
def v10_decode_accuracy(spark, sf_dir):
    """Exact paths decoded again from one-byte prefixes: the share of hops and of paths found."""
    p = packets(spark, sf_dir)
    gold = paths.exact_paths(p, nodes(spark, sf_dir))
    return paths.accuracy(gold, p, nodes(spark, sf_dir))
