"""Traffic statistics over packet observations: time series, mixes, diversity, signal, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import little_endian, region_health, time_bin
from ..operators.relational import canonical, filled, first_by, in_days, in_scope
from ..sources.domain import AS_OF, aliases, as_of, packets
from .registry import query

_SCOPE = "network IS DISTINCT FROM 'test' AND NOT is_private"
_NOW = f"TIMESTAMP '{AS_OF}'"


def recent(spark: SparkSession, sf_dir: str, hours: int) -> DataFrame:
    return packets(spark, sf_dir).where(in_scope() & (F.col("time") >= as_of() - F.make_dt_interval(hours=F.lit(hours))) & (F.col("time") <= as_of()))


def _since(hours: int) -> str:
    return f"{_SCOPE} AND time >= {_NOW} - INTERVAL {hours} HOUR AND time <= {_NOW}"


def _share(c):
    return F.round(F.lit(100.0) * c / F.sum(c).over(Window.partitionBy()), 6)


@query(f"""
    SELECT h AS hour, CAST(count(packet_hash) AS BIGINT) AS packets FROM (SELECT unnest(generate_series({_NOW} - INTERVAL 24 HOUR, {_NOW}, INTERVAL 1 HOUR)) AS h)
    LEFT JOIN (SELECT * FROM packets WHERE {_since(24)}) p ON date_trunc('hour', p.time) = h GROUP BY 1
""")
def q01_packets_per_hour(spark, sf_dir):
    counted = recent(spark, sf_dir, 24).groupBy(F.date_trunc("hour", "time").cast("timestamp_ntz").alias("hour")).agg(F.count("packet_hash").alias("packets"))
    return filled(counted, "hour", as_of() - F.expr("INTERVAL 24 HOURS"), as_of(), "1 HOUR").fillna(0, ["packets"])


@query(f"SELECT date_trunc('day', time)::DATE AS day, count(*) AS packets, count(DISTINCT packet_hash) AS distinct_packets FROM packets WHERE {_since(168)} GROUP BY 1")
def q02_packets_per_day(spark, sf_dir):
    return recent(spark, sf_dir, 168).groupBy(F.to_date("time").alias("day")).agg(F.count("*").alias("packets"), F.count_distinct("packet_hash").alias("distinct_packets"))


@query(f"""
    SELECT date_trunc('day', time)::DATE AS day, count(DISTINCT coalesce(canonical_id, upper(trim(src_node_id)))) AS radios
    FROM packets LEFT JOIN aliases ON source_id = upper(trim(src_node_id)) WHERE {_since(168)} GROUP BY 1
""")
def q03_unique_radios_per_day(spark, sf_dir):
    known = canonical(recent(spark, sf_dir, 168).select("time", "src_node_id"), "src_node_id", aliases(spark, sf_dir))
    return known.groupBy(F.to_date("time").alias("day")).agg(F.count_distinct("src_node_id").alias("radios"))


_TYPES = {2: "Text", 3: "Ack", 4: "Advert", 5: "Group text"}


@query(f"SELECT CASE packet_type WHEN 2 THEN 'Text' WHEN 3 THEN 'Ack' WHEN 4 THEN 'Advert' WHEN 5 THEN 'Group text' ELSE 'Other' END AS label, count(*) AS packets FROM packets WHERE {_since(24)} GROUP BY 1")
def q04_packet_types(spark, sf_dir):
    labels = F.create_map(*[F.lit(x) for p in _TYPES.items() for x in p])
    return recent(spark, sf_dir, 24).groupBy(F.coalesce(labels[F.col("packet_type")], F.lit("Other")).alias("label")).agg(F.count("*").alias("packets"))


@query(f"SELECT hop_count, count(*) AS packets, CAST(100.0 AS DOUBLE) * count(*) / sum(count(*)) OVER () AS pct FROM packets WHERE {_since(168)} GROUP BY 1")
def q05_hop_counts(spark, sf_dir):
    c = F.col("packets")
    return recent(spark, sf_dir, 168).groupBy("hop_count").agg(F.count("*").alias("packets")).withColumn("pct", F.lit(100.0) * c / F.sum(c).over(Window.partitionBy()))


@query(f"""
    SELECT hash, count(*) AS uses FROM (SELECT unnest(path_hashes) AS hash FROM packets WHERE {_since(168)}) GROUP BY 1 HAVING count(*) > 1 ORDER BY uses DESC, hash LIMIT 10
""")
def q06_prefix_repeats(spark, sf_dir):
    hashes = recent(spark, sf_dir, 168).select(F.explode("path_hashes").alias("hash"))
    return hashes.groupBy("hash").agg(F.count("*").alias("uses")).where("uses > 1").orderBy(F.desc("uses"), "hash").limit(10)


@query(f"""
    SELECT count(*) FILTER (WHERE time >= {_NOW} - INTERVAL 24 HOUR) AS day_packets, count(*) AS week_packets, count(DISTINCT src_node_id) AS radios,
        count(DISTINCT rx_node_id) FILTER (WHERE time >= {_NOW} - INTERVAL 24 HOUR) AS day_observers FROM packets WHERE {_since(168)}
""")
def q07_totals(spark, sf_dir):
    day = F.col("time") >= as_of() - F.expr("INTERVAL 24 HOURS")
    return recent(spark, sf_dir, 168).agg(F.count_if(day).alias("day_packets"), F.count("*").alias("week_packets"), F.count_distinct("src_node_id").alias("radios"), F.count_distinct(F.when(day, F.col("rx_node_id"))).alias("day_observers"))


@query(f"""
    SELECT region, count(DISTINCT packet_hash) FILTER (WHERE time >= {_NOW} - INTERVAL 24 HOUR) AS packets_24h, count(DISTINCT packet_hash) AS packets_7d,
        count(DISTINCT rx_node_id) FILTER (WHERE time >= {_NOW} - INTERVAL 24 HOUR) AS active_observers, count(DISTINCT rx_node_id) AS observers, max(time) AS last_packet
    FROM packets WHERE {_since(168)} GROUP BY 1
""")
def q08_region_summary(spark, sf_dir):
    day = F.col("time") >= as_of() - F.expr("INTERVAL 24 HOURS")
    return recent(spark, sf_dir, 168).groupBy("region").agg(
        F.count_distinct(F.when(day, F.col("packet_hash"))).alias("packets_24h"), F.count_distinct("packet_hash").alias("packets_7d"),
        F.count_distinct(F.when(day, F.col("rx_node_id"))).alias("active_observers"), F.count_distinct("rx_node_id").alias("observers"), F.max("time").alias("last_packet"),
    )


@query(f"SELECT region, date_trunc('day', time)::DATE AS day, count(DISTINCT packet_hash) AS packets FROM packets WHERE {_since(168)} GROUP BY 1, 2")
def q09_region_daily(spark, sf_dir):
    return recent(spark, sf_dir, 168).groupBy("region", F.to_date("time").alias("day")).agg(F.count_distinct("packet_hash").alias("packets"))


@query(f"SELECT length(hash) // 2 AS bytes, count(*) AS hops FROM (SELECT unnest(path_hashes) AS hash FROM packets WHERE {_since(168)}) GROUP BY 1")
def q10_hash_widths(spark, sf_dir):
    return recent(spark, sf_dir, 168).select(F.explode("path_hashes").alias("h")).groupBy(F.expr("length(h) div 2").alias("bytes")).agg(F.count("*").alias("hops"))


@query(f"""
    SELECT d AS day, CAST(count(packet_hash) AS BIGINT) AS paths, round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE len(path_hashes) > 2) / greatest(1, count(packet_hash)), 6) AS long_pct
    FROM (SELECT unnest(generate_series({_NOW} - INTERVAL 7 DAY, {_NOW}, INTERVAL 1 DAY)) AS d) LEFT JOIN (SELECT * FROM packets WHERE {_since(168)}) ON date_trunc('day', time) = d GROUP BY 1
""")
def q12_path_trend(spark, sf_dir):
    days = recent(spark, sf_dir, 168).groupBy(F.date_trunc("day", "time").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("paths"), F.count_if(F.size("path_hashes") > 2).alias("long"))
    out = filled(days, "day", as_of() - F.expr("INTERVAL 7 DAYS"), as_of(), "1 DAY").fillna(0, ["paths", "long"])
    return out.select("day", "paths", F.round(F.lit(100.0) * F.col("long") / F.greatest(F.lit(1), "paths"), 6).alias("long_pct"))


@query(f"""
    SELECT count(*) AS packets, round(avg(n), 6) AS mean_observers, max(n) AS most_observers, round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE n = 1) / count(*), 6) AS single_pct
    FROM (SELECT packet_hash, count(DISTINCT rx_node_id) AS n FROM packets WHERE {_since(168)} AND rx_node_id IS NOT NULL GROUP BY 1)
""")
def q13_observer_diversity(spark, sf_dir):
    per = recent(spark, sf_dir, 168).where("rx_node_id is not null").groupBy("packet_hash").agg(F.count_distinct("rx_node_id").alias("n"))
    return per.agg(F.count("*").alias("packets"), F.round(F.avg("n"), 6).alias("mean_observers"), F.max("n").alias("most_observers"), F.round(F.lit(100.0) * F.count_if(F.col("n") == 1) / F.count("*"), 6).alias("single_pct"))


@query(f"SELECT count(rssi) AS samples, round(avg(rssi), 6) AS mean_rssi, round(quantile_cont(rssi, 0.5), 6) AS median_rssi, count(snr) AS snr_samples, round(avg(snr), 6) AS mean_snr, round(quantile_cont(snr, 0.5), 6) AS median_snr FROM packets WHERE {_since(24)}")
def q14_signal(spark, sf_dir):
    r = lambda c: F.round(c, 6)
    return recent(spark, sf_dir, 24).agg(F.count("rssi").alias("samples"), r(F.avg("rssi")).alias("mean_rssi"), r(F.median("rssi")).alias("median_rssi"), F.count("snr").alias("snr_samples"), r(F.avg("snr")).alias("mean_snr"), r(F.median("snr")).alias("median_snr"))


@query(f"SELECT (['Transport flood', 'Flood', 'Direct', 'Transport direct'])[route_type + 1] AS route, count(*) AS packets FROM packets WHERE {_since(24)} GROUP BY 1")
def q15_routes(spark, sf_dir):
    names = F.array(*map(F.lit, ["Transport flood", "Flood", "Direct", "Transport direct"]))
    return recent(spark, sf_dir, 24).groupBy(F.get(names, F.col("route_type")).alias("route")).agg(F.count("*").alias("packets"))


@query(f"""
    SELECT transport_codes, CAST('0x' || substr(transport_codes, 3, 2) || substr(transport_codes, 1, 2) AS BIGINT) AS code, count(*) AS packets
    FROM packets WHERE {_since(168)} AND transport_codes IS NOT NULL GROUP BY 1, 2 ORDER BY packets DESC, transport_codes LIMIT 12
""")
def q16_transport_codes(spark, sf_dir):
    coded = recent(spark, sf_dir, 168).where("transport_codes is not null")
    return coded.groupBy("transport_codes", little_endian(F.substring("transport_codes", 1, 4)).alias("code")).agg(F.count("*").alias("packets")).orderBy(F.desc("packets"), "transport_codes").limit(12)


@query(f"""
    SELECT coalesce(nullif(regexp_extract(payload, '"k": ?([0-9]+)', 1), ''), 'Unknown') AS channel, count(*) AS packets, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 6) AS pct
    FROM packets WHERE {_since(168)} GROUP BY 1 ORDER BY packets DESC, channel LIMIT 12
""")
def q17_channels(spark, sf_dir):
    name = F.coalesce(F.nullif(F.regexp_extract("payload", '"k": ?([0-9]+)', 1), F.lit("")), F.lit("Unknown"))
    counted = recent(spark, sf_dir, 168).groupBy(name.alias("channel")).agg(F.count("*").alias("packets"))
    return counted.withColumn("pct", _share(F.col("packets"))).orderBy(F.desc("packets"), "channel").limit(12)


@query(f"SELECT hour(time) AS hour, count(*) AS packets FROM packets WHERE {_since(168)} GROUP BY 1 ORDER BY packets DESC, hour LIMIT 1")
def q18_peak_hour(spark, sf_dir):
    hours = recent(spark, sf_dir, 168).groupBy(F.hour("time").cast("long").alias("hour")).agg(F.count("*").alias("packets"))
    return hours.orderBy(F.desc("packets"), "hour").limit(1)


@query(f"""
    WITH r AS (SELECT region, count(DISTINCT rx_node_id) FILTER (WHERE time >= {_NOW} - INTERVAL 24 HOUR) AS active, count(DISTINCT rx_node_id) AS total,
        count(*) FILTER (WHERE time >= {_NOW} - INTERVAL 24 HOUR) AS packets, (epoch({_NOW}) - epoch(max(time))) / 60 AS minutes FROM packets WHERE {_since(168)} GROUP BY 1)
    SELECT region, CAST(floor(0.4 * greatest(0, least(100, 100 * (60 - minutes) / 55)) + 0.3 * CASE WHEN active >= 2 THEN 100.0 WHEN active = 1 THEN 60.0 ELSE 0.0 END
        + 0.2 * greatest(0, least(100, 100 * log10(packets + 1.0) / 4)) + 0.1 * greatest(0, least(100, 100 * total / 3.0)) + 0.5) AS BIGINT) AS score FROM r
""")
def q19_region_health(spark, sf_dir):
    day = F.col("time") >= as_of() - F.expr("INTERVAL 24 HOURS")
    seconds = F.unix_micros(as_of().cast("timestamp")) / 1e6 - F.unix_micros(F.max("time").cast("timestamp")) / 1e6
    r = recent(spark, sf_dir, 168).groupBy("region").agg(F.count_distinct(F.when(day, F.col("rx_node_id"))).alias("active"), F.count_distinct("rx_node_id").alias("total"), F.count_if(day).alias("packets"), (seconds / 60).alias("minutes"))
    return r.select("region", region_health(F.col("active"), F.col("total"), F.col("packets"), F.col("minutes")).alias("score"))


@query(f"""
    SELECT coalesce(rx.node, tx.node) AS node, coalesce(rx.n, 0) AS received, coalesce(tx.n, 0) AS sent
    FROM (SELECT rx_node_id AS node, count(*) AS n FROM packets WHERE {_since(24)} AND rx_node_id IS NOT NULL GROUP BY 1) rx
    FULL JOIN (SELECT src_node_id AS node, count(DISTINCT packet_hash) AS n FROM packets WHERE {_since(24)} AND src_node_id IS NOT NULL GROUP BY 1) tx ON rx.node = tx.node
""")
def q21_observer_activity(spark, sf_dir):
    p = recent(spark, sf_dir, 24)
    rx = p.where("rx_node_id is not null").groupBy(F.col("rx_node_id").alias("node")).agg(F.count("*").alias("received"))
    tx = p.where("src_node_id is not null").groupBy(F.col("src_node_id").alias("node")).agg(F.count_distinct("packet_hash").alias("sent"))
    return rx.join(tx, "node", "full").fillna(0, ["received", "sent"])


@query(f"""
    WITH b AS (SELECT time_bucket(INTERVAL 15 MINUTE, time, TIMESTAMP '2000-01-01 00:00:00') AS bin, * FROM packets WHERE {_since(360)}),
    n AS (SELECT bin, src_node_id, count(*) AS c FROM b WHERE src_node_id IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT bin, src_node_id FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY c DESC, src_node_id) AS r FROM n) WHERE r <= 250)
    SELECT s.bin, s.packets, s.observers, t.nodes FROM (SELECT bin, count(DISTINCT packet_hash) AS packets, count(DISTINCT rx_node_id) AS observers FROM b GROUP BY 1) s
    LEFT JOIN (SELECT bin, count(*) AS nodes FROM t GROUP BY 1) t ON s.bin = t.bin
""")
def q22_activity_timeline(spark, sf_dir):
    b = recent(spark, sf_dir, 360).withColumn("bin", time_bin(F.col("time"), 15))
    per = b.where("src_node_id is not null").groupBy("bin", "src_node_id").count()
    top = per.withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("count"), "src_node_id"))).where("r <= 250")
    stats = b.groupBy("bin").agg(F.count_distinct("packet_hash").alias("packets"), F.count_distinct("rx_node_id").alias("observers"))
    return stats.join(top.groupBy("bin").agg(F.count("*").alias("nodes")), "bin", "left")


@query(f"""
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY packet_hash ORDER BY len(path_hashes) DESC, time DESC, observation_id) AS r FROM packets WHERE {_since(24)}),
    o AS (SELECT packet_hash, array_to_string(list_sort(list_distinct(list(rx_node_id) FILTER (WHERE rx_node_id IS NOT NULL))), ',') AS observers, count(*) AS rx_count FROM packets WHERE {_since(24)} GROUP BY 1)
    SELECT k.packet_hash, k.observation_id, k.hop_count, coalesce(o.observers, '') AS observers, o.rx_count FROM k JOIN o ON k.packet_hash = o.packet_hash WHERE k.r = 1
""")
def q28_recent_packets(spark, sf_dir):
    p = recent(spark, sf_dir, 24)
    best = first_by(p, ["packet_hash"], F.size("path_hashes").desc(), F.desc("time"), F.col("observation_id"))
    seen = p.groupBy("packet_hash").agg(F.array_join(F.array_sort(F.collect_set("rx_node_id")), ",").alias("observers"), F.count("*").alias("rx_count"))
    return best.select("packet_hash", "observation_id", "hop_count").join(seen, "packet_hash")


@query(f"""
    SELECT src_node_id, count(*) AS packets, max(time) AS last_seen FROM packets WHERE {_since(168)} AND src_node_id IS NOT NULL GROUP BY 1 ORDER BY packets DESC, src_node_id LIMIT 100
""")
def q36_sender_activity(spark, sf_dir):
    return recent(spark, sf_dir, 168).where("src_node_id is not null").groupBy("src_node_id").agg(F.count("*").alias("packets"), F.max("time").alias("last_seen")).orderBy(F.desc("packets"), "src_node_id").limit(100)


@query(f"""
    WITH o AS (SELECT rx_node_id AS observer, count(DISTINCT date_trunc('hour', time)) AS hours, count(*) AS packets, count(DISTINCT src_node_id) AS sources FROM packets WHERE {_since(48)} AND rx_node_id IS NOT NULL GROUP BY 1)
    SELECT observer, round(0.5 * least(100, 100 * hours / 48.0) + 0.25 * 100 * packets / max(packets) OVER () + 0.25 * least(100, 2 * sources), 6) AS score FROM o
""")
def q37_observer_health(spark, sf_dir):
    o = recent(spark, sf_dir, 48).where("rx_node_id is not null").groupBy(F.col("rx_node_id").alias("observer")).agg(F.count_distinct(F.date_trunc("hour", "time")).alias("hours"), F.count("*").alias("packets"), F.count_distinct("src_node_id").alias("sources"))
    score = 0.5 * F.least(F.lit(100.0), 100 * F.col("hours") / 48.0) + 25.0 * F.col("packets") / F.max("packets").over(Window.partitionBy()) + 0.25 * F.least(F.lit(100), 2 * F.col("sources"))
    return o.select("observer", F.round(score, 6).alias("score"))


@query(f"""
    WITH o AS (SELECT rx_node_id, max(time) AS seen, arg_max(network, observation_id) AS net FROM packets WHERE rx_node_id IS NOT NULL GROUP BY 1)
    SELECT count(*) AS observers, count(*) FILTER (WHERE seen >= {_NOW} - INTERVAL 6 HOUR) AS active, CAST(max(floor((epoch({_NOW}) - epoch(seen)) / 60)) AS BIGINT) AS most_stale
    FROM o WHERE rx_node_id NOT IN (SELECT node_id FROM nodes WHERE network = 'test')
""")
def q46_ingest_freshness(spark, sf_dir):
    from ..sources.domain import nodes

    o = packets(spark, sf_dir).where("rx_node_id is not null").groupBy("rx_node_id").agg(F.max("time").alias("seen"))
    o = o.join(nodes(spark, sf_dir).where("network = 'test'").select(F.col("node_id").alias("rx_node_id")), "rx_node_id", "left_anti")
    minutes = F.floor(F.timestamp_diff("MICROSECOND", F.col("seen"), as_of()) / 60e6)
    return o.agg(F.count("*").alias("observers"), F.count_if(F.col("seen") >= as_of() - F.expr("INTERVAL 6 HOURS")).alias("active"), F.max(minutes).alias("most_stale"))


@query(f"SELECT network, count(*) FILTER (WHERE len(list_filter(path_hashes, lambda x: length(x) > 2)) > 0) AS multibyte, count(*) AS packets FROM packets WHERE {_since(168)} GROUP BY 1")
def q47_multibyte_presence(spark, sf_dir):
    return recent(spark, sf_dir, 168).groupBy("network").agg(F.count_if(F.exists("path_hashes", lambda x: F.length(x) > 2)).alias("multibyte"), F.count("*").alias("packets"))


@query(f"""
    WITH e AS (SELECT *, date_trunc('hour', time) AS h FROM packets WHERE {_SCOPE}), lo AS (SELECT {_NOW} - INTERVAL 47 HOUR - INTERVAL 20 MINUTE AS t)
    SELECT region, CAST(count(*) AS BIGINT) AS packets, round(avg(rssi), 6) AS mean_rssi FROM e CROSS JOIN lo WHERE e.time >= lo.t AND e.time <= {_NOW} GROUP BY 1
""")
def a15_rollup_stitch(spark, sf_dir):
    """Whole hours from the hourly rollup of sums and counts, the partial first hour from raw rows."""
    p = packets(spark, sf_dir).where(in_scope() & (F.col("time") <= as_of())).withColumn("hour", F.date_trunc("hour", "time").cast("timestamp_ntz"))
    start = as_of() - F.expr("INTERVAL 47 HOURS 20 MINUTES")
    edge = as_of() - F.expr("INTERVAL 47 HOURS")
    sums = (F.count("*").alias("n"), F.count("rssi").alias("k"), F.sum("rssi").alias("s"))
    rollup = p.groupBy("region", "hour").agg(*sums)
    parts = rollup.where(F.col("hour") >= edge).drop("hour").union(p.where((F.col("time") >= start) & (F.col("time") < edge)).groupBy("region").agg(*sums))
    return parts.groupBy("region").agg(F.sum("n").alias("packets"), F.round(F.sum("s") / F.sum("k"), 6).alias("mean_rssi"))


@query("""
    SELECT network, date_trunc('day', time)::DATE AS day, max(hop_count) AS hops, arg_max(packet_hash, hop_count * 100000000 - observation_id) AS packet_hash
    FROM packets WHERE NOT is_private GROUP BY 1, 2
""")
def a16_daily_longest(spark, sf_dir):
    rank = F.struct("hop_count", -F.col("observation_id"))
    return packets(spark, sf_dir).where("not is_private").groupBy("network", F.to_date("time").alias("day")).agg(F.max("hop_count").alias("hops"), F.max_by("packet_hash", rank).alias("packet_hash"))


@query("""
    SELECT src_node_id, max(n) AS most FROM (
        SELECT src_node_id, count(*) OVER (PARTITION BY src_node_id ORDER BY time RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS n FROM packets WHERE src_node_id IS NOT NULL
    ) GROUP BY 1
""")
def w09_burst_density(spark, sf_dir):
    half = 1_800_000_000
    w = Window.partitionBy("src_node_id", "day").orderBy("us").rangeBetween(-half, Window.currentRow)
    p = in_days(packets(spark, sf_dir).where("src_node_id is not null").select("src_node_id", "time"), "time", half)
    return p.withColumn("n", F.count("*").over(w)).groupBy("src_node_id").agg(F.max("n").alias("most"))
