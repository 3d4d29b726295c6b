"""Queries in SQL text through the registered functions; DuckDB's SQL says the same without them."""

from __future__ import annotations

from ..functions.sql import register
from ..sources.domain import nodes, packets
from .devices import frames
from .registry import query


@query("""
    SELECT observation_id, CASE WHEN rssi < -110 THEN -110 WHEN rssi > -60 THEN -60 ELSE rssi END AS rssi, time_bucket(INTERVAL 7 MINUTE, time, TIMESTAMP '2000-01-01') AS bin,
        least(rx_node_id, src_node_id) || ':' || greatest(rx_node_id, src_node_id) AS link
    FROM packets WHERE rx_node_id IS NOT NULL AND src_node_id IS NOT NULL
""")
def s213_scalars(spark, sf_dir):
    register(spark)
    return spark.sql(
        "SELECT observation_id, tw_clamp(rssi, -110, -60) AS rssi, tw_time_bin(time, 7) AS bin, tw_link_key(rx_node_id, src_node_id) AS link FROM {p} WHERE rx_node_id IS NOT NULL AND src_node_id IS NOT NULL",
        p=packets(spark, sf_dir),
    )


@query("""
    SELECT n, CASE WHEN lat IS NOT NULL THEN round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(54.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(54.0)) * pow(sin(radians(-4.0 - lon) / 2), 2)))), 6) END AS km,
        round(sqrt(pow(54.0 - lat, 2) + pow((-4.0 - lon) * cos(radians((lat + 54.0) / 2)), 2)) * 111, 6) AS flat_km, lat IS NOT NULL AND NOT (abs(lat) <= 5 AND abs(lon) <= 5) AS placed FROM nodes
""")
def s213_distances(spark, sf_dir):
    register(spark)
    return spark.sql("SELECT n, round(tw_km(lat, lon, 54, -4), 6) AS km, round(tw_flat_km(lat, lon, 54, -4, 111), 6) AS flat_km, tw_has_position(lat, lon, 5) AS placed FROM {n}", n=nodes(spark, sf_dir))


@query("""
    SELECT observation_id, route_type AS route, packet_type AS payload_type, transport_codes AS transport, 2 AS hash_size, hop_count, array_to_string(path_hashes, '') AS path
    FROM packets WHERE observation_id % 50 > 1
""")
def s213_frames(spark, sf_dir):
    """Frames that are well-formed, by the table function and a lateral join."""
    register(spark)
    f = frames(spark, sf_dir).select("observation_id", "raw_hex")
    return spark.sql("SELECT f.observation_id, w.route, w.payload_type, w.transport, w.hash_size, w.hop_count, array_join(w.path_hashes, '') AS path FROM {f} f, LATERAL tw_frame(f.raw_hex) w", f=f)


@query("""
    WITH v AS (SELECT observation_id, rx_node_id, list_filter(path_hashes, lambda h, i: len(h) = 4 AND i <= 4) AS valid FROM packets),
    t AS (SELECT observation_id, CASE WHEN len(valid) > 1 AND starts_with(coalesce(rx_node_id, ''), valid[-1]) THEN valid[1:len(valid) - 1] ELSE valid END AS hashes FROM v),
    h AS (SELECT observation_id, unnest(hashes) AS hash, unnest(range(1, len(hashes) + 1)) AS pos, len(hashes) AS n FROM t),
    u AS (SELECT substr(node_id, 1, 4) AS hash, min(node_id) AS node_id FROM nodes WHERE lat IS NOT NULL AND (role IS NULL OR role = 2) GROUP BY 1 HAVING count(*) = 1)
    SELECT observation_id, CAST(max(n) AS INTEGER) AS decoded_hops, string_agg(substr(u.node_id, 1, 6), ' -> ' ORDER BY pos) AS decoded_path
    FROM h LEFT JOIN u ON u.hash = h.hash GROUP BY 1 HAVING max(n) >= 2 AND count(u.node_id) = max(n) AND count(DISTINCT u.node_id) = max(n)
""")
def s213_exact_paths(spark, sf_dir):
    """Paths of four hops at most whose hashes each name one placed node, none twice, without the receiver's own hop."""
    register(spark)
    return spark.sql(
        """
        WITH h AS (SELECT p.observation_id, x.pos, x.hash FROM {p} p, LATERAL tw_path(p.path_hashes, 4, 2, p.rx_node_id) x),
        u AS (SELECT substr(node_id, 1, 4) AS hash, min(node_id) AS node_id FROM {n} WHERE lat IS NOT NULL AND (role IS NULL OR role = 2) GROUP BY 1 HAVING count(*) = 1)
        SELECT observation_id, CAST(count(*) AS INT) AS decoded_hops, array_join(transform(array_sort(collect_list(struct(pos, node_id))), s -> substr(s.node_id, 1, 6)), ' -> ') AS decoded_path
        FROM h LEFT JOIN u ON u.hash = h.hash GROUP BY 1 HAVING count(*) >= 2 AND count(node_id) = count(*) AND count(DISTINCT node_id) = count(*)
        """,
        p=packets(spark, sf_dir), n=nodes(spark, sf_dir),
    )
