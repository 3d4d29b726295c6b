"""One device behind several ids: what speaks for it, and which id stands for the group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity
from ..sources.domain import nodes, packets, status_samples
from .registry import query


def _evidence(spark, sf_dir):
    adverts = packets(spark, sf_dir).where("packet_type = 4 and src_node_id is not null")
    own = adverts.groupBy(F.col("src_node_id").alias("node_id")).agg(F.count("*").alias("self_adverts"), F.min("time").alias("first"), F.max("time").alias("last"))
    status = status_samples(spark, sf_dir).groupBy("node_id").agg(F.count("*").alias("statuses"))
    heard = adverts.where("rx_node_id is not null and rx_node_id != src_node_id")
    pair = heard.groupBy(F.least("src_node_id", "rx_node_id").alias("a"), F.greatest("src_node_id", "rx_node_id").alias("b")).agg(F.count("*").alias("adverts"))
    return own.join(status, "node_id", "full"), pair


_PAIRS = """
    n AS (SELECT node_id, network, role, lat, lon, advert_count, last_seen, list_filter(string_split(upper(name), ' '), lambda w: w <> '') AS words FROM nodes),
    k AS (SELECT *, array_to_string(list_filter(words, lambda w: w NOT IN ('REPEATER', 'NODE'))[1:2], '|') AS bucket, coalesce(role = 2 AND lat IS NOT NULL AND advert_count > 0, false) AS active,
        role IS NULL AND lat IS NULL AND advert_count = 0 AS bare FROM n),
    adv AS (SELECT * FROM packets WHERE packet_type = 4 AND src_node_id IS NOT NULL),
    e AS (SELECT k.*, coalesce(s.c, 0) AS statuses, coalesce(o.c, 0) AS selfs, o.first, o.last FROM k LEFT JOIN (SELECT node_id, count(*) AS c FROM status GROUP BY 1) s ON s.node_id = k.node_id
        LEFT JOIN (SELECT src_node_id, count(*) AS c, min(time) AS first, max(time) AS last FROM adv GROUP BY 1) o ON o.src_node_id = k.node_id),
    h AS (SELECT least(src_node_id, rx_node_id) AS a, greatest(src_node_id, rx_node_id) AS b, count(*) AS adverts FROM adv WHERE rx_node_id <> src_node_id GROUP BY 1, 2),
    one AS (SELECT bucket FROM e WHERE active GROUP BY 1 HAVING count(*) = 1),
    p AS (SELECT x.node_id AS a, y.node_id AS b, len(list_intersect(x.words, y.words)) / len(list_distinct(list_concat(x.words, y.words))) >= 0.6 AS names, coalesce(x.network = y.network AND x.network <> 'test', false) AS one_network,
        coalesce(x.role = 2, true) AND coalesce(y.role = 2, true) AS roles,
        list_sum(list_transform(range(1, 65), lambda i: CASE WHEN substr(x.node_id, i, 1) <> substr(y.node_id, i, 1) THEN 1 ELSE 0 END)) <= 1 AS near_ids,
        coalesce(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) <= 3 AND x.lat IS NOT NULL AND y.lat IS NOT NULL, false) AS one_place,
        coalesce(h.adverts, 0) >= 3 AS heard, coalesce(x.selfs >= 3 AND y.selfs >= 3 AND (CASE WHEN x.first > y.last THEN epoch(x.first) - epoch(y.last) WHEN y.first > x.last THEN epoch(y.first) - epoch(x.last) END) <= 14 * 86400, false) AS handover,
        x.statuses > 0 OR y.statuses > 0 AS status, x.active OR y.active AS any_active, x.bare OR y.bare AS bare, o.bucket IS NOT NULL AS alone,
        NOT (len(x.words) >= 2 AND len(x.words) = len(y.words) AND x.words[1:len(x.words) - 1] = y.words[1:len(y.words) - 1] AND x.words[-1] <> y.words[-1]) AS no_veto
        FROM e x JOIN e y ON x.bucket = y.bucket AND x.node_id < y.node_id LEFT JOIN h ON h.a = x.node_id AND h.b = y.node_id LEFT JOIN one o ON o.bucket = x.bucket),
    g AS (SELECT *, one_network AND roles AND names AND ((near_ids AND one_place) OR (heard AND no_veto AND bare AND status AND any_active) OR (handover AND no_veto AND status AND any_active)) AS high,
        one_network AND roles AND names AND no_veto AND bare AND any_active AND status AND alone AS medium FROM p)
"""


@query(f"""
    WITH {_PAIRS} SELECT a, b, names, one_network, roles, near_ids, one_place, heard, handover, status,
        CAST(names AS INTEGER) + CAST(one_network AS INTEGER) + CAST(roles AS INTEGER) + CAST(near_ids AS INTEGER) + CAST(one_place AS INTEGER) + CAST(heard AS INTEGER) + CAST(handover AS INTEGER) + CAST(status AS INTEGER) AS score,
        high OR medium AS accepted, CASE WHEN high THEN 'high' WHEN medium THEN 'medium' ELSE 'low' END AS confidence FROM g
""")
def e01_pairs(spark, sf_dir):
    return identity.assess(nodes(spark, sf_dir), *_evidence(spark, sf_dir))


@query("""
    WITH m AS (SELECT *, split_part(name, ' ', 2) AS identity FROM nodes), r AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY coalesce(role = 2 AND lat IS NOT NULL AND advert_count > 0, false) DESC, advert_count DESC, last_seen DESC, node_id) AS r, count(*) OVER (PARTITION BY identity) AS members FROM m)
    SELECT identity, node_id AS canonical_id, members FROM r WHERE r = 1
""")
def e04_canonical(spark, sf_dir):
    """Of the nodes of one name the one that stands for them."""
    return identity.choose_canonical(nodes(spark, sf_dir).withColumn("identity", F.split_part("name", F.lit(" "), F.lit(2))))


_DEVICES = """
    devices AS (SELECT node_id, name, network, role, lat, lon, advert_count, last_seen FROM nodes
        UNION ALL SELECT substr(node_id, 1, 63) || CASE WHEN substr(node_id, 64) = '0' THEN '1' ELSE '0' END, name, network, 2, lat + 0.001, lon, 1, last_seen FROM nodes WHERE n % 4 = 1 AND lat IS NOT NULL
        UNION ALL SELECT upper(md5('x' || CAST(n AS VARCHAR)) || md5('y' || CAST(n AS VARCHAR))), name, network, NULL, NULL, NULL, 0, NULL FROM nodes WHERE n % 6 = 2)
"""


def _devices(spark, sf_dir):
    """Nodes, some with a second id a digit apart at their place, others with a bare second id."""
    n = nodes(spark, sf_dir)
    columns = ["node_id", "name", "network", "role", "lat", "lon", "advert_count", "last_seen"]
    twin = F.concat(F.substring("node_id", 1, 63), F.when(F.substring("node_id", 64, 1) == "0", "1").otherwise("0"))
    twins = n.where("n % 4 = 1 and lat is not null").withColumns({"node_id": twin, "role": F.lit(2), "lat": F.col("lat") + 0.001, "advert_count": F.lit(1).cast("long")})
    other = F.upper(F.concat(F.md5(F.concat(F.lit("x"), F.col("n").cast("string")).cast("binary")), F.md5(F.concat(F.lit("y"), F.col("n").cast("string")).cast("binary"))))
    none = {"role": F.lit(None).cast("int"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "advert_count": F.lit(0).cast("long"), "last_seen": F.lit(None).cast("timestamp_ntz")}
    bare = n.where("n % 6 = 2").withColumns({"node_id": other, **none})
    return n.select(*columns).union(twins.select(*columns)).union(bare.select(*columns))


@query(f"""
    WITH {_DEVICES}, {_PAIRS.replace("FROM nodes)", "FROM devices)")} SELECT a, b, high OR medium AS accepted, CASE WHEN high THEN 'high' ELSE 'medium' END AS confidence FROM g WHERE high OR medium
""")
def e03_accepted_pairs(spark, sf_dir):
    """Ids that are one device, without pairing all devices of a name."""
    return identity.accepted_pairs(_devices(spark, sf_dir), *_evidence(spark, sf_dir)).select("a", "b", "accepted", "confidence")


@query()
def e03_identity_groups(spark, sf_dir):
    devices = _devices(spark, sf_dir)
    return identity.groups(identity.accepted_pairs(devices, *_evidence(spark, sf_dir)), devices)
