"""Identity, topology, paths, telemetry and messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import edit_ratio, flat_km, free_space_db
from ..operators import graph, learning, paths, rf, spam
from ..operators.relational import canonical, either_way, nearest, prefix_join, spread, weighted_quantile, within_km
from ..sources.domain import AS_OF, aliases, as_of, campaigns, links, messages, nodes, packets, read, status_samples
from ..sources.sinks import changes, merge_aggregate, shared_folder
from .registry import query

_NOW = f"TIMESTAMP '{AS_OF}'"


@query("SELECT p.hash, n.node_id FROM (SELECT DISTINCT hash FROM hops) p JOIN nodes n ON n.node_id LIKE p.hash || '%'")
def j09_prefix_join(spark, sf_dir):
    hashes = packets(spark, sf_dir).select(F.explode("path_hashes").alias("hash")).distinct()
    return prefix_join(hashes, "hash", nodes(spark, sf_dir).select("node_id"), "node_id").select("hash", "node_id")


@query("SELECT h.node, l.a, l.b, l.observed FROM (SELECT DISTINCT a AS node FROM links) h JOIN links l ON l.a = h.node OR l.b = h.node")
def j11_either_end(spark, sf_dir):
    l = links(packets(spark, sf_dir))
    ends = either_way(l.select("a", "b", "observed"))
    asked = l.select(F.col("a").alias("node")).distinct()
    return asked.join(ends, "node").select("node", F.least("node", "peer").alias("a"), F.greatest("node", "peer").alias("b"), "observed")


@query("SELECT node_id, sample_id, battery_mv FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY time DESC, sample_id DESC) AS r FROM status) WHERE r = 1")
def j12_latest_status(spark, sf_dir):
    latest = status_samples(spark, sf_dir).groupBy("node_id").agg(F.max_by(F.struct("sample_id", "battery_mv"), F.struct("time", "sample_id")).alias("s"))
    return latest.select("node_id", "s.*")


@query(f"""
    SELECT x.n AS a, y.n AS b FROM nodes x JOIN nodes y ON x.n < y.n
    WHERE 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) <= 120
""")
def j17_within_km(spark, sf_dir):
    return within_km(nodes(spark, sf_dir), 120, "n").select("a", "b")


@query("""
    WITH d AS (SELECT x.n, y.n AS peer, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) AS km
        FROM nodes x JOIN nodes y ON y.role = 2 AND x.n <> y.n),
    r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY km, CAST(peer AS VARCHAR)) AS r FROM d WHERE km <= 400)
    SELECT CAST(n AS VARCHAR) AS node_id, CAST(peer AS VARCHAR) AS peer FROM r WHERE r <= 3
""")
def j18_nearest(spark, sf_dir):
    n = nodes(spark, sf_dir).select(F.col("n").cast("string").alias("node_id"), "lat", "lon", "role")
    return nearest(n.drop("role"), n.where("role = 2").drop("role"), 4, 400).where("node_id != peer").withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy("km", "peer"))).where("r <= 3").select("node_id", "peer")


@query("SELECT p.packet_hash, p.observation_id FROM packets p WHERE p.rx_node_id NOT IN (SELECT source_id FROM aliases WHERE source_id IS NOT NULL)")
def j07_null_aware_anti(spark, sf_dir):
    p = packets(spark, sf_dir).select("packet_hash", "observation_id", "rx_node_id")
    return spark.sql("SELECT packet_hash, observation_id FROM {p} WHERE rx_node_id NOT IN (SELECT source_id FROM {a} WHERE source_id IS NOT NULL)", p=p, a=aliases(spark, sf_dir))


@query("SELECT n.n, n.network FROM nodes n WHERE EXISTS (SELECT 1 FROM packets p WHERE p.src_node_id = n.node_id AND p.network IS NOT DISTINCT FROM n.network)")
def j05_semi_null_safe(spark, sf_dir):
    p = packets(spark, sf_dir).select("src_node_id", F.col("network").alias("net")).distinct()
    n = nodes(spark, sf_dir)
    return n.join(p, (p.src_node_id == n.node_id) & p.net.eqNullSafe(n.network), "left_semi").select("n", "network")


@query("""
    WITH c AS (SELECT coalesce(canonical_id, upper(trim(node_id))) AS id, n.* FROM nodes n LEFT JOIN aliases ON source_id = upper(trim(node_id)))
    SELECT id, min(n) AS keeper, count(*) AS members, sum(advert_count)::BIGINT AS adverts, max(last_seen) AS last_seen, bool_or(role = 2) AS repeater FROM c GROUP BY 1
""")
def e04_identities(spark, sf_dir):
    c = canonical(nodes(spark, sf_dir), "node_id", aliases(spark, sf_dir), "id")
    return c.groupBy("id").agg(F.min("n").alias("keeper"), F.count("*").alias("members"), F.sum("advert_count").alias("adverts"), F.max("last_seen").alias("last_seen"), F.bool_or(F.col("role") == 2).alias("repeater"))


@query("""
    WITH ends AS (SELECT a AS node, observed FROM links UNION ALL SELECT b, observed FROM links)
    SELECT node, count(*) AS degree, sum(observed)::BIGINT AS observations FROM ends GROUP BY 1
""")
def g03_degrees(spark, sf_dir):
    return graph.degrees(links(packets(spark, sf_dir)))


@query("""
    WITH e AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
    walk AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, walk.root FROM walk JOIN e ON e.u = walk.node)
    SELECT node, min(root) AS component FROM walk GROUP BY 1
""")
def g01_components(spark, sf_dir):
    return graph.components(links(packets(spark, sf_dir)).select("a", "b"))


@query("""
    WITH e AS (SELECT a AS u, b AS v FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
    reach AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, reach.root FROM reach JOIN e ON e.u = reach.node),
    n AS (SELECT node, min(root) AS component FROM reach GROUP BY 1), size AS (SELECT component, count(*) AS c FROM n GROUP BY 1),
    start AS (SELECT x.node AS x, x.component, min(y.node) AS s FROM n x JOIN n y ON x.component = y.component AND x.node <> y.node GROUP BY 1, 2),
    walk AS (SELECT x, s AS node FROM start UNION SELECT w.x, e.v FROM walk w JOIN e ON e.u = w.node AND e.v <> w.x)
    SELECT s.x AS node FROM start s JOIN size z ON z.component = s.component JOIN (SELECT x, count(*) AS c FROM walk GROUP BY 1) w ON w.x = s.x WHERE w.c < z.c - 1
""")
def g02_articulation(spark, sf_dir):
    return graph.articulation_points(links(packets(spark, sf_dir)).select("a", "b"))


@query("""
    WITH e AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links), s AS (SELECT min(u) AS s FROM e),
    h1 AS (SELECT DISTINCT v FROM e, s WHERE u = s), h2 AS (SELECT DISTINCT e.v FROM e JOIN h1 ON e.u = h1.v),
    a AS (SELECT s AS node, 0 AS hops FROM s UNION ALL SELECT v, 1 FROM h1 UNION ALL SELECT v, 2 FROM h2)
    SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM a GROUP BY 1
""")
def g04_bounded_hops(spark, sf_dir):
    l = links(packets(spark, sf_dir)).select("a", "b")
    start = l.agg(F.least(F.min("a"), F.min("b")).alias("node"))
    return graph.hops_from(l, start, 2)


@query(f"""
    SELECT a, b, observed, CASE WHEN observed <= 2 AND last_observed < {_NOW} - INTERVAL 7 DAY THEN 'weak' WHEN observed >= 10 THEN 'strong' ELSE 'normal' END AS status,
        least(a_to_b, b_to_a) AS bottleneck FROM links
""")
def q49_link_reach(spark, sf_dir):
    weak = (F.col("observed") <= 2) & (F.col("last_observed") < as_of() - F.expr("INTERVAL 7 DAYS"))
    status = F.when(weak, "weak").when(F.col("observed") >= 10, "strong").otherwise("normal")
    return links(packets(spark, sf_dir)).select("a", "b", "observed", status.alias("status"), F.least("a_to_b", "b_to_a").alias("bottleneck"))


@query("""
    WITH u AS (SELECT substr(node_id, 1, 4) AS hash, min(node_id) AS node_id FROM nodes WHERE role = 2 GROUP BY 1 HAVING count(*) = 1),
    d AS (SELECT h.observation_id, count(*) AS n, bool_and(u.node_id IS NOT NULL) AS ok, count(DISTINCT u.node_id) AS k, max(h.hop_len) AS hop_len, string_agg(u.node_id, '>' ORDER BY h.pos) AS path
        FROM hops h LEFT JOIN u ON h.hash = u.hash GROUP BY 1)
    SELECT observation_id, CAST(n AS INTEGER) AS hops, md5(path) AS path_md5 FROM d WHERE ok AND n >= 2 AND k = n
""")
def v11_exact_paths(spark, sf_dir):
    found = paths.exact_paths(packets(spark, sf_dir), nodes(spark, sf_dir))
    return found.select("observation_id", F.col("hops").cast("int").alias("hops"), F.md5(F.col("path").cast("binary")).alias("path_md5"))


def _learned(spark, sf_dir):
    """What path learning says of all packets; nodes closer than 30 km count as viable links."""
    shared_folder(spark)
    p, n = packets(spark, sf_dir), nodes(spark, sf_dir).withColumn("elevation_m", F.lit(None).cast("double"))
    ways = learning.travelled(p)
    near = within_km(learning.on_paths(n, ways), 30).checkpoint()
    found = learning.routes(learning.resolved(ways, n, near)).checkpoint()
    return paths.Evidence(
        learning.prefix_priors(found), learning.position_priors(found), learning.corridor_priors(found), learning.node_transitions(found), learning.position_transitions(found), near
    )


@query()
def v01_viterbi_paths(spark, sf_dir):
    return paths.decode(packets(spark, sf_dir).where("size(path_hashes) > 1"), nodes(spark, sf_dir), _learned(spark, sf_dir))


_VIEWS = """
    v AS (SELECT network, packet_hash, observation_id, rx_node_id, path_hashes[1:CASE WHEN observation_id % 4 = 3 THEN 1 ELSE len(path_hashes) END] AS path FROM packets),
    d AS (SELECT network, packet_hash, array_to_string(path, '>') AS path, len(path) AS n, min(rx_node_id) AS by FROM v WHERE rx_node_id IS NOT NULL AND len(path) > 0 GROUP BY ALL)
"""


def _views(spark, sf_dir):
    """Observations of a packet, the last of the four with its first hop alone."""
    i = F.col("observation_id")
    return packets(spark, sf_dir).withColumn("path_hashes", F.when(i % 4 == 3, F.slice("path_hashes", 1, 1)).otherwise(F.col("path_hashes")))


@query(f"""
    WITH {_VIEWS}, o AS (SELECT v.observation_id, c.path AS canonical, row_number() OVER (PARTITION BY v.observation_id ORDER BY c.n DESC, c.by, c.path) AS r
        FROM v JOIN d c ON v.network = c.network AND v.packet_hash = c.packet_hash AND starts_with(c.path, array_to_string(v.path, '>')) WHERE v.rx_node_id IS NOT NULL AND len(v.path) > 0)
    SELECT observation_id, canonical FROM o WHERE r = 1
""")
def v05_shared_groups(spark, sf_dir):
    """The way that each observation of a packet is part of."""
    return paths.shared_groups(_views(spark, sf_dir)).select("observation_id", F.array_join("canonical", ">").alias("canonical"))


@query()
def v07_shared_paths(spark, sf_dir):
    """Every packet's ways decoded once from all observers, and what each observer saw of them."""
    return paths.shared_decode(_views(spark, sf_dir), nodes(spark, sf_dir), _learned(spark, sf_dir))


@query("""
    WITH c AS (SELECT network, pos, hash, count(*) AS n FROM hops GROUP BY 1, 2, 3),
    r AS (SELECT *, n / sum(n) OVER (PARTITION BY network, pos) AS p, row_number() OVER (PARTITION BY network, pos ORDER BY n DESC, hash) AS r FROM c)
    SELECT network, CAST(pos AS INTEGER) AS pos, hash, n, round(p, 6) AS p FROM r WHERE r <= 16
""")
def l02_position_priors(spark, sf_dir):
    hops = learning.hops(packets(spark, sf_dir))
    return learning.priors(hops, ["network", "pos"], ["hash"], 16)


@query("""
    WITH t AS (SELECT x.network, x.hash AS src, y.hash AS dst, count(*) AS n FROM hops x JOIN hops y ON x.observation_id = y.observation_id AND y.pos = x.pos + 1 GROUP BY 1, 2, 3),
    r AS (SELECT *, n / sum(n) OVER (PARTITION BY network, src) AS p, row_number() OVER (PARTITION BY network, src ORDER BY n DESC, dst) AS r FROM t)
    SELECT network, src, dst, n, round(p, 6) AS p FROM r WHERE r <= 5
""")
def l02_transition_priors(spark, sf_dir):
    return learning.priors(learning.transitions(packets(spark, sf_dir)), ["network", "src"], ["dst"], 5)


@query("""
    WITH m AS (SELECT x.network, x.hash || '>' || y.hash || '>' || z.hash AS motif FROM hops x JOIN hops y ON x.observation_id = y.observation_id AND y.pos = x.pos + 1 JOIN hops z ON x.observation_id = z.observation_id AND z.pos = x.pos + 2)
    SELECT network, motif, count(*) AS n FROM m GROUP BY 1, 2
""")
def l02_motifs(spark, sf_dir):
    return learning.motifs(packets(spark, sf_dir), 3)


@query(f"""
    WITH e AS (SELECT a, b, observed, a_to_b, b_to_a, (epoch({_NOW}) - epoch(last_observed)) / 86400 AS days FROM links)
    SELECT a, b, round(0.42 * observed / (observed + 2.0) + 0.22 * (1 - abs(a_to_b - b_to_a) / CAST(observed AS DOUBLE)) + 0.20 * greatest(0.05, least(1, exp(-days / 21))), 6) AS score FROM e
""")
def l03_edge_scores(spark, sf_dir):
    return learning.edge_scores(links(packets(spark, sf_dir)), as_of())


@query("""
    WITH w AS (SELECT node_id, time, uptime_secs, air_secs, lag(uptime_secs) OVER o AS u0, lag(air_secs) OVER o AS a0 FROM status WINDOW o AS (PARTITION BY node_id ORDER BY time, sample_id))
    SELECT node_id, count(*) AS samples, round(avg(CASE WHEN uptime_secs > u0 AND air_secs >= a0 THEN least(100, CAST(100 AS DOUBLE) * (air_secs - a0) / (uptime_secs - u0)) END), 6) AS utilisation FROM w GROUP BY 1
""")
def w08_utilisation(spark, sf_dir):
    w = Window.partitionBy("node_id").orderBy("time", "sample_id")
    s = status_samples(spark, sf_dir).withColumns({"u0": F.lag("uptime_secs").over(w), "a0": F.lag("air_secs").over(w)})
    used = F.when((F.col("uptime_secs") > F.col("u0")) & (F.col("air_secs") >= F.col("a0")), F.least(F.lit(100.0), F.lit(100.0) * (F.col("air_secs") - F.col("a0")) / (F.col("uptime_secs") - F.col("u0"))))
    return s.groupBy("node_id").agg(F.count("*").alias("samples"), F.round(F.avg(used), 6).alias("utilisation"))


@query("""
    WITH s AS (SELECT battery_mv, sum(uptime_secs) AS w FROM status GROUP BY 1), c AS (SELECT *, sum(w) OVER (ORDER BY battery_mv) AS cum, sum(w) OVER () AS total FROM s)
    SELECT min(battery_mv) AS battery_mv FROM c WHERE cum >= total * 0.65
""")
def a17_weighted_quantile(spark, sf_dir):
    tagged = status_samples(spark, sf_dir).select(F.lit(1).alias("all"), "battery_mv", "uptime_secs")
    return weighted_quantile(tagged, ["all"], "battery_mv", "uptime_secs", 0.65).drop("all")


@query("""
    SELECT n.n, round(20 * log10(4 * pi() * k.km * 1000 / (299792458.0 / 868e6)), 6) AS loss_db FROM nodes n
    JOIN (SELECT n, sqrt(pow(lat - 54.0, 2) + pow((lon + 4.0) * cos(radians((lat + 54.0) / 2)), 2)) * 111.32 AS km FROM nodes WHERE lat IS NOT NULL) k ON n.n = k.n
""")
def f01_free_space(spark, sf_dir):
    km = flat_km(F.lit(54.0), F.lit(-4.0), F.col("lat"), F.col("lon"))
    return nodes(spark, sf_dir).where("lat is not null").select("n", F.round(free_space_db(km), 6).alias("loss_db"))


@query("""
    WITH p AS (SELECT p_partkey AS id, list_transform(range(25), lambda i: CAST(50 + (p_partkey * 7 + i * i * 13) % 97 AS DOUBLE)) AS h, CAST(100 + p_size * 10 AS DOUBLE) AS step FROM part),
    q AS (SELECT *, 24 * step AS d, h[1] + 5.0 AS a, h[25] + 1.5 AS b, 299792458.0 / 868e6 AS wave FROM p),
    r AS (SELECT *, list_max(list_transform(range(1, 24), lambda i: (h[i + 1] + i * step * (d - i * step) / (2 * 6371000.0 * 4 / 3) - (a + (b - a) * (i * step) / d)) * sqrt(2 * d / (wave * (i * step) * (d - i * step))))) AS v,
        list_aggregate(list_transform(range(1, 25), lambda i: abs(h[i + 1] - h[i])), 'quantile_cont', 0.75) AS p75 FROM q),
    l AS (SELECT *, 20 * log10(4 * pi() * d / wave) + CASE WHEN v > -0.78 THEN greatest(0, 6.9 + 20 * log10(sqrt(pow(v - 0.1, 2) + 1) + v - 0.1)) ELSE 0 END + least(6, 0.08 * ln(1 + p75)) AS loss FROM r)
    SELECT id, d / 1000 AS km, round(v, 6) AS v, round(loss, 6) AS loss_db, loss < 140 AND v <= 1.12 AS viable FROM l
""", domain=False)
def f02_path_profiles(spark, sf_dir):
    found = rf.path_losses(rf.synthetic_profiles(spread(read(spark, sf_dir, "part"), "p_partkey")))
    return found.withColumn("loss_db", F.round("loss_db", 6))


@query("""
    SELECT conv_id, turn, round(1 - levenshtein(lower(text), lower(nxt)) / CAST(greatest(1, length(text), length(nxt)) AS DOUBLE), 6) AS ratio
    FROM (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '', 'g') AS text, regexp_replace(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '[^ -~]', '', 'g') AS nxt FROM messages) WHERE nxt IS NOT NULL
""")
def k02_message_similarity(spark, sf_dir):
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    m = messages(spark, sf_dir).select("conv_id", "turn", F.regexp_replace("text", "[^ -~]", "").alias("text"), F.regexp_replace(nxt, "[^ -~]", "").alias("nxt")).where("nxt is not null")
    return m.select("conv_id", "turn", F.round(edit_ratio(F.lower("text"), F.lower("nxt")), 6).alias("ratio"))


@query()
def k02_message_clusters(spark, sf_dir):
    return spam.clusters(campaigns(spark, sf_dir))


@query("""
    SELECT src_node_id, count(*) AS packets, count(DISTINCT date_trunc('hour', time)) AS hours, max(c) AS most_a_minute FROM (
        SELECT src_node_id, time, count(*) OVER (PARTITION BY src_node_id, date_trunc('minute', time)) AS c FROM packets WHERE packet_type = 4 AND src_node_id IS NOT NULL
    ) GROUP BY 1
""")
def k08_advert_evidence(spark, sf_dir):
    return spam.advert_evidence(packets(spark, sf_dir).where("packet_type = 4 and src_node_id is not null"))


@query("""
    WITH o AS (SELECT network, src_node_id, min(time) AS first, max(time) AS last, count(*) AS n FROM packets WHERE src_node_id IS NOT NULL GROUP BY 1, 2) SELECT network, count(*) AS keys, sum(n)::BIGINT AS rows FROM o GROUP BY 1
""")
def s17_merge(spark, sf_dir):
    """Two halves merged as an old table and a batch give what one pass over both gives."""
    p = packets(spark, sf_dir).where("src_node_id is not null").withColumns({"first": F.col("time"), "last": F.col("time"), "n": F.lit(1).cast("long")})
    rules = {"first": "min", "last": "max", "n": "sum"}
    empty = p.limit(0)
    old = merge_aggregate(empty, p.where("observation_id % 2 = 0"), ["network", "src_node_id"], rules)
    merged = merge_aggregate(old, p.where("observation_id % 2 = 1"), ["network", "src_node_id"], rules)
    return merged.groupBy("network").agg(F.count("*").alias("keys"), F.sum("n").alias("rows"))


@query("""
    WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), w AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1)
    SELECT coalesce(o.k, w.k) AS k, CASE WHEN w.k IS NULL THEN 'delete' ELSE 'upsert' END AS action, w.n FROM o FULL JOIN w ON o.k = w.k WHERE w.k IS NULL OR o.k IS NULL OR o.n <> w.n
""")
def s18_changes(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    count = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return changes(count("o_orderkey % 3 != 0"), count("o_orderkey % 3 != 1"), ["k"])
