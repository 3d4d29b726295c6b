"""Reports: owners, alerts, priors for readers, adverts, origins, feeds and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import flat_km, has_position
from ..operators import graph, learning, paths
from ..operators.relational import canonical, first_by, in_days, small
from ..sources.domain import AS_OF, REGIONS, aliases, as_of, links, messages, nodes, packets, read, status_samples
from .registry import query
from .traffic import _since, recent

_NOW = f"TIMESTAMP '{AS_OF}'"
#: Region, latitude and longitude of its centre.
CENTRES = [(r, 51.0 + 2.0 * k, -6.0 + 1.5 * k) for k, r in enumerate(REGIONS)]
SNAP_KM = 200.0
#: Name and box (south, north, west, east), the first that fits.
BOXES = [("north-west", 55.0, 90.0, -90.0, -5.0), ("north", 55.0, 90.0, -5.0, 90.0), ("west", 0.0, 55.0, -90.0, -5.0)]


@query("""
    WITH s AS (SELECT a, b, observed FROM links),
    e AS (SELECT a AS u, b AS v FROM s UNION SELECT b, a FROM s),
    walk AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, walk.root FROM walk JOIN e ON e.u = walk.node),
    c AS (SELECT node, min(root) AS component FROM walk GROUP BY 1)
    SELECT component, count(DISTINCT node) AS nodes, CAST(count(*) / 2 AS BIGINT) AS links, CAST(sum(observed) / 2 AS BIGINT) AS observations
    FROM (SELECT c.component, c.node, s.observed FROM c JOIN s ON c.node = s.a UNION ALL SELECT c.component, c.node, s.observed FROM c JOIN s ON c.node = s.b) GROUP BY 1
""")
def q24_topology_shape(spark, sf_dir):
    l = links(packets(spark, sf_dir)).select("a", "b", "observed")
    found = graph.components(l.select("a", "b"))
    size = found.groupBy("component").agg(F.count("*").alias("nodes"))
    used = l.join(found.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count("*").alias("links"), F.sum("observed").alias("observations"))
    return size.join(used, "component").select("component", "nodes", "links", "observations")


@query("""
    WITH r AS (SELECT substr(src_node_id, 1, 4) AS x, substr(rx_node_id, 1, 4) AS y, snr FROM packets WHERE src_node_id <> rx_node_id),
    g AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS reports, max(snr) AS best_snr FROM r GROUP BY 1, 2)
    SELECT l.a, l.b, l.observed, coalesce(g.reports, 0) AS reports, g.best_snr FROM links l LEFT JOIN g ON l.a = g.a AND l.b = g.b
""")
def q26_reported_links(spark, sf_dir):
    p = packets(spark, sf_dir)
    x, y = F.substring("src_node_id", 1, 4), F.substring("rx_node_id", 1, 4)
    g = p.where("src_node_id != rx_node_id").groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.count("*").alias("reports"), F.max("snr").alias("best_snr"))
    return links(p).join(g, ["a", "b"], "left").select("a", "b", "observed", F.coalesce("reports", F.lit(0)).alias("reports"), "best_snr")


@query(f"""
    SELECT packet_hash, count(*) AS observations, min(time) AS first, max(time) AS last, count(DISTINCT rx_node_id) AS observers, max(hop_count) AS longest
    FROM packets WHERE {_since(24)} GROUP BY 1 ORDER BY last DESC, packet_hash LIMIT 100
""")
def q30_packet_details(spark, sf_dir):
    g = recent(spark, sf_dir, 24).groupBy("packet_hash").agg(
        F.count("*").alias("observations"), F.min("time").alias("first"), F.max("time").alias("last"), F.count_distinct("rx_node_id").alias("observers"), F.max("hop_count").alias("longest")
    )
    return g.orderBy(F.desc("last"), "packet_hash").limit(100)


@query("""
    WITH c AS (SELECT coalesce(canonical_id, upper(trim(node_id))) AS id, s.* FROM status s LEFT JOIN aliases ON source_id = upper(trim(node_id))),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time DESC, sample_id DESC) AS r, count(*) OVER (PARTITION BY id) AS samples FROM c)
    SELECT id, sample_id, battery_mv, samples FROM r WHERE r = 1
""")
def q34_identity_status(spark, sf_dir):
    c = canonical(status_samples(spark, sf_dir), "node_id", aliases(spark, sf_dir), "id")
    latest = F.max_by(F.struct("sample_id", "battery_mv"), F.struct("time", "sample_id")).alias("s")
    return c.groupBy("id").agg(latest, F.count("*").alias("samples")).select("id", "s.sample_id", "s.battery_mv", "samples")


@query("""
    WITH w AS (SELECT *, lag(uptime_secs) OVER (PARTITION BY node_id ORDER BY time, sample_id) AS u0 FROM status)
    SELECT node_id, date_trunc('month', time)::DATE AS month, count(*) AS samples, round(avg(battery_mv), 4) AS battery_mv, count(*) FILTER (WHERE uptime_secs < u0) AS resets FROM w GROUP BY 1, 2
""")
def q35_status_history(spark, sf_dir):
    before = F.lag("uptime_secs").over(Window.partitionBy("node_id").orderBy("time", "sample_id"))
    s = status_samples(spark, sf_dir).withColumn("reset", F.col("uptime_secs") < before)
    return s.groupBy("node_id", F.trunc("time", "month").alias("month")).agg(F.count("*").alias("samples"), F.round(F.avg("battery_mv"), 4).alias("battery_mv"), F.count_if("reset").alias("resets"))


@query("""
    SELECT least(x.hash, y.hash) AS a, greatest(x.hash, y.hash) AS b, date_trunc('day', x.time)::DATE AS day, count(*) AS observed
    FROM hops x JOIN hops y ON x.observation_id = y.observation_id AND y.pos = x.pos + 1 GROUP BY 1, 2, 3
""")
def q39_link_history(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("time", F.date_trunc("day", "time"))
    return links(p, "time").select("a", "b", F.to_date("time").alias("day"), "observed")


@query("""
    WITH o AS (SELECT node_id FROM nodes)
    SELECT o.node_id, 'incoming' AS kind, p.src_node_id AS peer, count(*) AS packets, max(rssi) AS rssi FROM packets p JOIN o ON p.rx_node_id = o.node_id GROUP BY 1, 2, 3
    UNION ALL SELECT o.node_id, 'heard by', p.rx_node_id, count(*), max(rssi) FROM packets p JOIN o ON p.src_node_id = o.node_id GROUP BY 1, 2, 3
    UNION ALL SELECT o.node_id, 'adverts', CAST(date_trunc('day', time)::DATE AS VARCHAR), count(*), max(rssi) FROM packets p JOIN o ON p.src_node_id = o.node_id WHERE packet_type = 4 GROUP BY 1, 2, 3
""")
def q40_owner_bundle(spark, sf_dir):
    """One pass: each packet of an owned node is a row for each kind it belongs to."""
    owned = small(nodes(spark, sf_dir).select("node_id"))
    row = lambda kind, node, peer, when=F.lit(True): F.when(when, F.struct(F.lit(kind).alias("kind"), F.col(node).alias("node_id"), peer.alias("peer")))
    rows = F.array(
        row("incoming", "rx_node_id", F.col("src_node_id")), row("heard by", "src_node_id", F.col("rx_node_id")),
        row("adverts", "src_node_id", F.to_date("time").cast("string"), F.col("packet_type") == 4),
    )
    r = packets(spark, sf_dir).select("rssi", F.explode(F.array_compact(rows)).alias("r")).select("r.*", "rssi").join(owned, "node_id")
    return r.groupBy("node_id", "kind", "peer").agg(F.count("*").alias("packets"), F.max("rssi").alias("rssi"))


@query(f"""
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY time DESC, sample_id DESC) AS r FROM status)
    SELECT n.n, (['silent', 'battery', 'airtime'])[n.n % 3 + 1] AS rule, coalesce(CASE n.n % 3 WHEN 0 THEN s.time IS NULL OR s.time < {_NOW} - INTERVAL 900 DAY WHEN 1 THEN s.battery_mv < 3600 ELSE s.air_secs > 2500 END, false) AS triggered
    FROM nodes n LEFT JOIN s ON n.node_id = s.node_id AND s.r = 1
""")
def q43_alert_rules(spark, sf_dir):
    """A rule for each node; a node without samples is silent, and a missing value triggers no other rule."""
    s = status_samples(spark, sf_dir).groupBy("node_id").agg(F.max_by(F.struct("time", "battery_mv", "air_secs"), F.struct("time", "sample_id")).alias("s"))
    silent = F.col("s.time").isNull() | (F.col("s.time") < as_of() - F.expr("INTERVAL 900 DAYS"))
    kind = F.col("n") % 3
    met = F.when(kind == 0, silent).when(kind == 1, F.col("s.battery_mv") < 3600).otherwise(F.col("s.air_secs") > 2500)
    rule = F.when(kind == 0, "silent").when(kind == 1, "battery").otherwise("airtime")
    return nodes(spark, sf_dir).join(s, "node_id", "left").select("n", rule.alias("rule"), F.coalesce(met, F.lit(False)).alias("triggered"))


@query("SELECT conv_id, CAST(to_json(list({'turn': turn, 'sender': sender} ORDER BY turn, sender)) AS VARCHAR) AS history FROM messages GROUP BY 1")
def q44_nested_history(spark, sf_dir):
    """Turns of a conversation as a JSON array: as long as the conversation."""
    return messages(spark, sf_dir).groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "sender")))).alias("history"))


@query("SELECT event_type, ts AS last, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", domain=False)
def q48_latest_of_name(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""
    WITH m AS (SELECT x.network, x.hash || '>' || y.hash || '>' || z.hash AS motif, count(*) AS n FROM hops x JOIN hops y ON x.observation_id = y.observation_id AND y.pos = x.pos + 1
        JOIN hops z ON x.observation_id = z.observation_id AND z.pos = x.pos + 2 GROUP BY 1, 2),
    k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE n % 9 = 0 AND list_contains(string_split(m.motif, '>'), substr(node_id, 1, 4)))),
    r AS (SELECT *, row_number() OVER (PARTITION BY network ORDER BY n DESC, motif) AS r FROM k)
    SELECT network, motif, n FROM r WHERE r <= 20
""")
def q50_public_motifs(spark, sf_dir):
    """The most frequent motifs of a network that name no private node."""
    m = packets(spark, sf_dir).transform(learning.motifs, 3)
    private = nodes(spark, sf_dir).where("n % 9 = 0").select(F.substring("node_id", 1, 4).alias("hash"))
    hidden = m.select("motif").distinct().select("motif", F.explode(F.split("motif", ">")).alias("hash")).join(small(private), "hash", "left_semi").select("motif").distinct()
    rank = F.row_number().over(Window.partitionBy("network").orderBy(F.desc("n"), "motif"))
    return m.join(hidden, "motif", "left_anti").withColumn("r", rank).where("r <= 20").select("network", "motif", "n")


_ADVERTS = """b AS (SELECT src_node_id, avg(rssi) AS mean, stddev_samp(rssi) AS sd FROM packets WHERE packet_type = 4 AND src_node_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 10 AND stddev_samp(rssi) < 60),
    m AS (SELECT *, count(*) OVER (PARTITION BY src_node_id, date_trunc('hour', time)) AS per_hour FROM packets WHERE packet_type = 4 AND src_node_id IS NOT NULL),
    j AS (SELECT m.observation_id, m.network, b.mean IS NULL AS is_new, coalesce(abs(m.rssi - b.mean) > 1.5 * b.sd, false) AS odd, m.per_hour > 1 AS burst FROM m LEFT JOIN b USING (src_node_id)),
    v AS (SELECT *, CAST(is_new AS INTEGER) + 2 * CAST(odd AS INTEGER) + 2 * CAST(burst AS INTEGER) AS score FROM j)
"""


def _baseline(adverts):
    """Mean and deviation of the sources that are established."""
    return adverts.groupBy("src_node_id").agg(F.avg("rssi").alias("mean"), F.stddev_samp("rssi").alias("sd"), F.count("*").alias("adverts"), F.sum(F.round(F.col("rssi") * 100).cast("long")).alias("rssi_cents")).where("adverts >= 10 and sd < 60")


def _adverts(spark, sf_dir):
    return packets(spark, sf_dir).where("packet_type = 4 and src_node_id is not null")


def _verdicts(spark, sf_dir):
    a = _adverts(spark, sf_dir)
    hour = F.date_trunc("hour", "time")
    rate = a.groupBy("src_node_id", hour.alias("hour")).agg(F.count("*").alias("per_hour"))
    j = a.withColumn("hour", hour).join(rate, ["src_node_id", "hour"]).join(_baseline(a), "src_node_id", "left")
    odd = F.coalesce(F.abs(F.col("rssi") - F.col("mean")) > F.col("sd") * 1.5, F.lit(False))
    score = F.col("mean").isNull().cast("int") + 2 * odd.cast("int") + 2 * (F.col("per_hour") > 1).cast("int")
    verdict = F.when(score >= 3, "spoof").when(score >= 2, "suspect").otherwise("clean")
    return j.select("observation_id", "network", score.alias("score"), verdict.alias("verdict"))


@query("SELECT src_node_id, count(*) AS adverts, CAST(sum(CAST(round(rssi * 100) AS BIGINT)) AS BIGINT) AS rssi_cents, round(stddev_samp(rssi), 4) AS sd FROM packets WHERE packet_type = 4 AND src_node_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 10 AND stddev_samp(rssi) < 60")
def k10_established(spark, sf_dir):
    return _baseline(_adverts(spark, sf_dir)).select("src_node_id", "adverts", "rssi_cents", F.round("sd", 4).alias("sd"))


@query("WITH " + _ADVERTS + "SELECT observation_id, CAST(score AS INTEGER) AS score, CASE WHEN score >= 3 THEN 'spoof' WHEN score >= 2 THEN 'suspect' ELSE 'clean' END AS verdict FROM v")
def k09_advert_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("observation_id", "score", "verdict")


@query("WITH " + _ADVERTS + "SELECT network, count(*) AS adverts, count(*) FILTER (WHERE score >= 2 AND score < 3) AS suspects, count(*) FILTER (WHERE score >= 3) AS spoofs FROM v GROUP BY 1")
def q51_suspect_summary(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return v.groupBy("network").agg(F.count("*").alias("adverts"), F.count_if(F.col("verdict") == "suspect").alias("suspects"), F.count_if(F.col("verdict") == "spoof").alias("spoofs"))


@query("SELECT network, md5(text) AS signature, count(*) AS messages, count(DISTINCT sender) AS senders, min(time) AS first, max(time) AS last FROM messages GROUP BY 1, 2")
def k01_signatures(spark, sf_dir):
    sign = F.md5(F.col("text").cast("binary")).alias("signature")
    return messages(spark, sf_dir).groupBy("network", sign).agg(F.count("*").alias("messages"), F.count_distinct("sender").alias("senders"), F.min("time").alias("first"), F.max("time").alias("last"))


@query("""
    WITH m AS (SELECT *, count(*) OVER (PARTITION BY network, md5(text)) AS copies FROM messages)
    SELECT network, count(*) AS messages, count(*) FILTER (WHERE copies > 1) AS repeated, count(DISTINCT md5(text)) FILTER (WHERE copies > 1) AS incidents, max(time) FILTER (WHERE copies > 1) AS last FROM m GROUP BY 1
""")
def q52_incident_status(spark, sf_dir):
    """Counted by signature first, so a message copied without end is one row of the second count."""
    s = messages(spark, sf_dir).groupBy("network", F.md5(F.col("text").cast("binary")).alias("signature")).agg(F.count("*").alias("n"), F.max("time").alias("last"))
    many = F.col("n") > 1
    return s.groupBy("network").agg(F.sum("n").alias("messages"), F.sum(F.when(many, F.col("n")).otherwise(0)).alias("repeated"), F.count_if(many).alias("incidents"), F.max(F.when(many, F.col("last"))).alias("last"))


@query("""
    WITH p AS (SELECT p_partkey AS id, i AS pos, 50.0 + (p_partkey * 7 + i * i * 13) % 97 AS h FROM part, unnest(range(25)) AS t(i)),
    b AS (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS island FROM p WHERE h > 100)
    SELECT id, CAST(min(pos) AS INTEGER) AS first, count(*) AS points, CAST(max(h) AS DOUBLE) AS highest FROM b GROUP BY id, island
""", domain=False)
def q58_blocked_runs(spark, sf_dir):
    """Runs of consecutive profile points above 100 m."""
    from ..operators.rf import synthetic_profiles

    p = synthetic_profiles(read(spark, sf_dir, "part")).select("id", F.posexplode("heights_m").alias("pos", "h")).where("h > 100")
    p = p.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    return p.groupBy("id", "island").agg(F.min("pos").alias("first"), F.count("*").alias("points"), F.max("h").alias("highest")).drop("island")


@query("""
    WITH s AS (SELECT *, 2 * CAST(snr IS NOT NULL AS INTEGER) + CAST(rx_node_id IS NOT NULL AS INTEGER) + len(path_hashes) AS score FROM packets),
    r AS (SELECT *, row_number() OVER (PARTITION BY packet_hash ORDER BY score DESC, observation_id) AS r FROM s)
    SELECT packet_hash, max(observation_id) FILTER (WHERE r = 1) AS best, count(*) AS copies, count(DISTINCT rx_node_id) AS observers, count(DISTINCT region) AS regions FROM r GROUP BY 1
""")
def q59_merged_feed(spark, sf_dir):
    """The most informative observation of each packet, with what the others add."""
    score = 2 * F.col("snr").isNotNull().cast("int") + F.col("rx_node_id").isNotNull().cast("int") + F.size("path_hashes")
    best = F.max_by("observation_id", F.struct(score, -F.col("observation_id"))).alias("best")
    return packets(spark, sf_dir).groupBy("packet_hash").agg(best, F.count("*").alias("copies"), F.size(F.collect_set("rx_node_id")).cast("long").alias("observers"), F.size(F.collect_set("region")).cast("long").alias("regions"))


@query("""
    WITH h AS (SELECT region, date_trunc('hour', time) AS hour, count(*) AS packets FROM packets GROUP BY 1, 2),
    w AS (SELECT *, lag(packets) OVER (PARTITION BY region ORDER BY hour) AS before FROM h)
    SELECT region, hour, packets, before, coalesce(packets < 0.5 * before, false) AS alert FROM w
""")
def q60_rate_alerts(spark, sf_dir):
    h = packets(spark, sf_dir).groupBy("region", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("packets"))
    h = h.withColumn("before", F.lag("packets").over(Window.partitionBy("region").orderBy("hour")))
    return h.withColumn("alert", F.coalesce(F.col("packets") < F.col("before") * 0.5, F.lit(False)))


@query("""
    WITH o AS (SELECT p.pk, p.hop_count, min(p.hop_count) OVER (PARTITION BY p.pk) AS least, n.lat, n.lon FROM packets p JOIN nodes n ON p.rx_node_id = n.node_id WHERE n.lat IS NOT NULL),
    w AS (SELECT *, CAST(1 AS DOUBLE) / (1 + hop_count) AS w FROM o WHERE hop_count <= least + 1)
    SELECT pk, count(*) AS cohort, round(sum(w * lat) / sum(w), 4) AS lat, round(sum(w * lon) / sum(w), 4) AS lon FROM w GROUP BY 1
""")
def k04_origins(spark, sf_dir):
    """The weighted centre of the observers with the fewest hops, or one more."""
    heard = small(nodes(spark, sf_dir).where("lat is not null").select(F.col("node_id").alias("rx_node_id"), "lat", "lon"))
    o = packets(spark, sf_dir).select("pk", "hop_count", "rx_node_id").join(heard, "rx_node_id")
    near = o.withColumn("least", F.min("hop_count").over(Window.partitionBy("pk"))).where("hop_count <= least + 1")
    w = F.lit(1.0) / (F.col("hop_count") + 1)
    centre = lambda c: F.round(F.sum(w * F.col(c)) / F.sum(w), 4).alias(c)
    return near.groupBy("pk").agg(F.count("*").alias("cohort"), centre("lat"), centre("lon"))


@query(f"""
    WITH c(region, clat, clon) AS (VALUES {", ".join(f"('{r}', {a}::DOUBLE, {o}::DOUBLE)" for r, a, o in CENTRES)}),
    d AS (SELECT n, region, sqrt(pow(clat - lat, 2) + pow((clon - lon) * cos(radians((lat + clat) / 2)), 2)) * 111.32 AS km FROM nodes, c WHERE lat IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY km, region) AS r FROM d)
    SELECT n, CASE WHEN km <= {SNAP_KM} THEN region END AS region, round(km, 4) AS km FROM r WHERE r = 1
""")
def k06_region_snap(spark, sf_dir):
    """The nearest fixed centre, without a join."""
    far = F.array_min(F.array(*[F.struct(flat_km(F.col("lat"), F.col("lon"), F.lit(a), F.lit(o)).alias("km"), F.lit(r).alias("region")) for r, a, o in CENTRES]))
    n = nodes(spark, sf_dir).where(has_position(F.col("lat"), F.col("lon"))).select("n", far.alias("c"))
    return n.select("n", F.when(F.col("c.km") <= SNAP_KM, F.col("c.region")).alias("region"), F.round("c.km", 4).alias("km"))


@query(f"SELECT n, CASE {' '.join(f"WHEN lat >= {s} AND lat < {t} AND lon >= {w} AND lon < {e} THEN '{b}'" for b, s, t, w, e in BOXES)} ELSE 'elsewhere' END AS box FROM nodes")
def p08_boxes(spark, sf_dir):
    box = F.lit("elsewhere")
    for name, s, t, w, e in reversed(BOXES):
        box = F.when((F.col("lat") >= s) & (F.col("lat") < t) & (F.col("lon") >= w) & (F.col("lon") < e), name).otherwise(box)
    return nodes(spark, sf_dir).select("n", box.alias("box"))


@query("""
    WITH t AS (SELECT x.network, x.hash AS src, y.hash AS dst, count(*) AS n FROM hops x JOIN hops y ON x.observation_id = y.observation_id AND y.pos = x.pos + 1 GROUP BY 1, 2, 3),
    p AS (SELECT network, src, max(n) / sum(n) AS p FROM t GROUP BY 1, 2)
    SELECT network, count(*) AS sources, round(avg(p), 4) AS confidence, round(avg(CASE WHEN p >= 0.6 THEN 1.0 ELSE 0.0 END), 4) AS sure FROM p GROUP BY 1
""")
def l04_calibration(spark, sf_dir):
    """How often the most frequent next hop is right, and for which share of sources it is at 0.6 or above."""
    top = learning.priors(learning.transitions(packets(spark, sf_dir)), ["network", "src"], ["dst"], 1)
    return top.groupBy("network").agg(F.count("*").alias("sources"), F.round(F.avg("p"), 4).alias("confidence"), F.round(F.avg((F.col("p") >= 0.6).cast("double")), 4).alias("sure"))


@query("""
    WITH w AS (SELECT src_node_id, region, time, count(*) OVER r AS n, count(DISTINCT region) OVER r AS k FROM packets WHERE src_node_id IS NOT NULL WINDOW r AS (PARTITION BY src_node_id ORDER BY time RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW))
    SELECT src_node_id, max(n) AS packets, max(k) AS regions FROM w GROUP BY 1
""")
def t09_rates(spark, sf_dir):
    """The most packets, and the most regions, of a source within any half hour."""
    half = 1_800_000_000
    w = Window.partitionBy("src_node_id", "day").orderBy("us").rangeBetween(-half, 0)
    p = in_days(packets(spark, sf_dir).where("src_node_id is not null").select("src_node_id", "region", "time"), "time", half)
    p = p.select("src_node_id", F.count("*").over(w).alias("n"), F.size(F.collect_set("region").over(w)).cast("long").alias("k"))
    return p.groupBy("src_node_id").agg(F.max("n").alias("packets"), F.max("k").alias("regions"))


@query("""
    WITH g AS (SELECT src_node_id, time, CASE WHEN time - lag(time) OVER o > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS gap FROM packets WHERE src_node_id IS NOT NULL WINDOW o AS (PARTITION BY src_node_id ORDER BY time)),
    s AS (SELECT *, sum(gap) OVER (PARTITION BY src_node_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT src_node_id, min(time) AS first, count(*) AS packets FROM s GROUP BY src_node_id, s
""")
def t10_bursts(spark, sf_dir):
    """Bursts of a source that a gap of 30 minutes ends; as a stream these are streaming.ingest.sessions."""
    g = packets(spark, sf_dir).where("src_node_id is not null").groupBy(F.session_window("time", "30 minutes"), "src_node_id").agg(F.count("*").alias("packets"))
    return g.select("src_node_id", F.col("session_window.start").cast("timestamp_ntz").alias("first"), "packets")


@query("""
    SELECT least(src_node_id, rx_node_id) AS a, greatest(src_node_id, rx_node_id) AS b, count(*) AS packets, count(*) FILTER (WHERE src_node_id < rx_node_id) AS a_to_b, min(time) AS first, max(time) AS last
    FROM packets WHERE src_node_id <> rx_node_id GROUP BY 1, 2
""")
def e02_pair_evidence(spark, sf_dir):
    p = packets(spark, sf_dir).where("src_node_id != rx_node_id")
    return p.groupBy(F.least("src_node_id", "rx_node_id").alias("a"), F.greatest("src_node_id", "rx_node_id").alias("b")).agg(
        F.count("*").alias("packets"), F.count_if(F.col("src_node_id") < F.col("rx_node_id")).alias("a_to_b"), F.min("time").alias("first"), F.max("time").alias("last")
    )


@query("""
    WITH k AS (SELECT *, coalesce(CASE WHEN pk % 19 <> 0 THEN packet_hash END, concat_ws(':', src_node_id, packet_type, date_trunc('second', time))) AS key FROM packets),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time, observation_id) AS r FROM k)
    SELECT observation_id, network FROM r WHERE r = 1
""")
def w07_content_keys(spark, sf_dir):
    """One row a packet; where the hash is missing, source, type and second stand for it."""
    made = F.concat_ws(":", "src_node_id", F.col("packet_type").cast("string"), F.date_trunc("second", "time").cast("string"))
    key = F.coalesce(F.when(F.col("pk") % 19 != 0, F.col("packet_hash")), made)
    p = packets(spark, sf_dir).select("observation_id", "network", "time", key.alias("key"))
    return first_by(p, ["key"], F.col("time"), F.col("observation_id")).select("observation_id", "network")


@query("""
    WITH q AS (SELECT DISTINCT pk, pk * 3 AS ord FROM packets), r AS (SELECT q.ord, p.*, row_number() OVER (PARTITION BY q.ord ORDER BY p.time, p.observation_id) AS r FROM q JOIN packets p ON p.pk = q.pk)
    SELECT ord, packet_hash, observation_id, CAST(r AS INTEGER) AS r FROM r WHERE r <= 3
""")
def j13_requested(spark, sf_dir):
    """Three observations of each packet of a list, here of all packets, with its place in the list."""
    p = packets(spark, sf_dir)
    r = p.join(p.select("pk").distinct().withColumn("ord", F.col("pk") * 3), "pk").withColumn("r", F.row_number().over(Window.partitionBy("ord").orderBy("time", "observation_id")))
    return r.where("r <= 3").select("ord", "packet_hash", "observation_id", "r")


@query("""
    SELECT n, CAST(to_json({'type': 'Feature', 'geometry': {'type': 'Point', 'coordinates': [lon, lat]}, 'properties': {'id': node_id, 'name': name, 'network': network}}) AS VARCHAR) AS feature FROM nodes WHERE lat IS NOT NULL
""")
def s15_geojson(spark, sf_dir):
    """A GeoJSON feature a row, to be written as lines."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    about = F.struct(F.col("node_id").alias("id"), "name", "network")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), about.alias("properties")), {"ignoreNullFields": "false"})
    return nodes(spark, sf_dir).where("lat is not null").select("n", feature.alias("feature"))


@query("""
    WITH u AS (SELECT substr(node_id, 1, 4) AS hash, min(node_id) AS node_id, min(lat) AS lat, min(lon) AS lon FROM nodes WHERE role = 2 GROUP BY 1 HAVING count(*) = 1),
    d AS (SELECT h.observation_id, count(*) AS n, bool_and(u.node_id IS NOT NULL) AS ok, count(DISTINCT u.node_id) AS k,
        string_agg(CASE WHEN u.lat IS NOT NULL THEN '<rtept lat="' || CAST(u.lat AS VARCHAR) || '" lon="' || CAST(u.lon AS VARCHAR) || '"/>' ELSE '' END, '' ORDER BY h.pos) AS points FROM hops h LEFT JOIN u ON h.hash = u.hash GROUP BY 1)
    SELECT observation_id, '<rte>' || points || '</rte>' AS route FROM d WHERE ok AND n >= 2 AND k = n
""")
def s16_routes(spark, sf_dir):
    """Exact paths as GPX routes; hops without a position have no point."""
    found = paths.exact_paths(packets(spark, sf_dir), nodes(spark, sf_dir)).select("observation_id", F.posexplode(F.split("path", ">")).alias("pos", "node_id"))
    tag = F.concat(F.lit('<rtept lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('"/>'))
    points = found.join(small(nodes(spark, sf_dir).select("node_id", F.coalesce(tag, F.lit("")).alias("point"))), "node_id")
    route = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "point"))), lambda x: x["point"]), "")
    return points.groupBy("observation_id").agg(F.concat(F.lit("<rte>"), route, F.lit("</rte>")).alias("route"))


@query("""
    SELECT 'c' || CAST(user_id AS VARCHAR) AS client, count(*) FILTER (WHERE event_type <> 'error') AS connected, count(*) FILTER (WHERE event_type = 'error') AS denied, max(ts) AS last FROM events GROUP BY 1
""", domain=False)
def s21_broker_log(spark, sf_dir):
    """Log lines parsed back to connections and refusals of each client; other lines are left out."""
    e = read(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "error", F.lit(": Client c{} refused: not authorised")).otherwise(F.lit(": New client connected from 10.0.0.1 as c{} (p2, c1)"))
    lines = e.select(F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.replace(text, F.lit("{}"), F.col("user_id").cast("string"))).alias("line"))
    part = lambda k: F.regexp_extract("line", r"^(\d+): (?:(New client connected) from \S+ as (\S+)|Client (\S+) refused)", k)
    rows = lines.select(F.timestamp_micros(part(1).try_cast("long")).alias("time"), F.concat(part(3), part(4)).alias("client"), (part(2) != "").alias("ok")).where("client != ''")
    return rows.groupBy("client").agg(F.count_if("ok").alias("connected"), F.count_if(~F.col("ok")).alias("denied"), F.max("time").cast("timestamp_ntz").alias("last"))


@query("SELECT o_orderkey, CAST(o_orderkey % 7 AS INTEGER) AS attempt, o_orderkey % 7 >= 5 AS dead, CASE WHEN o_orderkey % 7 BETWEEN 1 AND 4 THEN CAST(least(3600, 30 * pow(2, o_orderkey % 7 - 1)) AS INTEGER) END AS wait_secs FROM orders", domain=False)
def o02_retry_schedule(spark, sf_dir):
    attempt = (F.col("o_orderkey") % 7).cast("int")
    wait = F.when(attempt.between(1, 4), F.least(F.lit(3600), F.lit(30) * F.pow(F.lit(2), attempt - 1)).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", attempt.alias("attempt"), (attempt >= 5).alias("dead"), wait.alias("wait_secs"))


@query("SELECT a AS node FROM links UNION SELECT b FROM links")
def u02_link_ends(spark, sf_dir):
    return links(packets(spark, sf_dir)).select(F.explode(F.array("a", "b")).alias("node")).distinct()
