"""Single functions and rules as queries of their own: text, places, JSON, scopes, guards and small operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import places, text
from ..operators.identity import name_tokens
from ..operators.relational import distances, nearest, weighted_quantile, within_km
from ..sources import wire
from ..sources.domain import AS_OF, aliases, as_of, messages, nodes, packets, read, status_samples
from ..sources.sinks import shared_folder
from .registry import query

_NOW = f"TIMESTAMP '{AS_OF}'"


@query("SELECT split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 9) AS ninth, count(*) AS parts FROM part GROUP BY 1, 2", domain=False)
def n01_split_part(spark, sf_dir):
    part = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    return read(spark, sf_dir, "part").groupBy(part(1).alias("first"), part(9).alias("ninth")).agg(F.count("*").alias("parts"))


@query("SELECT ('0x' || substr(md5(packet_hash), 1, 8))::BIGINT % 100 < 70 AS learn, count(*) AS observations, count(DISTINCT packet_hash) AS packets FROM packets GROUP BY 1")
def n02_sample(spark, sf_dir):
    """70 percent of the packets to learn from, the same in every run."""
    return packets(spark, sf_dir).groupBy(text.sampled(F.col("packet_hash"), 70).alias("learn")).agg(F.count("*").alias("observations"), F.count_distinct("packet_hash").alias("packets"))


_FNV = "list_reduce([CAST(2166136261 AS BIGINT)] || list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"SELECT node_id, {_FNV.format('node_id')} AS hash FROM nodes")
def n03_fnv(spark, sf_dir):
    return nodes(spark, sf_dir).select("node_id", text.fnv1a(F.col("node_id")).alias("hash"))


@query("SELECT x.n, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN substr(x.node_id, i, 1) <> substr(y.node_id, i, 1) THEN 1 ELSE 0 END)) AS INTEGER) AS apart FROM nodes x JOIN nodes y ON y.n = x.n + 1")
def n04_nibbles(spark, sf_dir):
    nxt = nodes(spark, sf_dir).select((F.col("n") - 1).alias("n"), F.col("node_id").alias("next"))
    return nodes(spark, sf_dir).join(nxt, "n").select("n", text.nibbles_apart(F.col("node_id"), F.col("next")).alias("apart"))


@query("""
    WITH w AS (SELECT n, string_split(upper(name), ' ') AS words FROM nodes)
    SELECT x.n, y.n AS other FROM w x JOIN w y ON x.n < y.n AND len(x.words) = len(y.words) AND x.words[1:len(x.words) - 1] = y.words[1:len(y.words) - 1] AND x.words[-1] <> y.words[-1]
""")
def n05_name_variants(spark, sf_dir):
    """Names that differ in the last word alone: an equi-join on the words before it."""
    w = nodes(spark, sf_dir).select("n", name_tokens(F.col("name")).alias("words")).withColumn("stem", F.array_join(F.slice("words", 1, F.size("words") - 1), " "))
    other = w.select("stem", F.col("n").alias("other"), F.col("words").alias("words_b"))
    return w.join(other, "stem").where((F.col("n") < F.col("other")) & text.ordinal_variants(F.col("words"), F.col("words_b"))).select("n", "other")


@query("""
    SELECT conv_id, turn, substr(sender, 1, 2) || '…' AS sender, CASE WHEN length(t) > 160 THEN rtrim(substr(t, 1, 159)) || '…' WHEN t = '' THEN '[message]' ELSE t END AS sample
    FROM (SELECT conv_id, turn, sender, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b(?:https?://)?(?:www\\.)?[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+(?:/\\S*)?', '[link]', 'g'), '@\\S+', '[mention]', 'g'), '(?i)\\b[0-9a-f]{8,}\\b', '[id]', 'g')) AS t
        FROM (SELECT conv_id, turn, sender, regexp_replace(text, '[^!-~]+', ' ', 'g') AS text FROM messages))
""")
def n06_public_samples(spark, sf_dir):
    """Messages fit to be shown: links, mentions and ids out, names as hints; of their printable characters, as SQL has no NFKC."""
    plain = F.regexp_replace("text", r"[^!-~]+", " ")
    return messages(spark, sf_dir).select("conv_id", "turn", text.name_hint(F.col("sender")).alias("sender"), text.public_sample(plain).alias("sample"))


@query("""
    SELECT network, round(min(lat) - 20 / CAST(111 AS DOUBLE), 9) AS south, round(max(lat) + 20 / CAST(111 AS DOUBLE), 9) AS north,
        round(min(lon) - 20 / (111 * cos((min(lat) + max(lat)) / 2 * pi() / 180)), 9) AS west, round(max(lon) + 20 / (111 * cos((min(lat) + max(lat)) / 2 * pi() / 180)), 9) AS east
    FROM nodes GROUP BY 1
""")
def n07_bounds(spark, sf_dir):
    box = nodes(spark, sf_dir).groupBy("network").agg(*places.bounds("lat", "lon", 20.0))
    return box.select("network", *[F.round(c, 9).alias(c) for c in ("south", "north", "west", "east")])


@query(f"""
    SELECT n, round(floor(lat / 0.1 + 0.5) * 0.1, 6) AS coarse_lat, round(lat + km / 111 * cos(turn), 6) AS lat, round(lon + km / (111 * greatest(0.01, cos(lat * pi() / 180))) * sin(turn), 6) AS lon
    FROM (SELECT *, sqrt({_FNV.format("node_id || ':distance'")} / CAST(4294967295 AS DOUBLE)) * 1.609344 AS km, {_FNV.format("node_id || ':bearing'")} / CAST(4294967295 AS DOUBLE) * 2 * pi() AS turn FROM nodes)
""")
def n08_masked(spark, sf_dir):
    """Positions for the public: to a tenth of a degree, and moved within a mile, by each node's id alone."""
    lat, lon = places.masked(F.col("lat"), F.col("lon"), F.col("node_id"))
    return nodes(spark, sf_dir).select("n", F.round(places.coarse(F.col("lat")), 6).alias("coarse_lat"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("""
    SELECT n, CAST(k AS INTEGER) AS k, round(lon + 500 / (111320 * cos(lat * pi() / 180)) * sin(k * (2 * pi() / 12)), 9) AS x, round(lat + CAST(500 AS DOUBLE) / 111320 * cos(k * (2 * pi() / 12)), 9) AS y
    FROM (SELECT *, unnest(range(13)) AS k FROM nodes WHERE lat IS NOT NULL)
""")
def n09_circles(spark, sf_dir):
    ring = places.circle(F.col("lat"), F.col("lon"), 500.0, 12)
    return nodes(spark, sf_dir).where("lat is not null").select("n", F.posexplode(ring).alias("k", "p")).select("n", "k", F.round(F.col("p")[0], 9).alias("x"), F.round(F.col("p")[1], 9).alias("y"))


@query("SELECT CASE WHEN snr IS NULL THEN 'unknown' WHEN snr >= 8 THEN 'strong' WHEN snr >= 2 THEN 'medium' WHEN snr >= 0 THEN 'weak' ELSE 'poor' END AS band, count(*) AS packets FROM packets GROUP BY 1")
def n10_snr_bands(spark, sf_dir):
    return packets(spark, sf_dir).groupBy(places.snr_band(F.col("snr")).alias("band")).agg(F.count("*").alias("packets"))


@query("""
    WITH h AS (SELECT x.n, y.n AS other, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) AS km,
        CASE WHEN x.n % 4 <> 0 THEN CAST(x.n * 5 AS DOUBLE) END AS ea, CAST(y.n * 3 - 20 AS DOUBLE) AS eb, CASE WHEN x.n % 3 <> 0 THEN CAST(120 + y.n AS DOUBLE) END AS loss
        FROM nodes x JOIN nodes y ON x.lat IS NOT NULL AND y.lat IS NOT NULL AND x.network = y.network AND x.n < y.n),
    m AS (SELECT *, CASE WHEN ea IS NOT NULL THEN sqrt(2 * 6371000 / 0.75 / 1000 * greatest(0, ea + 15) / 1000) + sqrt(2 * 6371000 / 0.75 / 1000 * greatest(0, eb + 15) / 1000) - km END AS margin FROM h)
    SELECT n, other, km <= 150 AND NOT coalesce(loss > 165, false) AND NOT coalesce(margin < -25, false) AS possible, round(CASE WHEN ea IS NOT NULL THEN margin END, 6) AS margin_km,
        round(CASE WHEN ea IS NULL THEN 0 ELSE greatest(-1, least(1, margin / 25)) END, 6) AS soft FROM m WHERE km <= 200
""")
def n11_hop_gate(spark, sf_dir):
    """Which hops of up to 200 km between nodes of a network physics allows."""
    p, km = within_km(nodes(spark, sf_dir), 200, "n", "network").withColumnsRenamed({"a": "n_a", "b": "n_b"}), F.col("km")
    high = F.when(F.col("n_a") % 4 != 0, (F.col("n_a") * 5).cast("double")), (F.col("n_b") * 3 - 20).cast("double")
    gate = places.hop_gate(km, *high, F.when(F.col("n_a") % 3 != 0, (F.col("n_b") + 120).cast("double")))
    return p.select(F.col("n_a").alias("n"), F.col("n_b").alias("other"), gate.alias("g")).select("n", "other", "g.possible", F.round("g.margin_km", 6).alias("margin_km"), F.round("g.soft", 6).alias("soft"))


@query("SELECT network, CAST(hour(time) // 6 AS INTEGER) AS quarter, count(*) AS packets FROM packets GROUP BY 1, 2")
def n12_day_quarters(spark, sf_dir):
    return packets(spark, sf_dir).groupBy("network", F.floor(F.hour("time") / 6).cast("int").alias("quarter")).agg(F.count("*").alias("packets"))


@query("""
    WITH w AS (SELECT min(time) AS lo, max(time) AS hi FROM packets), s AS (SELECT unnest(range(0, CAST(ceil((epoch_us(hi) - epoch_us(lo)) / 14400000000) AS BIGINT))) AS k, lo, hi FROM w)
    SELECT lo + k * INTERVAL 4 HOUR AS start, least(hi, lo + (k + 1) * INTERVAL 4 HOUR) AS stop FROM s
""")
def n13_windows(spark, sf_dir):
    """A range of time in windows of four hours, the last one cut short."""
    w = packets(spark, sf_dir).agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    s = w.select("hi", F.explode(F.filter(F.expr("sequence(lo, hi, INTERVAL 4 HOURS)"), lambda t: t < F.col("hi"))).alias("start"))
    return s.select("start", F.least("hi", F.col("start") + F.expr("INTERVAL 4 HOURS")).alias("stop"))


@query("""
    WITH u AS (SELECT list(hash) AS known FROM (SELECT substr(node_id, 1, 4) AS hash FROM nodes WHERE role = 2 GROUP BY 1 HAVING count(*) = 1))
    SELECT observation_id, array_to_string(list_filter(path_hashes, lambda h: list_contains(u.known, h)), '>') AS known FROM packets, u WHERE len(path_hashes) > 0
""")
def n14_known_hops(spark, sf_dir):
    """Paths with their known hops alone, in order: the hops meet the known prefixes and gather again by position."""
    known = nodes(spark, sf_dir).where("role = 2").groupBy(F.substring("node_id", 1, 4).alias("hash")).count().where("count = 1").select("hash", F.lit(True).alias("known"))
    p = packets(spark, sf_dir).where("size(path_hashes) > 0")
    paths = p.select("path_hashes").distinct()  # far fewer than packets
    h = paths.select("path_hashes", F.posexplode("path_hashes").alias("pos", "hash")).join(known, "hash", "left")
    kept = h.groupBy("path_hashes").agg(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("pos", "hash")))).alias("h"))
    return p.join(kept, "path_hashes").select("observation_id", F.array_join(F.transform("h", lambda x: x["hash"]), ">").alias("known"))


_MIXED = "CASE event_id % 4 WHEN 0 THEN '{\"v\":\"7\"}' WHEN 1 THEN '{\"v\":null}' WHEN 2 THEN '{}' ELSE '{\"v\":' || CAST(event_id % 9 AS VARCHAR) || '}' END"


@query(f"SELECT event_id, CASE WHEN json_type(j, '$.v') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(j, '$.v') AS DOUBLE) END AS v, json_exists(j, '$.v') AS has FROM (SELECT event_id, {_MIXED} AS j FROM events)", domain=False)
def n15_typed_fields(spark, sf_dir):
    """A field's value if it is a number, not a text of digits; and whether the key is there, be it null."""
    i = F.col("event_id")
    j = F.when(i % 4 == 0, '{"v":"7"}').when(i % 4 == 1, '{"v":null}').when(i % 4 == 2, "{}").otherwise(F.concat(F.lit('{"v":'), (i % 9).cast("string"), F.lit("}")))
    v = F.try_parse_json("j")
    number = F.schema_of_variant(F.try_variant_get(v, "$.v", "variant")).isin("BIGINT", "DOUBLE") | F.schema_of_variant(F.try_variant_get(v, "$.v", "variant")).startswith("DECIMAL")
    e = read(spark, sf_dir, "events").select("event_id", j.alias("j"))
    return e.select("event_id", F.when(number, F.try_variant_get(v, "$.v", "double")).alias("v"), F.array_contains(F.json_object_keys("j"), "v").alias("has"))


@query("SELECT observation_id, CAST(k AS INTEGER) AS k, hash FROM (SELECT observation_id, unnest(path_hashes) AS hash, unnest(range(len(path_hashes))) AS k FROM packets WHERE len(path_hashes) > 0)")
def n16_array_elements(spark, sf_dir):
    """A JSON array's elements as rows."""
    j = packets(spark, sf_dir).select("observation_id", F.to_json("path_hashes").alias("j"))
    return j.select("observation_id", F.posexplode(F.from_json("j", "array<string>")).alias("k", "hash"))


@query("SELECT node_id, reading, value FROM (SELECT node_id, unnest(['battery', 'uptime']) AS reading, unnest([CAST(battery_mv AS BIGINT), uptime_secs]) AS value FROM status)")
def n17_recordset(spark, sf_dir):
    """A JSON array of records as rows and columns."""
    rows = F.array(*[F.struct(F.lit(name).alias("reading"), F.col(c).cast("long").alias("value")) for name, c in (("battery", "battery_mv"), ("uptime", "uptime_secs"))])
    j = status_samples(spark, sf_dir).select("node_id", F.to_json(rows).alias("j"))
    return j.select("node_id", F.inline(F.from_json("j", "array<struct<reading:string,value:bigint>>")))


@query("SELECT event_id, '{\"k\":' || CAST(json_extract_string(props, '$.k') AS VARCHAR) || ',\"status\":\"closed\"}' AS props FROM events", domain=False)
def n18_json_set(spark, sf_dir):
    """A field set in a JSON record."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.to_json(F.struct(F.from_json("props", "k bigint").getField("k").alias("k"), F.lit("closed").alias("status"))).alias("props"))


@query("SELECT n.n, count(*) AS ids, min(a.id) AS first FROM nodes n JOIN (SELECT canonical_id AS id, canonical_id FROM aliases UNION SELECT source_id, canonical_id FROM aliases) a ON a.canonical_id = n.node_id GROUP BY 1")
def p04_alias_sets(spark, sf_dir):
    """A canonical node's id with the ids of all its aliases."""
    a = aliases(spark, sf_dir)
    ids = a.select(F.col("canonical_id").alias("node_id"), F.explode(F.array("canonical_id", "source_id")).alias("id")).distinct()
    return nodes(spark, sf_dir).join(ids, "node_id").groupBy("n").agg(F.count("*").alias("ids"), F.min("id").alias("first"))


@query(f"""
    SELECT n, CASE WHEN last_seen >= {_NOW} - INTERVAL 1 DAY THEN 'online' WHEN last_seen >= {_NOW} - INTERVAL 14 DAY THEN 'recent' ELSE 'stale' END AS presence,
        network <> 'test' AND lat IS NOT NULL AND coalesce(role, 2) = 2 AS shown FROM nodes
""")
def p14_presence(spark, sf_dir):
    """What a map shows of a node: the age of its last sign, and whether it is in the public scope."""
    seen = lambda d: F.col("last_seen") >= as_of() - F.expr(f"INTERVAL {d} DAYS")
    shown = (F.col("network") != "test") & F.col("lat").isNotNull() & (F.coalesce("role", F.lit(2)) == 2)
    return nodes(spark, sf_dir).select("n", F.when(seen(1), "online").when(seen(14), "recent").otherwise("stale").alias("presence"), shown.alias("shown"))


@query("SELECT src_node_id, max(time) AS last FROM packets WHERE src_node_id IS NOT NULL GROUP BY 1 HAVING max(time) = max(time) FILTER (WHERE network = 'test')")
def a13_latest_is_test(spark, sf_dir):
    """Nodes whose latest packet was in the test network."""
    g = packets(spark, sf_dir).where("src_node_id is not null").groupBy("src_node_id")
    return g.agg(F.max("time").alias("last"), F.max(F.when(F.col("network") == "test", F.col("time"))).alias("test")).where("last = test").select("src_node_id", "last")


@query("SELECT region, list_sort(list(rssi))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95 FROM packets GROUP BY 1")
def a23_floor_percentile(spark, sf_dir):
    """The value at place floor(0.95 n) of the sorted ones: from counts of distinct values, so no list of all is kept."""
    v = packets(spark, sf_dir).groupBy("region", "rssi").agg(F.count("*").alias("c"))
    w = Window.partitionBy("region")
    v = v.withColumns({"upto": F.sum("c").over(w.orderBy("rssi")), "n": F.sum("c").over(w)})
    return v.where("upto > floor(n * 0.95)").groupBy("region").agg(F.min("rssi").alias("p95"))


@query("SELECT row_number() OVER (ORDER BY observed DESC, a, b) AS place, a, b FROM (SELECT * FROM links ORDER BY observed DESC, a, b LIMIT 100)")
def w06_numbered(spark, sf_dir):
    """The place of each row in the order of a page: numbered after the limit, so one task has the page alone."""
    from ..sources.domain import links

    top = links(packets(spark, sf_dir)).orderBy(F.desc("observed"), "a", "b").limit(100)
    return top.select(F.row_number().over(Window.orderBy(F.desc("observed"), "a", "b")).cast("long").alias("place"), "a", "b")


@query("SELECT observation_id FROM packets p WHERE NOT EXISTS (SELECT 1 FROM packets q WHERE q.observation_id % 3 = 0 AND q.pk = p.pk AND q.rx_node_id IS NOT DISTINCT FROM p.rx_node_id AND q.snr IS NOT DISTINCT FROM p.snr)")
def j08_null_safe_anti(spark, sf_dir):
    """Rows not stored yet, nulls being equal: what a repeated insert adds."""
    p = packets(spark, sf_dir).select("observation_id", "pk", "rx_node_id", "snr")
    s = p.where("observation_id % 3 = 0").select(F.col("pk").alias("k"), F.col("rx_node_id").alias("rx"), F.col("snr").alias("s"))
    return p.join(s, (F.col("pk") == F.col("k")) & F.col("rx_node_id").eqNullSafe(F.col("rx")) & F.col("snr").eqNullSafe(F.col("s")), "left_anti").select("observation_id")


@query("""
    SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN battery_mv WHEN sample_id % 3 = 1 THEN battery_mv END AS battery_mv, CASE WHEN sample_id % 3 < 2 THEN CAST(uptime_secs AS DOUBLE) END AS uptime_secs, sample_id % 3 = 2 AS raw_only
    FROM status WHERE sample_id % 5 <> 4
""")
def s07_status_fields(spark, sf_dir):
    """Telemetry under other names of its fields, uptime from milliseconds where there are no seconds; a sample without any of
    them is kept for its raw statistics alone, one without statistics is none."""
    s = status_samples(spark, sf_dir)
    i, battery, uptime = F.col("sample_id"), F.col("battery_mv").cast("string"), F.col("uptime_secs").cast("string")
    millis = (F.col("uptime_secs") * 1000 + 999).cast("string")  # a number, not digits put after digits: 0999 is no JSON
    stats = F.when(i % 3 == 0, F.concat(F.lit('{"battery_mv":'), battery, F.lit(',"uptime_secs":'), uptime, F.lit("}")))
    stats = stats.when(i % 3 == 1, F.concat(F.lit('{"batteryMv":"'), battery, F.lit('","uptime_ms":'), millis, F.lit("}"))).otherwise(F.lit('{"mqtt":{"queue":1}}'))
    j = s.select("sample_id", F.when(i % 5 != 4, stats).alias("stats"))
    return wire.status_fields(j).select("sample_id", F.col("battery_mv").cast("int").alias("battery_mv"), "uptime_secs", "raw_only")


@query("SELECT observation_id, CAST(len(path_hashes) AS INTEGER) AS neighbours FROM packets WHERE observation_id % 3 <> 2")
def s08_neighbours(spark, sf_dir):
    """Neighbour lists under either of their names."""
    i, j = F.col("observation_id"), F.to_json("path_hashes")
    body = F.when(i % 3 == 0, F.concat(F.lit('{"nodes":'), j, F.lit("}"))).when(i % 3 == 1, F.concat(F.lit('{"neighbours":'), j, F.lit("}"))).otherwise('{"nodes":"none"}')
    found = wire.neighbour_list(packets(spark, sf_dir).select("observation_id", body.alias("body")), "body")
    return found.where("neighbours is not null").select("observation_id", F.size("neighbours").alias("neighbours"))


@query("""
    SELECT packet_type, CASE packet_type WHEN 4 THEN 'advert' WHEN 5 THEN 'channel message' WHEN 2 THEN 'direct message' WHEN 3 THEN 'acknowledgement' ELSE 'type ' || CAST(packet_type AS VARCHAR) END || ' over ' || CAST(hop_count AS VARCHAR) || ' hops' AS summary, count(*) AS packets
    FROM packets GROUP BY 1, 2
""")
def s06_summaries(spark, sf_dir):
    """A line for each kind of payload."""
    p = packets(spark, sf_dir)
    return p.groupBy("packet_type", F.concat(wire.payload_name(F.col("packet_type")), F.lit(" over "), F.col("hop_count").cast("string"), F.lit(" hops")).alias("summary")).agg(F.count("*").alias("packets"))


@query("""
    WITH p AS (SELECT n, CAST(to_json({'node_id': node_id, 'name': name, 'network': network}) AS VARCHAR) AS row FROM nodes ORDER BY n LIMIT 40), s AS (SELECT *, sum(length(row) + 1) OVER (ORDER BY n) AS bytes FROM p)
    SELECT n, row, bytes::BIGINT AS bytes FROM s WHERE bytes <= 4000
""")
def s13_map_page(spark, sf_dir):
    """A page bounded in rows and in bytes: the running sum is over the page's rows alone, never over the table."""
    row = F.to_json(F.struct("node_id", "name", "network"))
    page = nodes(spark, sf_dir).select("n", row.alias("row")).orderBy("n").limit(40)
    return page.withColumn("bytes", F.sum(F.octet_length("row") + 1).over(Window.orderBy("n"))).where("bytes <= 4000")


@query("SELECT k, generation, v FROM (SELECT o_custkey AS k, o_orderkey % 7 AS generation, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7 DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1", domain=False)
def s19_fence(spark, sf_dir):
    """Of all writes to a snapshot the one of the newest generation stays, then the latest: an older writer can't undo it."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 7).alias("generation"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("v"))
    return o.groupBy("k").agg(F.max(F.struct("generation", "t", "v")).alias("s")).select("k", "s.generation", "s.v")


@query("""
    WITH old AS (SELECT DISTINCT o_custkey AS k, 'old' AS origin FROM orders WHERE o_orderkey % 2 = 0), new AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0)
    SELECT n.k, coalesce(o.origin, 'new') AS origin FROM new n LEFT JOIN old o ON o.k = n.k
""", domain=False)
def o03_insert_or_return(spark, sf_dir):
    """For each key of a batch the stored row, or else the one now inserted."""
    o = read(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.lit("old").alias("origin")).distinct()
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k")).distinct()
    return new.join(old, "k", "left").select("k", F.coalesce("origin", F.lit("new")).alias("origin"))


@query("""
    SELECT k, CASE WHEN creating AND jobs >= 8 THEN 'jobs' WHEN handles >= 30 THEN 'handles' WHEN own >= 4 THEN 'own handles' END AS refused
    FROM (SELECT o_custkey AS k, count(*) AS jobs, count(*) FILTER (WHERE o_orderstatus = 'O') AS own, sum(o_orderkey % 4) AS handles, o_custkey % 2 = 0 AS creating FROM orders GROUP BY o_custkey)
""", domain=False)
def o06_admission(spark, sf_dir):
    """Why a request is refused: the first capacity that its counts exceed."""
    c = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "O").alias("own"), F.sum(F.col("o_orderkey") % 4).alias("handles"))
    return c.select("k", F.when((F.col("k") % 2 == 0) & (F.col("jobs") >= 8), "jobs").when(F.col("handles") >= 30, "handles").when(F.col("own") >= 4, "own handles").alias("refused"))


@query("SELECT src_node_id, CASE WHEN network IN ('north', 'south') THEN 'main' ELSE network END AS network, min(time) AS first, max(time) AS last FROM packets WHERE src_node_id IS NOT NULL GROUP BY 1, 2")
def o07_one_network(spark, sf_dir):
    """Sightings of two networks that become one keep the whole span of both."""
    name = F.when(F.col("network").isin("north", "south"), "main").otherwise(F.col("network"))
    return packets(spark, sf_dir).where("src_node_id is not null").groupBy("src_node_id", name.alias("network")).agg(F.min("time").alias("first"), F.max("time").alias("last"))


@query("SELECT sha256(packet_hash || '|' || coalesce(rx_node_id, '') || '|' || CAST(epoch_us(time) AS VARCHAR)) AS id, observation_id FROM packets")
def o10_stable_ids(spark, sf_dir):
    """Ids from a row's natural key: a second run gives each row its first one."""
    key = F.concat_ws("|", "packet_hash", F.coalesce("rx_node_id", F.lit("")), F.unix_micros(F.col("time").cast("timestamp")).cast("string"))
    return packets(spark, sf_dir).select(F.sha2(key, 256).alias("id"), "observation_id")


@query("SELECT observation_id, CASE WHEN size > 1 AND size * hops > 64 THEN NULL ELSE hops END AS hops FROM (SELECT observation_id, observation_id % 3 + 1 AS size, observation_id % 63 AS hops FROM packets)")
def o14_impossible_paths(spark, sf_dir):
    """The hops of a path unless it can't fit: more than 64 bytes of hashes."""
    i = F.col("observation_id")
    return packets(spark, sf_dir).select("observation_id", F.when(~((i % 3 + 1 > 1) & ((i % 3 + 1) * (i % 63) > 64)), i % 63).alias("hops"))


@query("SELECT observation_id, NOT (packet_type = 4 AND observation_id % 2 = 0 AND observation_id % 5 <> 0) AS taken, rx_node_id IS NOT DISTINCT FROM src_node_id OR observation_id % 4 = 0 AS own FROM packets")
def o15_guards(spark, sf_dir):
    """A sent advert counts only if it could be decoded; a status only if it names no other device than its topic's."""
    i = F.col("observation_id")
    claimed = F.when(i % 4 != 0, F.coalesce(F.col("src_node_id"), F.lit("nobody")))
    direction = F.when(i % 2 == 0, "tx").otherwise("rx")
    kept = wire.advert_is_verified(direction, F.col("packet_type"), i % 5 == 0)
    return packets(spark, sf_dir).select("observation_id", kept.alias("taken"), (wire.status_is_own(F.col("rx_node_id"), claimed) | (F.col("rx_node_id").isNull() & F.col("src_node_id").isNull())).alias("own"))


@query("SELECT observation_id, CASE WHEN observation_id % 3 = 0 THEN packet_hash WHEN observation_id % 3 = 1 THEN upper(substr(md5(CAST(pk AS VARCHAR)), 1, 16)) ELSE upper(substr(sha256(CAST(observation_id AS VARCHAR)), 1, 32)) END AS hash FROM packets")
def o16_hash_order(spark, sf_dir):
    """A packet's own hash, else one given with it of 16 to 128 hex digits, else one of the row."""
    i = F.col("observation_id")
    own = F.when(i % 3 == 0, F.col("packet_hash"))
    given = F.when(i % 3 == 1, F.substring(F.md5(F.col("pk").cast("string").cast("binary")), 1, 16)).otherwise("not a hash")
    row = F.upper(F.substring(F.sha2(i.cast("string"), 256), 1, 32))
    return packets(spark, sf_dir).select("observation_id", F.coalesce(own, F.when(given.rlike("^[0-9A-Fa-f]{16,128}$"), F.upper(given)), row).alias("hash"))


@query("SELECT a, b, observed, false AS forced FROM links WHERE NOT (observed % 10 = 0) UNION ALL SELECT a, b, 0, true FROM links WHERE observed % 10 = 0")
def o17_rebuilt_links(spark, sf_dir):
    """Links computed anew; those forced by hand stay as they were."""
    from ..sources.domain import links

    l = links(packets(spark, sf_dir))
    forced = l.where("observed % 10 = 0").select("a", "b", F.lit(0).cast("long").alias("observed"), F.lit(True).alias("forced"))
    fresh = l.select("a", "b", "observed", F.lit(False).alias("forced")).join(forced.select("a", "b"), ["a", "b"], "left_anti")
    return fresh.unionByName(forced)


@query("""
    WITH d AS (SELECT x.n, min(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))))) AS km
        FROM nodes x JOIN nodes y ON y.role = 2 AND x.n <> y.n AND x.lat IS NOT NULL AND y.lat IS NOT NULL GROUP BY 1)
    SELECT n, round(least(14, greatest(0, km - 12) * 0.6), 6) AS penalty_db FROM d
""")
def f08_support_penalty(spark, sf_dir):
    """Decibels for the distance to the nearest other repeater beyond 12 km, 14 at most."""
    n = nodes(spark, sf_dir).select(F.col("n").cast("string").alias("node_id"), "lat", "lon", "role")
    near = nearest(n.drop("role"), n.where("role = 2").drop("role"), 2, None).where("node_id != peer").groupBy("node_id").agg(F.min("km").alias("km"))
    return near.select(F.col("node_id").cast("long").alias("n"), F.round(F.least(F.lit(14.0), F.greatest(F.lit(0.0), F.col("km") - 12) * 0.6), 6).alias("penalty_db"))


@query("""
    WITH h AS (SELECT p_partkey AS id, unnest(range(25)) AS k, unnest(list_transform(range(25), lambda i: CAST(50 + (p_partkey * 7 + i * i * 13) % 97 AS DOUBLE))) AS h FROM part)
    SELECT id, CAST(k AS INTEGER) AS k, min(h) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS ground FROM h
""", domain=False)
def f09_ground(spark, sf_dir):
    """Terrain from a surface profile: the least of the nine heights around each, inside the row."""
    from ..operators import rf

    p = rf.synthetic_profiles(read(spark, sf_dir, "part"))
    low = rf.sliding_minimum(F.col("heights_m"), 4)
    return p.select("id", F.posexplode(low).alias("k", "ground"))


@query("""
    SELECT band, count(*) AS links, round(min(km), 6) AS least, round(quantile_disc(km, 0.5), 6) AS median, round(max(km), 6) AS most FROM (
        SELECT CASE WHEN km < 50 THEN 'near' WHEN km < 120 THEN 'far' ELSE 'very far' END AS band, km FROM (
            SELECT 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) AS km
            FROM nodes x JOIN nodes y ON x.n < y.n AND x.network = y.network WHERE x.lat IS NOT NULL AND y.lat IS NOT NULL) WHERE km <= 200
    ) GROUP BY 1
""")
def f13_distance_report(spark, sf_dir):
    """A check of results: counts and percentiles by band, of pairs up to 200 km apart."""
    band = F.when(F.col("km") < 50, "near").when(F.col("km") < 120, "far").otherwise("very far")
    shared_folder(spark)
    d = distances(nodes(spark, sf_dir), 200, "network").select(band.alias("band"), "km", "n").checkpoint()
    r = d.groupBy("band").agg(F.sum("n").alias("links"), F.round(F.min("km"), 6).alias("least"), F.round(F.max("km"), 6).alias("most"))
    return r.join(weighted_quantile(d, ["band"], "km", "n", 0.5), "band").select("band", "links", "least", F.round("km", 6).alias("median"), "most")


@query("""
    WITH m AS (SELECT conv_id, turn, lower(regexp_replace(text, '[^ -~]', '', 'g')) AS a, lower(regexp_replace(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '[^ -~]', '', 'g')) AS b FROM messages),
    g AS (SELECT *, list_distinct(list_transform(range(1, length(a) + 2), lambda i: substr('  ' || a || ' ', i, 3))) AS ga, list_distinct(list_transform(range(1, length(b) + 2), lambda i: substr('  ' || b || ' ', i, 3))) AS gb,
        list_distinct(string_split(a, ' ')) AS wa, list_distinct(string_split(b, ' ')) AS wb, 1 - levenshtein(a, b) / CAST(greatest(1, length(a), length(b)) AS DOUBLE) AS edits FROM m WHERE b IS NOT NULL)
    SELECT conv_id, turn, round(CASE WHEN a = b THEN 1 WHEN length(a) = 0 OR length(b) = 0 THEN 0 WHEN greatest(length(a), length(b)) < 12 THEN edits
        ELSE greatest(edits, 2.0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)), len(list_intersect(wa, wb)) / CAST(len(wa) + len(wb) - len(list_intersect(wa, wb)) AS DOUBLE)) END, 6) AS similarity FROM g
""")
def n19_message_similarity(spark, sf_dir):
    """How alike a message and the next one are: by edits, trigrams and words."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[^ -~]", ""))
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    # few bytes and much work: dealt out by count, or few tasks would compare them all
    m = messages(spark, sf_dir).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), "conv_id")
    m = m.select("conv_id", "turn", plain(F.col("text")).alias("a"), plain(nxt).alias("b")).where("b is not null")
    none = F.array().cast("array<string>")
    return m.select("conv_id", "turn", F.round(text.message_similarity(F.col("a"), F.col("b"), none, none), 6).alias("similarity"))
