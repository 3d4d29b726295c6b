"""Mesh-telemetry tables as arithmetic views of the star-schema test tables, in Spark and as DuckDB SQL.

The test data holds no packets, so both dialects derive them by the same rules; DUCK names the same tables as CTEs.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every query that looks back does so from here: the test events end a few minutes before.
AS_OF = "2024-01-31 00:00:00"
NODES = 60
REGIONS = ["MME", "NCL", "EDI", "LHR", "MAN"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def node_id(n: Column) -> Column:
    """64 hex digits for a number."""
    s = n.cast("string")
    return F.upper(F.concat(F.md5(F.concat(F.lit("n"), s).cast("binary")), F.md5(F.concat(F.lit("m"), s).cast("binary"))))


def packet_node(n: Column) -> Column:
    """``node_id`` of a number below NODES, looked up: packets name these nodes many times each."""
    half = lambda c, k: hashlib.md5(f"{c}{k}".encode()).hexdigest().upper()
    return F.coalesce(F.get(F.array(*[F.lit(half("n", k) + half("m", k)) for k in range(NODES)]), n.cast("int")), node_id(n))


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(read(spark, sf_dir, "events"))


def observations(e: DataFrame) -> DataFrame:
    """One row for each event, of a table or a stream; four consecutive events observe one packet."""
    i, u = F.col("event_id"), F.col("user_id")
    pk = F.floor(i / 4).cast("long")
    route = (pk % 4).cast("int")
    hops = (i % 6).cast("int")
    path = F.transform(F.sequence(F.lit(0), hops - 1), lambda k: F.substring(packet_node((pk + k * 11) % NODES), 1, 4))
    return e.select(
        i.alias("observation_id"), F.col("ts").alias("time"), pk.alias("pk"),
        F.upper(F.md5(F.concat(F.lit("p"), pk.cast("string")).cast("binary"))).alias("packet_hash"),
        F.when(i % 97 != 0, packet_node(u % 40)).alias("rx_node_id"),
        F.when(pk % 53 != 0, packet_node(pk * 7 % NODES)).alias("src_node_id"),
        F.when(pk % 11 == 0, "test").when(pk % 3 == 0, "north").otherwise("south").alias("network"),
        F.element_at(F.array(*map(F.lit, REGIONS)), (u % 5 + 1).cast("int")).alias("region"),
        F.when(F.col("event_type") == "click", 5).when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 3).otherwise(7).alias("packet_type"),
        route.alias("route_type"), hops.alias("hop_count"),
        F.round(F.lit(-120.0) + F.col("value") / 490 * 80, 2).alias("rssi"),
        F.when(i % 5 != 0, (i % 41 - 20) / 2.0).alias("snr"),
        F.when(route.isin(0, 3), F.upper(F.substring(F.md5(F.concat(F.lit("t"), (pk % 7).cast("string")).cast("binary")), 1, 8))).alias("transport_codes"),
        F.when(hops > 0, path).otherwise(F.array().cast("array<string>")).alias("path_hashes"),
        F.col("props").alias("payload"), (pk % 17 == 0).alias("is_private"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each customer; packets name the first NODES. Three nodes share a name; a lattice of 120 places is filled closer
    and closer."""
    n = F.col("c_custkey")
    block = F.floor(n / NODES).cast("long")
    shift = block * 7 % 100 / 1000.0
    return read(spark, sf_dir, "customer").select(
        n.alias("n"), node_id(n).alias("node_id"), F.concat(F.lit("Hill "), (block * 20 + n % 20).cast("string"), F.when(n % 3 == 0, " Repeater").otherwise(" Node")).alias("name"),
        F.when(n % 13 != 0, F.lit(49.5) + (n * 37 % 120) / 10.0 + shift).alias("lat"), F.when(n % 13 != 0, F.lit(-8.5) + (n * 53 % 60) / 10.0 + shift).alias("lon"),
        F.when(n % 7 == 6, None).otherwise(F.element_at(F.array(*map(F.lit, [2, 2, 1, 2, 3, 2])), (n % 7 % 6 + 1).cast("int"))).alias("role"),
        F.when(n % 11 == 0, "test").when(n % 3 == 0, "north").otherwise("south").alias("network"),
        (n * 3 % 17).alias("advert_count"), F.concat(F.lit("1."), (n % 4).cast("string")).alias("firmware"),
        (as_of() - F.make_dt_interval(days=(n % 35).cast("int"))).alias("last_seen"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tenth node, from 5, is an alias of the node before it."""
    n = F.col("c_custkey")
    return read(spark, sf_dir, "customer").where(n % 10 == 5).select(node_id(n).alias("source_id"), node_id(n - 1).alias("canonical_id"))


def status_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        packet_node(F.col("o_custkey") % NODES).alias("node_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("time"), k.alias("sample_id"),
        (F.lit(3200) + k % 1000).cast("int").alias("battery_mv"), (k * 37 % 100000).alias("uptime_secs"), F.when(k % 9 != 0, k * 11 % 5000).alias("air_secs"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    minute = (F.col("conv_id") * 7 + F.col("turn")).cast("int")
    return c.select("conv_id", "turn", F.concat("role", (F.col("conv_id") % 10).cast("string")).alias("sender"), F.when(F.col("conv_id") % 3 == 0, "north").otherwise("south").alias("network"), "text", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=minute)).alias("time"))


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that repeat with small changes, by senders who change their names a little, among tests and single ones."""
    o = read(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 23
    kind, n = c % 4, c.cast("string")
    text = F.when(kind == 0, F.concat(F.lit("Great offer of group "), n, F.lit(" for all stations, see www.deal"), n, F.lit(".com/now?x="), k.cast("string"), F.repeat(F.lit("!"), (k % 4).cast("int"))))
    text = text.when(kind == 1, F.concat(F.lit("Calling every station of round "), n, F.lit(" this evening "), F.element_at(F.array(*map(F.lit, ["on", "at", "ON"])), (k % 3 + 1).cast("int")), F.lit(" the hill")))
    text = text.when(kind == 2, F.element_at(F.array(*map(F.lit, ["test", "Test 123", "ping"])), (k % 3 + 1).cast("int"))).otherwise(F.md5(k.cast("string").cast("binary")))
    sender = F.when(kind == 0, F.concat(F.lit("Dealer"), n, F.lit("_"), (k % 3).cast("string"))).when(kind == 1, F.concat(F.lit("Op "), n)).otherwise(F.md5((k % 50).cast("string").cast("binary")))
    time = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(k * 7 + F.floor(k / 400) * 7200).cast("double"))
    return o.select(k.alias("conv_id"), (k % 2).alias("turn"), sender.alias("sender"), F.when(c % 2 == 0, "north").otherwise("south").alias("network"), text.alias("text"), time.alias("time"))


def links(packets: DataFrame, *by: str) -> DataFrame:
    """Undirected links of consecutive path hops, a < b by prefix, with counts for both directions; apart for each ``by``, of network and time."""
    hop = packets.where(F.size("path_hashes") > 1).select("network", "time", F.explode(F.arrays_zip(F.slice("path_hashes", 1, F.size("path_hashes") - 1).alias("x"), F.slice("path_hashes", 2, F.size("path_hashes") - 1).alias("y"))).alias("p"))
    x, y = F.col("p.x"), F.col("p.y")
    return hop.groupBy(*by, F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(
        F.count("*").alias("observed"), F.sum((x < y).cast("long")).alias("a_to_b"), F.sum((x > y).cast("long")).alias("b_to_a"), F.max("time").alias("last_observed")
    )


_ID = "upper(md5('n' || CAST({0} AS VARCHAR)) || md5('m' || CAST({0} AS VARCHAR)))"


def _id(n: str) -> str:
    return _ID.format(n)


DUCK = f"""
    packets AS (
        SELECT event_id AS observation_id, ts AS time, event_id // 4 AS pk, upper(md5('p' || CAST(event_id // 4 AS VARCHAR))) AS packet_hash,
            CASE WHEN event_id % 97 <> 0 THEN {_id("(user_id % 40)")} END AS rx_node_id,
            CASE WHEN (event_id // 4) % 53 <> 0 THEN {_id(f"((event_id // 4) * 7 % {NODES})")} END AS src_node_id,
            CASE WHEN (event_id // 4) % 11 = 0 THEN 'test' WHEN (event_id // 4) % 3 = 0 THEN 'north' ELSE 'south' END AS network,
            (['MME', 'NCL', 'EDI', 'LHR', 'MAN'])[user_id % 5 + 1] AS region,
            CASE event_type WHEN 'click' THEN 5 WHEN 'purchase' THEN 4 WHEN 'view' THEN 2 WHEN 'error' THEN 3 ELSE 7 END AS packet_type,
            CAST((event_id // 4) % 4 AS INTEGER) AS route_type, CAST(event_id % 6 AS INTEGER) AS hop_count, round(-120.0 + value / 490 * 80, 2) AS rssi,
            CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 41 - 20 AS DOUBLE) / 2 END AS snr,
            CASE WHEN (event_id // 4) % 4 IN (0, 3) THEN upper(substr(md5('t' || CAST((event_id // 4) % 7 AS VARCHAR)), 1, 8)) END AS transport_codes,
            list_transform(range(event_id % 6), lambda k: substr({_id(f"((event_id // 4 + k * 11) % {NODES})")}, 1, 4)) AS path_hashes,
            props AS payload, (event_id // 4) % 17 = 0 AS is_private
        FROM events
    ),
    nodes AS (
        SELECT n, {_id("n")} AS node_id, 'Hill ' || CAST(n // {NODES} * 20 + n % 20 AS VARCHAR) || CASE WHEN n % 3 = 0 THEN ' Repeater' ELSE ' Node' END AS name,
            CASE WHEN n % 13 <> 0 THEN 49.5 + CAST(n * 37 % 120 AS DOUBLE) / 10 + CAST(n // {NODES} * 7 % 100 AS DOUBLE) / 1000 END AS lat, CASE WHEN n % 13 <> 0 THEN -8.5 + CAST(n * 53 % 60 AS DOUBLE) / 10 + CAST(n // {NODES} * 7 % 100 AS DOUBLE) / 1000 END AS lon,
            CASE WHEN n % 7 = 6 THEN NULL ELSE ([2, 2, 1, 2, 3, 2])[n % 7 % 6 + 1] END AS role,
            CASE WHEN n % 11 = 0 THEN 'test' WHEN n % 3 = 0 THEN 'north' ELSE 'south' END AS network, n * 3 % 17 AS advert_count, '1.' || CAST(n % 4 AS VARCHAR) AS firmware,
            TIMESTAMP '{AS_OF}' - n % 35 * INTERVAL 1 DAY AS last_seen
        FROM (SELECT c_custkey AS n FROM customer)
    ),
    aliases AS (SELECT {_id("n")} AS source_id, {_id("(n - 1)")} AS canonical_id FROM (SELECT c_custkey AS n FROM customer) WHERE n % 10 = 5),
    status AS (
        SELECT {_id(f"(o_custkey % {NODES})")} AS node_id, CAST(o_orderdate AS TIMESTAMP) AS time, o_orderkey AS sample_id, CAST(3200 + o_orderkey % 1000 AS INTEGER) AS battery_mv,
            o_orderkey * 37 % 100000 AS uptime_secs, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey * 11 % 5000 END AS air_secs
        FROM orders
    ),
    messages AS (
        SELECT conv_id, turn, role || CAST(conv_id % 10 AS VARCHAR) AS sender, CASE WHEN conv_id % 3 = 0 THEN 'north' ELSE 'south' END AS network, text,
            TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 7 + turn) * INTERVAL 1 MINUTE AS time
        FROM conversations
    ),
    hops AS (SELECT observation_id, pk, network, time, unnest(path_hashes) AS hash, unnest(range(1, len(path_hashes) + 1)) AS pos, len(path_hashes) AS hop_len FROM packets WHERE len(path_hashes) > 0),
    links AS (
        SELECT least(x.hash, y.hash) AS a, greatest(x.hash, y.hash) AS b, count(*) AS observed, count(*) FILTER (WHERE x.hash < y.hash) AS a_to_b,
            count(*) FILTER (WHERE x.hash > y.hash) AS b_to_a, max(x.time) AS last_observed
        FROM hops x JOIN hops y ON x.observation_id = y.observation_id AND y.pos = x.pos + 1 GROUP BY 1, 2
    )
"""
