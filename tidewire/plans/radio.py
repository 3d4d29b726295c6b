"""Radio planning, learned links, labels and scopes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import free_space_db, radio_horizon_km
from ..operators import paths, rf
from ..operators.relational import nearest
from ..sources.domain import AS_OF, aliases, as_of, nodes, packets, read, status_samples
from ..sources.sinks import archive
from .registry import query

_NOW = f"TIMESTAMP '{AS_OF}'"
_PROFILE = "SELECT p_partkey AS id, i AS pos, 50.0::DOUBLE + (p_partkey * 7 + i * i * 13) % 97 AS h FROM part, unnest(range(25)) AS t(i)"


def _points(spark, sf_dir):
    return rf.synthetic_profiles(read(spark, sf_dir, "part")).select("id", F.posexplode("heights_m").alias("pos", "h"))


@query("""
    WITH s AS (SELECT node_id, battery_mv AS v, sum(uptime_secs) AS w FROM status GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY node_id ORDER BY v) AS cum, sum(w) OVER (PARTITION BY node_id) AS total FROM s)
    SELECT node_id, min(v) FILTER (WHERE cum * 20 >= total * 7) AS low, min(v) FILTER (WHERE cum * 20 >= total * 13) AS middle, min(v) FILTER (WHERE cum * 10 >= total * 9) AS high FROM c GROUP BY 1
""")
def f07_thresholds(spark, sf_dir):
    """Weighted quantiles .35, .65 and .9 from one pass, in whole numbers."""
    s = status_samples(spark, sf_dir).groupBy("node_id", F.col("battery_mv").alias("v")).agg(F.sum("uptime_secs").alias("w"))
    w = Window.partitionBy("node_id")
    c = s.withColumns({"cum": F.sum("w").over(w.orderBy("v")), "total": F.sum("w").over(w)})
    at = lambda share, parts, name: F.min(F.when(F.col("cum") * parts >= F.col("total") * share, F.col("v"))).alias(name)
    return c.groupBy("node_id").agg(at(7, 20, "low"), at(13, 20, "middle"), at(9, 10, "high"))


_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))))"


@query(f"""
    WITH k AS (SELECT x.n AS site, y.n AS peer, {_KM} AS km FROM nodes x JOIN nodes y ON x.n <> y.n), l AS (SELECT *, 20 * log10(4 * pi() * km * 1000 / (299792458.0 / 868e6)) AS loss FROM k WHERE km <= 200 AND km > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(loss, 6), peer) AS r FROM l)
    SELECT site, peer, round(km, 4) AS km, round(loss, 4) AS loss_db FROM r WHERE r <= 5
""")
def f10_site_links(spark, sf_dir):
    """The five peers of least free-space loss within 200 km of each site."""
    n, loss = nodes(spark, sf_dir).select("n", "lat", "lon"), lambda km: F.round(free_space_db(km), 6)
    l = nearest(n, n, 5, 200, "n", loss, apart=True)
    return l.select(F.col("n").alias("site"), "peer", F.round("km", 4).alias("km"), F.round(free_space_db(F.col("km")), 4).alias("loss_db"))


@query("SELECT p_partkey AS id, round((sqrt(5.0) + sqrt(1.5 + p_size)) * sqrt(2 * 6371.0 * 1000 * 4 / 3) / 1000, 4) AS km FROM part", domain=False)
def f12_horizons(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(radio_horizon_km(F.lit(5.0), F.col("p_size") + 1.5), 4).alias("km"))


@query()
def f04_coverage(spark, sf_dir):
    """Reach of a 20 m mast along each ray over made-up ground."""
    ground = F.transform(F.sequence(F.lit(0), F.lit(72 * 60 - 1)), lambda i: ((F.col("s_suppkey") * 31 + i * 7) % 40).cast("double"))
    return rf.coverage(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("site_id"), F.lit(20.0).alias("mast_m"), ground.alias("heights")))


@query(f"WITH p AS ({_PROFILE}), m AS (SELECT *, max(h) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p) SELECT id, count(*) FILTER (WHERE h < before) AS shadowed, CAST(min(pos) FILTER (WHERE h < before) AS INTEGER) AS first FROM m GROUP BY 1", domain=False)
def w10_shadows(spark, sf_dir):
    """Points lower than one before them."""
    before = F.max("h").over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    low = F.col("h") < F.col("before")
    return _points(spark, sf_dir).withColumn("before", before).groupBy("id").agg(F.count_if(low).alias("shadowed"), F.min(F.when(low, F.col("pos"))).alias("first"))


@query(f"WITH p AS ({_PROFILE}) SELECT id, CAST(pos AS INTEGER) AS pos, round(quantile_cont(h, 0.75) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING), 4) AS p75 FROM p", domain=False)
def w11_growing_quantile(spark, sf_dir):
    """The 75th percentile of each prefix of a profile, which has 25 points."""
    grow = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return _points(spark, sf_dir).select("id", "pos", F.round(F.percentile("h", 0.75).over(grow), 4).alias("p75"))


@query("""
    WITH c AS (SELECT rx_node_id, region, count(*) AS n, min(time) AS first FROM packets WHERE rx_node_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY rx_node_id ORDER BY n DESC, first, region) AS r FROM c)
    SELECT rx_node_id, region, n FROM r WHERE r = 1
""")
def a19_best_label(spark, sf_dir):
    """The most frequent region of an observer; of equals, the one seen first."""
    c = packets(spark, sf_dir).where("rx_node_id is not null").groupBy("rx_node_id", "region").agg(F.count("*").alias("n"), F.min("time").alias("first"))
    best = F.min_by(F.struct("region", "n"), F.struct(-F.col("n"), "first", "region")).alias("b")
    return c.groupBy("rx_node_id").agg(best).select("rx_node_id", "b.region", "b.n")


@query("""
    SELECT coalesce(network, 'all') AS network, coalesce(region, 'all') AS region, count(*) AS packets, count(snr) AS with_snr, CAST(grouping(network, region) AS INTEGER) AS level FROM packets GROUP BY GROUPING SETS ((network, region), (network), (region), ())
""")
def a21_strata(spark, sf_dir):
    return spark.sql(
        """
        SELECT coalesce(network, 'all') AS network, coalesce(region, 'all') AS region, count(*) AS packets, count(snr) AS with_snr, CAST(grouping_id(network, region) AS INT) AS level
        FROM {p} GROUP BY GROUPING SETS ((network, region), (network), (region), ())
        """,
        p=packets(spark, sf_dir).select("network", "region", "snr"),
    )


@query("SELECT NOT EXISTS (FROM aliases EXCEPT ALL FROM aliases) AS same, EXISTS (SELECT 1 FROM aliases) AS changed")
def u05_alias_maps(spark, sf_dir):
    """Whether two alias maps hold the same rows: the map against itself, and against itself without its first row."""
    a = aliases(spark, sf_dir)
    less = a.where(F.col("source_id") != a.agg(F.min("source_id")).first()[0])
    apart = lambda x, y: x.exceptAll(y).union(y.exceptAll(x)).agg((F.count("*") > 0).alias("changed"))
    return apart(a, a).select((~F.col("changed")).alias("same")).join(F.broadcast(apart(a, less)))


@query("SELECT CASE WHEN n % 35 <= 28 THEN n END AS n, CASE WHEN n % 35 > 28 THEN CAST(to_json({'n': n, 'network': network}) AS VARCHAR) END AS record FROM nodes")
def s24_archive(spark, sf_dir):
    kept, gone = archive(nodes(spark, sf_dir).select("n", "network"), F.col("n") % 35 > 28)
    return kept.select("n", F.lit(None).cast("string").alias("record")).union(gone.select(F.lit(None).cast("long"), "record"))


@query("""
    WITH u AS (SELECT substr(node_id, 1, 4) AS hash, min(node_id) AS node_id FROM nodes WHERE role = 2 GROUP BY 1 HAVING count(*) = 1),
    d AS (SELECT h.observation_id FROM hops h LEFT JOIN u ON h.hash = u.hash GROUP BY 1 HAVING bool_and(u.node_id IS NOT NULL) AND count(*) >= 2 AND count(DISTINCT u.node_id) = count(*)),
    e AS (SELECT x.node_id AS src, y.node_id AS dst FROM d JOIN hops p USING (observation_id) JOIN hops q ON q.observation_id = p.observation_id AND q.pos = p.pos + 1 JOIN u x ON x.hash = p.hash JOIN u y ON y.hash = q.hash)
    SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS observed, count(*) FILTER (WHERE src < dst) AS a_to_b FROM e GROUP BY 1, 2
""")
def r01_resolved_links(spark, sf_dir):
    """Direction counters of the links of exact paths."""
    ids = F.split("path", ">")
    pairs = F.explode(F.arrays_zip(F.slice(ids, 1, F.size(ids) - 1).alias("src"), F.slice(ids, 2, F.size(ids) - 1).alias("dst"))).alias("e")
    e = paths.exact_paths(packets(spark, sf_dir), nodes(spark, sf_dir)).select(pairs).select("e.*")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("observed"), F.count_if(F.col("src") < F.col("dst")).alias("a_to_b"))


@query(f"SELECT n, network = 'north' AS own FROM nodes WHERE network = 'north' OR node_id IN (SELECT src_node_id FROM packets WHERE network = 'north' AND time >= {_NOW} - INTERVAL 7 DAY)")
def p02_node_scope(spark, sf_dir):
    """Nodes of a network, or heard on it within the week."""
    seen = packets(spark, sf_dir).where((F.col("network") == "north") & (F.col("time") >= as_of() - F.expr("INTERVAL 7 DAYS"))).select(F.col("src_node_id").alias("node_id")).distinct()
    n = nodes(spark, sf_dir).join(seen.withColumn("heard", F.lit(True)), "node_id", "left")
    return n.where((F.col("network") == "north") | F.col("heard")).select("n", (F.col("network") == "north").alias("own"))
