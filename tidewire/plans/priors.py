"""The tables that path learning writes, from paths whose hops name one node each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import flat_km
from ..operators import learning
from ..operators.relational import spread, within_km
from ..sources.domain import AS_OF, as_of, nodes, observations, read
from ..sources.sinks import shared_folder
from .registry import query

_NOW = f"TIMESTAMP '{AS_OF}'"
_PLACED = "lat IS NOT NULL AND lon IS NOT NULL AND (role IS NULL OR role = 2)"
#: Which hops a walk back can name follows from counts alone: a hash's nodes, less the receiver and the later hops of that hash.
_ROUTES = f"""
    known AS (SELECT substr(node_id, 1, 4) AS hash, min(node_id) AS node_id, count(*) AS c FROM nodes WHERE {_PLACED} GROUP BY 1),
    placed AS (SELECT node_id FROM nodes WHERE {_PLACED}),
    trimmed AS (SELECT observation_id, region, time, CASE WHEN src_node_id IN (SELECT node_id FROM placed) THEN src_node_id END AS src, rx_node_id AS rx,
        CASE WHEN starts_with(rx_node_id, path_hashes[-1]) THEN path_hashes[1:len(path_hashes) - 1] ELSE path_hashes END AS path
        FROM packets WHERE rx_node_id IN (SELECT node_id FROM placed) AND len(path_hashes) > 0),
    given AS (SELECT observation_id, rx, unnest(path) AS hash, unnest(range(len(path))) AS place FROM trimmed WHERE len(path) > 0),
    named AS (SELECT g.observation_id, g.place, g.hash, CASE WHEN k.c = 1 THEN k.node_id END AS node,
        row_number() OVER (PARTITION BY g.observation_id, g.hash ORDER BY g.place DESC) - 1 + CASE WHEN starts_with(rx, g.hash) THEN 1 ELSE 0 END < k.c AS free FROM given g JOIN known k ON k.hash = g.hash),
    hop AS (SELECT observation_id, hash, node, row_number() OVER (PARTITION BY observation_id ORDER BY place) - 1 AS pos, lag(hash) OVER (PARTITION BY observation_id ORDER BY place) AS before FROM named WHERE free),
    whole AS (SELECT observation_id FROM hop JOIN trimmed USING (observation_id) GROUP BY 1 HAVING bool_and(node IS NOT NULL) AND count(*) = max(len(path))),
    ways AS (SELECT observation_id, count(*) AS n FROM hop GROUP BY 1),
    stop AS (SELECT observation_id, 0 AS pos, src AS node FROM trimmed SEMI JOIN ways USING (observation_id) WHERE src IS NOT NULL UNION ALL SELECT observation_id, pos + 1, node FROM hop
        UNION ALL SELECT observation_id, n + 1, rx FROM trimmed JOIN ways USING (observation_id)),
    step AS (SELECT x.observation_id, x.pos, x.node AS src, y.node AS dst FROM stop x JOIN stop y ON x.observation_id = y.observation_id AND y.pos = x.pos + 1),
    verified AS (SELECT t.region, CAST(hour(t.time) // 6 AS INTEGER) AS quarter, t.time, s.src, s.dst FROM step s JOIN trimmed t ON t.observation_id = s.observation_id WHERE s.src IS NOT NULL AND s.dst IS NOT NULL)
"""


def _ranked(rows: str, given: str, of: str, k: int) -> str:
    return f"""
        WITH {_ROUTES}, c AS (SELECT {given}, {of}, count(*) AS n FROM ({rows}) GROUP BY ALL),
        r AS (SELECT *, round(n / sum(n) OVER (PARTITION BY {given}), 6) AS p, row_number() OVER (PARTITION BY {given} ORDER BY n DESC, {of}) AS r FROM c)
        SELECT {given}, {of}, n, p FROM r WHERE r <= {k}
    """


def _resolved(spark, sf_dir, p, ways):
    """Packets with their hops named, all of whose ways are among ``ways``; nodes closer than 30 km count as linked."""
    placed = nodes(spark, sf_dir).withColumn("elevation_m", F.when(F.col("n") % 5 != 0, (F.col("n") * 29 % 400).cast("double")))
    placed = learning.on_paths(placed, ways, sources=True).checkpoint()
    return learning.resolved(p, placed, within_km(placed, 30))


def _packets(spark, sf_dir):
    return observations(spread(read(spark, sf_dir, "events")))


def _found(spark, sf_dir):
    shared_folder(spark)
    p = _packets(spark, sf_dir)
    return _resolved(spark, sf_dir, p, p.select("src_node_id", "rx_node_id", "path_hashes").distinct().checkpoint())


def _routes(spark, sf_dir):
    """The routes of all packets, those of one way as one row."""
    p = learning.travelled(_packets(spark, sf_dir))
    return learning.routes(_resolved(spark, sf_dir, p, p))


@query()
def l01_resolved_hops(spark, sf_dir):
    """What each hop of a path is, by a walk back from the receiver over its hash's nodes."""
    return _found(spark, sf_dir).select("observation_id", F.posexplode("hops").alias("pos", "h")).select("observation_id", "pos", "h.prefix", "h.node_id", "h.unique", F.round("h.score", 6).alias("score"))


@query(_ranked("SELECT t.region, coalesce(h.before, '') AS before, h.hash AS prefix, h.node FROM hop h JOIN trimmed t ON t.observation_id = h.observation_id WHERE h.node IS NOT NULL", "region, before, prefix", "node", 3))
def l02_prefix_nodes(spark, sf_dir):
    return learning.prefix_priors(_routes(spark, sf_dir))


@query(_ranked("SELECT substr(h.node, 1, 2) AS byte, CAST(h.pos AS INTEGER) AS pos, h.node FROM hop h JOIN whole w ON w.observation_id = h.observation_id", "byte, pos", "node", 64))
def l02_position_nodes(spark, sf_dir):
    return learning.position_priors(_routes(spark, sf_dir))


@query(_ranked("SELECT t.src, t.rx, CAST(h.pos AS INTEGER) AS pos, h.node FROM hop h JOIN whole w ON w.observation_id = h.observation_id JOIN trimmed t ON t.observation_id = h.observation_id WHERE t.src IS NOT NULL", "src, rx, pos", "node", 16))
def l02_corridors(spark, sf_dir):
    return learning.corridor_priors(_routes(spark, sf_dir))


@query(_ranked("SELECT region, src, dst FROM verified", "region, src", "dst", 5))
def l02_node_transitions(spark, sf_dir):
    return learning.node_transitions(_routes(spark, sf_dir))


@query(_ranked("SELECT CAST(s.pos AS INTEGER) AS pos, s.src, s.dst FROM step s JOIN whole w ON w.observation_id = s.observation_id JOIN trimmed t ON t.observation_id = s.observation_id WHERE t.src IS NOT NULL", "pos, src", "dst", 16))
def l02_position_transitions(spark, sf_dir):
    return learning.position_transitions(_routes(spark, sf_dir))


@query(f"""
    WITH {_ROUTES}, pair AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) FILTER (WHERE src < dst) AS a_to_b, count(*) FILTER (WHERE src > dst) AS b_to_a FROM verified WHERE src <> dst GROUP BY 1, 2),
    link AS (SELECT p.*, CASE WHEN (a_to_b + b_to_a) % 3 <> 0 THEN CAST(120 + (a_to_b + b_to_a) % 45 AS DOUBLE) END AS loss, sqrt(pow(y.lat - x.lat, 2) + pow((y.lon - x.lon) * cos(radians((x.lat + y.lat) / 2)), 2)) * 111.32 AS km
        FROM pair p JOIN nodes x ON x.node_id = a JOIN nodes y ON y.node_id = b),
    ends AS (SELECT a AS src, b AS dst, a_to_b AS there, b_to_a AS back, loss, km FROM link UNION ALL SELECT b, a, b_to_a, a_to_b, loss, km FROM link),
    obs AS (SELECT region, quarter, src, dst, count(*) AS observed, max(time) AS last FROM verified GROUP BY ALL), act AS (SELECT region, quarter, src, sum(observed) AS active FROM obs GROUP BY ALL),
    deg AS (SELECT src, count(*) AS degree FROM ends GROUP BY 1),
    j AS (SELECT act.region, act.quarter, e.*, coalesce(o.observed, 0) AS observed, o.last, greatest(coalesce(o.observed, 0), greatest(1, floor(active / CAST(degree AS DOUBLE) + 0.5))) AS expected
        FROM act JOIN deg USING (src) JOIN ends e ON e.src = act.src LEFT JOIN obs o ON o.region = act.region AND o.quarter = act.quarter AND o.src = e.src AND o.dst = e.dst),
    s AS (SELECT *, expected - observed AS missing, there / CAST(there + back AS DOUBLE) AS direction, CASE WHEN last IS NULL THEN 0.05 ELSE greatest(0.05, least(1, exp(-(epoch({_NOW}) - epoch(last)) / 86400 / 21))) END AS recent,
        coalesce(greatest(0, least(1, (160 - loss) / 45)), 0.55) AS loss_score FROM j)
    , t AS (SELECT region, quarter, src, dst, observed, CAST(expected AS BIGINT) AS expected, CAST(missing AS BIGINT) AS missing, round(greatest(0.02, least(0.995,
        0.42 * observed / (expected + 2.0) + 0.22 * direction + 0.2 * recent + 0.16 * CASE WHEN loss IS NULL THEN 0.55 ELSE loss_score END - missing / expected * 0.3
        - least(0.35, CASE WHEN coalesce(km > 55 AND loss > 150, false) THEN 0.14 ELSE 0 END + CASE WHEN observed < 3 AND missing >= 3 THEN 0.1 ELSE 0 END + CASE WHEN direction < 0.06 AND observed >= 5 THEN 0.06 ELSE 0 END))), 6) AS score
    FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY region, quarter, src ORDER BY score DESC, dst) AS r FROM t)
    SELECT region, quarter, src, dst, observed, expected, missing, score FROM k WHERE r <= 8
""")
def l03_directed_edges(spark, sf_dir):
    steps = learning.verified_steps(_routes(spark, sf_dir))
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    pair = steps.where("src != dst").groupBy(a.alias("a"), b.alias("b")).agg(F.sum(F.when(F.col("src") < F.col("dst"), F.col("n")).otherwise(0)).alias("a_to_b"), F.sum(F.when(F.col("src") > F.col("dst"), F.col("n")).otherwise(0)).alias("b_to_a"))
    side = lambda s: nodes(spark, sf_dir).select(F.col("node_id").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
    n = F.col("a_to_b") + F.col("b_to_a")
    linked = pair.join(side("a"), "a").join(side("b"), "b").withColumns({"loss_db": F.when(n % 3 != 0, (n % 45 + 120).cast("double")), "km": flat_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))})
    return learning.directed_edges(steps, linked, as_of())


@query(f"""
    WITH {_ROUTES}, run AS (SELECT x.observation_id, x.node AS a, y.node AS b, z.node AS c FROM stop x JOIN stop y ON x.observation_id = y.observation_id AND y.pos = x.pos + 1 LEFT JOIN stop z ON x.observation_id = z.observation_id AND z.pos = x.pos + 2),
    m AS (SELECT observation_id, 2 AS length, a AS head, a || '>' || b AS motif FROM run WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT observation_id, 3, a || '>' || b, a || '>' || b || '>' || c FROM run WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
    c AS (SELECT t.region, CAST(hour(t.time) // 6 AS INTEGER) AS quarter, m.length, m.head, m.motif, count(*) AS n FROM m JOIN trimmed t ON t.observation_id = m.observation_id GROUP BY ALL),
    r AS (SELECT *, round(n / sum(n) OVER (PARTITION BY region, quarter, length, head), 6) AS p, row_number() OVER (PARTITION BY region, quarter, length, head ORDER BY n DESC, motif) AS r FROM c)
    SELECT region, quarter, length, motif, n, p FROM r WHERE r <= CASE length WHEN 2 THEN 6 ELSE 4 END
""")
def l02_node_motifs(spark, sf_dir):
    """The runs of two and three stops that follow most often, for each region and quarter of the day."""
    return learning.node_motifs(_routes(spark, sf_dir))
