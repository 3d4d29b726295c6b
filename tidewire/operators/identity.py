"""One device behind several ids: pairs within a name's bucket are assessed, then joined under a distance rule."""

from __future__ import annotations

from math import asin, cos, radians, sin, sqrt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import haversine_km
from ..functions.text import nibbles_apart, ordinal_variants
from ..sources.sinks import shared_folder
from .graph import components

APART_KM = 3.0


def name_tokens(name):
    """Upper-case words without version marks, RPT spelled out."""
    words = F.split(F.regexp_replace(F.regexp_replace(F.upper(name), r"\bV\d+\b", " "), r"\bRPT\b", "REPEATER"), r"[^A-Z0-9]+")
    return F.filter(words, lambda w: F.length(w) > 0)


#: Words of a name that don't tell devices apart, and fixed limits of evidence.
COMMON = ("REPEATER", "NODE")
LEAST_ADVERTS, HANDOVER_DAYS, SAME_NAME, NEAR_NIBBLES = 3, 14, 0.6, 1
MOST_OF_A_NAME = 3000
#: Ids of a name with one half that are paired by it.
MOST_OF_A_HALF = 64


def assess(nodes: DataFrame, evidence: DataFrame, heard: DataFrame, test: str = "test") -> DataFrame:
    """a < b of one name's bucket with eight signals, their score, accepted and confidence.

    nodes: node_id, name, network, role, lat, lon, advert_count. evidence: node_id, statuses, self_adverts, first, last.
    heard: a, b and adverts, those of one heard by the other, either way. Signals: names alike, one network other than the
    ``test`` one, roles that fit, ids a digit apart, one place, adverts heard of one another, an id taking over from another
    within two weeks, a status. Names that differ in the last word alone are a veto on the weaker ways to be accepted. A
    name of more than MOST_OF_A_NAME devices is refused before any pair is made, rather than cut.
    """
    e = _prepared(nodes, evidence)
    largest = e.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    if largest > MOST_OF_A_NAME:
        raise ValueError(f"a name has {largest} devices; pairs are made of up to {MOST_OF_A_NAME}")
    p = _side(e, "a").join(_side(e, "b").withColumnRenamed("bucket_b", "bucket_a"), "bucket_a").where("node_id_a < node_id_b")
    return _assessed(p, e, heard, test)


_COLUMNS = ["node_id", "bucket", "words", "network", "role", "lat", "lon", "active", "bare", "statuses", "self_adverts", "first", "last"]
SIGNALS = ("names", "one_network", "roles", "near_ids", "one_place", "heard", "handover", "status")


def _side(e: DataFrame, s: str) -> DataFrame:
    return e.select(*[F.col(c).alias(f"{c}_{s}") for c in _COLUMNS])


def _prepared(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Nodes with a name, with their evidence, words, the name's bucket, and whether they are active or bare."""
    e = nodes.join(evidence, "node_id", "left").fillna(0, ["statuses", "self_adverts"]).withColumn("words", name_tokens(F.col("name")))
    own = F.filter("words", lambda w: ~w.isin(*COMMON))
    e = e.withColumn("bucket", F.array_join(F.slice(F.when(F.size(own) > 0, own).otherwise(F.col("words")), 1, 2), "|")).where("size(words) > 0")
    e = e.withColumn("active", F.coalesce((F.col("role") == 2) & F.col("lat").isNotNull() & (F.col("advert_count") > 0), F.lit(False)))
    return e.withColumn("bare", F.col("role").isNull() & F.col("lat").isNull() & (F.coalesce("advert_count", F.lit(0)) == 0))


def _assessed(p: DataFrame, e: DataFrame, heard: DataFrame, test: str) -> DataFrame:
    """The signals of pairs of one bucket, sides _a and _b, and whether they are accepted."""
    alone = e.where("active").groupBy(F.col("bucket").alias("bucket_a")).agg(F.count("*").alias("actives"))
    p = p.join(alone, "bucket_a", "left")
    p = p.join(heard.select(F.col("a").alias("node_id_a"), F.col("b").alias("node_id_b"), "adverts"), ["node_id_a", "node_id_b"], "left").fillna(0, ["adverts", "actives"])
    c = F.col
    never = lambda x: F.coalesce(x, F.lit(False))
    apart = F.when(c("first_a") > c("last_b"), F.timestamp_diff("SECOND", c("last_b"), c("first_a"))).when(c("first_b") > c("last_a"), F.timestamp_diff("SECOND", c("last_a"), c("first_b")))
    like = lambda s: c(f"role_{s}").isNull() | (c(f"role_{s}") == 2)
    p = p.withColumns({
        "names": F.size(F.array_intersect("words_a", "words_b")) / F.size(F.array_union("words_a", "words_b")).cast("double") >= SAME_NAME,
        "one_network": never((c("network_a") == c("network_b")) & (c("network_a") != test)), "roles": like("a") & like("b"),
        "near_ids": nibbles_apart(c("node_id_a"), c("node_id_b")) <= NEAR_NIBBLES, "one_place": never(haversine_km(c("lat_a"), c("lon_a"), c("lat_b"), c("lon_b")) <= APART_KM),
        "heard": c("adverts") >= LEAST_ADVERTS, "status": (c("statuses_a") > 0) | (c("statuses_b") > 0),
        "handover": never((c("self_adverts_a") >= LEAST_ADVERTS) & (c("self_adverts_b") >= LEAST_ADVERTS) & (apart <= HANDOVER_DAYS * 86400)),
    })
    score = sum((c(s).cast("int") for s in SIGNALS), F.lit(0))
    same, some, bare = c("one_network") & c("roles") & c("names"), c("active_a") | c("active_b"), c("bare_a") | c("bare_b")
    no_veto = ~ordinal_variants(c("words_a"), c("words_b"))
    high = same & ((c("near_ids") & c("one_place")) | (c("heard") & no_veto & bare & c("status") & some) | (c("handover") & no_veto & c("status") & some))
    medium = same & no_veto & bare & some & c("status") & (c("actives") == 1)
    confidence = F.when(high, "high").when(medium, "medium").otherwise("low")
    return p.select(c("node_id_a").alias("a"), c("node_id_b").alias("b"), *SIGNALS, score.alias("score"), (high | medium).alias("accepted"), confidence.alias("confidence"))


def accepted_pairs(nodes: DataFrame, evidence: DataFrame, heard: DataFrame, test: str = "test") -> DataFrame:
    """The accepted pairs of ``assess``, of names however common: pairs meet by what can make them accepted.

    Ids a digit apart share one of their halves; where many share a half, they meet by masks of a digit. Those heard of one another are given; a takeover meets in cells of HANDOVER_DAYS of a name and
    network; a bare id meets the one active node of its name. Only pairs that meet are assessed, so a name's devices aren't all
    paired.
    """
    shared_folder(nodes.sparkSession)
    e = _prepared(nodes, evidence).checkpoint()  # read many times below
    id = F.upper("node_id")
    halves = F.explode(F.array(F.concat(F.lit("<"), F.substring(id, 1, 32)), F.concat(F.lit(">"), F.substring(id, 33, 32)))).alias("key")
    placed = e.where("lat is not null").select("node_id", "bucket", halves).withColumn("n", F.count("*").over(Window.partitionBy("bucket", "key")))
    few = placed.where(F.col("n").between(2, MOST_OF_A_HALF)).select("node_id", "bucket", "key")
    mask = F.transform(F.sequence(F.lit(1), F.length(id)), lambda i: F.concat(F.substr(id, F.lit(1), i - 1), F.lit("_"), F.substr(id, i + 1)))
    many = placed.where(F.col("n") > MOST_OF_A_HALF).select("node_id", "bucket").distinct().select("node_id", "bucket", F.explode(mask).alias("key"))
    keyed = few.union(many)
    meet = keyed.withColumnRenamed("node_id", "x").join(keyed.withColumnRenamed("node_id", "y"), ["bucket", "key"]).where("x < y").select("x", "y")
    meet = meet.union(heard.where(F.col("adverts") >= LEAST_ADVERTS).select("a", "b"))
    cell = lambda t: F.floor(F.unix_micros(F.col(t).cast("timestamp")) / (HANDOVER_DAYS * 86_400_000_000))
    sent = e.where(F.col("self_adverts") >= LEAST_ADVERTS)
    begins = sent.select("bucket", "network", F.col("node_id").alias("x"), F.col("first").alias("from"), cell("first").alias("cell"))
    ends = sent.select("bucket", "network", F.col("node_id").alias("y"), F.col("last").alias("to"), F.explode(F.array(cell("last"), cell("last") + 1)).alias("cell"))
    near = begins.join(ends, ["bucket", "network", "cell"]).where((F.col("from") > F.col("to")) & (F.timestamp_diff("SECOND", "to", "from") <= HANDOVER_DAYS * 86400))
    meet = meet.union(near.select("x", "y"))
    only = e.where("active").groupBy("bucket").agg(F.min("node_id").alias("y"), F.count("*").alias("n")).where("n = 1")
    meet = meet.union(e.where("bare").select("bucket", F.col("node_id").alias("x")).join(only, "bucket").select("x", "y"))
    ids = meet.where("x != y").select(F.least("x", "y").alias("node_id_a"), F.greatest("x", "y").alias("node_id_b")).distinct()
    p = ids.join(_side(e, "a"), "node_id_a").join(_side(e, "b"), "node_id_b").where("bucket_a = bucket_b")
    return _assessed(p, e, heard, test).where("accepted")


def _join(pdf: pd.DataFrame) -> pd.DataFrame:
    """The union of a component's pairs, surest first, without one that would put places more than APART_KM apart together."""

    def km(p, q):
        a = sin(radians(q[0] - p[0]) / 2) ** 2 + cos(radians(p[0])) * cos(radians(q[0])) * sin(radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371.0 * asin(min(1.0, sqrt(a)))

    place: dict[str, list] = {}
    for r in pdf.itertuples():
        for i, lat, lon in ((r.a, r.lat_a, r.lon_a), (r.b, r.lat_b, r.lon_b)):
            place[i] = [] if pd.isna(lat) or pd.isna(lon) else [(lat, lon)]
    root = {i: i for i in place}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = pdf.assign(high=pdf.confidence == "high").sort_values(["high", "score", "a", "b"], ascending=[False, False, True, True])
    for r in order.itertuples():
        x, y = find(r.a), find(r.b)
        if x != y and all(km(p, q) <= APART_KM for p in place[x] for q in place[y]):
            root[y] = x
            place[x] = list(dict.fromkeys(place[x] + place.pop(y)))
    members: dict[str, list] = {}
    for i in root:
        members.setdefault(find(i), []).append(i)
    rows = [(i, min(m), len(m)) for m in members.values() if len(m) > 1 for i in m]
    return pd.DataFrame(rows, columns=["node_id", "identity", "members"])


def groups(accepted: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, identity (the least id of its group) and members, of the nodes that accepted pairs join.

    Pairs join surest first, and none that would bring places more than APART_KM apart together. A task holds one component of the
    accepted pairs, which is what could be one device, not a name.
    """
    shared_folder(accepted.sparkSession)
    accepted = accepted.select("a", "b", "score", "confidence").checkpoint()
    at = lambda s: nodes.select(F.col("node_id").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
    of = components(accepted).withColumnRenamed("node", "a")
    placed = accepted.join(of, "a").join(at("a"), "a").join(at("b"), "b")
    return placed.groupBy("component").applyInPandas(_join, "node_id string, identity string, members long")


def choose_canonical(members: DataFrame, group: str = "identity") -> DataFrame:
    """The node that stands for each group: an active repeater with a position first, then most adverts, then the latest
    sign, then the least id."""
    active = F.coalesce((F.col("role") == 2) & F.col("lat").isNotNull() & (F.col("advert_count") > 0), F.lit(False))
    order = F.struct((~active).alias("x"), (-F.coalesce("advert_count", F.lit(0))).alias("n"), (-F.coalesce(F.unix_micros(F.col("last_seen").cast("timestamp")), F.lit(0))).alias("t"), "node_id")
    return members.groupBy(group).agg(F.min_by("node_id", order).alias("canonical_id"), F.count("*").alias("members"))
