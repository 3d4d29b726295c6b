"""Priors learned from paths: positions, transitions, motifs, edge scores, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp
from ..sources.sinks import shared_folder

#: Weights of a confirmed link and of distance, kilometres of the source's pull, of distance's decay and of ambiguity.
LINKED, CLOSE, PULL_KM, DECAY_KM, AMBIGUITY_KM = 2.5, 1.3, 100.0, 22.0, 45.0
#: The most frequent choices that each table keeps of a group.
PREFIX_K, POSITION_K, CORRIDOR_K, TRANSITION_K, POSITION_TRANSITION_K, EDGE_K, MOTIF2_K, MOTIF3_K = 3, 64, 16, 5, 16, 8, 6, 4


def hops(packets: DataFrame) -> DataFrame:
    """One row for each hop, positions from 1."""
    return packets.select("observation_id", "network", F.posexplode("path_hashes").alias("pos", "hash")).withColumn("pos", F.col("pos") + 1)


def motifs(packets: DataFrame, length: int) -> DataFrame:
    """Counts of runs of ``length`` hops, sliced from the path: no self-join."""
    n = F.size("path_hashes") - length + 1
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("path_hashes", i, length), ">"))
    found = packets.where(n >= 1).select("network", F.explode(runs).alias("motif"))
    return found.groupBy("network", "motif").agg(F.count("*").alias("n"))


def transitions(packets: DataFrame) -> DataFrame:
    """network, src and dst of each two hops in a row."""
    n = F.size("path_hashes") - 1
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("path_hashes", i).alias("src"), F.get("path_hashes", i + 1).alias("dst")))
    return packets.where(n >= 1).select("network", F.explode(pairs).alias("p")).select("network", "p.*")


def priors(rows: DataFrame, given: list[str], of: list[str], k: int | Column) -> DataFrame:
    """For each ``given`` the k most frequent ``of`` with their count n and share p of all; ties by value. A row counts n times, if it says so."""
    counted = rows.groupBy(*given, *of).agg((F.sum("n") if "n" in rows.columns else F.count("*")).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*given))
    rank = F.row_number().over(Window.partitionBy(*given).orderBy(F.desc("n"), *of))
    return counted.withColumns({"p": F.round(F.col("n") / total, 6), "_r": rank}).where(F.col("_r") <= k).drop("_r")


def edge_scores(links: DataFrame, now: Column) -> DataFrame:
    """Reliability, balance of directions and recency (half-life scale of 21 days) of each link."""
    days = F.timestamp_diff("MICROSECOND", F.col("last_observed"), now) / 86400e6
    reliable = F.col("observed") / (F.col("observed") + 2.0)
    balance = 1 - F.abs(F.col("a_to_b") - F.col("b_to_a")) / F.col("observed").cast("double")
    return links.select("a", "b", F.round(0.42 * reliable + 0.22 * balance + 0.20 * clamp(F.exp(-days / 21), 0.05, 1.0), 6).alias("score"))


def calibration(scored: DataFrame, confidence: str = "confidence", right: str = "right") -> DataFrame:
    """Scale, bias and threshold that bring the mean confidence to the share of right answers."""
    both = scored.agg(F.avg(F.col(right).cast("double")).alias("top1"), F.avg(confidence).alias("mean"))
    scale = clamp(F.col("top1") / F.nullif(F.col("mean"), F.lit(0.0)), 0.55, 1.7)
    both = both.withColumn("scale", F.coalesce(scale, F.lit(1.0)))
    return both.withColumns({"bias": clamp(F.col("top1") - F.col("mean") * F.col("scale"), -0.2, 0.2), "threshold": clamp(0.35 + 0.2 * (1 - F.col("top1")), 0.3, 0.88)})


def content_hash(df: DataFrame) -> DataFrame:
    """A digest of the rows, whatever their order: equal tables give equal digests, at any number of partitions."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    return df.agg(F.count("*").alias("n"), *parts).select(F.sha2(F.concat_ws(",", "n", *[f"s{k}" for k in range(4)]), 256).alias("digest"))


def _flat_km(lat: np.ndarray, lon: np.ndarray, lat0: float, lon0: float) -> np.ndarray:
    return np.hypot((lat - lat0) * 111, (lon - lon0) * 111 * np.cos(np.radians((lat + lat0) / 2)))


def backward(path: list[str], rx: tuple, src: tuple | None, candidates: dict[str, list[tuple]], linked: set[tuple[str, str]]) -> list[tuple]:
    """prefix, node_id, unique and score of the hops that a walk back from the receiver can name.

    Nodes are (node_id, lat, lon, elevation_m). At each hop the best of its hash's nodes not on the way yet follows: by a confirmed
    link with the hop before, closeness and height, progress to the source, less a penalty where others of that hash are
    as near; of equals the least id. A hop without a node left is passed over.
    """
    out, used, here = [], {rx[0]}, rx
    for prefix in reversed(path):
        every = candidates.get(prefix) or []
        free = np.array([n[0] not in used for n in every], bool)
        if not free.any():
            continue
        lat, lon, high = (np.array([n[k] or 0.0 for n in every], float) for k in (1, 2, 3))
        km = _flat_km(lat, lon, here[1], here[2])
        close = 0.65 * np.exp(-km / DECAY_KM) + 0.35 * np.clip((np.minimum(high, here[3] or 0.0) + 60) / 320, 0, 1)
        near = np.where(km <= AMBIGUITY_KM, np.clip(1 - km / AMBIGUITY_KM, 0, 1), 0)
        alike = np.clip(1 - np.abs(km[None, :] - km[:, None]) / AMBIGUITY_KM, 0, 1)
        doubt = np.clip(((alike * near[None, :]).sum(axis=1) - near) * 0.12, 0, 0.24)
        score = CLOSE * close - doubt + LINKED * np.array([(min(n[0], here[0]), max(n[0], here[0])) in linked for n in every])
        if src is not None:
            score = score + (_flat_km(np.array(here[1]), np.array(here[2]), src[1], src[2]) - _flat_km(lat, lon, src[1], src[2])) / PULL_KM
        best = max(np.flatnonzero(free).tolist(), key=lambda i: (score[i], [-ord(c) for c in every[i][0]]))
        out.append((prefix, every[best][0], len(every) == 1, float(score[best])))
        used.add(every[best][0])
        here = every[best]
    return out[::-1]


def travelled(packets: DataFrame) -> DataFrame:
    """One row for all packets of one way in one region and quarter of the day: their number n and the time of the last.

    Packets share ways, so what is learned from counts alone needs no row for each of them.
    """
    shared_folder(packets.sparkSession)
    p = packets.where(F.col("rx_node_id").isNotNull() & (F.size("path_hashes") > 0))
    return p.groupBy("region", _quarter().alias("quarter"), "src_node_id", "rx_node_id", "path_hashes").agg(F.count("*").alias("n"), F.max("time").alias("time")).checkpoint()


def _of(df: DataFrame) -> list[str]:
    """What is kept of a packet, or of all ``travelled`` a way."""
    return [c for c in ("observation_id", "region", "quarter", "time", "n") if c in df.columns]


def resolved(packets: DataFrame, nodes: DataFrame, links: DataFrame, size: int = 4) -> DataFrame:
    """observation_id, region, time, src, rx, path and hops of packets whose receiver has a known place: what each hop is.
    Of ``travelled`` packets quarter and n instead of an id.

    nodes: node_id, lat, lon, elevation_m and role; repeaters and nodes without a role count. links: confirmed a and b. The
    receiver's own last hop is left out. Packets share paths: each distinct path, source and receiver is walked once. Candidates
    and links come by equi-joins on hashes; a task holds one path's candidates and the links among them.
    """
    shared_folder(packets.sparkSession)
    known = nodes.where("lat is not null and lon is not null and (role is null or role = 2)").select("node_id", "lat", "lon", F.coalesce(F.col("elevation_m").cast("double"), F.lit(0.0)).alias("elevation_m"))
    place = F.struct("node_id", "lat", "lon", "elevation_m")
    by_hash = known.groupBy(F.substring("node_id", 1, size).alias("hash")).agg(F.sort_array(F.collect_list(place)).alias("nodes"))
    p = packets.where(F.col("rx_node_id").isNotNull() & (F.size("path_hashes") > 0))
    own = F.col("rx_node_id").startswith(F.get("path_hashes", F.size("path_hashes") - 1))
    path = F.when(own, F.slice("path_hashes", 1, F.size("path_hashes") - 1)).otherwise(F.col("path_hashes"))
    p = p.select(*_of(packets), F.col("src_node_id").alias("src"), F.col("rx_node_id").alias("rx"), path.alias("path")).where("size(path) > 0")
    rx = known.select(F.col("node_id").alias("rx"), place.alias("rx_at"))
    ways = p.select("path", "src", "rx").distinct().checkpoint()  # read three times, made once
    ways = ways.join(rx, "rx").join(known.select(F.col("node_id").alias("src"), place.alias("src_at")), "src", "left")
    hop = ways.select("path").distinct().select("path", F.explode(F.array_distinct("path")).alias("hash")).join(by_hash, "hash")
    trellis = hop.groupBy("path").agg(F.collect_list(F.struct("hash", "nodes")).alias("candidates"))
    stops = F.array_distinct(F.concat("path", F.array(F.substring("rx", 1, size))))
    pair = ways.select("path", "rx").distinct().select("path", "rx", F.explode(stops).alias("h1"), stops.alias("stops")).select("path", "rx", "h1", F.explode("stops").alias("h2")).where("h1 <= h2")
    side = [F.substring(c, 1, size) for c in ("a", "b")]
    of = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().groupBy(F.least(*side).alias("h1"), F.greatest(*side).alias("h2")).agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    linked = pair.join(of, ["h1", "h2"]).groupBy("path", "rx").agg(F.flatten(F.collect_list("pairs")).alias("linked"))
    ways = ways.join(trellis, "path", "left").join(linked, ["path", "rx"], "left")
    # few bytes and much work: dealt out by count, or few tasks would walk them all
    spark = packets.sparkSession
    ways = ways.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), "path", "rx", "src")

    flat = F.flatten(F.transform("candidates", lambda c: F.transform(c["nodes"], lambda n: F.struct(c["hash"].alias("hash"), n["node_id"].alias("node_id"), n["lat"].alias("lat"), n["lon"].alias("lon"), n["elevation_m"].alias("elevation_m")))))
    ways = ways.select("path", "src", "rx", "rx_at", "src_at", flat.alias("node"), "linked")
    # flat lists of texts and numbers: lists of structs would come as an object each
    lists = {"hash": "node.hash", "id": "node.node_id", "lat": "node.lat", "lon": "node.lon", "high": "node.elevation_m", "a": "linked.a", "b": "linked.b"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node = lambda d: (d["node_id"], d["lat"], d["lon"], d["elevation_m"])
        for frame in frames:
            out = []
            for path, src, rx, rx_at, src_at, *rest in zip(*(frame[c] for c in ("path", "src", "rx", "rx_at", "src_at", *lists))):
                hash, id, lat, lon, high, a, b = (x.tolist() if x is not None else [] for x in rest)
                of: dict[str, list[tuple]] = {}
                for h, *place in zip(hash, id, lat, lon, high):
                    of.setdefault(h, []).append(tuple(place))
                out.append((list(path), src, rx, src_at is not None, backward(list(path), node(rx_at), None if src_at is None else node(src_at), of, set(zip(a, b)))))
            yield pd.DataFrame(out, columns=["way", "from", "to", "placed", "hops"])

    walked = ways.select("path", "src", "rx", "rx_at", "src_at", *[F.col(c).alias(k) for k, c in lists.items()]).mapInPandas(run, "way array<string>, from string, to string, placed boolean, hops array<struct<prefix:string,node_id:string,unique:boolean,score:double>>")
    both = p.join(walked, (p.path == walked["way"]) & (p.rx == walked["to"]) & p.src.eqNullSafe(walked["from"]))
    source = F.when(F.col("placed"), F.col("src"))  # a source without a place is none
    return both.select(*_of(p), source.alias("src"), "rx", "path", "hops").where("size(hops) > 0")


def on_paths(nodes: DataFrame, packets: DataFrame, sizes: tuple[int, ...] = (4,), sources: bool = False) -> DataFrame:
    """The nodes that a path can lead over: those whose id, cut to one of ``sizes``, is a hash of a path, and the receivers; with ``sources`` these too."""
    ends = F.array("rx_node_id", *(["src_node_id"] if sources else []))
    keys = packets.select(F.explode("path_hashes").alias("_key")).select(F.upper(F.trim("_key")).alias("_key")).union(packets.select(F.explode(ends))).distinct()
    cut = F.explode(F.array(*[F.substring("node_id", 1, k) for k in sizes], F.col("node_id")))
    return nodes.join(nodes.select("node_id", cut.alias("_key")).join(keys, "_key", "left_semi").select("node_id"), "node_id", "left_semi")


def routes(found: DataFrame) -> DataFrame:
    """Of resolved packets observation_id, region, quarter, time, n, src, rx, path and ids of the hops that were named, and whether that is all.

    ids is null where a hop's hash fits several nodes, so that only what is sure is learned from.
    """
    ids = F.transform("hops", lambda h: F.when(h["unique"], h["node_id"]))
    whole = (F.size("hops") == F.size("path")) & F.forall("hops", lambda h: h["unique"])
    if "n" not in found.columns:
        found = found.withColumns({"quarter": _quarter(), "n": F.lit(1)})
    return found.select(*_of(found), "src", "rx", F.transform("hops", lambda h: h["prefix"]).alias("path"), ids.alias("ids"), whole.alias("whole"))


def _whole() -> Column:
    return F.col("whole")


def _steps(stops: Column) -> Column:
    """pos, src and dst of each two stops in a row."""
    return F.transform(F.sequence(F.lit(0), F.size(stops) - 2), lambda i: F.struct(i.alias("pos"), F.get(stops, i).alias("src"), F.get(stops, i + 1).alias("dst")))


def _stops() -> Column:
    return F.concat(F.when(F.col("src").isNotNull(), F.array("src")).otherwise(F.array().cast("array<string>")), F.col("ids"), F.array("rx"))


def _quarter() -> Column:
    return F.floor(F.hour("time") / 6).cast("int")


def verified_steps(found: DataFrame) -> DataFrame:
    """region, quarter, src and dst of each step between two known stops: source, hops and receiver; taken n times, at ``time`` for the last."""
    steps = found.select("region", "quarter", "time", "n", F.explode(_steps(_stops())).alias("s"))
    return steps.select("region", "quarter", "time", "n", "s.src", "s.dst").where("src is not null and dst is not null")


def node_motifs(found: DataFrame) -> DataFrame:
    """The most frequent runs of two and of three known stops, of each region and quarter: of a first stop and of a first pair."""
    def runs(length: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size("stops") - length + 1), lambda i: F.slice("stops", i, length))
        return F.when(F.size("stops") >= length, made).otherwise(F.array().cast("array<array<string>>"))

    # both lengths from one pass, as paths are costly to make
    rows = found.select("region", "quarter", "n", _stops().alias("stops")).select("region", "quarter", "n", F.explode(F.concat(runs(2), runs(3))).alias("run"))
    rows = rows.where(~F.exists("run", lambda x: x.isNull())).withColumn("length", F.size("run"))
    rows = rows.select("region", "quarter", "n", "length", F.array_join(F.slice("run", 1, F.col("length") - 1), ">").alias("head"), F.array_join("run", ">").alias("motif"))
    k = F.when(F.col("length") == 2, MOTIF2_K).otherwise(MOTIF3_K)
    return priors(rows, ["region", "quarter", "length", "head"], ["motif"], k).select("region", "quarter", "length", "motif", "n", "p")


def prefix_priors(found: DataFrame, k: int = PREFIX_K) -> DataFrame:
    """Which node a hop's hash means after the hop before it, from hops that name one node."""
    before = lambda i: F.when(i > 0, F.get("path", i - 1)).otherwise("")
    hop = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.struct(F.get("path", i).alias("prefix"), before(i).alias("before"), F.get("ids", i).alias("node")))
    rows = found.select("region", "n", F.explode(hop).alias("h")).select("region", "n", "h.*").where("node is not null")
    return priors(rows, ["region", "before", "prefix"], ["node"], k)


def position_priors(found: DataFrame, k: int = POSITION_K) -> DataFrame:
    """Which node stands at a place of a path for a first byte, from paths known in whole."""
    rows = found.where(_whole()).select("n", F.posexplode("ids").alias("pos", "node")).withColumn("byte", F.substring("node", 1, 2))
    return priors(rows, ["byte", "pos"], ["node"], k)


def corridor_priors(found: DataFrame, k: int = CORRIDOR_K) -> DataFrame:
    """Which node stands at a place between a source and a receiver, from paths known in whole."""
    return priors(found.where(_whole() & F.col("src").isNotNull()).select("src", "rx", "n", F.posexplode("ids").alias("pos", "node")), ["src", "rx", "pos"], ["node"], k)


def node_transitions(found: DataFrame, k: int = TRANSITION_K) -> DataFrame:
    return priors(verified_steps(found), ["region", "src"], ["dst"], k)


def position_transitions(found: DataFrame, k: int = POSITION_TRANSITION_K) -> DataFrame:
    """Which node follows another at a place of the way from source to receiver, from paths known in whole."""
    stops = F.concat(F.array("src"), F.col("ids"), F.array("rx"))
    rows = found.where(_whole() & F.col("src").isNotNull()).select("n", F.explode(_steps(stops)).alias("s")).select("n", "s.*")
    return priors(rows, ["pos", "src"], ["dst"], k)


def directed_edges(steps: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """A score for each direction of each link in each region and quarter of the day in which its first end was active.

    links: a, b, a_to_b, b_to_a, loss_db and km, for each two neighbours. Of an end's steps each neighbour is expected to
    have an equal share. The score weighs reliability, direction, recency and loss, less missing steps and signs of error; of each
    end the EDGE_K best stay.
    """
    observed = steps.groupBy("region", "quarter", "src", "dst").agg(F.sum("n").alias("observed"), F.max("time").alias("last"))
    active = observed.groupBy("region", "quarter", "src").agg(F.sum("observed").alias("active"))
    rest = ["loss_db", "km"]
    ends = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("a_to_b").alias("there"), F.col("b_to_a").alias("back"), *rest).union(links.select("b", "a", "b_to_a", "a_to_b", *rest))
    degree = ends.groupBy("src").agg(F.count("*").alias("degree"))
    e = active.join(degree, "src").join(ends, "src").join(observed, ["region", "quarter", "src", "dst"], "left").fillna(0, ["observed"])
    even = F.greatest(F.lit(1), F.floor(F.col("active") / F.col("degree") + 0.5))
    e = e.withColumn("expected", F.greatest("observed", even)).withColumn("missing", F.col("expected") - F.col("observed"))
    reliable = F.col("observed") / (F.col("expected") + 2.0)
    direction = F.coalesce(F.col("there") / F.nullif((F.col("there") + F.col("back")).cast("double"), F.lit(0.0)), F.lit(0.5))
    days = F.timestamp_diff("MICROSECOND", F.col("last"), now) / 86400e6
    recent = F.coalesce(clamp(F.exp(-days / 21), 0.05, 1.0), F.lit(0.05))
    loss = F.coalesce(clamp((160 - F.col("loss_db")) / 45, 0, 1), F.lit(0.55))
    when = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    doubt = when((F.col("km") > 55) & (F.col("loss_db") > 150), 0.14) + when((F.col("observed") < 3) & (F.col("missing") >= 3), 0.1) + when((direction < 0.06) & (F.col("observed") >= 5), 0.06)
    score = clamp(0.42 * reliable + 0.22 * direction + 0.2 * recent + 0.16 * loss - F.col("missing") / F.col("expected") * 0.3 - clamp(doubt, 0, 0.35), 0.02, 0.995)
    scored = e.select("region", "quarter", "src", "dst", "observed", "expected", "missing", F.round(score, 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("region", "quarter", "src").orderBy(F.desc("score"), "dst"))
    return scored.withColumn("_r", rank).where(F.col("_r") <= EDGE_K).drop("_r")
