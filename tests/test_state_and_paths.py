"""Keyed state, path learning and decoding, origins, stored incidents and published versions against plain loops."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import incident_store, learning, origins, paths, rf, spam
from tidewire.sources.publication import Publication
from tidewire.sources.sinks import shared_folder
from tidewire.streaming import stateful

T0 = 1_704_067_200_000  # 2024-01-01 in milliseconds


def _stream(spark, tmp_path, rows, end, schema, form, runs=2, batch=1):
    """Rows dealt over files, read in ``runs`` runs of one checkpoint with a restart between them; at last ``end``, which moves the watermark."""
    own = stateful.state_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    files = [*(rows[i::5] for i in range(5)), [end]]
    for run in range(runs):
        for some in files[run * 6 // runs : (run + 1) * 6 // runs]:
            own.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(given)
        s = own.readStream.schema(own.read.parquet(given).schema).option("maxFilesPerTrigger", batch).parquet(given)
        q = form(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint"))
        q.trigger(availableNow=True).start().awaitTermination()
    return own.read.parquet(out).collect()


def _at(ms):
    return F.timestamp_millis(F.lit(ms))


def test_propagation_equals_batch_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for p in range(12):
        start = T0 + p * 20_000
        rows += [("n", f"p{p}", start + rng.randint(0, 90_000), f"o{rng.randint(0, 5)}", rng.randint(0, 9)) for _ in range(8)]
    rows += [rows[3], rows[3], ("n", "p0", None, "o", 1), (None, "p0", T0, "o", 1), ("n", "p1", T0 + 15_000, None, 1)]
    rows += [("n", "p0", T0 + 700_000, "late", 3), ("n", "end", T0 + 2_000_000, "o", 0)]  # known no more
    rng.shuffle(rows)
    # rows come in any order, at most half an hour late
    made = lambda s: stateful.propagation(s.withColumn("time", F.timestamp_millis("ms").cast("timestamp_ntz")).drop("ms"), "30 minutes")
    got = _stream(spark, tmp_path, rows, ("n", "z", T0 + 9_000_000, "o", 0), "network string, packet_hash string, ms long, rx_node_id string, hop_count int", made)
    want = {}
    for key in {(r[0], r[1]) for r in rows if None not in (r[0], r[2], r[3])}:
        seen = sorted((r[2], r[3], r[4]) for r in rows if (r[0], r[1]) == key and None not in (r[2], r[3]))
        while seen:
            first = seen[0][0]
            inside = [s for s in seen if s[0] <= first + 60_000]
            want[(*key, first)] = (sorted({s[1] for s in inside}), len(inside), max(s[2] for s in inside))
            seen = [s for s in seen if s[0] > first + 600_000]
    assert {(r.network, r.packet_hash, r.first_ms): (r.observers, r.sightings, r.most_hops) for r in got if r.packet_hash != "z"} == want
    assert len([r for r in got if r.packet_hash != "z"]) == len(want)


def test_rates_equal_range_frames(spark, tmp_path):
    rng = random.Random(6)
    rows, id = [], 0
    for sender in ("a", "b", "c"):
        t = T0
        for _ in range(70):
            t += rng.choice([0, 500, 1000, 1500, 40_000 if sender == "a" else 900])
            id += 1
            rows.append((sender, id, f"n{rng.randint(0, 4 if sender != 'c' else 1)}", t))
    rng.shuffle(rows)
    made = lambda s: stateful.advert_rates(s.withColumn("time", F.timestamp_millis("ms").cast("timestamp_ntz")).drop("ms"), "3 hours")
    got = {r.id: (r.in_minute, r.names, r.flood, r.rotation) for r in _stream(spark, tmp_path, rows, ("end", 999, "n", T0 + 30_000_000), "sender string, id long, name string, ms long", made) if r.sender != "end"}
    want = {}
    for s, i, _, t in rows:
        if s != "end":
            n = sum(x[0] == s and t - 60_000 < x[3] <= t for x in rows)
            k = len({x[2] for x in rows if x[0] == s and t - 1_800_000 <= x[3] <= t})
            want[i] = (n, k, n > 30, k > 3)
    assert got == want and any(v[2] for v in want.values()) and any(v[3] for v in want.values())


def test_held_results_live_half_an_hour(spark, tmp_path):
    m = 60_000
    rows = [
        ("n", "p", T0, "AA", "AA1", 0.9), ("n", "p", T0 + 20 * m, "AA", "AA2", 0.7), ("n", "p", T0 + 21 * m, "BB", "BB1", 0.6), ("n", "p", T0 + 22 * m, "AA", "AA3", 0.2),
        ("n", "p", T0 + 60 * m, "AA", "AA4", 0.9), ("n", "q", T0 + 5 * m, "CC", "CC1", 0.1), ("n", None, T0, "AA", "AA1", 0.9), ("n", "q", T0 + 6 * m, None, "x", 0.9),
    ]
    random.Random(1).shuffle(rows)
    made = lambda s: stateful.held_results(s.withColumn("time", F.timestamp_millis("ms").cast("timestamp_ntz")).drop("ms"), "2 hours")
    got = _stream(spark, tmp_path, rows, ("n", "end", T0 + 1000 * m, "ZZ", "Z", 0.9), "network string, packet_hash string, ms long, hash string, node string, confidence double", made)
    told = sorted((r.packet_hash, (r.first_ms - T0) // m, (r.last_ms - T0) // m, r.refinements, r.hops) for r in got)
    assert told == [("p", 0, 21, 3, ["AA=AA2", "BB=BB1"]), ("p", 60, 60, 1, ["AA=AA4"])]


def _nodes(rng, n, prefixes):
    return [(rng.choice(prefixes) + f"{i:04X}", 54 + rng.random() * 0.8, -2 + rng.random() * 0.8, rng.choice([None, float(rng.randint(0, 400))]), 2) for i in range(n)]


def test_hops_resolve_as_by_a_plain_walk(spark):
    rng = random.Random(8)
    nodes = _nodes(rng, 24, ["AA01", "BB02", "CC03", "DD04", "EE05"]) + [("FF06X", None, None, 1.0, 2), ("AA01Y", 54.1, -1.5, 2.0, 1)]
    placed = [n for n in nodes if n[1] is not None and n[4] in (None, 2)]
    links = [tuple(sorted((rng.choice(placed)[0], rng.choice(placed)[0]))) for _ in range(40)]
    links = [x for x in links if x[0] != x[1]]
    packets = [(i, "MME", "2024-01-01 10:00:00", rng.choice([*(n[0] for n in placed), None, "unknown"]), rng.choice([*(n[0] for n in placed), "FF06X", None]), [rng.choice(["AA01", "BB02", "CC03", "DD04", "EE05", "9999", "FF06"]) for _ in range(rng.randint(0, 6))]) for i in range(120)]
    df = spark.createDataFrame(packets, "observation_id int, region string, time string, src_node_id string, rx_node_id string, path_hashes array<string>")
    out = learning.resolved(df, spark.createDataFrame(nodes, "node_id string, lat double, lon double, elevation_m double, role int"), spark.createDataFrame(links, "a string, b string"))
    got = {r.observation_id: [(h.prefix, h.node_id, h.unique, round(h.score, 9)) for h in r.hops] for r in out.collect()}
    known = {n[0]: n for n in placed}

    def km(a, b):
        return math.hypot((a[1] - b[1]) * 111, (a[2] - b[2]) * 111 * math.cos(math.radians((a[1] + b[1]) / 2)))

    clip = lambda x, a, b: max(a, min(b, x))
    want = {}
    for i, _, _, src, rx, path in packets:
        if rx not in known or not path:
            continue
        path = path[:-1] if rx.startswith(path[-1]) else path
        here, used, hops = known[rx], {rx}, []
        for prefix in reversed(path):
            every = sorted(n for n in placed if n[0].startswith(prefix))
            scored = []
            for c in every:
                if c[0] in used:
                    continue
                d = km(c, here)
                score = 2.5 * (tuple(sorted((c[0], here[0]))) in set(links)) + 1.3 * (0.65 * math.exp(-d / 22) + 0.35 * clip((min(c[3] or 0, here[3] or 0) + 60) / 320, 0, 1))
                score += (km(known[src], here) - km(known[src], c)) / 100 if src in known else 0
                raw = sum(clip(1 - abs(km(o, here) - d) / 45, 0, 1) * clip(1 - km(o, here) / 45, 0, 1) for o in every if o is not c and km(o, here) <= 45)
                scored.append((round(score - clip(raw * 0.12, 0, 0.24), 9), c))
            if scored:
                top = max(s for s, _ in scored)
                here = min(c for s, c in scored if s == top)
                used.add(here[0])
                hops.insert(0, (prefix, here[0], len(every) == 1, top))
        if hops:
            want[i] = hops
    assert {i: [h[:3] for h in v] for i, v in got.items()} == {i: [h[:3] for h in v] for i, v in want.items()} and len(want) > 60
    assert all(abs(a[3] - b[3]) < 1e-8 for i in want for a, b in zip(got[i], want[i]))
    empty = learning.resolved(df.limit(0), spark.createDataFrame(nodes, "node_id string, lat double, lon double, elevation_m double, role int"), spark.createDataFrame(links, "a string, b string"))
    assert empty.count() == 0


def test_shared_groups_match_a_plain_loop(spark):
    rng = random.Random(9)
    rows = [(i, "n" if i % 5 else None, f"p{i % 9}", rng.choice(["r1", "r2", "r3", "r4", None]), [rng.choice("AB") for _ in range(rng.randint(0, 5))]) for i in range(200)]
    df = spark.createDataFrame(rows, "observation_id int, network string, packet_hash string, rx_node_id string, path_hashes array<string>")
    got = {r.observation_id: r.canonical for r in paths.shared_groups(df).collect()}
    packets = defaultdict(list)
    for i, net, p, rx, path in rows:
        if rx is not None and path:
            packets[net, p].append((-len(path), rx, path, i))
    want = {}
    for entries in packets.values():
        groups = []
        for _, _, path, i in sorted(entries):
            fits = [g for g in groups if g[: len(path)] == path]
            if not fits:
                groups.append(path)
            want[i] = fits[0] if fits else path
    assert got == want


def test_shared_decode_projects_one_way_to_all_observers(spark):
    nodes = [("AA", 54.0, -2.0), ("AB", 54.6, -2.0), ("B1", 54.1, -2.0), ("B2", 54.7, -2.0), ("C1", 54.2, -2.0), ("R1", 54.15, -2.0), ("R2", 54.25, -2.0), ("SS", 53.95, -2.0)]
    nodes = [(i + "00" + "0" * 60, *x) for i, *x in nodes]
    full = {n[0][:2]: n[0] for n in nodes}
    df = spark.createDataFrame([(n, lat, lon, 2) for n, lat, lon in nodes], "node_id string, lat double, lon double, role int")
    hop = lambda *p: [x + "00" for x in p]
    seen = [(1, "n", "p", full["R2"], full["SS"], 5, hop("AA", "B1", "C1")), (2, "n", "p", full["R1"], full["SS"], 5, hop("AA", "B1")), (3, "n", "p", full["R1"], full["SS"], 5, hop("AA", "ZZ")), (4, "n", "q", full["R1"], None, 4, hop("AA"))]
    out = paths.shared_decode(spark.createDataFrame(seen, "observation_id int, network string, packet_hash string, rx_node_id string, src_node_id string, packet_type int, path_hashes array<string>"), df)
    got = {r.observation_id: r for r in out.collect()}
    name = lambda t: ">".join(x[:2] for x in t.split(">")) if t else t
    assert name(got[1].nodes) == "SS>AA>B1>C1>R2" and name(got[2].nodes) == "SS>AA>B1>R1" and (got[1].resolved, got[1].remaining) == (3, 0)
    assert got[2].segments == got[2].nodes and got[1].confidence == 1.0
    # an unknown hop leaves a gap: two runs, of which the receiver's alone is too short
    assert name(got[3].nodes) == "SS>AA>R1" and name(got[3].segments) == "SS>AA" and (got[3].resolved, got[3].remaining) == (1, 1) and got[3].confidence == 0.5
    assert name(got[4].nodes) == "AA>R1"


def test_origins_match_a_plain_walk(spark):
    rng = random.Random(12)
    nodes = [(rng.choice(["A1B2", "A1C3", "D4E5", "F6A7"]) + f"{i:04d}", 54 + rng.random() * 2, -3 + rng.random() * 2) for i in range(40)]
    links = [tuple(sorted(rng.sample([n[0] for n in nodes], 2))) for _ in range(120)]
    hashes = ["A1", "A1B2", "D4", "d4e5 ", "F6A7", "99"]
    got_rows = [(f"i{k % 6}", k, rng.choice(nodes)[0] if k % 13 else None, rng.choice([0, 1, 2, 2, 3, None]), [rng.choice(hashes) for _ in range(rng.randint(0, 3))]) for k in range(150)] + [("few", 900, nodes[0][0], 1, ["A1B2"])]
    df = spark.createDataFrame(got_rows, "incident string, observation_id int, rx_node_id string, hop_count int, path_hashes array<string>")
    out = origins.origins(df, spark.createDataFrame(nodes, "node_id string, lat double, lon double"), spark.createDataFrame(links, "a string, b string"))
    got = {r.incident: r for r in out.collect()}
    at = {n[0]: n for n in nodes}
    want = {}
    for incident in {r[0] for r in got_rows}:
        seen = sorted((r[3], r[1], r[2], r[4]) for r in got_rows if r[0] == incident and r[2] in at and r[3] is not None and r[4])
        seen = [s for s in seen if s[0] <= seen[0][0] + 1][:40]
        votes = defaultdict(lambda: [0.0, 0, 0])
        for hops, _, rx, path in seen:
            here, linked = at[rx], 0
            for h in reversed(path):
                every = [n for n in nodes if n[0].startswith(h.strip().upper())]
                near = [n for n in every if tuple(sorted((n[0], here[0]))) in set(links)]
                linked += bool(near)
                pool = near or [n for n in every if origins._km(here, n) <= 150]
                if not pool:
                    break
                here = min(pool, key=lambda n: (origins._km(here, n), n[0]))  # noqa: B023
            else:
                q = linked / len(path)
                v = votes[here[0]]
                v[0] += (0.5 + 0.5 * q) / (1 + hops) * (0.4 if q < 0.5 else 1)
                v[1] += 1
                v[2] += q < 0.5
        if sum(v[1] for v in votes.values()) < 3:
            continue
        top = at[min(votes, key=lambda n: (-round(votes[n][0], 9), n))]
        inside = {n: v for n, v in votes.items() if origins._km(top, at[n]) <= 45}
        w = sum(v[0] for v in inside.values())
        want[incident] = (sum(v[0] * at[n][1] for n, v in inside.items()) / w, sum(v[0] * at[n][2] for n, v in inside.items()) / w, sum(v[1] for v in inside.values()))
    assert set(got) == set(want) and len(want) >= 4 and "few" not in want
    for i, (lat, lon, n) in want.items():
        assert (got[i].lat, got[i].lon, got[i].votes) == (pytest.approx(lat, abs=1e-6), pytest.approx(lon, abs=1e-6), n)


def test_incidents_of_two_runs_equal_those_of_one(spark, tmp_path):
    shared_folder(spark)
    rng = random.Random(3)
    rows = []
    for k in range(160):
        who = k % 4
        text = ["Great offer for all stations see www.deal.com now", f"calling every station of round {k // 40} this evening", "hello there", f"{rng.random()}"][who]
        rows.append((k // 80, k, k % 2, f"Dealer{who}", text + "!" * (k % 3), T0 // 1000 + k * 40 + (7200 if k >= 120 else 0)))
    df = spark.createDataFrame(rows, "net int, conv_id long, turn long, sender string, text string, s long")
    m = df.select(F.when(F.col("net") == 0, "north").otherwise("south").alias("network"), "conv_id", "turn", "sender", "text", F.timestamp_seconds("s").cast("timestamp_ntz").alias("time")).checkpoint()
    now = F.lit("2024-01-01 05:00:00").cast("timestamp_ntz")
    table = lambda df: Counter(map(tuple, df.select(*sorted(df.columns)).collect()))
    once = incident_store.merged(None, m).checkpoint()
    want = table(incident_store.incidents(once, now))
    for cut in (F.col("conv_id") < 77, F.col("conv_id") % 2 == 0):
        store = Publication(spark, os.path.join(str(tmp_path), f"s{rng.random()}"))
        assert incident_store.update(store, m.where(cut), 1) and incident_store.update(store, m.where(~cut).union(m.limit(5)), 2)
        assert table(store.read().drop("first", "last")) == table(once.drop("first", "last"))
        assert table(incident_store.incidents(store.read(), now)) == want
    assert want and {r.status for r in incident_store.incidents(once, now).collect()} <= {"active", "closed"}


@pytest.mark.parametrize("n", [1, 3, 25, 26, 40, 333])
def test_evidence_is_strided(spark, n):
    rows = [("g", k, 0, k, "other" if k != n // 3 else "said", "said") for k in range(n)]
    df = spark.createDataFrame(rows, "g string, conv_id int, turn int, time int, text string, rep string")
    got = sorted(r.conv_id for r in incident_store.evidence(df, ["g"], "rep", 25).collect())
    want = set(range(n))
    if n > 25:
        want = {0, n // 3, *range(n - 12, n)}
        left = 25 - len(want)
        for k in range(0, n, max(1, n // left)):
            if len(want) < 25:
                want.add(k)
        for k in range(n - 1, -1, -1):
            if len(want) < 25:
                want.add(k)
    assert got == sorted(want)


def test_readers_see_the_newest_whole_version(spark, tmp_path):
    store = Publication(spark, str(tmp_path / "t"))
    rows = lambda n: spark.range(n)
    assert store.read() is None and store.publish(rows(3), 5) and store.read().count() == 3
    assert not store.publish(rows(9), 4) and not store.publish(rows(9), 5) and store.read().count() == 3
    assert store.publish(rows(7), 8) and store.read().count() == 7
    os.makedirs(tmp_path / "t" / "versions" / "half")  # a writer was lost before its manifest
    other = Publication(spark, str(tmp_path / "t"))
    assert other.read().count() == 7 and other.generations() == [5, 8]
    assert store.publish(rows(1), 9) and not os.path.exists(tmp_path / "t" / "manifests" / "_draft")
    store.clean(1)
    assert other.generations() == [9] and other.read().count() == 1


def test_prefix_losses_equal_the_loss_of_each_beginning(spark):
    rng = random.Random(2)
    rows = [(i, [k * 250.0 for k in range(n)], [rng.uniform(0, 90) for _ in range(n)]) for i, n in enumerate([1, 2, 3, 4, 9, 40, 150])]
    rows += [(50, [0.0, 0.5, 300.0], [1.0, 2.0, 3.0]), (51, [0.0, 100.0], [float("nan"), 5.0]), (52, None, None), (53, [0.0, 500.0, 500.0, 900.0], [5.0, 9.0, 2.0, None])]
    schema = "id int, distances_m array<double>, heights_m array<double>"
    df = spark.createDataFrame(rows, schema).withColumns({"tx_m": F.lit(20.0), "rx_m": F.lit(8.0)})
    got = {(r.id, r.pos): r for r in rf.prefix_losses(df).collect()}
    clean = [(i, sorted((d, h) for d, h in zip(ds or [], hs or []) if h is not None and math.isfinite(h))) for i, ds, hs in rows]
    parts = [(i * 1000 + k, [d for d, _ in p[: k + 1]], [h for _, h in p[: k + 1]]) for i, p in clean for k in range(len(p))]
    want = {r.id: r for r in rf.path_losses(spark.createDataFrame(parts, schema).withColumns({"tx_m": F.lit(20.0), "rx_m": F.lit(8.0)})).collect()}
    assert {i * 1000 + k for i, k in got} == set(want)
    for (i, k), r in got.items():
        w = want[i * 1000 + k]
        assert (r.loss_db == w.loss_db or abs(r.loss_db - w.loss_db) <= 1e-9 * 1.5) and r.viable == w.viable, (i, k)


def test_line_of_sight_matches_a_plain_loop(spark):
    rng = random.Random(5)
    rays, steps = 8, 12
    rows = [(i, 10.0, float(rng.randint(0, 30)), [float(rng.choice([0, 5, 30, 60])) for _ in range(rays * steps)]) for i in range(6)]
    out = rf.line_of_sight(spark.createDataFrame(rows, "site_id long, mast_m double, ground_m double, heights array<double>"), rays, 500.0, steps).collect()
    got = {(r.site_id, r.ray): (r.reach_km, r.runs) for r in out}
    for i, mast, ground, heights in rows:
        for ray in range(rays):
            top, seen = -math.inf, []
            for s in range(steps):
                m = (s + 1) * 500.0
                low = ground + mast + m * m / (2 * 6_371_000 * 4 / 3)
                seen.append((heights[ray * steps + s] + 2 - low) / m + 1e-9 >= top)
                top = max(top, (heights[ray * steps + s] - low) / m)
            runs, k = [], 0
            while k < steps:
                if seen[k]:
                    e = k
                    while e + 1 < steps and seen[e + 1]:
                        e += 1
                    runs.append(f"{k + 1}-{e + 1}")
                    k = e
                k += 1
            first = seen.index(False) if False in seen else steps
            assert got[i, ray] == (first * 0.5, ",".join(runs))


def test_state_is_of_parts_not_of_keys(spark, tmp_path, monkeypatch):
    """400 packets in 4 parts: Spark keeps a few values for each part, where it kept several for each packet."""
    monkeypatch.setattr(stateful, "PARTS", 4)
    own = stateful.state_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    i = F.col("id")
    rows = own.range(400).select(F.lit("n").alias("network"), F.concat(F.lit("p"), i.cast("string")).alias("packet_hash"), F.timestamp_millis(F.lit(T0) + i).cast("timestamp_ntz").alias("time"), F.lit("o").alias("rx_node_id"), F.lit(1).alias("hop_count"))
    rows.coalesce(1).write.parquet(given)
    rows.limit(1).withColumns({"packet_hash": F.lit("end"), "time": F.timestamp_millis(F.lit(T0 + 9_000_000)).cast("timestamp_ntz")}).write.mode("append").parquet(given)
    s = own.readStream.schema(own.read.parquet(given).schema).option("maxFilesPerTrigger", 1).parquet(given)
    q = stateful.propagation(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert own.read.parquet(out).where("packet_hash != 'end'").count() == 400
    kept = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    assert kept and max(kept) < 100
