from collections import Counter
import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import columns as C
from tidewire.functions import text as T
from tidewire.operators import graph, identity, learning, paths, relational, rf, spam
from tidewire.sources import domain, sinks, wire


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = rng.integers(1, 4, rng.integers(2, 5))
        e = [rng.normal(size=n) for n in sizes]
        t = [rng.normal(size=(a, b)) for a, b in zip(sizes, sizes[1:])]
        best = {}
        for path in itertools.product(*map(range, sizes)):
            s = sum(x[i] for x, i in zip(e, path)) + sum(x[i, j] for x, i, j in zip(t, path, path[1:]))
            for k, i in enumerate(path):
                best[k, i] = max(best.get((k, i), -math.inf), s)
        chosen, margins = paths.viterbi(e, t)
        for k, n in enumerate(sizes):
            scores = sorted((best[k, i] for i in range(n)), reverse=True)
            assert best[k, chosen[k]] == pytest.approx(scores[0])
            assert margins[k] == (math.inf if n == 1 else pytest.approx(scores[0] - scores[1]))


def test_viterbi_dead_ends_still_score():
    chosen, _ = paths.viterbi([np.array([0.0, 1.0]), np.array([0.0])], [np.array([[0.0], [-np.inf]])])
    assert chosen == [1, 0]


def plain_km(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x)))


def test_decoding_with_evidence_matches_enumeration(spark):
    rng = random.Random(9)
    names = ["AAAA", "BBBB", "CCCC"]
    place = {}
    for k in range(9):
        place[f"{names[k % 3]}{k}"] = None if k == 8 else (50 + rng.random() * 1.2, rng.random() * 1.2)
    place |= {"SRC": (50.2, 0.1), "RX": (50.9, 0.8)}
    rows = [(n, p and p[0], p and p[1], 2 if n not in ("SRC", "RX") else 1) for n, p in place.items()]
    nodes = spark.createDataFrame(rows, "node_id string, lat double, lon double, role int")
    ids = [n for n in place if n not in ("SRC", "RX")]
    pick = lambda n: {tuple(x): rng.randint(1, 9) for x in n}
    prefixes = pick([("AAAA" if rng.random() < 0.5 else "", x[:4], x) for x in ids])
    positions = pick([(x[:2], rng.randint(0, 2), x) for x in ids])
    corridors = pick([("SRC", "RX", rng.randint(0, 2), x) for x in ids])
    follow = pick([rng.sample(ids, 2) for _ in range(12)])
    placed = pick([(rng.randint(1, 2), *rng.sample(ids, 2)) for _ in range(12)])
    near = {tuple(rng.sample(ids, 2)) for _ in range(6)}
    table = lambda d, kind: spark.createDataFrame([(*k, v) for k, v in d.items()], kind + ", n long")
    evidence = paths.Evidence(
        table(prefixes, "before string, prefix string, node string"), table(positions, "byte string, pos int, node string"), table(corridors, "src string, rx string, pos int, node string"),
        table(follow, "src string, dst string"), table(placed, "pos int, src string, dst string"), spark.createDataFrame(list(near), "a string, b string"),
    )
    seen = [(k, [rng.choice(names + ["DDDD"] * (k > 5)) for _ in range(rng.randint(1, 3))], rng.choice(["SRC", None]), rng.choice(["RX", "RX", None])) for k in range(12)]
    got = {(r.observation_id, r.pos): r for r in paths.decode(spark.createDataFrame(seen, "observation_id int, path_hashes array<string>, src_node_id string, rx_node_id string"), nodes, evidence).collect()}
    assert len(got) == sum(len(x[1]) for x in seen)
    w = paths.WEIGHTS
    for k, path, src, rx in seen:
        columns = []
        for i, h in enumerate(path):
            column = {}
            for x in ids:
                if not x.startswith(h):
                    continue
                p, to_rx = place[x], place[x] and rx and plain_km(place[x], place["RX"])
                e = w["prefix"] * math.log1p(prefixes.get((path[i - 1] if i else "", h, x), 0)) + w["position"] * math.log1p(positions.get((h[:2], i, x), 0)) + w["corridor"] * math.log1p(corridors.get((src, rx, i, x), 0))
                e -= (to_rx or 0) / 80
                if p and rx and src:
                    f = (i + 1) / (len(path) + 1)
                    e -= plain_km(p, [place["SRC"][c] + (place["RX"][c] - place["SRC"][c]) * f for c in (0, 1)]) / 55
                if i == len(path) - 1 and rx:
                    if not p or to_rx > 150:
                        continue
                    e -= 0.9 * to_rx / 80
                column[x] = e
            columns.append(column or {None: 0.0})

        def step(i, x, y):
            if x is None or y is None:
                return 0.0
            t = 2.0 * math.log1p(follow.get((x, y), 0)) + 1.2 * math.log1p(placed.get((i, x, y), 0)) + 0.8 * ((x, y) in near or (y, x) in near)
            return t - (plain_km(place[x], place[y]) / 40 if place[x] and place[y] else 0)

        best = {}
        for way in itertools.product(*columns):
            s = sum(columns[i][x] for i, x in enumerate(way)) + sum(step(i, x, y) for i, (x, y) in enumerate(zip(way, way[1:]), 1))
            for i, x in enumerate(way):
                best[i, x] = max(best.get((i, x), -math.inf), s)
        for i, column in enumerate(columns):
            r = got[k, i + 1]
            ranked = sorted((best[i, x] for x in column), reverse=True)
            assert best[i, r.node_id] == pytest.approx(ranked[0], abs=1e-6)
            assert r.margin == (None if len(ranked) == 1 else pytest.approx(ranked[0] - ranked[1], abs=1e-5))
            if r.margin is not None:
                assert r.confidence == pytest.approx(1 - math.exp(-r.margin / 0.12), abs=1e-4)


def test_message_clusters_match_a_plain_loop(spark):
    rng = random.Random(12)
    bases = ["great offer for all stations tonight see www.deal.com/now", "calling every station of the evening round again", "short one", "another text that nobody says twice at all"]
    rows = []
    for k in range(90):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh ")
        rows.append((k, 0, rng.choice(["Bob", "bobby", "Zed"]), rng.choice(["n", "n", "s"]), "".join(t), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.choice([0, 0, 400]) + rng.randrange(120))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, sender string, network string, text string, time timestamp_ntz")

    def grams(x):
        return {f"  {x} "[i : i + 3] for i in range(len(x) + 1)}

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, before = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
        return 1 - row[-1] / max(1, len(x), len(y))

    norm = spark.createDataFrame(rows, df.schema).select("conv_id", T.normalised(F.col("text")).alias("t"), T.links_of(F.col("text")).alias("u")).collect()
    text, links = {r.conv_id: r.t for r in norm}, {r.conv_id: set(r.u) for r in norm}

    def alike(x, y):
        a, b = text[x], text[y]
        if a == b:
            return 1.0
        if links[x] & links[y]:
            return max(0.85, edits(a, b))
        if max(len(a), len(b)) < 12:
            return edits(a, b)
        g, h, v, w = grams(a), grams(b), set(a.split(" ")), set(b.split(" "))
        return max(edits(a, b), 2 * len(g & h) / (len(g) + len(h)), len(v & w) / len(v | w))

    sessions, part = {}, {}
    for k, _, _, network, _, time in sorted(rows, key=lambda r: (r[5], r[0])):
        key = (network, text[k])
        if key not in sessions or time - sessions[key][-1][1] > dt.timedelta(minutes=30):
            part[key] = part.get(key, 0) + 1
            sessions[key] = []
        sessions[key].append((k, time))
        sessions[(*key, part[key])] = sessions[key]
    sessions = {k: v for k, v in sessions.items() if len(k) == 3}
    root = {k: k for k in sessions}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sender = {r[0]: {"Bob": "bob", "bobby": "bobby", "Zed": "zed"}[r[2]] for r in rows}
    names = {("bob", "bob"), ("bobby", "bobby"), ("zed", "zed"), ("bob", "bobby"), ("bobby", "bob")}
    for a, b in itertools.combinations(sorted(sessions), 2):
        x, y = sessions[a], sessions[b]
        near = max(x[0][1], y[0][1]) - min(x[-1][1], y[-1][1]) <= dt.timedelta(minutes=30)
        if a[0] == b[0] and near:
            s = alike(x[0][0], y[0][0])
            if s >= 0.82 or (s >= 0.6 and (sender[x[0][0]], sender[y[0][0]]) in names):
                root[find(a)] = find(b)
    want = {}
    for key, held in sessions.items():
        want.setdefault(find(key), set()).update(k for k, _ in held)
    got = {}
    for r in spam.clusters(df).collect():
        got.setdefault((r.network, r.cluster), set()).add(r.conv_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and max(map(len, got.values())) > 8


def test_components_and_cut_nodes(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)}
    named = [(f"{a:03}", f"{b:03}") for a, b in edges]
    df = spark.createDataFrame(named, "a string, b string")

    def parts(links):
        near = {}
        for a, b in links:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        out, seen = {}, set()
        for s in sorted(near):
            stack = [s] if s not in seen else []
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    out[x] = s
                    stack += near[x]
        return out

    want = parts(named)
    assert dict(map(tuple, graph.components(df).collect())) == want
    cut = set()
    for x in want:
        rest = [e for e in named if x not in e]
        left = parts(rest)
        mates = {y for y in want if want[y] == want[x] and y != x}
        if len({left.get(y, y) for y in mates}) > 1:
            cut.add(x)
    assert {r.node for r in graph.articulation_points(df).collect()} == cut


def test_within_km_matches_all_pairs(spark):
    rng = random.Random(1)
    points = [(f"{k:03}", rng.uniform(-89, 89), rng.uniform(-180, 180) if k % 2 else rng.uniform(-3, 3)) for k in range(300)] + [("x", None, 1.0)]
    df = spark.createDataFrame(points, "node_id string, lat double, lon double")
    got = {(r.a, r.b) for r in relational.within_km(df, 700).collect()}

    def km(p, q):
        a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(a)))

    near = [p for p in points if p[1] is not None]
    want = {(p[0], q[0]) for p, q in itertools.combinations(near, 2) if km(p, q) <= 700}
    assert got == want


def test_frames(spark):
    payload = "aabb"
    rows = [
        ("05" + "41" + "abcd" + payload, 1, 1, 2, ["ABCD"]), ("04" + "11223344" + "02" + "a1b2" + payload, 0, 1, 1, ["A1", "B2"]), ("06" + "00" + payload, 2, 1, 1, []),
        ("05" + "c1" + "abcdabcd" + payload, None, None, None, None), ("05" + "41" + "abcd", None, None, None, None), ("xyz", None, None, None, None), ("05", None, None, None, None), (None, None, None, None, None),
    ]
    out = wire.decode_frame(spark.createDataFrame([(r[0],) for r in rows], "raw_hex string")).collect()
    assert [(r.route, r.payload_type, r.hash_size, r.path_hashes) for r in out] == [r[1:] for r in rows]
    assert out[0].packet_id == out[1].packet_id == out[2].packet_id and len(out[0].packet_id) == 64
    assert out[1].transport == "11223344"


def test_topics(spark):
    obs = "ab" * 32
    rows = [
        (f"mesh/MME/{obs}/packets", ("MME", "packets", "main")), (f"Mesh/ mme/{obs.upper()}/Status ", ("MME", "status", "main")), (f"mesh/lhr/{obs}/neighbours", ("LHR", "neighbours", "main")),
        (f"lab/abc/{obs}/neighbors", ("ABC", "neighbors", "test")), (f"mesh/test/{obs}/packets", ("TEST", "packets", "test")), (f"mesh/MME/{obs}/other", None), ("mesh/MME/zz/packets", None),
        (f"x/MME/{obs}/status", None), (f"mesh/M-E/{obs}/status", None), (f"mesh/MME/{obs}/packets/x", None), (None, None), ("", None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "topic string")
    out = wire.parse_topic(df, prefixes={"mesh": "main", "lab": "test"}, test_regions=["TEST"]).collect()
    assert [r.region and (r.region, r.suffix, r.network) for r in out] == [r[1] for r in rows] and out[0].observer == obs.upper()
    assert [r.network for r in out if r.region is None] == [None] * 7


def test_column_functions(spark):
    row = spark.range(1).select(
        C.haversine_km(F.lit(51.5), F.lit(0.0), F.lit(48.85), F.lit(2.35)).alias("km"), C.free_space_db(F.lit(1.0)).alias("fs"), C.knife_edge_db(F.lit(0.0)).alias("ke"), C.knife_edge_db(F.lit(-1.0)).alias("none"),
        C.little_endian(F.lit("3412")).alias("le"), C.normalise_message(F.lit("Hellooooo!! see https://x.y/z  NOW")).alias("text"), C.dice(C.trigrams(F.lit("abc")), C.trigrams(F.lit("abc"))).alias("dice"),
        C.has_position(F.lit(0.0), F.lit(0.0)).alias("island"), C.csv_safe(F.lit("=1+1")).alias("csv"), C.edit_ratio(F.lit("kitten"), F.lit("sitting")).alias("lev"),
    ).first()
    assert row.km == pytest.approx(340.6, abs=2) and row.fs == pytest.approx(91.2, abs=0.1) and row.ke == pytest.approx(6.03, abs=0.01) and row.none == 0
    assert row.le == 0x1234 and row.text == "helloo see now" and row.dice == 1.0 and row.island is False and row.csv == "'=1+1" and row.lev == pytest.approx(1 - 3 / 7)


def plain_loss(d, h, tx, rx):
    """Loss and viability by a plain loop; see rf.path_losses."""
    points = sorted((x, y) for x, y in zip(d, h) if None not in (x, y) and math.isfinite(x) and math.isfinite(y)) if len(d) == len(h) else []
    if len(points) < 2:
        return math.inf, False
    far, wave = points[-1][0], 299_792_458.0 / 868e6
    if far < 1:
        return 0.0, True
    loss = 20 * math.log10(4 * math.pi * far / wave)
    start, stop, worst = points[0][1] + tx, points[-1][1] + rx, None
    for x, y in points[1:-1]:
        if 0 < x < far:
            above = y + x * (far - x) / (2 * 6_371_000 * 4 / 3) - (start + (stop - start) * x / far)
            v = above * math.sqrt(2 * far / (wave * x * (far - x)))
            worst = v if worst is None else max(worst, v)
    if worst is None:
        return loss, loss < 140
    if worst > -0.78:
        loss += max(0.0, 6.9 + 20 * math.log10(math.sqrt((worst - 0.1) ** 2 + 1) + worst - 0.1))
    if len(points) > 3:
        loss += min(6.0, 0.08 * math.log1p(float(np.percentile(np.abs(np.diff([y for _, y in points])), 75))))
    return loss, worst <= 1.12 and loss < 140


def test_path_losses_match_a_plain_loop(spark):
    rng, inf, nan = random.Random(3), math.inf, math.nan
    rows = [([0.0, 500.0], [10.0, 10.0]), ([0.0, 500.0, 1000.0], [1.0, 90.0, 1.0]), ([0.0], [5.0]), ([], []), ([0.0, 0.5], [1.0, 9.0]), ([0.0, 100.0], [nan, 5.0]), ([0.0, 100.0, 300.0], [1.0, inf, 5.0])]
    rows += [([0.0, 1.0], [1.0]), (None, [1.0]), ([0.0, 900.0, 300.0, 600.0], [1.0, 2.0, 70.0, None]), ([0.0, 0.0, 900.0], [1.0, 2.0, 3.0])]
    for n in (3, 4, 5, 9, 40):
        rows += [([k * 250.0 for k in range(n)], [rng.uniform(0, 60) for _ in range(n)]) for _ in range(6)]
    df = spark.createDataFrame([(i, d, h, 20.0, 8.0) for i, (d, h) in enumerate(rows)], "id int, distances_m array<double>, heights_m array<double>, tx_m double, rx_m double")
    out = {r.id: r for r in rf.path_losses(df).collect()}
    assert len(out) == len(rows)
    for i, (d, h) in enumerate(rows):
        loss, viable = plain_loss(d or [], h, 20.0, 8.0)
        assert out[i].loss_db == pytest.approx(loss, abs=1e-8) and out[i].viable == viable, (i, d, h)
    stepped = spark.createDataFrame([(1, [5.0, 40.0, 9.0, 7.0], 300.0, 9.0, 9.0)], "id int, heights_m array<double>, step_m double, tx_m double, rx_m double")
    assert rf.path_losses(stepped).first().loss_db == pytest.approx(plain_loss([0, 300, 600, 900], [5.0, 40.0, 9.0, 7.0], 9.0, 9.0)[0], abs=1e-8)


def test_merge_changes_and_archive(spark):
    old = spark.createDataFrame([("a", 1, 5, "x"), ("b", 2, 6, None)], "k string, n int, t int, v string")
    new = spark.createDataFrame([("a", 3, 4, "y"), ("b", 1, 9, None), ("c", 7, 1, "z")], "k string, n int, t int, v string")
    rules = {"n": "sum", "t": "max", "v": "latest:t"}
    got = {r.k: (r.n, r.t, r.v) for r in sinks.merge_aggregate(old, new, ["k"], rules).collect()}
    assert got == {"a": (4, 5, "x"), "b": (3, 9, None), "c": (7, 1, "z")}
    diff = {(r.k, r.action) for r in sinks.changes(old, new.where("k != 'b'"), ["k"]).collect()}
    assert diff == {("a", "upsert"), ("b", "delete"), ("c", "upsert")}
    stay, gone = sinks.archive(old, F.col("v") == "x")
    assert [r.k for r in stay.collect()] == ["b"] and '"v":"x"' in gone.first().record


def test_accepted_pairs_are_those_of_all_pairs_and_groups_keep_places_apart(spark):
    rng = random.Random(7)
    base = ["0123456789ABCDEF" * 4, "FEDCBA9876543210" * 4, "00112233445566778899AABBCCDDEEFF" * 2]
    flip = lambda s, k: s[:k] + ("0" if s[k] != "0" else "1") + s[k + 1 :]
    ids = {i for b in base for i in (b, flip(b, 5), flip(b, 60), flip(flip(b, 5), 60))} | {f"{k:064X}" for k in range(30)}
    rows = []
    for i in sorted(ids):
        placed = rng.random() < 0.6
        rows.append((i, rng.choice(["Hill Repeater", "Hill RPT V2", "Dale Node", "Hill 1", "Hill 2"]), rng.choice(["n", "m", "test"]), rng.choice([2, 2, None]), 50 + rng.random() * 0.06 if placed else None, 1.0 if placed else None, rng.choice([0, 3])))
    nodes = spark.createDataFrame(rows, "node_id string, name string, network string, role int, lat double, lon double, advert_count long")
    day = lambda k: f"2024-01-{k:02d} 00:00:00"
    sent = [(i, rng.randint(0, 1), rng.randint(0, 5), day(k := rng.randint(1, 20)), day(k + rng.randint(0, 5))) for i in sorted(ids) if rng.random() < 0.7]
    evidence = spark.createDataFrame(sent, "node_id string, statuses long, self_adverts long, f string, l string").selectExpr("node_id", "statuses", "self_adverts", "cast(f as timestamp_ntz) as first", "cast(l as timestamp_ntz) as last")
    heard = spark.createDataFrame([(*sorted(rng.sample(sorted(ids), 2)), rng.randint(1, 6)) for _ in range(80)], "a string, b string, adverts long").groupBy("a", "b").agg(F.max("adverts").alias("adverts"))
    every = identity.assess(nodes, evidence, heard).where("accepted").collect()
    accepted = identity.accepted_pairs(nodes, evidence, heard)
    assert Counter(map(tuple, accepted.collect())) == Counter(map(tuple, every)) and len(every) > 5
    edges = [("A", "B", 3, "medium"), ("B", "C", 5, "high"), ("C", "D", 4, "high"), ("D", "E", 1, "high"), ("X", "Y", 2, "high"), ("Y", "Z", 2, "high")]
    at = {"A": None, "B": 50.0, "C": None, "D": 50.01, "E": 50.05, "X": 10.0, "Y": None, "Z": 11.0}
    places = spark.createDataFrame([(i, lat, None if lat is None else 1.0) for i, lat in at.items()], "node_id string, lat double, lon double")
    got = {r.node_id: (r.identity, r.members) for r in identity.groups(spark.createDataFrame(edges, "a string, b string, score int, confidence string"), places).collect()}
    assert got == {"A": ("A", 4), "B": ("A", 4), "C": ("A", 4), "D": ("A", 4), "X": ("X", 2), "Y": ("X", 2)}


def test_clusters_and_incidents(spark):
    text = "buy the cheap thing now at the market"
    rows = [(k, 0, f"trader{k % 3}", "n", text + ("!" * (k % 4)), f"2024-01-01 00:{k:02}:00") for k in range(12)] + [(50, 0, "s", "n", text, "2024-01-01 03:00:00"), (51, 0, "s", "n", None, "2024-01-01 03:01:00")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, sender string, network string, text string, time string").withColumn("time", F.col("time").cast("timestamp_ntz"))
    c = spam.clusters(df)
    assert {r.cluster for r in c.where("conv_id < 12").collect()} == {"0:0"} and c.where("conv_id = 50").first().cluster == "50:0"
    incident = spam.incidents(c, df).collect()
    assert [(i.messages, i.senders, i.rotates, i.burst, i.text) for i in incident] == [(12, 3, True, 11, text)]
    assert incident[0].score == pytest.approx(0.3 * 5 / 8 + 0.2 + 0.25)
    unlike = df.withColumn("sender", F.element_at(F.array(*map(F.lit, ["ann", "joe", "max"])), (F.col("conv_id") % 3 + 1).cast("int")))
    assert spam.incidents(spam.clusters(unlike), unlike).collect() == []  # several unlike senders, and no link
    tests = df.withColumn("text", F.lit("test ping"))
    assert spam.incidents(spam.clusters(tests), tests).collect() == []


def test_content_hash_ignores_order(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    a, b = learning.content_hash(df).first(), learning.content_hash(df.orderBy(F.desc("id")).repartition(5)).first()
    assert a == b and learning.content_hash(df.where("id != 3")).first() != a


def test_coverage_equals_plain_loops(spark):
    rays, steps, step, mast = 3, 8, 500.0, 10.0
    ground = [float((r * 5 + s * 17) % 23) for r in range(rays) for s in range(steps)]
    sites = spark.createDataFrame([(1, mast, ground)], "site_id long, mast_m double, heights array<double>")
    got = {round(r.bearing): r.reach_km for r in rf.coverage(sites, rays, step, steps).collect()}
    for ray in range(rays):
        highest, reach = -math.inf, 0
        for s in range(steps):
            d = (s + 1) * step
            angle = (ground[ray * steps + s] + d * d / (2 * 6_371_000.0 * 4 / 3) - mast) / d
            loss = 20 * math.log10(4 * math.pi * d * 868e6 / 299_792_458.0)
            if angle < highest:
                loss += 6 + 200 * (highest - angle)
            if loss >= rf.VIABLE_DB:
                break
            reach, highest = s + 1, max(highest, angle)
        assert got[round(ray * 360 / rays)] == reach * step / 1000


def test_links_apart_for_each_day(spark):
    rows = [("a", d, ["01", "02", "01"]) for d in ("2024-01-01", "2024-01-01", "2024-01-02")]
    p = spark.createDataFrame(rows, "network string, time string, path_hashes array<string>")
    assert sorted((r.time, r.observed, r.a_to_b) for r in domain.links(p, "time").collect()) == [("2024-01-01", 4, 2), ("2024-01-02", 2, 1)]
