"""SimHash near-duplicates: partitions of correlated bits with their own thresholds, probed and verified exactly.

Two forms share one search. ``near_duplicates`` links fingerprints of 64 bits that differ in few of them: by the
generalised pigeonhole principle no pair is missed. ``near_copies`` links texts by the Jaccard similarity of their sets
of word shingles; its fingerprints are WIDE, its thresholds are shared out so that a pair at just the least similarity
is missed with a chance of MISS, and candidates are verified by their sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ASCII_LOWER, binary, only, ready, without

WORDS, SEED, LIMIT = 4, 42, 4
SET_WORDS, LEAST, MISS = 5, 0.8, 0.03
WIDE = 1024  # bits of a set's fingerprint
SAMPLE = 2048  # fingerprints, for correlations and candidate counts only
ROW_COST = 10.0  # of a shuffled key, in compared pairs
STAR_KEYS = 12  # groups of bits whose buckets find the hubs
HUBS = 256, 4096  # hubs that every node is compared with, and the nodes they are chosen from: the most popular ones
BROADCAST_SETS = 1 << 25  # bytes of shingle sets that are broadcast at most; more of them meet their pairs by shuffle
SALT_ROWS = 2048  # of a bucket's nodes that one task compares with the bucket
FULL_KEYS = 512  # of the fullest buckets, whose nodes bring all their bits to the comparison


def fingerprint(text: bytes | None, piece: int = 1 << 16) -> int:
    """The 64-bit SimHash of a text's word shingles, counting repeats; 0 if it has no word."""
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(WORDS, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, m = (ends - sizes).tolist(), len(words) - k + 1
    ends, total, digest = ends[k - 1 :].tolist(), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, m, piece):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo : min(m, lo + piece)], ends[lo : lo + piece])], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > m, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in binary(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return df.select("doc_id", "text").mapInArrow(run, schema)


def shingle_set(text: bytes | None, size: int = SET_WORDS) -> np.ndarray:
    """The distinct hashes of a text's word shingles in order; of a shorter text, the hash of all its words."""
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(words), min(size, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, digest = (ends - sizes).tolist(), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(words) - k + 1))


def wide_fingerprint(held: np.ndarray) -> bytes:
    """WIDE bits, each set if it is in over half of the hashes, which are spread to WIDE bits first."""
    times = np.random.default_rng(SEED).integers(0, 1 << 64, WIDE // 64, np.uint64) | np.uint64(1)
    total = np.zeros(WIDE, np.int64)
    for lo in range(0, len(held), 255):  # sums of a block fit a byte
        x = held[lo : lo + 255, None] * times
        x ^= x >> np.uint64(32)
        x *= times[::-1]
        x ^= x >> np.uint64(29)
        total += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(held), bitorder="little").tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def correlations(bits: np.ndarray) -> np.ndarray:
    x = bits - bits.mean(axis=0)
    x /= np.sqrt(np.maximum((x**2).sum(axis=0), 1e-9))
    return np.abs(x.T @ x)


def group_bits(near: np.ndarray, parts: int) -> list[list[int]]:
    """All positions in ``parts`` groups of equal size, each grown by the bit that is most correlated with it."""
    width = len(near)
    taken, free, groups = np.zeros(width), near.sum(axis=1), []
    for k in range(parts):
        size = width // parts + (k < width % parts)
        pull, group = free - taken, []  # a taken bit is below any other
        while len(group) < size:
            bit = int(pull.argmax())
            taken[bit] = np.inf
            free -= near[:, bit]
            pull = near[:, bit] + (pull if group else -taken)
            pull[bit] = -np.inf
            group.append(bit)
        groups.append(sorted(group))
    return groups


def pair_rate(bits: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """The share of pairs within 0..most differing bits in a group: as seen in the sample, no less than for independent bits."""
    share = bits[:, group].mean(axis=0)
    differ = np.array([1.0])
    for p in 2 * share * (1 - share):
        differ = np.convolve(differ, [1 - p, p])
    floor = np.cumsum(differ)[: most + 1]
    half = min(len(bits) // 2, 256)
    if half < 2:
        return floor
    packed = np.packbits(bits[:, group].astype(bool), axis=1)
    distance = np.bitwise_count(packed[:half, None] ^ packed[None, half : 2 * half]).sum(axis=2)
    return np.maximum(floor, [(distance <= t).mean() for t in range(most + 1)])


def _cost(rows: int, group: list[int], t: int, rate: float) -> float:
    return rows * ROW_COST * comb(len(group), t) + rows * rows / 2 * rate


def plan(bits: np.ndarray, rows: int, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """Groups of bits and their thresholds, of least estimated cost, that find every pair within ``limit`` bits.

    By the pigeonhole principle a pair within ``limit`` bits is within t in one of the groups if t+1 sums to
    limit+1 over all groups; a group with t = -1 is never probed. Dynamic programming shares limit+1 out.
    """
    best: tuple[float, list] = (float("inf"), [])
    near = correlations(bits)
    for parts in range(2, limit + 3):
        groups = group_bits(near, parts)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            rates = pair_rate(bits, g, min(limit, 2))
            costs = {-1: 0.0} | {t: _cost(rows, g, t, float(rates[t])) for t in range(len(rates))}
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for t, c in costs.items():
                    at = used + t + 1
                    if at <= limit + 1 and cost + c < new.get(at, (float("inf"),))[0]:
                        new[at] = (cost + c, [*chosen, t])
            table = new
        if limit + 1 in table and table[limit + 1][0] < best[0]:
            best = (table[limit + 1][0], list(zip(groups, table[limit + 1][1])))
    return [(g, t) for g, t in best[1] if t >= 0]


def differing_share(least: float) -> float:
    """The share of bits in which the fingerprints of two sets of Jaccard similarity ``least`` differ: the angle over pi."""
    return acos(min(1.0, 2 * least / (1 + least))) / pi


def plan_share(bits: np.ndarray, rows: int, least: float = LEAST, miss: float = MISS, steps: int = 200) -> list[tuple[list[int], int]]:
    """Groups and thresholds, of least estimated cost, that miss a pair at ``least`` with a chance of ``miss`` or less.

    Dynamic programming shares out log(1 / miss): a group that finds such a pair with chance p adds log(1 / (1 - p)).
    """
    p, need = differing_share(least), log(1 / miss)
    best: tuple[float, list] = (float("inf"), [])
    near = correlations(bits)
    for size in range(12, 31, 2):
        groups = group_bits(near, bits.shape[1] // size)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            rates = pair_rate(bits, g, 1)
            choices = [(0, 0.0, -1)]
            for t in range(2):
                found = sum(comb(len(g), i) * p**i * (1 - p) ** (len(g) - i) for i in range(t + 1))
                choices.append((int(log(1 / (1 - found)) / need * steps), _cost(rows, g, t, float(rates[t])), t))
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for gain, c, t in choices:
                    at = min(steps, used + gain)
                    if cost + c < new.get(at, (float("inf"),))[0]:
                        new[at] = (cost + c, [*chosen, t])
            table = new
        if steps in table and table[steps][0] < best[0]:
            best = (table[steps][0], list(zip(groups, table[steps][1])))
    return [(g, t) for g, t in best[1] if t >= 0]


def _sample_bits(nodes: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Bits of the SAMPLE fingerprints of least hash, a row each, and how many fingerprints there are."""
    held = [bytes(r[0]) for r in nodes.orderBy(F.xxhash64("bits"), "bits").limit(SAMPLE).select("bits").collect()]
    if not held:
        return np.zeros((1, width), np.float32), 0
    return np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, width // 8), axis=1, bitorder="little").astype(np.float32), nodes.count()


def bucket_keys(bits: np.ndarray, layout: list[tuple[list[int], int]]) -> np.ndarray:
    """The keys of each row of bits. Two rows share a key of a group just if they are within its threshold t there:
    a key leaves out t of the group's bits, and there is one for each choice of these."""
    made = []
    for part, (group, t) in enumerate(layout):
        value = bits[:, group].astype(np.uint64) @ (np.uint64(1) << np.arange(len(group), dtype=np.uint64))
        for k, gone in enumerate(combinations(range(len(group)), t)):
            rest = value & ~np.uint64(sum(1 << j for j in gone))
            rest = (rest ^ np.uint64(part << 40 | k << 8)) * np.uint64(0x9E3779B97F4A7C15)
            rest = (rest ^ (rest >> np.uint64(31)) ^ np.uint64(part << 20 | k)) * np.uint64(0xD6E8FEB86659FD93)
            made.append(rest ^ (rest >> np.uint64(32)))
    return np.stack(made, axis=1).view(np.int64) if made else np.zeros((len(bits), 0), np.int64)


def _keyed(nodes: DataFrame, layout: list[tuple[list[int], int]], width: int) -> DataFrame:
    """All columns of each node but its bits, a row for each of its keys. The keys come from the bits anew at each use:
    that costs less than keeping them."""
    rest = [c for c in nodes.columns if c != "bits"]
    schema = T.StructType([nodes.schema[c] for c in rest]).add("keys", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b"".join(binary(b.column(len(rest))))
            keys = bucket_keys(np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, width // 8), axis=1, bitorder="little"), layout)
            ends = np.arange(len(b) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))], [*rest, "keys"])

    return nodes.select(*rest, "bits").mapInArrow(run, schema).select(*rest, F.explode("keys").alias("key"))


def choose_hubs(rows: list, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and bits of up to HUBS of the rows (node, bits), in their order, none within ``limit`` bits of one before."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 1), np.uint64)
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint64).reshape(len(rows), -1)
    free, chosen = np.ones(len(rows), bool), []
    for i in range(len(rows)):
        if free[i] and len(chosen) < HUBS[0]:
            chosen.append(i)
            free &= np.bitwise_count(bits ^ bits[i]).sum(axis=1) > limit
    return np.array([rows[i]["node"] for i in chosen], np.int64), bits[chosen]


def to_hubs(nodes: DataFrame, hubs: tuple[np.ndarray, np.ndarray], limit: int) -> DataFrame:
    """node and hub for each node that has a hub within ``limit`` bits, other than itself: its nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bits = hubs
        for b in batches:
            own, x = b.column(0).to_numpy(), np.frombuffer(b"".join(binary(b.column(1))), np.uint64).reshape(-1, bits.shape[1])
            out = []
            for lo in range(0, len(own), 256):
                apart = np.bitwise_count(x[lo : lo + 256, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
                apart[own[lo : lo + 256, None] == ids] = limit + 1
                at = apart.argmin(axis=1)
                good = np.flatnonzero(apart[np.arange(len(at)), at] <= limit)
                out.append((own[lo : lo + 256][good], ids[at[good]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 2, ["node", "hub"])

    return nodes.select("node", "bits").mapInArrow(run, "node long, hub long")


def _word(bits: str, k: int) -> Column:
    """The k-th 64 bits of a binary column as a long."""
    return F.conv(F.hex(F.substring(bits, 8 * k + 1, 8)), 16, -10).cast("long")


def grouped(nodes: DataFrame, layout: list[tuple[list[int], int]], width: int, head_limit: int, limit: int, least: float, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node and group, the least node reachable, of every node.

    nodes: node, head and tail (64 bits each of its bits), n (a size that linked nodes share to ``least``), copies and
    bits. A candidate pair shares a key, is near in head, tail and size, and has to pass ``verify``. A large set of near
    copies falls into one label first: what copies change differs, so the text they come from shares most buckets with
    most nodes, and each node is compared with two such hubs, one of a few for all and one of its own buckets. Then, in
    all groups of bits, the nodes of a bucket outside of its largest label are compared with all others there, each pair once.
    So pairs inside a set of copies aren't made, and no link between labels is lost. Large buckets are salted. The fullest
    ones, where texts alike but less than ``least`` meet, compare all bits at once: such pairs aren't made either.
    """
    shown = ["node", "head", "tail", "n"]

    def close(other: str) -> Column:
        apart = F.bit_count(F.col("head").bitwiseXOR(F.col(f"{other}.head"))) + F.bit_count(F.col("tail").bitwiseXOR(F.col(f"{other}.tail")))
        return apart <= head_limit if least == 0 else (apart <= head_limit) & (F.least("n", f"{other}.n") >= F.greatest("n", f"{other}.n") * F.lit(least))

    def ordered(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    some = [(g, 0) for g, _ in layout[:STAR_KEYS]]
    keyed = _keyed(nodes.select("node", "copies", "bits"), some, width)
    shared = keyed.groupBy("key").agg(F.sum("copies").alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    popular = keyed.select("key", "node").join(shared, "key").groupBy("node").agg(F.sum("m").alias("popular"))
    ranked = nodes.drop("copies").join(popular, "node").checkpoint()  # of nodes that share a bucket
    hubs = choose_hubs(ranked.orderBy(F.desc("popular"), "node").limit(HUBS[1]).select("node", "bits").collect(), limit)
    keyed = _keyed(ranked.select("popular", *shown, "bits"), some, width)
    hub = keyed.groupBy("key").agg(F.count("*").alias("m"), F.max(F.struct("popular", *shown)).alias("hub")).where("m > 1").drop("m")
    star = keyed.join(hub, "key").where((F.col("node") != F.col("hub.node")) & close("hub")).groupBy("node").agg(F.max(F.struct("hub.popular", "hub.node")).alias("h")).select("node", F.col("h.node").alias("hub"))
    if len(hubs[0]):
        star = star.union(to_hubs(ranked, hubs, limit))
    label = components(verify(star.select(*ordered("node", "hub")).distinct())).select(F.col("id").alias("node"), F.col("component").alias("label"))
    size = label.groupBy("label").agg(F.count("*").alias("size"))
    labelled = nodes.drop("copies").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).join(size, "label", "left").fillna(1, ["size"]).checkpoint()
    tops = _keyed(labelled.select("label", "size", "bits"), layout, width).groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max(F.struct("size", "label")).alias("top"), F.max("label").alias("high"))
    tops = tops.where("low != high").select("key", "m", F.ceil(F.col("m") / SALT_ROWS).cast("int").alias("salts"), F.col("top.label").alias("top")).checkpoint()

    def met(keyed: DataFrame, tops: DataFrame, near: Column) -> DataFrame:
        values = [c for c in keyed.columns if c != "key"]
        mixed = keyed.join(tops.drop("m"), "key")
        ask = mixed.where("label != top").select("key", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), "top", *values)
        all_ = mixed.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.struct(*values).alias("other"))
        once = (F.col("other.label") == F.col("top")) | (F.col("node") < F.col("other.node"))  # others outside of the largest label ask too
        return ask.join(all_, ["key", "salt"]).where((F.col("label") != F.col("other.label")) & once & close("other") & near).select(*ordered("node", "other.node"))

    own = labelled.select(*shown, "label", "bits")
    if width <= 128:  # head and tail are all bits
        pairs = met(_keyed(own, layout, width), tops, F.lit(True))
    else:
        full = tops.orderBy(F.desc("m"), "key").limit(FULL_KEYS).checkpoint()
        words = F.array(*[_word("bits", k) for k in range(width // 64)])
        alike = sum((F.bit_count(F.get("words", k).bitwiseXOR(F.get("other.words", k))) for k in range(width // 64)), F.lit(0)) <= limit
        pairs = met(_keyed(own, layout, width), tops.join(F.broadcast(full.select("key")), "key", "left_anti"), F.lit(True))
        pairs = pairs.union(met(_keyed(own.withColumn("words", words), layout, width).join(F.broadcast(full.select("key")), "key", "left_semi"), F.broadcast(full), alike))
    links = verify(pairs.distinct())
    of = labelled.select("node", "label")
    links = links.join(of.withColumnsRenamed({"node": "a", "label": "x"}), "a").join(of.withColumnsRenamed({"node": "b", "label": "y"}), "b")
    merged = components(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()).withColumnRenamed("id", "label")
    return labelled.join(merged, "label", "left").select("node", F.coalesce("component", "label").alias("group"))


def components(edges: DataFrame) -> DataFrame:
    """id and component, the least id reachable, for each id in the links a < b: alternating large and small stars.

    Each round is two aggregates joined back to the links and is written to the checkpoint folder.
    """
    edges = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).checkpoint()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("v", "v"))


def near_duplicates(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row, from whole texts.

    Fingerprints within ``limit`` bits are linked; component_id is the least doc_id reachable, the row's own included.
    Equal fingerprints are joined to one before the search. Null, empty and wordless texts have fingerprint zero and
    link like any other. A row without doc_id gets the component of its fingerprint, which is null if no row with
    this fingerprint has a doc_id. Repeated rows get equal results; an empty table stays empty.
    """
    found = fingerprints(df).checkpoint()
    fps = found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")).checkpoint()
    little = [F.substring(F.lpad(F.hex("fp"), 16, "0"), k, 2) for k in range(15, 0, -2)]
    nodes = fps.select(F.col("fp").alias("node"), F.col("fp").alias("head"), F.lit(0).cast("long").alias("tail"), F.lit(1).cast("long").alias("n"), "copies", F.unhex(F.concat(*little)).alias("bits"))
    group = grouped(nodes, plan(*_sample_bits(nodes, 64), limit), 64, limit, limit, 0, lambda pairs: pairs)
    return _named(found, fps.withColumnRenamed("fp", "node"), group, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(found: DataFrame, nodes: DataFrame, group: DataFrame, node: str) -> DataFrame:
    """found with component_id, the least id in each row's group."""
    known = nodes.join(group, "node", "left").select(F.col("node").alias(node), "id", F.coalesce("group", "node").alias("group"))
    least = known.groupBy("group").agg(F.min("id").alias("component_id"))
    return found.join(known.join(least, "group").select(node, "component_id"), node, "left")


def near_copies(df: DataFrame, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """doc_id and component_id of every row with a doc_id: the least doc_id reachable by links of texts.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is ``least`` or more (A-Z
    lower-cased; a shorter text is one shingle; texts without a word are equal). Texts of one set are one node. A pair
    beyond ``least`` is missed with a chance of ``miss`` at most, less the more similar it is; no pair below is linked.
    Repeated rows get equal results; an empty table stays empty.
    """
    ready(df.sparkSession)
    df = df.where("doc_id is not null").select("doc_id", "text")
    share = differing_share(least)
    head_limit, limit = (ceil(w * share + 4.5 * sqrt(w * share * (1 - share)) + w / 128) for w in (128, WIDE))

    def digest(held: np.ndarray) -> int:
        return int(np.uint64(xxhash.xxh3_64_intdigest(held.tobytes())).view(np.int64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [shingle_set(t) for t in binary(b.column(1))]
            columns = [pa.array(map(digest, held), pa.int64()), pa.array(map(len, held), pa.int64()), pa.array(map(wide_fingerprint, held), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "node", "n", "bits"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [shingle_set(t) for t in binary(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, held), pa.int64()), pa.array([h.tobytes() for h in held], pa.binary())], ["node", "held"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [[np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(k)] for k in (2, 3)]
            yield b.select([0, 1]).filter(pa.array([jaccard(x, y) >= least for x, y in zip(*held)], pa.bool_()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(binary(b.column(k))), np.uint64).reshape(-1, WIDE // 64) for k in (2, 3))
            yield b.select([0, 1]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= limit))

    found = df.mapInArrow(sign, T.StructType([df.schema["doc_id"]]).add("node", "long").add("n", "long").add("bits", "binary")).checkpoint()
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("copies")).checkpoint()
    head, tail = (_word("bits", k) for k in range(2))

    def both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
        left, right = (values.select(F.col("node").alias(x), F.col(column).alias(f"{column}_{x}")) for x in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", f"{column}_a", f"{column}_b")

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs near in all bits, then those whose sets are; only texts of the former are read again."""
        pairs = both(pairs, nodes, "bits").mapInArrow(near, "a long, b long").checkpoint()
        asked = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select(F.col("id").alias("doc_id")).distinct()
        sets = only(df, asked, "doc_id").mapInArrow(hold, "node long, held binary").dropDuplicates(["node"]).checkpoint()
        size = sets.agg(F.sum(F.octet_length("held"))).first()[0] or 0
        return both(pairs, F.broadcast(sets) if size <= BROADCAST_SETS else sets, "held").mapInArrow(compare, "a long, b long").checkpoint()

    asked = nodes.where("n > 0").select("node", head.alias("head"), tail.alias("tail"), "n", "copies", "bits")
    group = grouped(asked, plan_share(*_sample_bits(asked, WIDE), least, miss), WIDE, head_limit, limit, least, verify)
    return _named(found.select("doc_id", "node"), nodes.select("node", "id"), group, "node").select("doc_id", "component_id")


def keep_one(df: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of df whose doc_id is the least of its group of near copies; of rows that share it, one. Rows without
    doc_id stay, however often they repeat."""
    found = near_copies(df, least).checkpoint()
    kept = without(df, found.where("doc_id != component_id").select("doc_id").distinct(), "doc_id")
    twice = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id").checkpoint()
    if twice.isEmpty():
        return kept
    return without(kept, twice, "doc_id").union(only(kept, twice, "doc_id").dropDuplicates(["doc_id"]))
