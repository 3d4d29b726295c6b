"""Exact top-k by inner product: pages of a metric tree, visited best first under stored triangle-inequality bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import ready

PIVOTS = 128, 4096  # routing objects of the root, least and most: a sample bounded whatever the rows
PAGE, LEAF, BLOCK = 1024, 64, 256  # vectors in a page and in a leaf; queries in a block
RINGS = 16  # of a pivot, by distance
TURN = 4096  # queries that one copy of a page meets
SALTS = 8

# Each stored vector gets one more component that brings it to the length M, and a query gets a zero. Then
# d(q,x)^2 = |q|^2 + M^2 - 2 q.x orders by the inner product, and d is a metric, which the tree needs.


def quantise(df: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component; rows with a null vector, id or component, or one that is
    not finite, are left out."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good).select("vec_id", v.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of equal length; a shorter vector counts as padded with zeros."""
    if len(column) and column.null_count == 0:
        sizes = np.diff(column.offsets.to_numpy())
        if (sizes == dims).all():
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    for row, v in zip(out, column.to_pylist()):
        row[: len(v)] = v
    return out


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with the component that brings each to the length ``longest``."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1, keepdims=True), 0))], axis=1)


def _ask(q: np.ndarray) -> np.ndarray:
    return np.pad(q.astype(np.float64), ((0, 0), (0, 1)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles where these hold every partial sum; beyond 64 bits the nearest long."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def choose_pivots(vectors: DataFrame, rows: int, dims: int) -> np.ndarray:
    """Vectors of least hash of their ids: one for each eight pages of vectors, within the bounds of PIVOTS."""
    found = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(int(np.clip(rows // (8 * PAGE), *PIVOTS))).collect()
    return np.stack([np.pad(np.array(r["v"], np.int64), (0, dims - len(r["v"]))) for r in found]) if found else np.zeros((0, dims), np.int64)


_NODE = "pivot long, lo double, hi double, ids binary, matrix binary, distances binary, centre binary, radius double, leaf_centres binary, leaf_radii binary, leaf_parents binary"


def pages(vectors: DataFrame, dims: int, longest: float, pivots: Broadcast) -> DataFrame:
    """Packs every vector into pages of one pivot, the nodes of the tree.

    A page stores its vectors and their distances to the pivot (least and most as lo and hi), its own routing object and
    covering radius, and for each leaf of LEAF vectors a routing object, a covering radius and the distance to the
    page's routing object. A pivot's rows are split by distance into rings, and a ring by salts as its count asks, so a
    pivot with a third of all rows, or with equal ones, has many pages in many tasks.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                d = _distances(_lift(_matrix(b.column(1), dims), longest), pivots.value)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near), pa.array(d[np.arange(len(near)), near])], ["vec_id", "v", "pivot", "distance"])

    assigned = vectors.mapInArrow(assign, "vec_id long, v array<long>, pivot long, distance double").checkpoint()
    total = assigned.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"))
    rings = F.least(F.lit(RINGS), F.greatest(F.lit(1), (F.col("n") / PAGE).cast("long")))
    ring = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("distance"))) * rings / RINGS)
    dealt = assigned.join(F.broadcast(total), "pivot").withColumn("ring", ring).drop("n", "cuts")
    crowd = dealt.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / PAGE).alias("salts"))
    dealt = dealt.join(F.broadcast(crowd), ["pivot", "ring"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), "salts"))
    dealt = dealt.repartition(F.col("pivot"), F.col("ring"), F.col("salt")).sortWithinPartitions("pivot", "ring", "salt", "distance", "vec_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple, float, int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            d, matrix = np.array([h[1] for h in held]), np.stack([h[3] for h in held])
            lifted = _lift(matrix, longest)
            centre = lifted.mean(axis=0)
            parts = [lifted[lo : lo + LEAF] for lo in range(0, len(held), LEAF)]
            centres = np.stack([x.mean(axis=0) for x in parts])
            radii = np.array([_distances(c[None], x).max() for c, x in zip(centres, parts)])
            stored = (np.array([h[2] for h in held], np.int64), matrix, d, centre)
            row = [held[0][0][0], d.min(), d.max(), *(x.tobytes() for x in stored), float(_distances(centre[None], lifted).max())]
            row += [x.tobytes() for x in (centres, radii, _distances(centre[None], centres)[0])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, made)], schema=made)

        for b in batches:
            where = zip(*(b.column(k).to_pylist() for k in (2, 4, 5)))
            for at, d, i, v in zip(where, b.column(3).to_pylist(), b.column(0).to_pylist(), _matrix(b.column(1), dims)):
                if held and (held[0][0] != at or len(held) == PAGE):
                    yield flush()
                held.append((at, d, i, v))
        if held:
            yield flush()

    made = to_arrow_schema(T.StructType.fromDDL(_NODE))
    packed = dealt.select("vec_id", "v", "pivot", "distance", "ring", "salt").mapInArrow(make, _NODE)
    return packed.withColumn("page", F.xxhash64("pivot", "lo", "hi", "ids")).checkpoint()


class Page:
    """A stored page, as ``pages`` packs it."""

    def __init__(self, row: dict, dims: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.matrix = np.frombuffer(row["matrix"], np.int64).reshape(-1, dims)
        self.distances, self.leaf_radii, self.leaf_parents = (np.frombuffer(row[k]) for k in ("distances", "leaf_radii", "leaf_parents"))
        self.centre, self.radius = np.frombuffer(row["centre"])[None], row["radius"]
        self.leaf_centres = np.frombuffer(row["leaf_centres"]).reshape(-1, dims + 1)


def search_page(queries: np.ndarray, ids: np.ndarray, floors: np.ndarray, to_pivot: np.ndarray, page: Page, k: int, longest: float) -> list[list[tuple[int, int]]]:
    """The best (score, -vec_id) of one page for each query of a block that can reach its floor.

    Queries whose bound to the page lies beyond their k-th best leave at once. Leaves wait in a heap by the least bound
    of any query; a leaf's bound comes first from stored distances (to the pivot, and of the leaf to the page), and a new
    distance is computed for those queries only that these can't rule out.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in ids]
    lifted = _ask(queries)
    square = (lifted**2).sum(axis=1) + longest**2
    slack = 1e-6 * (1 + square)

    def reach() -> np.ndarray:  # the largest distance that can still enter
        kth = np.array([max(f, b[0][0] if len(b) == k else -np.inf) for f, b in zip(floors, best)])
        return np.sqrt(np.maximum(square - 2 * kth + slack, 0))

    to_page = _distances(lifted, page.centre)[:, 0]
    first = reach()
    into = to_page - page.radius <= first
    heap = []
    for n, (radius, parent) in enumerate(zip(page.leaf_radii, page.leaf_parents)):
        rows = slice(n * LEAF, (n + 1) * LEAF)
        lo, hi = page.distances[rows].min(), page.distances[rows].max()
        bound = np.maximum(np.maximum(to_pivot - hi, lo - to_pivot), np.abs(to_page - parent) - radius)
        ask = np.flatnonzero(into & (bound <= first))
        if len(ask):
            bound[ask] = np.maximum(bound[ask], _distances(lifted[ask], page.leaf_centres[n : n + 1])[:, 0] - radius)
            bound[~into] = np.inf
            heapq.heappush(heap, (float(bound.min()), n, rows, bound))
    while heap:
        _, _, rows, bound = heapq.heappop(heap)
        ask = np.flatnonzero(bound <= reach())
        if not len(ask):
            continue
        scores = _dot(queries[ask], page.matrix[rows])
        for a, row in zip(ask.tolist(), scores):
            mine = best[a]
            kth = mine[0][0] if len(mine) == k else max(floors[a], -np.inf)
            for j in np.flatnonzero(row >= kth).tolist():
                entry = (int(row[j]), -int(page.ids[rows][j]))
                if -entry[1] == ids[a]:
                    continue
                if len(mine) < k:
                    heapq.heappush(mine, entry)
                elif entry > mine[0]:
                    heapq.heapreplace(mine, entry)
    return best


def top_k(df: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products of each query with every other row.

    Queries are the rows whose vec_id is divisible by ``every``. Vectors are floor(1024 x); ties go to the smaller
    vec_id. Rows that are null, or hold null or non-finite components, take no part; shorter vectors count as padded
    with zeros; rows that repeat a query's vec_id aren't its candidates and get rows of their own, other repeated rows each count. Scores are
    exact, and the nearest long if beyond 64 bits. With fewer than k candidates all are returned; an empty table gives
    no row; other columns are left alone.

    The descent goes level by level. A query first searches the best page of its nearest pivot, for a floor. With that it
    keeps the pivots whose covering radius it can reach, then of these pivots' pages those that stored distances don't
    rule out. Vectors go to their pages in a shuffle, and each page is stored once, or once for each TURN queries.
    """
    spark = df.sparkSession
    ready(spark, 4096)
    vectors = quantise(df)
    shape = vectors.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), F.count("*")).first()
    dims, longest = int(shape[0] or 0), float(np.sqrt(shape[1] or 0.0)) * (1 + 1e-9) + 1e-9
    pivots = spark.sparkContext.broadcast(_lift(choose_pivots(vectors, shape[2], dims), longest))
    paged = pages(vectors, dims, longest, pivots)
    directory = paged.select("pivot", "page", "lo", "hi")
    covering = np.zeros(len(pivots.value))
    for r in directory.groupBy("pivot").agg(F.max("hi").alias("hi")).collect():  # a number for each pivot
        covering[r["pivot"]] = r["hi"]
    queries = vectors.where(F.col("vec_id") % every == 0).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    asks = "row long, query_id long, v array<long>, floor double, reach double, pivot long, d double"

    def to_pivots(nearest: bool):
        """Of a query's distances to all pivots those to its nearest one, or to those it can reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                q, floor = _ask(_matrix(b.column(2), dims)), b.column(3).to_numpy(zero_copy_only=False)
                d = _distances(q, pivots.value)
                square = (q**2).sum(axis=1) + longest**2
                reach = np.sqrt(np.maximum(0, square * (1 + 1e-6) + 1e-6 - 2 * floor))
                at = (np.arange(len(b)), d.argmin(axis=1)) if nearest else np.nonzero(d - covering <= reach[:, None])
                for lo in range(0, len(at[0]), 4096):
                    i, p = (x[lo : lo + 4096] for x in at)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in b.columns), pa.array(reach[i]), pa.array(p), pa.array(d[i, p])], ["row", "query_id", "v", "floor", "reach", "pivot", "d"])

        return run

    gap = F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d"), F.lit(0.0))
    nodes = [c.split()[0] for c in _NODE.split(", ")][3:]

    def visit(pairs: DataFrame) -> DataFrame:
        """Searches the pages of (row, query_id, v, d, floor, page). Pages and their queries meet in order: a page comes
        first, then its queries, of which no more than a block is held."""
        counts = pairs.groupBy("page").agg(F.ceil(F.count("*") / TURN).alias("salts"))
        crowded = counts.where("salts > 1")
        salt = F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1)))
        asked = pairs.join(crowded, "page", "left").select("page", salt.alias("salt"), F.struct("row", "query_id", "v", "d", "floor").alias("ask"), F.lit(None).alias("node"))
        stored = paged.join(counts, "page").select("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).alias("ask"), F.struct(*nodes).alias("node"))
        both = stored.unionByName(asked).withColumn("first", F.col("node").isNull())
        both = both.repartition(F.col("page"), F.col("salt")).sortWithinPartitions("page", "salt", "first").select("ask", "node")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            page, held = None, []

            def search() -> pa.RecordBatch:
                ask = pa.concat_arrays(held)
                held.clear()
                ids = ask.field(1).to_numpy(zero_copy_only=False)
                found = search_page(_matrix(ask.field(2), dims), ids, ask.field(4).to_numpy(zero_copy_only=False), ask.field(3).to_numpy(zero_copy_only=False), page, k, longest)
                rows = [(r, q, -e[1], e[0]) for r, q, best in zip(ask.field(0).to_pylist(), ids.tolist(), found) for e in best]
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], ["row", "query_id", "vec_id", "score"])

            for b in batches:
                is_page = b.column(1).is_valid().to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(is_page).tolist() + [len(b)]
                at = 0
                for e in edges:
                    for lo in range(at, e, BLOCK):
                        held.append(b.column(0).slice(lo, min(BLOCK, e - lo)))
                        if sum(map(len, held)) >= BLOCK:
                            yield search()
                    if e < len(b):
                        if held:
                            yield search()
                        page = Page(b.column(1)[e].as_py(), dims)
                    at = e + 1
            if held:
                yield search()

        return both.mapInArrow(run, "row long, query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        """The k best of each query: each step keeps k rows of a query and salt before they meet."""
        entry = F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), F.col("vec_id").alias("i"))
        found = found.select("row", "query_id", entry.alias("e"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
        some = found.groupBy("row", "query_id", "salt").agg(F.slice(F.sort_array(F.collect_list("e")), 1, k).alias("e"))
        return some.groupBy("row", "query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("e"))), 1, k).alias("e"))

    bottom = F.lit(float("-inf"))
    start = queries.select("row", F.col("vec_id").alias("query_id"), "v", bottom.alias("floor")).mapInArrow(to_pivots(True), asks)
    home = start.select("row", "pivot", "d").join(directory, "pivot").groupBy("row").agg(F.min_by("page", F.struct(gap.alias("g"), "lo", "page")).alias("page"))
    first = visit(start.join(home, "row").select("row", "query_id", "v", "d", "floor", "page"))
    kth = best(first).select("row", F.when(F.size("e") == k, -F.element_at("e", k)["s"].cast("double")).otherwise(bottom).alias("floor"))
    asked = queries.join(kth, "row", "left").select("row", F.col("vec_id").alias("query_id"), "v", F.coalesce("floor", bottom).alias("floor"))
    asked = asked.mapInArrow(to_pivots(False), asks)
    pairs = asked.join(directory, "pivot").where(gap <= F.col("reach")).select("row", "query_id", "v", "d", "floor", "page")
    ranked = best(visit(pairs)).select("query_id", F.posexplode("e").alias("r", "e"))
    return ranked.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("e.i").alias("vec_id"), (-F.col("e.s")).cast("long").alias("score"))
