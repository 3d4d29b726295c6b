"""Graph measures over undirected links (a, b)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import shared_folder
from .relational import either_way, shuffled


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a loop."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def degrees(edges: DataFrame) -> DataFrame:
    """node, its degree and the sum of its links' observations."""
    return either_way(edges.select("a", "b", "observed")).groupBy("node").agg(F.count("*").alias("degree"), F.sum("observed").alias("observations"))


def components(edges: DataFrame) -> DataFrame:
    """node and component, the least node reachable: alternating large and small stars until nothing changes."""
    edges = _checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(shuffled(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(least), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = after


def _cut_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Articulation points of one component by depth-first low links, with a stack of our own."""
    near: dict[str, list[str]] = {}
    for a, b in zip(pdf.a, pdf.b):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    cut = set()
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        branches, stack = 0, [(root, None, iter(sorted(near[root])))]
        while stack:
            node, parent, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                stack.pop()
                if stack:
                    low[parent] = min(low[parent], low[node])
                    if parent != root and low[node] >= order[parent]:
                        cut.add(parent)
                    branches += parent == root
            elif nxt not in order:
                order[nxt] = low[nxt] = len(order)
                stack.append((nxt, node, iter(sorted(near[nxt]))))
            elif nxt != parent:
                low[node] = min(low[node], order[nxt])
        if branches > 1:
            cut.add(root)
    return pd.DataFrame({"node": sorted(cut)}, dtype="object")


def articulation_points(edges: DataFrame, most_links: int = 2_000_000) -> DataFrame:
    """Nodes whose loss parts their component. A task holds one component; one beyond ``most_links`` links is refused."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    tagged = edges.join(components(edges), edges.a == F.col("node")).select("a", "b", "component")
    largest = tagged.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > most_links:
        raise ValueError(f"a component has {largest} links; articulation points are found in one task up to {most_links}")
    return tagged.groupBy("component").applyInPandas(_cut_nodes, "node string")


def hops_from(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """node and the least number of hops, up to ``most``, from any start node: one join for each hop."""
    both = either_way(edges.select("a", "b")).distinct()
    reached = start.select("node", F.lit(0).alias("hops"))
    frontier = reached
    for k in range(1, most + 1):
        frontier = frontier.select("node").join(both, "node").select(F.col("peer").alias("node")).distinct().join(reached, "node", "left_anti").select("node", F.lit(k).alias("hops"))
        reached = reached.union(frontier)
    return reached
