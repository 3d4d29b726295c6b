"""Clusters of messages kept from run to run: new messages join what is stored as if all had come at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfkc, normalised
from ..sources.publication import Publication
from . import spam
from .relational import shuffled

#: Hours without a message after which an incident is closed, and messages that are kept as its evidence.
ONGOING_HOURS, EVIDENCE = 6, 25
_MESSAGE = ["network", "conv_id", "turn", "time", "sender", "text"]


def merged(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """All messages with their cluster, its size, first and last, after new ones came.

    A stored cluster is open if it ends less than JOIN_MINUTES before the first new message of its network and begins less
    than that after the last. No other can be joined by what is new, so only open ones are clustered again, message by message;
    a message that was stored already counts once. Clusters that the new messages link become one, by its first message.
    """
    new = new.select(*_MESSAGE).dropDuplicates(["network", "conv_id", "turn"])
    if stored is None:
        return _clustered(new)
    span = F.make_dt_interval(mins=F.lit(spam.JOIN_MINUTES))
    bounds = new.groupBy(F.col("network").alias("_network")).agg((F.min("time") - span).alias("_lo"), (F.max("time") + span).alias("_hi"))
    near = F.col("network").eqNullSafe(F.col("_network")) & (F.col("last") >= F.col("_lo")) & (F.col("first") <= F.col("_hi"))
    opened = stored.join(bounds, near, "left_semi")
    rest = stored.join(bounds, near, "left_anti")
    again = opened.select(*_MESSAGE).unionByName(new).dropDuplicates(["network", "conv_id", "turn"])
    return rest.unionByName(_clustered(again))


def _clustered(messages: DataFrame) -> DataFrame:
    found = spam.clusters(messages).select("network", "conv_id", "turn", "cluster", "size")
    made = messages.join(shuffled(found), ["network", "conv_id", "turn"])
    ends = made.groupBy("network", "cluster").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    return made.join(shuffled(ends), ["network", "cluster"]).select(*_MESSAGE, "cluster", "size", "first", "last")


def update(store: Publication, new: DataFrame, generation: int) -> bool:
    """One run: the stored clusters with new messages, published as a generation."""
    return store.publish(merged(store.read(), new), generation)


def evidence(members: DataFrame, keys: list[str], representative: str, limit: int = EVIDENCE) -> DataFrame:
    """Of each group ``limit`` messages at most: the first, the first of the representative text, the newest half, then every so
    many-th from the start, then the newest of the rest."""
    w = Window.partitionBy(*keys)
    m = members.withColumns({"_i": F.row_number().over(w.orderBy("time", "conv_id", "turn")) - 1, "_n": F.count("*").over(w)})
    first_of = F.min(F.when(F.col("text") == F.col(representative), F.col("_i"))).over(w)
    sure = (F.col("_n") <= limit) | (F.col("_i") == 0) | (F.col("_i") == first_of) | (F.col("_i") >= F.col("_n") - max(1, limit // 2))
    m = m.withColumn("_sure", F.coalesce(sure, F.lit(False)))
    m = m.withColumn("_left", F.greatest(F.lit(0), limit - F.count_if("_sure").over(w)))
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / F.greatest(F.lit(1), F.col("_left"))))

    def ranked(on: Column, order: Column) -> Column:
        return F.when(on, F.row_number().over(Window.partitionBy(*keys, on).orderBy(order)))

    at = ~F.col("_sure") & (F.col("_i") % stride == 0)
    m = m.withColumn("_step", F.coalesce(ranked(at, F.col("_i")) <= F.col("_left"), F.lit(False)))
    m = m.withColumn("_more", F.col("_left") - F.count_if("_step").over(w))
    rest = ~F.col("_sure") & ~F.col("_step")
    m = m.withColumn("_last", F.coalesce(ranked(rest, -F.col("_i")) <= F.col("_more"), F.lit(False)))
    return m.where("_sure or _step or _last").select(*members.columns)


def incidents(stored: DataFrame, now: Column, least: int = spam.LEAST) -> DataFrame:
    """The incidents of the stored clusters, each active or closed, with how many messages are kept as evidence and the first and last
    of these."""
    found = spam.incidents(stored.select("network", "conv_id", "turn", "cluster", "size"), stored, least)
    closed = F.col("last") <= now - F.make_dt_interval(hours=F.lit(ONGOING_HOURS))
    found = found.withColumn("status", F.when(closed, "closed").otherwise("active"))
    members = stored.drop("size", "first", "last").join(shuffled(found.select("network", "cluster", F.col("text").alias("_said"))), ["network", "cluster"])
    members = members.withColumn("text", normalised(nfkc(F.coalesce("text", F.lit("")))))
    kept = evidence(members, ["network", "cluster"], "_said").groupBy("network", "cluster").agg(F.count("*").alias("evidence"), F.min("time").alias("evidence_from"), F.max("time").alias("evidence_to"))
    return found.join(shuffled(kept), ["network", "cluster"])
