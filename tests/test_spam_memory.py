"""Tables of messages never pass through the driver, and a crowded half hour is dealt to several tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions.text import message_similarity
from tidewire.operators import graph, incident_store, spam


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(7)
    bases = ["great offer for all stations tonight see www.deal.com/now", "calling every station of the evening round again", "short one"]
    rows = []
    for k in range(120):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 3, 9])):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh ")
        rows.append((k, 0, rng.choice(["Bob", "bobby", "Zed"]), rng.choice(["n", "s"]), "".join(t), rng.randrange(5000)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, sender string, network string, text string, s long")
    return df.select("conv_id", "turn", "sender", "network", "text", F.timestamp_seconds("s").cast("timestamp_ntz").alias("time"))


def table(df):
    return sorted(map(tuple, df.collect()))


def test_no_table_of_messages_is_broadcast(spark, crowd, capsys):
    found = spam.clusters(crowd)
    made = [found, spam.incidents(found, crowd, 2), incident_store.merged(None, crowd), graph.components(found.select(F.col("conv_id").alias("a"), F.col("turn").alias("b")))]
    for df in made:
        df.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_cells_of_many_sessions_in_several_tasks(crowd, monkeypatch):
    want = table(spam.clusters(crowd))
    monkeypatch.setattr(spam, "CELL_SESSIONS", 2)
    assert table(spam.clusters(crowd)) == want


def test_trigrams_of_a_pair_are_made_once(crowd):
    none = F.array().cast("array<string>")
    plan = crowd.select(message_similarity(F.col("text"), F.col("sender"), none, none).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(1") == 2
