"""What is learned from counts is learned of ways, each taken once with its number of packets."""

import pytest
from pyspark.sql import functions as F

from tidewire.operators import learning
from tidewire.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["l02_node_transitions", "l02_position_nodes", "l02_position_transitions"])
def test_packets_are_not_walked_or_joined_one_by_one(spark, name):
    """The plan that walks the paths reads ways alone: events were read six times in it, by the one task of their file."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "event_id" not in plan and "c_custkey" not in plan


def test_ways_stand_for_their_packets(spark):
    rows = [(i, "MME", f"2024-01-0{1 + i % 3} 0{i % 8}:00:00", [None, "AB0001"][i % 2], ["CD0002", None][i % 7 == 6], [["AB00", "EF00"], ["EF00"], []][i % 3]) for i in range(60)]
    packets = spark.createDataFrame(rows, "observation_id int, region string, time string, src_node_id string, rx_node_id string, path_hashes array<string>").withColumn("time", F.col("time").cast("timestamp_ntz"))
    nodes = spark.createDataFrame([("AB0001", 50.0, 1.0, None, 2), ("CD0002", 50.1, 1.0, 1.0, 2), ("EF0003", 50.1, 1.1, 2.0, None)], "node_id string, lat double, lon double, elevation_m double, role int")
    links = spark.createDataFrame([("CD0002", "AB0001"), ("AB0001", "EF0003")], "a string, b string")
    ways = learning.travelled(packets)
    assert sum(r.n for r in ways.collect()) == sum(r[4] is not None and len(r[5]) > 0 for r in rows) > ways.count()
    each, once = (learning.routes(learning.resolved(p, nodes, links)) for p in (packets, ways))
    for made in (learning.node_transitions, learning.position_transitions, learning.position_priors, learning.corridor_priors, learning.prefix_priors, learning.node_motifs):
        assert sorted(map(tuple, made(each).collect())) == sorted(map(tuple, made(once).collect())) != []
    total = lambda found: sorted(map(tuple, learning.verified_steps(found).groupBy("region", "quarter", "src", "dst").agg(F.sum("n"), F.max("time")).collect()))
    assert total(each) == total(once)


def test_nodes_of_sources(spark):
    nodes = spark.createDataFrame([("ABCD01",), ("FFFF03",), ("AB0004",)], "node_id string")
    packets = spark.createDataFrame([(["ABCD"], None, "FFFF03"), ([], "AB0004", None)], "path_hashes array<string>, rx_node_id string, src_node_id string")
    assert learning.on_paths(nodes, packets).count() == 2 and learning.on_paths(nodes, packets, sources=True).count() == 3
