from pyspark.sql import functions as F

from tidewire.operators import learning
from tidewire.sources import domain


def test_nodes_that_paths_can_lead_over(spark):
    nodes = spark.createDataFrame([("ABCD01",), ("ABCE02",), ("FFFF03",), ("AB0004",)], "node_id string")
    packets = spark.createDataFrame([(["ABCD", " ff "], "AB0004"), ([], None), (None, "FF")], "path_hashes array<string>, rx_node_id string")
    assert sorted(r[0] for r in learning.on_paths(nodes, packets).collect()) == ["AB0004", "ABCD01"]
    assert sorted(r[0] for r in learning.on_paths(nodes, packets, (2, 4)).collect()) == ["AB0004", "ABCD01", "FFFF03"]


def test_walks_are_dealt_to_all_tasks(spark, capsys):
    """One small partition of ways would be walked by one task."""
    nodes = spark.createDataFrame([("AB0001", 50.0, 1.0, 1.0, 2), ("CD0002", 50.1, 1.0, 1.0, 2)], "node_id string, lat double, lon double, elevation_m double, role int")
    packets = spark.createDataFrame([(1, "MME", "t", None, "CD0002", ["AB00"])], "observation_id int, region string, time string, src_node_id string, rx_node_id string, path_hashes array<string>")
    found = learning.resolved(packets, nodes, spark.createDataFrame([("AB0001", "CD0002")], "a string, b string"))
    found.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    assert [(r.observation_id, [h.node_id for h in r.hops]) for r in found.collect()] == [(1, ["AB0001"])]


def test_looked_up_ids_are_those_of_numbers(spark):
    n = F.col("id") - 5
    assert spark.range(110).where(~domain.packet_node(n).eqNullSafe(domain.node_id(n))).count() == 0
    assert spark.range(1).select(domain.packet_node(F.lit(None).cast("long"))).first()[0] is None
