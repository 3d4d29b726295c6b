from pyspark.sql import functions as F

from tidewire.plans.catalogue import QUERIES
from tidewire.streaming.ingest import with_privacy


def test_messages_are_compared_in_all_tasks(spark):
    out = QUERIES["n19_message_similarity"](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_prefixes_are_looked_up_whatever_their_number_and_form(spark):
    packets = spark.createDataFrame(
        [(1, "n", ["0000", "FFFF"], None), (2, "n", ["AB12"], None), (3, "n", ["ab12"], None), (4, "n", ["x"], None), (5, "n", [], "003F00"), (6, "s", ["0000"], None), (7, None, ["0040"], None), (8, "n", [None, "0040"], None), (9, "n", None, None), (10, "n", ["0041"], "0041FF"), (11, "t", ["q"], None)],
        "id int, network string, path_hashes array<string>, src_node_id string",
    )
    prefixes = spark.createDataFrame([("n", p) for p in ("FFFF", "ab12", "x", "003F", "0040", None, "ABCDE")] + [("t", "q"), (None, "0000")], "network string, prefix string")
    out = with_privacy(packets, prefixes)
    assert out.columns == [*packets.columns, "visible"]
    assert {r.id: r.visible for r in out.collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False, 8: False, 9: True, 10: True, 11: False}
    many = spark.range(65536).select(F.lit("n").alias("network"), F.lpad(F.hex("id"), 4, "0").alias("prefix")).where("id % 2 = 0")
    out = with_privacy(packets, many)
    assert "getbit" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.visible for r in out.collect()} == {1: False, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False, 8: False, 9: True, 10: True, 11: True}


def test_paths_are_resolved_once_for_motifs_of_both_lengths(spark):
    out = QUERIES["l02_node_motifs"](spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "int", "int", "string", "bigint", "double"]
