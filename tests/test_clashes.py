import duckdb

from tidewire.plans import devices
from tidewire.plans.catalogue import QUERIES


def test_clashes_of_many_blocks(spark, tmp_path, monkeypatch, capsys):
    """Ids of one first byte meet by blocks, in one task: pairs joined row by row over few tasks were written digit by digit."""
    monkeypatch.setattr(devices, "BLOCK_IDS", 3)
    path = str(tmp_path / "customer.parquet")
    spark.range(3000).selectExpr("id as c_custkey").write.parquet(path)
    out = QUERIES["q57_prefix_clashes"](spark, str(tmp_path))
    out.explain()
    assert capsys.readouterr().out.count("REPARTITION_BY_NUM") == 2
    ids = duckdb.sql("SELECT upper(md5('n' || CAST(range AS VARCHAR)) || md5('m' || CAST(range AS VARCHAR))) AS id FROM range(3000)")  # noqa: F841
    want = duckdb.sql("SELECT x.id, y.id FROM ids x JOIN ids y ON x.id[1:2] = y.id[1:2] AND x.id < y.id").fetchall()
    assert sorted(map(tuple, out.select("a", "b").collect())) == sorted(want)


def test_ids_are_not_sent_to_every_executor(spark, capsys):
    """The ids were broadcast, as lists of them count for little in Spark's estimate."""
    QUERIES["q57_prefix_clashes"](spark, "/root/testdata/sf0.001").explain()
    assert "Broadcast" not in capsys.readouterr().out
