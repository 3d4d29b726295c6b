"""Small files that make much work are dealt to all tasks."""

import duckdb
import numpy as np
import pytest

from tidewire.operators import rf
from tidewire.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["f05_line_of_sight", "f02_path_profiles", "f02_prefix_losses"])
def test_rows_are_dealt_to_all_tasks(spark, capsys, name):
    QUERIES[name](spark, SF).explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_sights_of_any_key(spark, tmp_path):
    path = str(tmp_path / "supplier.parquet")
    spark.createDataFrame([(-7,), (0,), (40,), (1641,)], "s_suppkey long").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{path}/*.parquet'")
    got = QUERIES["f05_line_of_sight"](spark, str(tmp_path)).select("site_id", "ray", "reach_km", "runs").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT site_id, ray, reach_km, runs FROM ({ORACLE_SQL['f05_line_of_sight']})").fetchall())


def test_rays_of_one_length_are_computed_together():
    rng = np.random.default_rng(2)
    d, h = np.cumsum(rng.uniform(50, 300, (9, 7)), axis=1), rng.uniform(0, 90, (9, 7))
    tx, rx = rng.uniform(1, 9, 9), rng.uniform(1, 9, 9)
    loss, worst = rf.prefix_loss(d, h, tx, rx)
    for i in range(9):
        alone = rf.prefix_loss(d[i : i + 1], h[i : i + 1], tx[i : i + 1], rx[i : i + 1])
        np.testing.assert_array_equal(loss[i], alone[0][0])
        np.testing.assert_array_equal(worst[i], alone[1][0])
