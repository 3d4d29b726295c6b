"""Ids a digit apart meet by halves, and by masks where many share a half, whatever the case of their letters."""

import pytest

from tidewire.operators import identity


@pytest.mark.parametrize("most", [64, 2])
def test_near_ids_meet(spark, monkeypatch, most):
    monkeypatch.setattr(identity, "MOST_OF_A_HALF", most, raising=False)
    ids = ["A" * 64, "a" * 63 + "B", "A" * 20 + "C" + "A" * 43, "A" * 40 + "DD" + "A" * 22, "F" * 64]
    nodes = spark.createDataFrame([(i, "Hill 1 Node", "north", 2, 50.0, 1.0, 1) for i in ids], "node_id string, name string, network string, role int, lat double, lon double, advert_count long")
    evidence = spark.createDataFrame([], "node_id string, statuses long, self_adverts long, first timestamp_ntz, last timestamp_ntz")
    heard = spark.createDataFrame([], "a string, b string, adverts long")
    want = {(r.a, r.b) for r in identity.assess(nodes, evidence, heard).where("accepted").collect()}
    assert {(r.a, r.b) for r in identity.accepted_pairs(nodes, evidence, heard).collect()} == want and len(want) == 2
