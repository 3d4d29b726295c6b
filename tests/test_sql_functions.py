"""SQL functions equal their Column forms."""

import datetime as dt

from pyspark.sql import functions as F

from tidewire.functions import columns as C
from tidewire.functions.sql import register
from tidewire.sources import wire


def test_scalars_equal_columns(spark):
    register(spark)
    register(spark)
    rows = [(1, 5.0, 50.0, -3.0, 51.0, 2.0, dt.datetime(2024, 1, 1, 0, 13, 9)), (2, -5.0, 0.0, 0.0, 0.0, 180.0, dt.datetime(1999, 12, 31, 23, 59, 59)), (3, 500.0, 90.0, 0.0, -90.0, 0.0, None), (4, None, None, 1.0, 2.0, None, None)]
    df = spark.createDataFrame(rows, "id int, x double, a double, b double, c double, d double, t timestamp_ntz")
    sql = spark.sql("SELECT id, tw_clamp(x, 0, 10) AS clamp, round(tw_km(a, b, c, d), 9) AS km, round(tw_flat_km(a, b, c, d), 9) AS flat, tw_time_bin(t, 7) AS bin, tw_has_position(a, b) AS placed, round(tw_free_space_db(x), 9) AS fs FROM {d}", d=df)
    a, b, c, d = (F.col(n) for n in "abcd")
    own = df.select("id", C.clamp(F.col("x"), 0, 10).alias("clamp"), F.round(C.haversine_km(a, b, c, d), 9).alias("km"), F.round(C.flat_km(a, b, c, d), 9).alias("flat"), C.time_bin(F.col("t"), 7).alias("bin"), C.has_position(a, b).alias("placed"), F.round(C.free_space_db(F.col("x")), 9).alias("fs"))
    assert [str(tuple(r)) for r in sql.orderBy("id").collect()] == [str(tuple(r)) for r in own.orderBy("id").collect()]
    assert [r[0] for r in spark.sql("SELECT tw_link_key(x, y) FROM VALUES ('a', 'b'), ('b', 'a'), (NULL, 'a') AS t(x, y)").collect()] == ["a:b", "a:b", None]


def test_frames_equal_columns(spark):
    register(spark)
    rows = ["0541abcdaabb", "041122334402a1b2aabb", "0600aabb", "05c1abcdabcdaabb", "0541abcd", "xyz", "05", "", None, "0541ABCDAABB1", " 0541abcdaabb", "0700000000", "04112233"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, raw_hex string")
    names = ["route", "payload_type", "transport", "hash_size", "hop_count", "path_hashes"]
    own = wire.decode_frame(df).where("route is not null").select("id", *names).collect()
    sql = spark.sql("SELECT d.id, w.* FROM {d} d, LATERAL tw_frame(d.raw_hex) w", d=df).collect()
    assert sorted(map(str, own)) == sorted(map(str, sql)) and len(own) >= 3


def test_paths_are_cut_and_trimmed(spark):
    register(spark)
    rows = [(1, ["aa11", "bb22", "cc33"], 9, "CC33FF"), (2, ["aa11", "b", "cc33"], 2, None), (3, ["cc33"], None, "CC33FF"), (4, None, 3, None), (5, [], 3, None), (6, ["aa11"], -1, None)]
    df = spark.createDataFrame(rows, "id int, p array<string>, hops int, rx string")
    got = spark.sql("SELECT d.id, x.pos, x.hash FROM {d} d, LATERAL tw_path(d.p, d.hops, 2, d.rx) x", d=df).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "AA11"), (1, 2, "BB22"), (2, 1, "AA11"), (3, 1, "CC33")]
