"""Merges and exports on plain files: no table format is assumed."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, named by spark.checkpoint.dir; a new local one only in local mode without a name."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


_MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


def merge_aggregate(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Old rows updated by new ones: one row for a key, each column merged by sum, min or max, or ``latest:column``.

    Both sides are aggregated together, so a null never hides a value and an empty side changes nothing.
    """
    both = old.select(*keys, *rules).unionByName(new.select(*keys, *rules))

    def merged(name: str, rule: str) -> Column:
        if rule.startswith("latest:"):
            return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(rule[7:])))
        return _MERGES[rule](name)

    return both.groupBy(*keys).agg(*[merged(n, r).alias(n) for n, r in rules.items()])


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new that old lacks or has otherwise (``upsert``) and keys only old has (``delete``)."""
    values = [c for c in new.columns if c not in keys]
    both = old.select(*keys, F.struct(*values).alias("was")).join(new.select(*keys, F.struct(*values).alias("now")), keys, "full")
    action = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull() | ~F.col("was").eqNullSafe(F.col("now")), "upsert")
    return both.withColumn("action", action).where("action is not null").select(*keys, "action", "now.*")


def geojson(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """A GeoJSON feature, as text, for each row with a position."""
    rest = [c for c in df.columns if c not in (lat, lon)]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def archive(df: DataFrame, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and those that go as JSON texts."""
    gone = F.coalesce(doomed, F.lit(False))
    return df.where(~gone), df.where(gone).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


def page_after(df: DataFrame, keys: list[str], cursor: list | None, rows: int) -> DataFrame:
    """The next rows in key order after a cursor of key values, one more than asked to show whether others follow."""
    if cursor is not None:
        tests = []
        for k in range(len(keys)):
            same = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(keys[:k], cursor)], F.lit(True))
            tests.append(same & (F.col(keys[k]) > F.lit(cursor[k])))
        df = df.where(reduce(lambda a, b: a | b, tests))
    return df.orderBy(*keys).limit(rows + 1)
