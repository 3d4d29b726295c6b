"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A-Z to a-z on bytes; every other byte stays, so UTF-8 stays valid.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def ready(spark: SparkSession, batch_rows: int = 1000) -> None:
    """Bound an Arrow batch (whole texts can be long) and name a checkpoint folder where the session has none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids that are broadcast at most; of 8 bytes each in a table of longs that is some tens of MB.
BROADCAST_IDS = 1_000_000


def whole_numbers(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")


def _by_ids(df: DataFrame, ids: DataFrame, id: str, how: str) -> DataFrame:
    """A join of df with distinct ids: by broadcast if they are whole numbers and few, else by shuffle."""
    ids = ids.checkpoint()
    few = whole_numbers(df, id) and ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), id, how).select(*df.columns)


def only(df: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """The rows of df whose id is one of ``ids``."""
    return _by_ids(df.where(F.col(id).isNotNull()), ids, id, "left_semi")


def without(df: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """The rows of df whose id is none of ``ids``; rows without an id stay, and never meet in a shuffle."""
    return df.where(F.col(id).isNull()).unionAll(_by_ids(df.where(F.col(id).isNotNull()), ids, id, "left_anti"))


def binary(column: pa.Array) -> list:
    """The UTF-8 bytes of each string, None for null, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def replace_columns(
    df: DataFrame, inputs: list[str], outputs: str | T.StructType, start: Callable[[], Callable[..., list]]
) -> DataFrame:
    """All columns of df plus ``outputs``, computed in Arrow batches from ``inputs``.

    ``start`` runs once in each task and returns the function of a batch: one Arrow array for each input, one
    array or list back for each output. A column of df that has an output's name, in any case, is replaced.
    """
    schema = outputs if isinstance(outputs, T.StructType) else T.StructType.fromDDL(outputs)
    taken = {f.name.lower() for f in schema}
    named = [f.name.lower() for f in df.schema]
    keep = [i for i, n in enumerate(named) if n not in taken]
    at = [named.index(n.lower()) for n in inputs]
    full = T.StructType([df.schema[i] for i in keep] + list(schema))
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            made = work(*(batch.column(i) for i in at))
            arrays = [batch.column(i) for i in keep] + list(made)
            yield pa.RecordBatch.from_arrays(
                [a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, arrow)],
                schema=arrow,
            )

    return df.mapInArrow(run, full)


def fold(column: str = "doc_id", parts: int = 5):
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def pack(data: bytes) -> bytes:
    return zlib.compress(data, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
