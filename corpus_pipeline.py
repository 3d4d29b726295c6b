"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and encoding, each over all rows of the one before."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import byte_bpe, language_id, line_dedup, mixing, simhash_dedup
from tidewire.llm._common import ready

#: Below this probability of its language a text is in none; equal shares of four languages are 0.25.
LEAST_SCORE = 0.3


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the used ones inside one struct, so that none has the name of an operator's output, and
    how to select the columns of docs again."""
    rest = [c for c in docs.columns if c not in used]
    held = docs.select(*used, F.struct(*rest).alias("row_of_documents")) if rest else docs
    return held, [F.col(c) if c in used else F.col("row_of_documents")[c].alias(c) for c in docs.columns]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a letter (``und``) and those whose best language is below LEAST_SCORE.

    Null and empty texts have no letter and go. A null doc_id or lang is no reason to go. Repeated rows all stay or all
    go; an empty table stays empty; columns named as the operator's outputs keep their own values.
    """
    held, columns = _apart(docs, "doc_id", "text", "lang")
    found = language_id.identify(held)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each text by its lines that stay, and n_chars by the new length.

    A null text becomes an empty one. Rows without doc_id lose no line; rows that share one are one document. All rows
    stay; an empty table stays empty; columns named as the operator's outputs keep their own values.
    """
    held, columns = _apart(docs, "doc_id", "text")
    out = line_dedup.dedup_lines(held).select(*columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near copies: five-word shingle sets of Jaccard 0.8 or more.

    Texts without a word are copies of each other. Of rows that share a kept doc_id one stays; rows without doc_id all
    stay. An empty table stays empty; no column is added or replaced.
    """
    return simhash_dedup.keep_one(docs).select(*docs.columns)


def interleave_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents in the order of their sources' schedule: the order of the rows in the written files.

    A source weighs the square root of its rows; a null source is a source of its own. All rows stay, repeated ones
    and those without doc_id too; an empty table stays empty; columns named as the operator's outputs keep their own
    values.
    """
    order = ["mix_slot", "mix_seq"]
    held, columns = _apart(docs, "doc_id", "source")
    return mixing.mix(held).repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the decoded text, and mix_position: the row's place in
    the schedule, which is its place in the files of the stage before, in the order of their names.

    A null text has no ids. All rows stay; an empty table stays empty; columns named as an output are replaced.
    """
    rest = [c for c in docs.columns if c.lower() != "mix_position"]
    placed = docs.select(F.struct(*rest).alias("row"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("k"))
    # as many rows as files, each with its file's first place
    before, offsets = 0, []
    for file, n in sorted(map(tuple, placed.groupBy("file").count().collect())):
        offsets.append((file, before))
        before += n
    first = spark.createDataFrame(offsets, "file string, first long")
    docs = placed.join(F.broadcast(first), "file").select("row.*", (F.col("first") + F.col("k")).alias("mix_position"))
    return byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("source_mixing", interleave_sources),
    ("byte_bpe", encode),
]

#: Kernels, SimHash and BPE are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet in the checkpoint folder and read again."""
    ready(spark)
    folder = os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = os.path.join(folder, f"{k}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
