"""Ranked lexical search: documents in shards of CSR postings with integer impacts, searched term at a time.

A task packs its documents into shards of a bounded number of postings. A shard is one row: its documents' ids, its terms, and
for each term the places of its documents with their impacts. A search adds a query's terms up in one dense array a shard, keeps
the best of each shard, and merges these.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import ASCII_LOWER, binary, ready

#: Terms are the maximal runs of ASCII letters and digits and of all that isn't ASCII; in Java's and Python's patterns.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: On UTF-8 bytes the same runs: every byte of a character beyond ASCII is above 0x7F.
_TERM = regex.compile(TERM.encode())
_GAP = regex.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
SLICE = 1 << 20  # bytes of a text that are held as terms at once
POSTINGS = 1 << 20  # of a shard, above which the next document starts another
QUERY_BYTES = 8 << 20  # of queries that are broadcast at once

SHARD = T.StructType([T.StructField(name, T.BinaryType()) for name in ("ids", "no_id", "terms", "starts", "places", "impacts")])


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists, each of one slice that ends between terms."""
    text = text.translate(ASCII_LOWER)
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text, at, end)
        at = end


def statistics(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms all have."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = length = 0
        for batch in batches:
            for text in binary(batch.column(0)):
                n = sum(map(len, terms(text or b"")))
                documents += n > 0
                length += n
        yield pa.RecordBatch.from_pydict({"documents": [documents], "length": [length]})

    row = docs.select("text").mapInArrow(run, "documents long, length long").agg(F.sum("documents"), F.sum("length")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What an occurrence count is worth in a document of n terms, before the term's weight; below 10^6."""
    m = 75 + (25 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def build_index(docs: DataFrame) -> DataFrame:
    """The shards of all rows that have a term; each row is a document of its own, with whatever id.

    A task holds one shard at a time, and of a long text one slice, besides the counts of its terms.
    """
    ready(docs.sparkSession)
    documents, length = statistics(docs)
    out = to_arrow_schema(SHARD)

    def pack(ids: list, vocabulary: dict[bytes, int], words: list, tfs: list) -> pa.RecordBatch:
        word, tf = np.concatenate(words), np.concatenate(tfs)
        place = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        n = np.array([t.sum() for t in tfs], np.int64)
        order = np.argsort(word, kind="stable")
        starts = np.zeros(len(vocabulary) + 1, np.int64)
        np.cumsum(np.bincount(word, minlength=len(vocabulary)), out=starts[1:])
        impact = impacts(tf, n[place], documents, length).astype(np.uint32)
        id = np.array([i or 0 for i in ids], np.int64)
        no_id = np.array([i is None for i in ids], bool)
        row = [id.tobytes(), no_id.tobytes(), b"\n".join(vocabulary), starts.tobytes(), place[order].tobytes(), impact[order].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vocabulary, words, tfs, held = [], {}, [], [], 0
        for batch in batches:
            for id, text in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
                counts: Counter = Counter()
                for some in terms(text or b""):
                    counts.update(some)
                if not counts:
                    continue
                ids.append(id)
                words.append(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in counts), np.int32, len(counts)))
                tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
                held += len(counts)
                if held >= POSTINGS:
                    yield pack(ids, vocabulary, words, tfs)
                    ids, vocabulary, words, tfs, held = [], {}, [], [], 0
        if ids:
            yield pack(ids, vocabulary, words, tfs)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SHARD)


class _Shard:
    """A shard's arrays, with the places of those of its terms that are asked for."""

    def __init__(self, row: dict, asked):
        self.ids, self.no_id = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["no_id"], bool)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.places, self.impacts = np.frombuffer(row["places"], np.int32), np.frombuffer(row["impacts"], np.uint32)
        self.at = {t: i for i, t in enumerate(row["terms"].split(b"\n")) if t in asked}

    def postings(self, term: bytes) -> tuple[np.ndarray, np.ndarray]:
        i = self.at[term]
        lo, hi = self.starts[i], self.starts[i + 1]
        return self.places[lo:hi], self.impacts[lo:hi].astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores above 0, best first; equal scores by ascending id, those without an id last.

    The partition finds the k-th score; all above it stay, and of those that tie with it the least ids.
    """
    above = np.flatnonzero(score > 0)
    if len(above) > k:
        kth = -np.partition(-score[above], k - 1)[k - 1]
        above = above[score[above] >= kth]
    order = np.lexsort((ids[above], no_id[above], -score[above]))
    return above[order[:k]]


def _shards(batches: Iterator[pa.RecordBatch], asked) -> Iterator[_Shard]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield _Shard({f: batch.column(i)[row].as_py() for i, f in enumerate(SHARD.names)}, asked)


def frequencies(index: DataFrame, asked: set[bytes]) -> dict[bytes, int]:
    """The number of documents that hold each of the terms asked for; under the empty term, of all documents."""
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for shard in _shards(batches, shared.value):
            df[b""] += len(shard.ids)
            for t, i in shard.at.items():
                df[t] += int(shard.starts[i + 1] - shard.starts[i])
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(df), pa.binary()), "df": pa.array(list(df.values()), pa.int64())})

    found = index.mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in found.collect()}


def _search(index: DataFrame, queries: list[tuple[int, Counter]], k: int) -> DataFrame:
    """The best k of each shard for a bounded list of numbered queries."""
    df = frequencies(index, {t for _, q in queries for t in q})
    documents = df.pop(b"", 0)
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
    weighted = [(number, [(t, weight[t] * times) for t, times in q.items() if weight.get(t)]) for number, q in queries]
    shared = index.sparkSession.sparkContext.broadcast((weighted, set(weight)))
    out = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, asked = shared.value
        for shard in _shards(batches, asked):
            score = np.zeros(len(shard.ids), np.int64)
            rows = []
            for number, q in weighted:
                score[:] = 0
                for t, w in q:
                    if t in shard.at:
                        places, worth = shard.postings(t)
                        score[places] += w * worth  # a document is at most once in a term's list
                top = best(score, shard.ids, shard.no_id, k)
                ids = pa.array(shard.ids[top], pa.int64(), mask=shard.no_id[top])
                rows.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(top), number)), ids, pa.array(score[top])], schema=out))
            if rows:
                yield from pa.Table.from_batches(rows).combine_chunks().to_batches()

    return index.mapInArrow(run, "query long, doc_id long, score long")


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """The queries as lists of (item_id, texts), each of bounded bytes; never all of them at once."""
    held, size = [], 0
    for row in queries.toLocalIterator():
        held.append((row["item_id"], row["texts"]))
        size += sum(map(len, row["texts"])) + 64
        if size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, queries: DataFrame, k: int = 20, index: DataFrame | None = None) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item, equal scores by ascending doc_id.

    docs: doc_id and text; queries: item_id and text. A document's score sums, over the item's terms with their repeats, the
    term's weight times the impact; only scores above 0 count. A text that is null or has no term is no document, and an item
    without terms, or whose terms no document holds, has no rows. Each row is a document of its own: repeated rows have a rank each;
    those without doc_id come last of equal scores. Rows that share an item_id are one item with the terms of all its different texts;
    a null item_id is an item too. An empty table gives no rows; other columns don't matter. ``index``: of the same docs, from
    build_index, if it is kept; else it is built and written to the checkpoint folder.
    """
    spark = docs.sparkSession
    ready(spark)
    queries = queries.where("text is not null").groupBy("item_id").agg(F.sort_array(F.collect_set(F.col("text"))).alias("texts"))
    index = build_index(docs).checkpoint() if index is None else index
    kinds = T.StructType().add("query", "long").add("item_id", queries.schema["item_id"].dataType)
    found = None
    for block in _blocks(queries):
        numbered = [(i, sum((Counter(some) for t in texts for some in terms(t.encode())), Counter())) for i, (_, texts) in enumerate(block)]
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], kinds)
        part = _search(index, numbered, k).join(F.broadcast(names), "query")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionAll(part)
    return found if found is not None else spark.createDataFrame([], T.StructType([kinds["item_id"]]).add("rank", T.IntegerType()).add("doc_id", "long").add("score", "long"))
