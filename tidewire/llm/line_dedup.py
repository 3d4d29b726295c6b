"""Line deduplication: two Bloom filters find suspected repeats; only these shuffle for exact counts.

The filters are cut into shards by hash, as many as the lines ask for, each in a task of its own: no filter is broadcast
or reaches the driver, and its size has no bound. Where a key is in many documents of one task, these are suspects
already and don't go to its shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ASCII_LOWER, BROADCAST_IDS, binary, fresh, ready, replace_columns, whole_numbers

PROBES = 2
BITS_A_KEY = 16
FLUSH = 1 << 18  # keys that a task holds before it sends them
SHARD_KEYS = 1 << 19  # keys of a shard at most, by the bytes of all texts
MANY = 8  # documents of one task that make a key a suspect at once
HEAVY_PARTS = 5000


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and for each its key if that has ``min_chars`` code points, else None."""
    lines = text.split(b"\n")
    keys = []
    for k in text.translate(ASCII_LOWER).split(b"\n"):
        k = k.strip()
        long = len(k) >= min_chars and (k.isascii() or len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars)
        keys.append(k if long else None)
    return lines, keys


def _positions(keys: np.ndarray, size: int) -> np.ndarray:
    """PROBES positions in a filter of ``size`` for each key of 16 bytes."""
    halves = keys.view("<u8").reshape(-1, 2)
    return np.stack([(halves[:, 0] + np.uint64(i) * (halves[:, 1] | np.uint64(1))) % np.uint64(size) for i in range(PROBES)], axis=1)


def suspects(df: DataFrame, min_chars: int) -> DataFrame:
    """doc_id and the 128-bit hash of each key that two rows at least may hold, once for each task's rows.

    Tasks send each of their keys once, with the documents that hold it, to its shard. A shard's task moves a key that its
    once-seen filter already has to the twice-seen one, and then lets those through that the latter has. False positives
    cost a shuffled row, never an error.
    """
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // ((min_chars + 1) * SHARD_KEYS)
    kind = df.schema["doc_id"].dataType

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders: dict[bytes, list] = {}
        held = turn = 0

        def flush() -> pa.RecordBatch:
            nonlocal turn
            keys = np.frombuffer(b"".join(holders), np.uint8).reshape(-1, 16)
            docs = list(holders.values())
            many = np.fromiter((len(d) > MANY for d in docs), bool, len(docs))
            shard = keys.view("<u8")[:, 1] % np.uint64(shards)
            rows = []
            for s in np.unique(shard).tolist():
                at = np.flatnonzero(shard == s)
                counts = np.array([len(docs[i]) for i in at], np.int32)
                own = [[] if many[i] else docs[i] for i in at]
                rows.append((s, False, keys[at].tobytes(), counts.tobytes(), [d for ds in own for d in ds]))
            for i in np.flatnonzero(many):  # known already: dealt over all shards
                turn += 1
                rows.append((turn % shards, True, keys[i].tobytes(), b"", docs[i]))
            holders.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

        for batch in batches:
            out = pa.schema([("shard", pa.int64()), ("sure", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary()), ("docs", pa.list_(batch.schema.field(0).type))])
            for d, t in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
                for k in {k for k in line_keys(t or b"", min_chars)[1] if k is not None}:
                    holders.setdefault(xxhash.xxh3_128_digest(k), []).append(d)
                    held += 1
                if held >= FLUSH:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    def let_through(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint8).reshape(-1, 16) for k in table.column("keys").to_pylist()]
        counts = [np.frombuffer(c, np.int32) for c in table.column("counts").to_pylist()]
        sure, docs = table.column("sure").to_pylist(), table.column("docs").combine_chunks()
        size = max(64, BITS_A_KEY * sum(len(k) for k, s in zip(keys, sure) if not s))
        once, twice = np.zeros(size, bool), np.zeros(size, bool)
        for k, n, s in zip(keys, counts, sure):
            if not s:
                at = _positions(k, size)
                twice[at[(n > 1) | once[at].all(axis=1)]] = True
                once[at] = True
        picked, found, first = [], [], 0
        ends = docs.offsets.to_numpy() - docs.offsets[0].as_py()
        for row, (k, n, s) in enumerate(zip(keys, counts, sure)):
            if s:
                at = np.arange(ends[row], ends[row + 1])
                picked.append(at)
                found.append(np.repeat(k, len(at), axis=0))
                continue
            n = np.where(n > MANY, 0, n)
            hit = np.repeat(twice[_positions(k, size)].all(axis=1), n)
            picked.append(ends[row] + np.flatnonzero(hit))
            found.append(np.repeat(k, n, axis=0)[hit])
        at = pa.array(np.concatenate(picked))
        hashes = np.concatenate(found).tobytes()
        key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(hashes)]).cast(pa.binary())
        return pa.table({"doc_id": docs.flatten().take(at), "key": key})

    sent = T.StructType().add("shard", "long").add("sure", "boolean").add("keys", "binary").add("counts", "binary").add("docs", T.ArrayType(kind))
    given = df.select("doc_id", "text").where("doc_id is not null").mapInArrow(send, sent)
    return given.groupBy("shard").applyInArrow(let_through, T.StructType().add("doc_id", kind).add("key", "binary"))


def dropped_keys(df: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id and the hashes of the keys whose lines it loses: those in ``min_docs`` documents or more, but for the
    largest doc_id that holds the key."""
    pairs = suspects(df, min_chars).distinct().checkpoint()
    counts = pairs.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    # at most HEAVY_PARTS keys can have this many pairs: they are broadcast, so no key's pairs meet in one task
    heavy_from = max(min_docs, pairs.count() // HEAVY_PARTS + 1)
    counts = counts.checkpoint()
    heavy = F.broadcast(counts.where(F.col("docs") >= heavy_from).select("key", "keeper"))
    light = counts.where(F.col("docs") < heavy_from).select("key", "keeper")
    marked = pairs.join(heavy, "key", "left")
    rest = marked.where("keeper is null").drop("keeper").join(light, "key")
    lost = marked.where("doc_id < keeper").select("doc_id", "key").union(rest.where("doc_id < keeper").select("doc_id", "key"))
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("lost")).checkpoint()


def dedup_lines(df: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drops repeated lines from every text and adds n_lines (before) and n_dropped.

    A line's key is the line without white space at both ends, A-Z lower-cased. A key of ``min_chars`` code points
    that ``min_docs`` documents hold stays only in the largest doc_id among them, where all its lines stay. Rows
    with the same doc_id are one document. A row without doc_id counts for no key and keeps all its lines. A null or
    empty text is one empty line. An empty table stays empty; other columns stay as they are.
    """
    ready(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c.lower() in ("n_lines", "n_dropped")])
    gone = fresh(df, "lost")
    lost = dropped_keys(df, min_chars, min_docs)
    # few lost keys, in bytes too, meet the texts by broadcast; else the texts of the losing documents shuffle
    docs, keys = lost.agg(F.count("*"), F.sum(F.size("lost"))).first()
    few = whole_numbers(df, "doc_id") and docs + (keys or 0) <= BROADCAST_IDS
    joined = df.join((F.broadcast(lost) if few else lost.hint("merge")).withColumnRenamed("lost", gone), "doc_id", "left")

    def start():
        def work(texts: pa.Array, lost: pa.Array) -> list:
            kept, n_lines, n_dropped = [], [], []
            for t, gone in zip(binary(texts), lost.to_pylist()):
                if not gone:
                    kept.append(t or b"")
                    n_lines.append(1 + (t or b"").count(b"\n"))
                    n_dropped.append(0)
                    continue
                gone = set(gone)
                lines, keys = line_keys(t or b"", min_chars)
                stay = [x for x, k in zip(lines, keys) if k is None or xxhash.xxh3_128_digest(k) not in gone]
                kept.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            return [pa.array(kept, pa.binary()).cast(pa.string()), n_lines, n_dropped]

        return work

    out = replace_columns(joined.select(*df.columns, gone), ["text", gone], "text string, n_lines long, n_dropped long", start)
    return out.select(*df.columns, "n_lines", "n_dropped")
