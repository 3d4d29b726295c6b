"""Language identification by string kernels: blended n-gram presence, Nyström landmarks and one-versus-rest ridge."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ._common import ASCII_LOWER, binary, fold, ready, replace_columns

DIMS = 1 << 14
ORDERS = (1, 2, 3)
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_LETTER = regex.compile(r"\p{L}")


def spectrum(text: bytes, out: np.ndarray, piece: int = 1 << 20) -> None:
    """Set out[code] for the hashed n-grams of all orders that occur anywhere in the text."""
    text = text.translate(ASCII_LOWER)
    for lo in range(0, max(1, len(text)), piece):
        b = np.frombuffer(text[lo : lo + piece + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        for n in ORDERS:
            if len(b) < n:
                break
            h = np.full(len(b) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h + b[k : len(b) - n + 1 + k]) * _FACTORS[k]
            out[(h ^ (h >> np.uint32(15))) % np.uint32(DIMS)] = 1


def spectra(texts: list) -> np.ndarray:
    """A unit row for each text; a null or empty text has a row of zeros."""
    x = np.zeros((len(texts), DIMS), np.float32)
    for row, t in zip(x, texts):
        spectrum(t or b"", row)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


@dataclass
class KernelModel:
    labels: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        scores = spectra(texts) @ self.landmarks.T @ self.weights
        e = np.exp(6 * (scores - scores.max(axis=1, keepdims=True)))
        return [self.labels[k] for k in scores.argmax(axis=1)], e.max(axis=1) / e.sum(axis=1)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return regex.search(rb"[A-Za-z]", text) is not None or _LETTER.search(text.decode("utf-8", "replace")) is not None


def sample_labelled(df: DataFrame, per_label: int, parts: int = 128, most_labels: int = 1000) -> DataFrame:
    """Ids, texts and labels of at most ``per_label`` rows of each label, by the hash of the id; of more than
    ``most_labels`` labels, of those with the most rows.

    Only ids and labels take part in the choice. It takes up to per_label/parts ids from each of ``parts`` hash groups, so
    no label gathers in one task. Rows that share an id and a label count once, by their least text.
    """
    h, parts = F.xxhash64("doc_id"), min(parts, per_label)
    keys = df.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    labels = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_labels).select("lang")
    keys = keys.distinct().join(F.broadcast(labels), "lang").withColumns({"part": F.pmod(h, F.lit(parts)), "h": h})
    order = Window.partitionBy("lang", "part").orderBy("h", "doc_id")
    chosen = keys.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label // parts)
    chosen = chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    held = df.select("doc_id", "text", "lang").join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("label")), "left_semi")
    return held.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def fit(train: DataFrame, per_label: int = 512, landmarks_per_label: int = 40, ridge: float = 1e-2) -> KernelModel | None:
    """Learn from at most ``per_label`` rows of each language; None if no row has a label.

    The tasks turn the sampled texts into bit-packed presence vectors of DIMS/8 bytes; only these reach the driver.
    """
    ready(train.sparkSession)

    def start():
        def work(texts: pa.Array) -> list:
            rows = []
            for t in binary(texts):
                x = np.zeros(DIMS, np.uint8)
                spectrum(t or b"", x)
                rows.append(np.packbits(x).tobytes())
            return [rows]

        return work

    made = replace_columns(sample_labelled(train, per_label), ["text"], "bits binary", start)
    rows = sorted((r["lang"], r["doc_id"], bytes(r["bits"])) for r in made.select("doc_id", "lang", "bits").collect())
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    y = np.array([labels.index(r[0]) for r in rows])
    x = np.unpackbits(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    rng = np.random.default_rng(7)
    marks = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:landmarks_per_label] for k in range(len(labels))])
    basis = x[marks]
    value, vector = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    use = value > 1e-6 * value.max(initial=1e-12)
    root = vector[:, use] / np.sqrt(value[use])
    phi = (x @ basis.T).astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(labels)), 1.0, -1.0)
    share = (len(y) / len(labels) / np.bincount(y, minlength=len(labels)))[y][:, None]
    weights = np.linalg.solve(phi.T @ (phi * share) + ridge * len(y) / 100 * np.eye(phi.shape[1]), phi.T @ (target * share))
    return KernelModel(labels, basis, (root @ weights).astype(np.float32))


def predict(df: DataFrame, model: KernelModel | None) -> DataFrame:
    """Adds lang_pred and score to every row, from the whole text alone.

    A null text and one without a letter get ``und`` and score 0, as does every text if there is no model. Repeated
    rows get equal results; an empty table stays empty; columns named as an output are replaced.
    """
    ready(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def work(texts: pa.Array) -> list:
            names, scores, data = [], [], binary(texts)
            for lo in range(0, len(data), 128):
                some = data[lo : lo + 128]
                named, score = model.predict(some) if model else (["und"] * len(some), np.zeros(len(some)))
                for t, n, s in zip(some, named, score):
                    known = model is not None and has_letter(t)
                    names.append(n if known else "und")
                    scores.append(float(min(1.0, s)) if known else 0.0)
            return [names, scores]

        return work

    return replace_columns(df, ["text"], "lang_pred string, score double", start)


def identify(df: DataFrame, **options) -> DataFrame:
    """Learn from the rows outside fold 0 and predict all rows; adds held_out, lang_pred and score."""
    held = fold() == 0
    model = fit(df.where(~held), **options)
    return predict(df, model).withColumn("held_out", held)
