"""Media columns: texts as 8-bit sound, with polyphase resampling, log-mel filterbanks and energy segments."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import binary, ready, replace_columns

STORED_RATE = 16_000
UP, DOWN, TAPS = 5, 8, 16  # to 10 kHz; TAPS for each phase
RATE = STORED_RATE * UP // DOWN
FRAME, HOP, BANDS = 256, 128, 24
PATCH = 64  # frames of a fixed-shape tensor (PATCH, BANDS)
UNIT = 64


def payload(text: bytes | None) -> bytes:
    """The text and zero bytes up to a positive multiple of UNIT."""
    text = text or b""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(samples: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(STORED_RATE)
        w.writeframes(samples)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@cache
def _phases() -> np.ndarray:
    """A windowed-sinc low-pass filter, a row for each phase, taps in reading order."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 0.9 / max(UP, DOWN)
    h = np.sinc(n * cut) * np.hanning(UP * TAPS + 2)[1:-1]
    h *= UP / h.sum()
    return np.stack([h[p::UP][::-1] for p in range(UP)]).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP/DOWN: each output meets only the taps of its phase, never the zeros between."""
    n_out = -(-len(x) * UP // DOWN)
    x = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN + TAPS, np.float32)])
    out = np.empty(n_out, np.float32)
    for r in range(UP):  # outputs r, r+UP, ... read windows DOWN samples apart
        count = len(range(r, n_out, UP))
        first = r * DOWN // UP
        windows = np.lib.stride_tricks.as_strided(x[first:], (count, TAPS), (DOWN * x.itemsize, x.itemsize))
        out[r::UP] = windows @ _phases()[r * DOWN % UP]
    return out


@cache
def _mel() -> np.ndarray:
    def mel(f):
        return 2595 * np.log10(1 + f / 700)

    points = 700 * (10 ** (np.linspace(mel(60.0), mel(RATE / 2), BANDS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / RATE)
    lo, mid, hi = points[:-2, None], points[1:-1, None], points[2:, None]
    return np.maximum(0, np.minimum((bins - lo) / (mid - lo), (hi - bins) / (hi - mid))).astype(np.float32).T


def log_mel(x: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Log filterbank energies and frame energies in dB; frames overlap by half; the last one is padded with zeros."""
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(x)), np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:frames]
    window, bands, energy = np.hanning(FRAME).astype(np.float32), np.empty((frames, BANDS), np.float32), np.empty(frames, np.float32)
    for lo in range(0, frames, block):
        power = np.abs(np.fft.rfft(view[lo : lo + block] * window, axis=1)) ** 2
        bands[lo : lo + block] = np.log(power.astype(np.float32) @ _mel() + 1e-6)
        energy[lo : lo + block] = 10 * np.log10(power.mean(axis=1) + 1e-9)
    return bands, energy


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Spans in seconds that begin above the upper and end below the lower energy threshold (mean +- half a deviation)."""
    mean, half = float(energy.mean()), float(energy.std()) / 2
    mark = np.where(energy > mean + half, 1, np.where(energy < mean - half, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[np.maximum(at, 0)], -1) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]])))
    return [(float(a * HOP / RATE), float(((b - 1) * HOP + FRAME) / RATE)) for a, b in zip(edge[::2], edge[1::2])]


def tensors(bands: np.ndarray) -> tuple[list[np.ndarray], list[tuple[float, float]]]:
    """Flat PATCH x BANDS tensors, the last padded with the floor value, and their spans in seconds."""
    n = max(1, -(-len(bands) // PATCH))
    full = np.full((n * PATCH, BANDS), np.log(np.float32(1e-6)), np.float32)
    full[: len(bands)] = bands
    ends = [min(len(bands), (k + 1) * PATCH) for k in range(n)]
    spans = [(k * PATCH * HOP / RATE, ((e - 1) * HOP + FRAME) / RATE) for k, e in enumerate(ends)]
    return list(full.reshape(n, -1)), spans


def fixed_shape(flat: pa.Array) -> pa.Array:
    """Tensors of a Spark column (flat lists) as an Arrow array of fixed shape (PATCH, BANDS)."""
    kind = pa.fixed_shape_tensor(pa.float32(), (PATCH, BANDS))
    return pa.ExtensionArray.from_storage(kind, flat.cast(kind.storage_type))


def tensor_lists(rows: list[list[np.ndarray]]) -> pa.Array:
    """A list of flat tensors for each row, by way of one fixed-shape array for all of them, which Spark has no type for."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate([t for r in rows for t in r]) if ends[-1] else np.zeros(0, np.float32)
    shaped = fixed_shape(pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), PATCH * BANDS))
    return pa.ListArray.from_arrays(pa.array(ends), shaped.storage.cast(pa.list_(pa.float32())))


def analyse(samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    bands, energy = log_mel(resample(x))
    return bands, segments(energy)


DIGEST = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)
REAL = ", media binary, speech array<struct<start_s:double,end_s:double>>, tensors array<array<float>>, spans array<struct<start_s:double,end_s:double>>"


def audio_features(df: DataFrame, whole: bool = True) -> DataFrame:
    """Stores each text as a WAV file, reads the stored bytes back and adds their features to the row.

    ``feature`` is the number of frames and of energy segments, then each band's mean log energy to three digits.
    With ``whole``, the file, the energy segments, and the flat log-mel tensors (see ``fixed_shape``) with their
    time spans are added too. A null text counts as empty: UNIT zero bytes. Long texts are analysed whole, in
    blocks of frames; equal texts get equal values; an empty table stays empty; columns named as an output are
    replaced.
    """
    ready(df.sparkSession, 500)

    def start():
        def work(texts: pa.Array) -> list:
            rows = []
            for t in binary(texts):
                media = store(payload(t))
                back = load(media)
                bands, speech = analyse(back)
                feature = f"{len(bands)};{len(speech)};" + ",".join(f"{v:.3f}" for v in bands.mean(axis=0, dtype=np.float64))
                row = [len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature]
                if whole:
                    flat, spans = tensors(bands)
                    as_spans = [[{"start_s": a, "end_s": b} for a, b in s] for s in (speech, spans)]
                    row += [media, as_spans[0], flat, as_spans[1]]
                rows.append(row)
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(7 + 4 * whole)]
            if whole:
                columns[-2] = tensor_lists(columns[-2])
            return columns

        return work

    return replace_columns(df, ["text"], DIGEST + REAL * whole, start)
