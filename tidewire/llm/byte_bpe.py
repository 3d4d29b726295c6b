"""Byte-level BPE through sentencepiece: the model is written from a rank file, never trained."""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from ._common import ready, replace_columns

#: Unicode's White_Space property, spelled out: Python's \s also has the separators U+001C to U+001F.
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable and not a space, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary, of fixed size, from a rank file: a line has the token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model in protobuf form: byte-mapped pieces scored by negative rank, identity normalisation."""
    letters = byte_letters()
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    pieces = []
    for r, t in enumerate(tokens):  # a rank that no token has keeps its place
        name = f"<unused {r}>" if t is None else "".join(letters[b] for b in t)
        kind = _field(3, 5) if t is None else b""
        pieces.append(_field(1, _field(1, name.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(r)) + kind))
    pieces.append(_field(1, _field(1, b"<un known>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes pre-tokens one by one, remembering up to ``remember`` of them, and decodes ids by the inverse mapping."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes, remember: int = 200_000):
        for old, new in ((r"[^\s", f"[^{WHITE_SPACE}"), (r"\S", f"[^{WHITE_SPACE}]"), (r"\s", f"[{WHITE_SPACE}]")):
            pattern = pattern.replace(old, new)
        self.split = regex.compile(pattern).findall
        self.ranks, self.remember = ranks, remember
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model)
        self.letters = dict(enumerate(byte_letters()))
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 2)
        for t, r in ranks.items():
            self.bytes[r] = t
        self.known: dict[str, bytes] = {}

    def _ids(self, part: str) -> bytes:
        data = part.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.model.EncodeAsIds(data.decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        parts, known = self.split(text), self.known
        found = list(map(known.get, parts))
        if None in found:
            if len(known) > self.remember:
                known.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = ids = known.get(parts[i]) or self._ids(parts[i])
                    if len(parts[i]) < 64:
                        known[parts[i]] = ids
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(df: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids themselves to every row.

    Each match of ``pattern`` is encoded alone by the ranks in the file ``path``; then the ids are decoded. A null
    text counts as empty, which has no ids. Long texts are encoded whole; repeated rows get equal results; an empty
    table stays empty; columns named as an output are replaced.
    """
    spark = df.sparkSession
    ready(spark, 500)
    ranks = read_ranks(spark, path)
    shared = spark.sparkContext.broadcast((ranks, serialise(ranks)))

    def start():
        codec = Codec(shared.value[0], pattern, shared.value[1])

        def work(texts: pa.Array) -> list:
            counts, ids_sha, text_sha, kept = [], [], [], []
            for t in texts.to_pylist():
                ids = codec.encode(t or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
            return [counts, ids_sha, text_sha, *([kept] if keep_ids else [])]

        return work

    names = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return replace_columns(df, ["text"], names, start)
