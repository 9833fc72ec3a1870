"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Every byte is mapped to one letter, so a token of the vocabulary becomes a piece. A piece's score is
its negative rank, so sentencepiece merges the pair of lowest rank first, leftmost first, which is
what the ranks mean. Normalisation is the identity and no prefix is added. Texts are cut into
pre-tokens by the given pattern, each is encoded by itself, and ids are decoded by the inverse map.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkey.llm.common import arrow_rows, blocks, lean

FIRST_LETTER = 0x100  # byte b is written as the letter U+0100 + b
CACHE_ENTRIES = 150_000
CACHED_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer: a whole number, a 32-bit float or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def letters(token: bytes) -> str:
    return "".join(chr(FIRST_LETTER + b) for b in token)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model; id 0 is unknown, rank r has the id r + 1 in order of ranks."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    pieces = [unknown]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, letters(token).encode()) + _field(2, float(-rank)) + _field(3, 1))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(
        _varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43)  # no ids (-1) for begin, end, pad
    )
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes with a model made by `model_bytes`; `ids` gives the rank of each piece in order."""

    def __init__(self, model: bytes, ids: list[int], pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.ids = ids
        # The inverse map: an id's piece, letter by letter back to bytes.
        self.bytes_of = {i: bytes(ord(c) - FIRST_LETTER for c in self.processor.id_to_piece(k + 1)) for k, i in enumerate(ids)}
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of pre-tokens; the model sees all of them in one call."""
        raw = [p.encode() for p in pieces]
        mapped = (np.frombuffer(b"".join(raw), dtype=np.uint8).astype("<u2") + FIRST_LETTER).tobytes().decode("utf-16-le")
        ends = list(accumulate(map(len, raw)))
        words = [mapped[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        ids = self.ids
        return {p: tuple(ids[k - 1] for k in found) for p, found in zip(pieces, self.processor.encode(words, num_threads=1), strict=True)}

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text. Short pre-tokens are remembered for later calls, long ones for this one."""
        split = [self.split(t) for t in texts]
        known = self.known
        new = list({p for s in split for p in s if p not in known})
        if len(known) + len(new) > CACHE_ENTRIES:
            known.clear()
            new = list({p for s in split for p in s})
        known.update(self.learn(new))
        out = [list(chain.from_iterable(map(known.__getitem__, s))) for s in split]
        for p in new:
            if len(p) > CACHED_CHARS:
                del known[p]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(model: bytes, ids: tuple[int, ...], pattern: str) -> Codec:
    return Codec(model, list(ids), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids themselves) for every text.

    `vocabulary` is the path of a rank file on the driver; the model made from it (about 1 MB) is
    broadcast. Null texts count as empty: no ids, digests of nothing. Repeated rows each give a row,
    an empty table none; columns other than doc_id and text are ignored. Rows are independent, so
    there is no shuffle; memory holds one text, its ids and a bounded cache of short pre-tokens.
    """
    ranks = read_ranks(vocabulary)
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((model_bytes(ranks), tuple(sorted(ranks.values())), pattern))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shipped.value)
        number = {i: str(i) for i in codec.ids}.__getitem__

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 4 + with_ids]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]
        for rows in blocks(((i, t or "") for i, t in arrow_rows(batches)), 1):
            ids = codec.encode_all([t for _, t in rows])
            columns = [
                [i for i, _ in rows],
                [len(x) for x in ids],
                [hashlib.sha256(" ".join(map(number, x)).encode()).hexdigest() for x in ids],
                [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
                ids,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)
        codec.known.clear()  # the worker lives on, perhaps for tasks that encode nothing

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(work), out)
