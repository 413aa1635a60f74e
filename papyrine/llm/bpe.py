"""Byte-level BPE by a sentencepiece model that is written here, field by field, from a rank file.

The model's pieces are the vocabulary's byte strings with each byte shown as a printable character; a piece's score is its
negative rank, so that sentencepiece merges in the order of the ranks; the normaliser is the identity. Every pre-token (a
match of the pattern) is encoded by itself and kept in a memo of bounded size; ids are turned back into bytes by the
inverse mapping.

Edge cases: null and empty texts have no ids; every text, very long ones too, decodes to its own UTF-8 bytes; of two merges of one
rank in a pre-token the left one is done first; repeated rows and rows with a null doc_id are each encoded; an empty table gives no
rows; further columns of docs, whatever their names, are not used.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

MEMO = 1 << 17
#: Longer pre-tokens are encoded each time rather than kept.
MEMO_CHARS = 64


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one in Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model. Its field numbers: pieces 1 (piece 1, score 2, type 3), trainer 2 (model type 3,
    vocabulary size 4, unknown's id 40, begin, end and padding 41 to 43), normaliser 3 (name 1, dummy prefix 3, extra white
    space 4, escaping 5). The ids are the ranks; the unknown piece that a model must have comes last."""
    shown, by_rank = byte_characters(), sorted(ranks, key=ranks.get)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    none = _varint((1 << 64) - 1)
    pieces = [_field(1, _field(1, "".join(shown[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, piece in enumerate(by_rank)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(by_rank)) + b"".join(_varint(n << 3) + none for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def ascii_split(pattern: str):
    """The pattern for ASCII texts, by the faster module of the standard library."""
    return re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace("?A-Za-z+", "?[A-Za-z]+").replace("?0-9+", "?[0-9]+"), re.ASCII).findall


class Codec:
    """Encoder and decoder of one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.pieces = sorted(ranks, key=ranks.get)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.split = regex.compile(pattern).findall
        self.split_ascii = ascii_split(pattern)
        self.shown = dict(enumerate(byte_characters()))
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _encode(self, pre_tokens: list[str]) -> list[tuple[int, ...]]:
        mapped = [x.encode().decode("latin-1").translate(self.shown) for x in pre_tokens]
        return [tuple(x) for x in self.model.encode(mapped, num_threads=1)]

    def encode(self, text: str) -> list[int]:
        parts = self.split_ascii(text) if text.isascii() else self.split(text)
        got = list(map(self.memo.get, parts))
        if None in got:
            found, new = {}, []
            for x in {x for x, ids in zip(parts, got, strict=True) if ids is None}:
                if (ids := self.older.get(x)) is None:
                    new.append(x)
                else:
                    found[x] = ids
            found.update(zip(new, self._encode(new), strict=True))
            got = [found[x] if ids is None else ids for x, ids in zip(parts, got, strict=True)]
            self.memo.update((x, ids) for x, ids in found.items() if len(x) <= MEMO_CHARS)
            if len(self.memo) > MEMO:  # what isn't asked for until the next turn is forgotten
                self.older, self.memo = self.memo, {}
        return list(chain.from_iterable(got))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and `ids` (array<int>) of each whole text, in rows as they came."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        made = codec(path, pattern)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                some = batch.slice(part, 512)
                ids = [made.encode(x or "") for x in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and `data` (binary): the bytes that the ids stand for; null ids give null."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        made = codec(path, pattern)
        for batch in batches:
            data = [None if x is None else made.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, data binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, `ids` (array<int>) of each whole text and the digest of the bytes decoded from them, in rows as they came."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        made = codec(path, pattern)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                some = batch.slice(part, 512)
                ids = [made.encode(x or "") for x in some.column(1).to_pylist()]
                back = [hashlib.sha256(made.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, the digest of the ids and that of the bytes decoded from them, in one pass over the texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        made = codec(path, pattern)
        names = list(map(str, range(len(made.pieces))))
        for batch in batches:
            n, sums, back = [], [], []
            for text in batch.column(1):
                ids = made.encode(text.as_py() or "")
                n.append(len(ids))
                sums.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(made.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
