"""Binary media columns: lossless 8-bit greyscale PNG, and perceptual hashes of what is read back.

Texts become images of 64 samples a row. The writer filters rows (none, sub or up, by the least sum of absolute
differences), deflates them and cuts the stream into IDAT chunks with checksums. The reader tests the signature, every chunk's
CRC-32, zlib's Adler-32 and the sizes, undoes all five row filters with numpy, and hands back the samples. The hash keeps the
signs of the 8 x 8 lowest cosine-transform frequencies of the image, resampled by area to 32 x 32, against their median.

Edge cases: null and empty texts are 64 zero bytes; very long texts are filtered, deflated and transformed a block of rows at a time;
equal texts, in repeated rows too, give equal values; of equally good row filters the first of none, sub and up is taken, and a
frequency equal to the median is 0 in the hash; rows with a null doc_id are stored; an empty table gives no rows; further columns of
docs, whatever their names, are not used; damaged media raise MediaError in the codec and give the row an `error` and null features
in read_media().
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
IDAT_BYTES = 1 << 16
#: Rows that are worked on at once.
BLOCK = 4096
#: Samples of a pixel by colour type: grey, RGB, palette index, grey and alpha, RGBA.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class MediaError(ValueError):
    """The bytes are not a PNG that this module reads, or are damaged."""


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, above: np.ndarray | None) -> bytes:
    """Rows with the number of their filter (none, sub or up, by the least sum of absolute differences) in front of each."""
    tried = np.empty((3, *rows.shape), np.uint8)
    tried[0] = rows
    tried[1, :, 0] = rows[:, 0]
    np.subtract(rows[:, 1:], rows[:, :-1], out=tried[1, :, 1:])
    tried[2, 0] = rows[0] if above is None else rows[0] - above
    np.subtract(rows[1:], rows[:-1], out=tried[2, 1:])
    kind = np.abs(tried.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = tried[kind, np.arange(len(rows))]
    return lines.tobytes()


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """An 8-bit greyscale PNG of payload, whose length is a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    deflate, parts = zlib.compressobj(level), []
    for at in range(0, len(rows), BLOCK):
        parts.append(deflate.compress(_filtered(rows[at : at + BLOCK], rows[at - 1] if at else None)))
    body = b"".join([*parts, deflate.flush()])
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", header), *(_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)), _chunk(b"IEND", b"")])


def chunks(data: bytes):
    """(kind, body) of each chunk up to IEND, its CRC-32 tested."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at = 8
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(crc, "big"):
            raise MediaError(f"checksum of chunk {kind!r} at {at}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n
    raise MediaError("no IEND chunk")


def _sequential(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Average (3) and Paeth (4) need each sample's left neighbour first."""
    out, up = row.tolist(), above.tolist()
    for i, x in enumerate(out):
        a, b = (out[i - step] if i >= step else 0), up[i]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            c = up[i - step] if i >= step else 0
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out[i] = (x + guess) & 255
    return np.array(out, np.uint8)


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters. Sub is a running sum along a row, up one down a run of rows; sums wrap at 256 as uint8 does."""
    if kinds.size and kinds.max() > 4:
        raise MediaError(f"row filter {kinds.max()}")
    out = rows.copy()
    sub = np.flatnonzero(kinds == 1)
    for at in range(0, len(sub), BLOCK):
        some = sub[at : at + BLOCK]
        out[some] = np.cumsum(rows[some].reshape(len(some), -1, step), axis=1, dtype=np.uint8).reshape(len(some), -1)
    hard = np.flatnonzero(kinds >= 3)
    cuts = sorted({*hard.tolist(), *range(BLOCK, len(rows), BLOCK), len(rows)})
    start, above = 0, np.zeros(rows.shape[1], np.uint8)
    for cut in cuts:
        if cut > start:
            block, up = out[start:cut], kinds[start:cut] == 2
            if up.any():
                sums = np.cumsum(block, axis=0, dtype=np.uint8)
                base = np.maximum.accumulate(np.where(up, -1, np.arange(cut - start)))
                before = np.zeros((cut - start, rows.shape[1]), np.uint8)
                before[base > 0] = sums[base[base > 0] - 1]
                before[base < 0] = np.uint8(0) - above  # an up run that starts the block continues the row above it
                block[:] = sums - before
            above = out[cut - 1]
        start = cut
        if cut < len(rows) and kinds[cut] >= 3:
            out[cut] = _sequential(int(kinds[cut]), rows[cut], above, step)
            above = out[cut]
            start = cut + 1
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples as (height, width * samples of a pixel) of an 8-bit PNG without interlace."""
    header, body = None, []
    for kind, part in chunks(data):
        if kind == b"IHDR":
            if len(part) != 13:
                raise MediaError("size of IHDR")
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
    if header is None:
        raise MediaError("no IHDR chunk")
    width, height, depth, colour, method, filters, interlace = header
    if depth != 8 or colour not in SAMPLES or method or filters or interlace:
        raise MediaError("only 8-bit PNG without interlace is read")
    step = SAMPLES[colour]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise MediaError(f"IDAT: {e}") from None
    if len(raw) != height * (width * step + 1):
        raise MediaError("IDAT has another size than IHDR says")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * step + 1)
    return unfilter(lines[:, 0], lines[:, 1:], step)


def _cosines(n: int = 32, low: int = 8) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(low)[:, None] / (2 * n))


def _transform(size: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """8 x size: resampling by area to 32, then the 8 lowest cosines; of its columns those from first to last."""
    edges = np.arange(33) * (size / 32)
    at = np.arange(first, size if last is None else last)
    cover = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
    return _cosines() @ (cover / (size / 32))


_cached = lru_cache(maxsize=512)(_transform)


def low_frequency_hash(image: np.ndarray) -> bytes:
    """8 bytes: which of the 64 lowest frequencies exceed their median."""
    n = len(image)
    if n <= BLOCK:
        lowest = (_cached if n <= 2048 else _transform)(n) @ image.astype(np.float64)
    else:
        lowest = sum(_transform(n, at, min(at + BLOCK, n)) @ image[at : at + BLOCK].astype(np.float64) for at in range(0, n, BLOCK))
    coefficients = lowest @ _cached(image.shape[1]).T
    flat = np.round(coefficients.ravel(), 6)
    return np.packbits(flat > np.median(flat)).tobytes()


SCHEMA = "doc_id {id}, n_bytes long, media binary, perceptual binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, error string"


def _features(media: bytes) -> tuple:
    read = decode_png(media)
    payload = read.tobytes()
    return low_frequency_hash(read), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the stored PNG (`media`), its hash (`perceptual`, 8 bytes) and digests of the payload as read back.
    One row for each row of docs; other columns of docs are not used."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            media = [encode_png(payload_of(x)) for x in texts]
            made = list(zip(*map(_features, media), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(made[0], pa.binary()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.string()), pa.array(made[3], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()), pa.nulls(len(texts), pa.string())],
                names=["doc_id", "n_bytes", "media", "perceptual", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "error"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(id=kind))


def read_media(table: DataFrame, column: str = "media") -> DataFrame:
    """`payload`, `perceptual` and `error` for each row's media; damaged or null media give nulls and an error."""
    out = "payload binary, perceptual binary, error string"

    def one(media):
        try:
            if media is None:
                raise MediaError("null")
            image = decode_png(media)
            return image.tobytes(), low_frequency_hash(image), None
        except MediaError as e:
            return None, None, str(e)

    def run(batches):
        for batch in batches:
            rows = list(map(one, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], names=["payload", "perceptual", "error"])

    return table.select(column).mapInArrow(run, out)
