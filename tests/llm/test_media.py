import hashlib
import struct
import zlib

import numpy as np
import pytest

from papyrine.llm import media


def test_payload_is_padded():
    assert media.payload_of(None) == bytes(64) == media.payload_of(b"")
    assert media.payload_of(b"x" * 64) == b"x" * 64
    assert media.payload_of(b"x" * 65) == b"x" * 65 + bytes(63)


def test_round_trip_and_determinism():
    for text in (b"", b"a", "é漢".encode() * 50, bytes(range(256)) * 300):
        payload = media.payload_of(text)
        stored = media.encode_png(payload)
        assert media.decode_png(stored).tobytes() == payload
        assert stored == media.encode_png(payload)
        assert len(media.low_frequency_hash(media.decode_png(stored))) == 8


def plain(kinds, rows, step):
    """The filters' definition, sample by sample."""
    above, out = [0] * rows.shape[1], []
    for kind, row in zip(kinds, rows.tolist(), strict=True):
        now = []
        for i, x in enumerate(row):
            a, b, c = (now[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            near = sorted((abs(a + b - c - v), k) for k, v in enumerate((a, b, c)))[0][1]
            now.append((x + (0, a, b, (a + b) // 2, (a, b, c)[near])[kind]) % 256)
        above = now
        out.append(now)
    return np.array(out, np.uint8)


def test_all_row_filters():
    rng = np.random.default_rng(1)
    for _ in range(200):
        step = int(rng.integers(1, 5))
        rows = rng.integers(0, 256, (int(rng.integers(1, 10)), step * 6), dtype=np.uint8)
        kinds = rng.integers(0, 5, len(rows))
        assert (media.unfilter(kinds, rows, step) == plain(kinds, rows, step)).all()


def test_damage_is_found():
    stored = media.encode_png(media.payload_of(b"some text " * 40))
    for i in range(0, len(stored), 7):
        broken = bytearray(stored)
        broken[i] ^= 1
        with pytest.raises(media.MediaError):
            media.decode_png(bytes(broken))
    with pytest.raises(media.MediaError):
        media.decode_png(stored[:-3])
    header = struct.pack(">IIBBBBB", 64, 1, 16, 0, 0, 0, 0)
    with pytest.raises(media.MediaError):
        media.decode_png(media.SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"IDAT", zlib.compress(bytes(65))) + media._chunk(b"IEND", b""))


def test_operator(odd, none):
    rows = media.store_media(odd).collect()
    assert len(rows) == odd.count()
    for r, source in zip(rows, odd.collect(), strict=True):
        text = (source.text or "").encode()
        payload = media.payload_of(text)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (source.doc_id, len(text), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert media.store_media(none).count() == 0
    back = media.read_media(media.store_media(odd)).collect()
    assert [b.payload for b in back] == [media.payload_of((s.text or "").encode()) for s in odd.collect()] and all(b.error is None for b in back)


def test_read_media_reports_damage(spark):
    rows = media.read_media(spark.createDataFrame([(bytearray(b"no picture"),), (None,)], "media binary")).collect()
    assert all(r.payload is None and r.error for r in rows)


def test_blocks_of_rows_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 123, 64 * 37, dtype=np.uint8))
    whole, image = media.encode_png(text), media.decode_png(media.encode_png(text))
    hashed = media.low_frequency_hash(image)
    rows, kinds = rng.integers(0, 256, (41, 6), dtype=np.uint8), rng.integers(0, 5, 41)
    for block in (1, 2, 7):
        monkeypatch.setattr(media, "BLOCK", block)
        assert zlib.decompress(b"".join(x for k, x in media.chunks(media.encode_png(text)) if k == b"IDAT")) == zlib.decompress(b"".join(x for k, x in media.chunks(whole) if k == b"IDAT"))
        assert media.decode_png(whole).tobytes() == text and media.low_frequency_hash(image) == hashed
        assert (media.unfilter(kinds, rows, 2) == plain(kinds, rows, 2)).all()


def test_feature_by_hand():
    """Area means on a fine grid, then the cosine transform's sums, one by one."""
    rng = np.random.default_rng(6)
    for height in (1, 3, 32, 50):
        image = rng.integers(0, 256, (height, 64), dtype=np.uint8)
        small = np.zeros((32, 32))
        fine = np.repeat(np.repeat(image.astype(float), 32, 0), 32, 1)
        for i in range(32):
            for j in range(32):
                small[i, j] = fine[i * height : (i + 1) * height, j * 64 : (j + 1) * 64].mean()
        found = [sum(small[i, j] * np.cos(np.pi * (2 * i + 1) * u / 64) * np.cos(np.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)) for u in range(8) for v in range(8)]
        found = np.round(found, 6)
        bits = "".join("1" if x > np.median(found) else "0" for x in found)
        assert media.low_frequency_hash(image) == int(bits, 2).to_bytes(8, "big")
