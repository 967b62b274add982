import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from siftloom.llm import media
from helpers import EDGE, docs, prose


def bmp(px, bits, palette=None, down=False):
    h, w = px.shape[:2]
    rows = [r.tobytes() for r in (px if down else px[::-1])]
    rows = [r + bytes(-len(r) % 4) for r in rows]
    pal = b"" if palette is None else b"".join(bytes([b, g, r, 0]) for r, g, b in palette)
    head = struct.pack("<IiiHHIIiiII", 40, w, -h if down else h, 1, bits, 0, 0, 0, 0, 0 if palette is None else len(palette), 0)
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(pal)) + head + pal + b"".join(rows)


def test_netpbm_kinds():
    r = np.random.default_rng(1)
    g, c = r.integers(0, 256, (5, 11)), r.integers(0, 256, (4, 3, 3))
    b = r.integers(0, 2, (3, 13))
    deep = r.integers(0, 1000, (2, 4))
    text = lambda a: " ".join(map(str, a.ravel().tolist())).encode()
    cases = [
        (b"P5\n# c\n11 5\n255\n" + g.astype(np.uint8).tobytes(), g, 255),
        (b"P2 11 5 255 # here\n" + text(g), g, 255),
        (b"P6 3 4 255\n" + c.astype(np.uint8).tobytes(), c, 255),
        (b"P3 3 4\n255 " + text(c), c, 255),
        (b"P4 13 3\n" + np.packbits(b.astype(np.uint8), axis=1).tobytes(), b, 1),
        (b"P1 13 3\n" + b"".join(str(x).encode() for x in b.ravel()), b, 1),
        (b"P5 4 2 999\n" + deep.astype(">u2").tobytes(), deep, 999),
        (b"P2 4 2 999\n" + text(deep), deep, 999),
    ]
    for data, want, top in cases:
        got, most = media.decode(data)
        assert (got == want).all() and most == top


def test_bmp_kinds():
    r = np.random.default_rng(2)
    c = r.integers(0, 256, (5, 3, 3)).astype(np.uint8)
    for down in (False, True):
        assert (media.decode(bmp(c[:, :, ::-1], 24, down=down))[0] == c).all()
    four = np.concatenate([c[:, :, ::-1], np.zeros((5, 3, 1), np.uint8)], axis=2)
    assert (media.decode(bmp(np.ascontiguousarray(four), 32))[0] == c).all()
    at = r.integers(0, 4, (3, 5)).astype(np.uint8)
    colours = [(0, 0, 0), (9, 8, 7), (200, 100, 0), (255, 255, 255)]
    assert (media.decode(bmp(at, 8, colours))[0] == np.array(colours)[at]).all()
    greys = [(0,) * 3, (80,) * 3, (160,) * 3, (255,) * 3]
    assert (media.decode(bmp(at, 8, greys))[0] == np.array(greys)[:, 0][at]).all()


BROKEN = [
    None, b"", b"P", b"P7 1 1 1\n\0", b"P5 9999999999 9999999999 255\n\0", b"P5 999999999 999999999 255\n\0", b"P2 2 1 255\n300 1", b"P2 2 1 255\n-1 1", b"P2 1 1 70000\n1", b"P2 2 1 255\n1 x",
    b"P5 2 2 255\n\0\0", b"P5 2", b"P5 0 5 255\n", b"P5 2 1 15\n\x20\0", b"BM", b"BM" + bytes(20), bmp(np.full((2, 2), 7, np.uint8), 8, [(0, 0, 0)]), bmp(np.zeros((2, 2), np.uint8), 8, [(0, 0, 0)])[:-3], b"BM" + bytes([255]) * 60, bytes([255]) * 40,
]


@pytest.mark.parametrize("data", BROKEN)
def test_broken_pictures_are_nulls(data):
    assert media.media_row(data) == (None,) * len(media.NAMES)


def test_area_resize_sums_the_pixels(monkeypatch):
    monkeypatch.setattr(media, "STRIP", 3)
    r = np.random.default_rng(3)
    for h, w, th, tw in ((8, 12, 4, 3), (7, 5, 3, 2), (3, 4, 6, 9), (1, 1, 4, 4), (11, 64, 8, 9)):
        img = r.integers(0, 256, (h, w)).astype(np.float64)
        fine = np.kron(img, np.ones((th, tw)))  # every pixel as th x tw equal ones, so borders fall on whole ones
        want = fine.reshape(th, h, tw, w).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(img, th, tw), want)


def test_samples_are_scaled_by_maxval():
    a = np.arange(16).reshape(4, 4)
    small = media.media_row(b"P2 4 4 15\n" + " ".join(map(str, a.ravel())).encode())
    large = media.media_row(b"P2 4 4 255\n" + " ".join(map(str, (a * 17).ravel())).encode())
    deep = media.media_row(b"P5 4 4 65535\n" + (a * 4369).astype(">u2").tobytes())
    tile = np.load(io.BytesIO(small[-1]))
    assert tile.max() == 255 and small[5:] == large[5:] == deep[5:]


def test_difference_hash():
    ramp = np.tile(np.arange(0, 90), (16, 1))
    assert media.difference_hash(ramp) == "ff" * 8 and media.difference_hash(ramp[:, ::-1]) == "00" * 8 == media.difference_hash(ramp * 0)


def test_texts_round_trip(spark):
    rows = EDGE + [(100 + i, t) for i, t in enumerate(prose(3, 20) + ["x" * 64, "y" * 65, "é" * 5000])]
    got = media.stored_media(docs(spark, rows)).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    same = {(r.media_sha256, r.feature, r.media_bytes) for r in got if r.doc_id in (6, 9)}
    assert len(same) == 1
    assert media.stored_media(docs(spark, [])).count() == 0


def test_features_of_unreadable_rows(spark):
    df = spark.createDataFrame([(1, 3, bytearray(b"P5 9 9 255\n")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r.feature is None and r.tile is None for r in media.media_features(df).collect())
