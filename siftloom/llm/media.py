"""Media columns: Netpbm and BMP decoding, area resizing, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Samples in a row of the picture that holds a payload, and sides of a tile.
WIDTH, TILE = 64, 16
#: Rows of a picture that are summed at once.
STRIP = 1 << 14


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """P1 to P6 as (height, width) or (height, width, 3), and its greatest sample; one byte a sample up to maxval 255, else two.  P1 and P4 have 1 for black."""
    kind, at, got = data[:2], 2, []
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm picture")
    while len(got) < (2 if kind in (b"P1", b"P4") else 3):
        m = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d{1,10})(?!\d)").match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        got.append(int(m[1]))
        at = m.end()
    w, h, top = (*got, 1)[:3]
    if top < 1 or top > 65_535:
        raise ValueError("maxval out of range")
    deep = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * deep
    least = {b"P1": n, b"P2": 2 * n - 1, b"P3": 2 * n - 1, b"P4": (w + 7) // 8 * h}.get(kind, n * (2 if top > 255 else 1))
    if len(data) - at < least:  # before any array is made
        raise ValueError("too few samples")
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        words = re.findall(rb"[01]", body) if kind == b"P1" else body.split()
        if len(words) < n or any(len(x) > 5 or not x.isdigit() for x in words[:n]):
            raise ValueError("too few samples, or others than numbers")
        flat = np.array(words[:n], dtype="S5").astype(np.int64) if n else np.empty(0, np.int64)
    elif kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, least, at + 1).reshape(h, (w + 7) // 8), axis=1)
        flat = bits[:, :w].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if n and int(flat.max()) > top:
        raise ValueError("a sample is beyond maxval")
    return flat.reshape((h, w, 3) if deep == 3 else (h, w)).astype(np.uint16 if top > 255 else np.uint8), top


def decode_bmp(data: bytes) -> tuple[np.ndarray, int]:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as (height, width, 3), or (height, width) if its palette is grey, and 255."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP picture")
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (8, 24, 32) or w < 0:
        raise ValueError("BMP kind not supported")
    row = (w * bits // 8 + 3) // 4 * 4
    if start + row * abs(h) > len(data):
        raise ValueError("too few samples")
    px = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8]
    px = px if h < 0 else px[::-1]
    if bits == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        if 14 + head + 4 * n > len(data) or px.size and int(px.max()) >= n:
            raise ValueError("the palette is too short")
        pal = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
        grey = (pal == pal[:, :1]).all()
        return (pal[:, 0][px] if grey else pal[px]), 255
    return px.reshape(abs(h), w, bits // 8)[:, :, 2::-1], 255


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The samples of a picture and the greatest that its kind allows; ValueError or struct.error if it can't be read."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: bytes, width: int = WIDTH) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def encode_npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
    return out.getvalue()


def area_resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area below each target pixel, from an integral image read at fractional corners.

    The integral image is kept for STRIP rows at a time, its last row carried on.
    """
    h, w = img.shape
    xs, ys = np.linspace(0, w, width + 1), np.linspace(0, h, height + 1)
    x0 = np.minimum(xs.astype(np.int64), w - 1)
    fx = xs - x0
    carry, sums = np.zeros(w + 1), np.empty((height + 1, width + 1))
    for top in range(0, h, STRIP):
        part = img[top : top + STRIP]
        integral = np.zeros((len(part) + 1, w + 1))
        np.cumsum(part, axis=0, out=integral[1:, 1:], dtype=np.float64)
        np.cumsum(integral[:, 1:], axis=1, out=integral[:, 1:])
        integral += carry
        last = top + len(part)
        for j in np.nonzero((ys >= top) & ((ys < last) | (last == h)))[0]:
            y0 = min(int(ys[j]) - top, len(part) - 1)
            line = integral[y0] + (ys[j] - top - y0) * (integral[y0 + 1] - integral[y0])
            sums[j] = line[x0] + fx * (line[x0 + 1] - line[x0])
        carry = integral[-1]
    area = (h / height) * (w / width)
    return np.diff(np.diff(sums, axis=0), axis=1) / area


def difference_hash(img: np.ndarray) -> str:
    """64 bits, row by row: whether a pixel of the 8 x 9 picture is darker than its right neighbour."""
    small = np.round(area_resize(img, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def grey(img: np.ndarray) -> np.ndarray:
    return img if img.ndim == 2 else img.mean(axis=2)


NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def media_row(data: bytes | None, tile: int = TILE) -> tuple:
    """What is read from a stored picture, in the order of NAMES; nulls if it can't be read or has no pixels.  Tiles and features see samples scaled to 0 to 255."""
    try:
        img, top = decode(data or b"")
    except (ValueError, struct.error):
        img, top = np.empty((0, 0)), 255
    if not img.size:
        return (None,) * len(NAMES)
    raw, g = img.tobytes(), grey(img)
    g = g if top == 255 else g * (255.0 / top)
    small = np.clip(np.rint(area_resize(g, tile, tile)), 0, 255).astype(np.uint8)
    return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(g), encode_npy(small)


def media_features(media: DataFrame) -> DataFrame:
    """media: doc_id, n_bytes, media (binary); other columns are ignored.

    One row for each row of media: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32 (of the last WIDTH samples' bytes), media_bytes,
    media_sha256, feature (difference hash), tile (NPY of TILE x TILE bytes).  A
    null or unreadable picture, or one without pixels, has nulls instead.
    """
    run = lambda c: {"doc_id": c["doc_id"], "n_bytes": c["n_bytes"]} | dict(zip(NAMES, zip(*map(media_row, c["media"]))))
    return common.arrow_map(media.select("doc_id", "n_bytes", "media"), run, SCHEMA)


def text_pictures(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text; other columns are ignored.  The UTF-8 bytes of each text, with zeros to a positive multiple of WIDTH, as a grey Netpbm picture.

    A null text is empty and gives one row of zeros; repeated rows stay repeated;
    equal texts give equal pictures; an empty table gives no rows.
    """

    def one(text: bytes | None) -> bytes:
        text = text or b""
        return encode_pgm(text + bytes(-len(text) % WIDTH if text else WIDTH))

    run = lambda c: {"doc_id": c["doc_id"], "n_bytes": [len(t or b"") for t in c["text"]], "media": list(map(one, c["text"]))}
    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def stored_media(docs: DataFrame) -> DataFrame:
    """Pictures of the texts, written to the shared folder, read back and measured."""
    return media_features(common.kept(text_pictures(docs), "media"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stored_media(common.documents(spark, sf_dir))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return out.select(*names, F.sha2("tile", 256).alias("tile_sha256"))
