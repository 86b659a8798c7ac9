"""Media columns: Netpbm and BMP images in binary columns, decoded, resized by area, tiled as NPY, hashed.

Cases: a null or empty medium, or one of another format, decodes to null features; no row raises or is dropped.
Extra columns stay out of the result but for the key. Equal bytes give equal results."""

from __future__ import annotations

import hashlib
import io
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
HASH_ROWS, HASH_COLUMNS = 8, 9
TILE = 32
#: Pixels of a row band whose prefix sums are held at once.
BAND = 1 << 20


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP, rows bottom up, each padded to four bytes."""
    h, w = samples.shape
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), dtype=np.uint8)
    rows[:, :w] = samples[::-1]
    grey = np.arange(256, dtype=np.uint32) * np.uint32(0x010101)
    start = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", start + h * stride, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, h * stride, 2835, 2835, 256, 0) + grey.astype("<u4").tobytes() + rows.tobytes()


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The whole numbers of a Netpbm header, comments skipped, and where the samples begin."""
    found, i = [], 2
    while len(found) < fields:
        c = data[i : i + 1]
        if c == b"#":
            i = data.index(b"\n", i) + 1
        elif c.isdigit():
            j = i
            while data[j : j + 1].isdigit():
                j += 1
            found.append(int(data[i:j]))
            i = j
        elif c.isspace():
            i += 1
        else:
            raise ValueError("bad header")
    return found, i + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P2, P3 (plain) and P4, P5, P6 (raw) to an array of rows, columns and, for colour, channels."""
    kind = data[:2]
    if kind == b"P4":
        (w, h), at = _header(data, 2)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w]
        return (1 - bits) * np.uint8(255)
    (w, h, most), at = _header(data, 3)
    if not 0 < most < 65536:
        raise ValueError("bad maximum")
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    n = math.prod(shape)
    if kind in (b"P2", b"P3"):
        samples = np.array([int(x) for x in data[at:].split()[:n]], dtype=np.int64)
        if ((samples < 0) | (samples > most)).any():
            raise ValueError("a sample out of range")
        return samples.astype(np.uint16 if most > 255 else np.uint8).reshape(shape)
    return np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (with palette), 24-bit and 32-bit BMP; grey palettes give one channel."""
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or depth not in (8, 24, 32) or w <= 0:
        raise ValueError("this BMP is not supported")
    stride = (w * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)[:, : w * depth // 8]
    rows = rows[::-1] if h > 0 else rows
    if depth > 8:
        return rows.reshape(abs(h), w, depth // 8)[:, :, 2::-1]
    palette = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    grey = (palette == palette[:, :1]).all()
    return palette[:, 0][rows] if grey else palette[rows]


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"23456":
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image[:, :, :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resized(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The mean of the source area under each target cell, from the integral image; borders count by their share.

    The integral image is held for a band of rows at a time: a tall image does not need it whole."""
    h, w = image.shape
    x = np.linspace(0, w, columns + 1)
    xi = np.minimum(x.astype(np.int64), w - 1)
    y = np.linspace(0, h, rows + 1)
    yi = np.minimum(y.astype(np.int64), h - 1)
    need = np.unique(np.concatenate([yi, yi + 1]))
    kept: dict[int, np.ndarray] = {0: np.zeros(columns + 1)}
    last, step = np.zeros(columns + 1), max(1, BAND // max(1, w))
    for top in range(0, h, step):
        band = image[top : top + step].astype(np.float64)
        across = np.zeros((len(band), w + 1))
        np.cumsum(band, axis=1, out=across[:, 1:])
        at_x = across[:, xi] + (x - xi) * (across[:, xi + 1] - across[:, xi])
        down = last + np.cumsum(at_x, axis=0)
        for r in need[(need > top) & (need <= top + len(band))]:
            kept[int(r)] = down[r - top - 1]
        last = down[-1]
    corner = np.stack([kept[int(a)] + (b - a) * (kept[int(a) + 1] - kept[int(a)]) for a, b in zip(yi, y, strict=True)])
    total = corner[1:, 1:] - corner[1:, :-1] - corner[:-1, 1:] + corner[:-1, :-1]
    return total / ((h / rows) * (w / columns))


def difference_hash(image: np.ndarray) -> str:
    small = np.rint(area_resized(image, HASH_ROWS, HASH_COLUMNS) * 256)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image)
    return out.getvalue()


def features(data: bytes | None) -> dict:
    """What one stored image gives; all null if it cannot be decoded, whatever its header claims."""
    try:
        image = decode(data or b"")
        plane = grey(image)
        if not plane.size:
            raise ValueError("no pixels")
        flat = image.tobytes()
        tile = np.clip(np.rint(area_resized(plane, TILE, TILE)), 0, 255).astype(np.uint8)
        return {"rows": image.shape[0], "columns": image.shape[1], "samples_sha256": hashlib.sha256(flat).hexdigest(), "tail_crc32": zlib.crc32(flat[-64:]), "tile": npy(tile), "feature": difference_hash(plane)}
    except (ValueError, TypeError, IndexError, OverflowError, MemoryError, struct.error):
        return dict.fromkeys(("rows", "columns", "samples_sha256", "tail_crc32", "tile", "feature"))


_FEATURES = "rows bigint, columns bigint, samples_sha256 string, tail_crc32 bigint, tile binary, feature string"
_ARROW = [("rows", pa.int64()), ("columns", pa.int64()), ("samples_sha256", pa.string()), ("tail_crc32", pa.int64()), ("tile", pa.binary()), ("feature", pa.string())]


def media_features(df: DataFrame, key: str = "id", medium: str = "media") -> DataFrame:
    """key, medium and the features of every stored image."""
    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, {medium} binary, {_FEATURES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = [features(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([g[n] for g in got], t) for n, t in _ARROW)], names=[key, medium, *(n for n, _ in _ARROW)])

    return df.select(key, medium).mapInArrow(run, schema)


def stored(payload: bytes) -> bytes:
    """The payload's bytes as 8-bit samples, 64 to a row: PGM, or BMP where the number of rows is even."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return (encode_pgm if len(samples) % 2 else encode_bmp)(samples)


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, payload_bytes and media: the text's UTF-8, bytes 0 appended to a positive multiple of 64, as an image. Null counts as empty."""
    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, n_bytes bigint, payload_bytes bigint, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                plain = [x.as_py() or b"" for x in part.column(1).cast(pa.binary())]
                padded = [b + bytes(-len(b) % 64 or (0 if b else 64)) for b in plain]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, plain), pa.int64()), pa.array(map(len, padded), pa.int64()), pa.array(map(stored, padded), pa.binary())], names=[key, "n_bytes", "payload_bytes", "media"])

    return df.select(key, text).mapInArrow(run, schema)


def text_image_features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """text_media and media_features in one: the stored bytes are read back before anything is computed from them."""
    media = text_media(df, key, text).select(F.struct(key, "n_bytes", "payload_bytes").alias("of"), "media")
    return media_features(media, "of").select("of.*", "media", *(n for n, _ in _ARROW))
