"""Media columns: payloads kept as pixels, with area-resized thumbnails, NPY tiles and difference hashes.

A payload becomes the samples of a binary Netpbm image (P6, 64 pixels or 192 bytes a row). Reading
back decodes the stored bytes to a numpy array; the thumbnail is the exact area mean, taken from an
integral image; the tile is a NumPy ``.npy`` file of that thumbnail; the difference hash compares
neighbouring thumbnail columns. BMP (24 bits, uncompressed) and P5/P6 Netpbm are decoded alike.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

WIDTH = 64
ROW = WIDTH * 3
HASH_ROWS, HASH_COLUMNS = 8, 9
#: Pixel rows that are summed at a time, and bytes of media that go on at a time.
STRIP, CHUNK = 4096, 4 << 20


def encode_ppm(payload: bytes, width: int = WIDTH) -> bytes:
    """A P6 image whose samples are ``payload`` (a positive multiple of ``3 * width`` bytes)."""
    rows, rest = divmod(len(payload), 3 * width)
    if rest or not rows:
        raise ValueError("payload is not a positive number of pixel rows")
    return b"P6\n%d %d\n255\n" % (width, rows) + payload


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP of an (height, width, 3) RGB array."""
    h, w, _ = pixels.shape
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), dtype=np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    head = b"BM" + struct.pack("<IHHI", 54 + h * stride, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * stride, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm_head(data: bytes) -> tuple[list[int], int]:
    found, at = [], 2
    while len(found) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode(data: bytes) -> np.ndarray:
    """Netpbm P5/P6 (8 bits) or 24-bit BMP bytes as an (height, width, channels) uint8 array."""
    if data[:2] in (b"P5", b"P6"):
        (w, h, top), at = _netpbm_head(data)
        if top > 255:
            raise ValueError("only 8-bit samples are supported")
        c = 3 if data[:2] == b"P6" else 1
        return np.frombuffer(data, dtype=np.uint8, count=w * h * c, offset=at).reshape(h, w, c)
    if data[:2] == b"BM":
        (start,) = struct.unpack_from("<I", data, 10)
        w, h, _, bits = struct.unpack_from("<iiHH", data, 18)
        if bits != 24:
            raise ValueError("only 24-bit BMP is supported")
        stride = (3 * w + 3) // 4 * 4
        rows = np.frombuffer(data, dtype=np.uint8, count=abs(h) * stride, offset=start).reshape(abs(h), stride)
        pixels = rows[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
        return pixels[::-1] if h > 0 else pixels
    raise ValueError("neither Netpbm nor BMP")


def _summed(integral: np.ndarray, parts: int) -> np.ndarray:
    """Differences of an integral (zero first, along axis 0) between the ``parts`` + 1 fractional edges."""
    edges = np.arange(parts + 1) * (len(integral) - 1) / parts
    lo = np.minimum(edges.astype(np.int64), len(integral) - 2)
    f = (edges - lo)[:, None]
    return np.diff(integral[lo] * (1 - f) + integral[lo + 1] * f, axis=0)


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Exact area means of an image (height, width, channels), channels averaged, from integrals with fractional edges.

    The integral along the columns is formed for STRIP rows at a time and reduced to ``columns`` sums at once; that
    along the rows holds only these.
    """
    h, w, c = image.shape
    total = np.zeros((h + 1, columns))
    for i in range(0, h, STRIP):
        part = image[i : i + STRIP].sum(axis=2, dtype=np.int64)
        across = np.zeros((w + 1, len(part)))
        np.cumsum(part.T, axis=0, out=across[1:])
        total[i + 1 : i + 1 + len(part)] = _summed(across, columns).T
    np.cumsum(total, axis=0, out=total)
    return _summed(total, rows) / (c * (h / rows) * (w / columns))


def thumbnail(pixels: np.ndarray) -> np.ndarray:
    """The 8 x 9 grey area means of an image, rounded to uint8."""
    return np.rint(area_resize(pixels, HASH_ROWS, HASH_COLUMNS)).astype(np.uint8)


def difference_hash(small: np.ndarray) -> str:
    """16 hex digits: whether each thumbnail sample exceeds its left neighbour, row by row."""
    bits = (small[:, 1:] > small[:, :-1]).astype(np.uint8).ravel()
    return np.packbits(bits).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    """The array as the bytes of a ``.npy`` file."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(a), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes (of the text as UTF-8, unpadded) and ``media``, a P6 image of the text padded with spaces.

    Null text is empty and gives one row of spaces; repeated rows stay; an empty table gives an empty one.
    """

    def encode(keys, texts):
        media, sizes, begin, held = [], [], 0, 0
        for i, t in enumerate(texts):
            raw = (t.as_py() or "").encode()
            sizes.append(len(raw))
            media.append(encode_ppm(raw + b" " * (-len(raw) % ROW if raw else ROW)))
            held += len(media[-1])
            if held > CHUNK or i == len(texts) - 1:
                yield {"__key": keys.slice(begin, len(media)), "n_bytes": sizes, "media": media}
                media, sizes, begin, held = [], [], i + 1, 0

    kind = df.select(key).schema[0].dataType.simpleString()
    return map_arrow(df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")), ["__key", "__text"], f"__key {kind}, n_bytes long, media binary", encode).withColumnRenamed("__key", key)


def media_features(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Adds to key, n_bytes and the stored ``media`` what reading it back gives.

    payload_bytes, payload_sha256 and tail_crc32 describe the decoded samples, media_bytes and
    media_sha256 the stored form, ``tile`` is the thumbnail as NPY bytes and ``feature`` its difference
    hash. Null media gives nulls.
    """

    def read(keys, sizes, stored):
        out = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")}
        for m in stored:
            data = m.as_py()
            if data is None:
                for v in out.values():
                    v.append(None)
                continue
            pixels = decode(data)
            payload, small = pixels.tobytes(), thumbnail(pixels)
            for c, v in (("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-16:])), ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).hexdigest()), ("feature", difference_hash(small)), ("tile", npy(small))):
                out[c].append(v)
        yield {"__key": keys, "n_bytes": sizes, **out}

    kind = df.select(key).schema[0].dataType.simpleString()
    schema = f"__key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return map_arrow(df.select(F.col(key).alias("__key"), "n_bytes", F.col(media).alias("__media")), ["__key", "n_bytes", "__media"], schema, read).withColumnRenamed("__key", key)


def write_tiles(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes key, stored image and NPY tile of every row to Parquet at ``path`` (a folder all executors share)."""
    stored = media_columns(df, key, text)
    media_features(stored, key).write.mode("overwrite").parquet(path)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the stored image and back: sizes, digests and difference hash."""
    stored = media_columns(table(spark, sf_dir, "documents"))
    return media_features(stored).drop("tile")


QUERIES = {"op8_media": op8_media}
ORACLE: dict[str, str] = {}
