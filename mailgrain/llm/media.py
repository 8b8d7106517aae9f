"""Media columns: Netpbm and BMP images decoded to numpy arrays, resized by area, and written as NPY tiles with difference hashes.

Decoders: PBM, PGM and PPM in plain and raw form (8 and 16 bits), and uncompressed BMP of 1, 4, 8, 24 and 32 bits. Area
resizing uses integral images, so each target pixel costs four look-ups whatever it covers. The difference hash compares
neighbouring pixels of a 9 x 8 reduction. Tables of images go through ``decode_media``; texts are first stored as images.

Defined results: null and empty texts are 64 zero bytes; equal texts have equal values; an image that can't be decoded gives
nulls and its error; repeated rows stay; null doc_ids stay null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, free_names, table, written

UNIT = 64
STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height long, width long, tile binary"
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 → height x width (x 3) array; one bit per sample becomes 0 (ink) and 255, samples of a largest value below 255 are scaled to it, and 16-bit samples stay as they are."""
    kind, at, head = raw[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(raw, at)
        if not m:
            raise ValueError("short Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height = head[:2]
    top = head[2] if len(head) > 2 else 1
    depth = 3 if kind in (b"P3", b"P6") else 1
    if width < 1 or height < 1 or not 1 <= top <= 65535:
        raise ValueError("bad Netpbm size")
    count = width * height * depth
    if count > 8 * len(raw):  # no kind has more samples than bits
        raise ValueError("short Netpbm data")
    if kind == b"P1":
        bits = re.sub(rb"#[^\n]*\n|\s", b"", raw[at:])
        out = np.frombuffer(bits, np.uint8, count) - 48
        if out.max() > 1:
            raise ValueError("Netpbm bit that is neither 0 nor 1")
    elif kind in (b"P2", b"P3"):
        cells = re.sub(rb"#[^\n]*\n", b" ", raw[at:]).split()[:count]
        if len(cells) < count:
            raise ValueError("short Netpbm data")
        if not all(c.isdigit() and len(c) <= 9 for c in cells):
            raise ValueError("Netpbm sample that is no number")
        out = np.array(cells, np.int64)
    elif kind == b"P4":
        rows = np.frombuffer(raw, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        out = np.unpackbits(rows, axis=1, count=width).ravel()
    else:
        out = np.frombuffer(raw, np.uint8 if top < 256 else ">u2", count, at + 1)
    if kind in (b"P1", b"P4"):
        out = (1 - out) * np.uint8(255)
    else:
        if out.max() > top:
            raise ValueError("Netpbm sample above the largest value")
        if top < 255:
            out = (out.astype(np.int64) * 510 + top) // (2 * top)
    out = out.astype(np.uint8 if top < 256 else np.uint16)
    return out.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP → height x width (x 3, red first) array; grey palettes give one channel."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise ValueError("not BMP")
    start, head = struct.unpack_from("<II", raw, 10)
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", raw, 18)
    if head < 40 or packing or width < 1 or not height or bits not in (1, 4, 8, 24, 32):
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if rows * stride > len(raw):
        raise ValueError("short BMP data")
    data = np.frombuffer(raw, np.uint8, rows * stride, start).reshape(rows, stride)
    if bits <= 8:
        used = struct.unpack_from("<I", raw, 46)[0] or 1 << bits
        palette = np.frombuffer(raw, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
        if bits < 8:
            cells = np.unpackbits(data, axis=1).reshape(rows, -1, bits)
            index = (cells << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, :width]
        else:
            index = data[:, :width]
        out = palette[index]
        if (palette == palette[:, :1]).all():
            out = out[..., 0]
    else:
        out = data[:, : width * bits // 8].reshape(rows, width, bits // 8)[..., 2::-1]
    return np.ascontiguousarray(out[::-1] if height > 0 else out)


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP, rows from the top; the width must be a multiple of four."""
    height, width = samples.shape
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    at = 54 + 1024
    return b"BM" + struct.pack("<IHHI", at + samples.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, -height, 1, 8, 0, samples.size, 2835, 2835, 256, 0) + palette.tobytes() + samples.tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel, by an integral image read at fractional corners."""
    grey = image.mean(2) if image.ndim == 3 else image.astype(np.float64)
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, 0), 1, out=total[1:, 1:])

    def along(a, edges, axis):
        low = np.minimum(edges.astype(int), a.shape[axis] - 2)
        part = edges - low
        shape = [1, 1]
        shape[axis] = -1
        return np.take(a, low, axis) + (np.take(a, low + 1, axis) - np.take(a, low, axis)) * part.reshape(shape)

    corners = along(along(total, np.linspace(0, h, height + 1), 0), np.linspace(0, w, width + 1), 1)
    sums = corners[1:, 1:] - corners[1:, :-1] - corners[:-1, 1:] + corners[:-1, :-1]
    return sums / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    small = area_resize(image, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 16) -> bytes:
    """The image resized to side x side samples of its own type (8 bits, or 16 where it has them), as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, np.iinfo(image.dtype).max).astype(image.dtype))
    return out.getvalue()


def store_payload(data: bytes) -> bytes:
    """Bytes, with zeros up to a positive multiple of 64, as an 8-bit grey image 64 wide: PGM if its height is odd, else BMP."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    samples = np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(-1, UNIT)
    return encode_pgm(samples) if len(samples) % 2 else encode_bmp(samples)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One stored image per document."""

    def run(batches):
        for b in batches:
            data = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array([store_payload(x) for x in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, STORED)


def read_stored(stored: DataFrame) -> DataFrame:
    """Digests, difference hash and NPY tile of each stored image, from its bytes."""

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in range(9)]
            for media in b.column("media").to_pylist():
                image = decode(media)
                payload = image.tobytes()
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), *image.shape[:2], npy_tile(image))
                for c, v in zip(rows, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]], names=[f.split()[0] for f in READ.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)


def decode_media(images: DataFrame, media_col: str = "media", side: int = 16) -> DataFrame:
    """Any table of images with a binary column: adds height, width, channels, tile (NPY), dhash and media_error.

    All rows and columns stay as they are; an added column whose name is taken, in upper or lower case, gets underscores at its end.
    """
    kinds = {"height": "long", "width": "long", "channels": "long", "tile": "binary", "dhash": "string", "media_error": "string"}
    names = free_names(images, *kinds)
    added = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds.values(), strict=True))

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for media in b.column(media_col).to_pylist():
                try:
                    image = decode(media)
                    row = (*image.shape[:2], 1 if image.ndim == 2 else image.shape[2], npy_tile(image, side), difference_hash(image), None)
                except (TypeError, ValueError, OverflowError, struct.error, IndexError) as e:
                    row = (None, None, None, None, None, str(e)[:200] or "unreadable")
                for c, v in zip(rows, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]], names=[*b.schema.names, *names])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema) + ", " + added
    return images.mapInArrow(run, out)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(store_texts(table(spark, sf_dir, "documents")))
    tiles = written(read_stored(stored))  # the NPY tiles are stored too, one a row
    return tiles.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")
