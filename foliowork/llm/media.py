"""Media columns: 8-bit samples stored as Netpbm or BMP, decoded to arrays, resized, tiled and hashed.

The containers are lossless, so a payload read back from them is the payload that was stored. Resizing is by
area: an integral image is read at fractional bounds, so every sample counts by the share of its area that a
target cell covers. The difference hash compares neighbouring cells of a 9 x 8 image.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliowork.llm.shared import read, text_of
from foliowork.llm.shingles import by_bytes

WIDTH = 64
TILE = 64


def write_pgm(pixels: np.ndarray) -> bytes:
    """A grey (h, w) or colour (h, w, 3) array as binary Netpbm."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


def read_netpbm(data: bytes) -> np.ndarray:
    """Decode P5 or P6 with a maximum of 255; comments in the header are skipped."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("the Netpbm header is cut off")
        fields.append(data[at:end])
        at = end
    kind, width, height, most = fields[0], *map(int, fields[1:])
    if kind not in (b"P5", b"P6") or most != 255:
        raise ValueError(f"unsupported Netpbm kind {kind!r} with maximum {most}")
    shape = (height, width) if kind == b"P5" else (height, width, 3)
    return np.frombuffer(data, dtype=np.uint8, count=int(np.prod(shape)), offset=at + 1).reshape(shape)


def write_bmp(pixels: np.ndarray) -> bytes:
    """A grey array as an 8-bit BMP: a grey palette, rows from the bottom, each padded to four bytes."""
    height, width = pixels.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), dtype=np.uint8)
    rows[:, :width] = pixels[::-1]
    palette = np.zeros((256, 4), dtype=np.uint8)
    palette[:, :3] = np.arange(256, dtype=np.uint8)[:, None]
    start = 14 + 40 + 1024
    head = b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 0, 0, 256, 256) + palette.tobytes() + rows.tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    """Decode an uncompressed BMP of 8 bits (through its palette's first channel) or 24 bits, to grey or RGB."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24):
        raise ValueError(f"unsupported BMP of {bits} bits, compression {packed}")
    each = bits // 8
    stride = (width * each + 3) // 4 * 4
    rows = np.frombuffer(data, dtype=np.uint8, count=abs(height) * stride, offset=start).reshape(abs(height), stride)[:, : width * each]
    rows = rows[::-1] if height > 0 else rows
    if bits == 24:
        return rows.reshape(abs(height), width, 3)[:, :, ::-1]
    palette = np.frombuffer(data, dtype=np.uint8, count=start - 14 - head, offset=14 + head).reshape(-1, 4)
    return palette[:, 0][rows]


WRITERS = {"pgm": write_pgm, "bmp": write_bmp}
READERS = {"pgm": read_netpbm, "bmp": read_bmp}


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under every target cell, from an integral image read at fractional bounds."""

    def along(sums: np.ndarray, cells: int) -> np.ndarray:
        """Differences, along the first axis, of running sums at `cells` + 1 even bounds."""
        edges = np.linspace(0, len(sums) - 1, cells + 1)
        low = np.minimum(edges.astype(np.int64), len(sums) - 2)
        part = (edges - low).reshape(-1, *[1] * (sums.ndim - 1))
        return np.diff(sums[low] * (1 - part) + sums[low + 1] * part, axis=0)

    h, w = pixels.shape
    integral = np.zeros((h + 1, w + 1), dtype=np.float64)
    np.cumsum(pixels, axis=0, dtype=np.float64, out=integral[1:, 1:])
    np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])
    return along(along(integral, height).T, width).T * (height * width / (h * w))


def difference_hash(pixels: np.ndarray) -> str:
    """Sixteen hex digits: whether each of 8 x 8 cells is brighter than its right neighbour."""
    small = np.round(area_resize(pixels, 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """A square 8-bit thumbnail as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.round(area_resize(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def payload_of(text: bytes) -> bytes:
    """The bytes with zeros after them, up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def media_columns(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", forms: tuple[str, ...] = ("pgm", "bmp"), with_files: bool = True
) -> DataFrame:
    """Store every text's bytes as images, read the stored bytes back, and compute features from what was read.

    Every form is written and decoded; features come from the first form's samples, and the others must decode to the same.
    Returns the id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    (difference hash and mean) and form_sha256 (of all forms in order, comma-joined), and, if asked for, `media` (the first
    form) and `tile` (an NPY file). Null and
    empty texts give one row of 64 zero samples. Equal texts give equal values; repeated rows and null ids stay;
    other columns are ignored; an empty table gives no rows. A row is held in memory as a whole, nothing more.
    """
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType)])
    for name, kind in (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("form_sha256", "string")):
        schema.add(name, kind)
    if with_files:
        schema.add("media", "binary").add("tile", "binary")
    def row(data: bytes) -> tuple:
        payload = payload_of(data)
        stored = [WRITERS[form](np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)) for form in forms]
        pixels, *others = (READERS[form](x) for form, x in zip(forms, stored, strict=True))
        if not all(np.array_equal(pixels, x) for x in others):
            raise ValueError("the forms decode to different samples")
        media, back = stored[0], np.ascontiguousarray(pixels).tobytes()
        digests = [hashlib.sha256(x).hexdigest() for x in stored]
        feature = f"{difference_hash(pixels)}:{pixels.mean():.4f}"
        values = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), digests[0], feature, ",".join(digests))
        return (*values, media, npy_tile(pixels)) if with_files else values

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            for part in by_bytes(batch, 1):
                rows = [row(x.encode("utf-8")) for x in part.column(1).to_pylist()]
                columns = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return docs.select(docs[id_column].alias("id"), text_of(text_column).alias("text")).mapInArrow(task, schema)


def op8_media(spark, sf_dir):
    made = media_columns(read(spark, sf_dir, "documents"))
    return made.withColumn("tile_sha256", F.sha2("tile", 256)).drop("media", "tile")


QUERIES = {"op8_media": op8_media}
ORACLES: dict[str, str] = {}
