"""Media columns: Netpbm and BMP images to arrays, area-resized tiles as NPY, difference hashes."""

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

from .common import read, text_batches

#: A text becomes an image of rows of eight RGB pixels, in blocks of eight rows: 192 bytes.
WIDTH, BLOCK = 8, 192
TILE = 32
_HEAD = re.compile(rb"^P([1-6])((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)")


def encode_ppm(pixels: np.ndarray) -> bytes:
    """A height x width x 3 array of 8-bit samples as binary Netpbm."""
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """The same array as an uncompressed 24-bit BMP."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    m = _HEAD.match(data)
    if not m:
        raise ValueError("bad Netpbm header")
    kind, w, h, at = int(m[1]), int(m[3]), int(m[5]), m.end()
    most, depth = 1, 3 if kind in (3, 6) else 1
    if kind not in (1, 4):
        n = re.compile(rb"(?:\s+|#[^\n]*\n)+(\d+)").match(data, at)
        most, at = int(n[1]), n.end()
    if kind in (1, 2, 3):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = [c - 48 for c in body if c in b"01"] if kind == 1 else body.split()
        flat = np.array(values[: w * h * depth], np.int64)
    elif kind == 4:
        flat = np.unpackbits(np.frombuffer(data, np.uint8, -(-w // 8) * h, at + 1).reshape(h, -1), axis=1)[:, :w].ravel().astype(np.int64)
    else:
        flat = np.frombuffer(data, np.uint8 if most < 256 else ">u2", w * h * depth, at + 1)
    if flat.size != w * h * depth:
        raise ValueError("image is cut short")
    if kind in (1, 4):
        flat, most = 1 - flat, 1
    if most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    return flat.astype(np.uint8).reshape(h, w, depth)


def _bmp(data: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or bits not in (8, 24, 32) or (packing == 3 and bits != 32) or w <= 0:
        raise ValueError("unsupported BMP")
    row = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        table = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        return np.ascontiguousarray(table[rows[:, :w]])
    return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])


def decode(data: bytes | None) -> np.ndarray | None:
    """A height x width x channels array of 8-bit samples; null for anything but a whole Netpbm or BMP image."""
    if not data:
        return None
    try:
        pixels = _bmp(data) if data[:2] == b"BM" else _netpbm(data) if data[:1] == b"P" else None
    except (ValueError, struct.error, IndexError, TypeError):
        return None
    return pixels if pixels is not None and pixels.size else None


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the area each new pixel covers, by an integral image; borders that cut a pixel take their part of it."""
    h, w, c = pixels.shape
    table = np.zeros((h + 1, w + 1, c))
    table[1:, 1:] = pixels.astype(np.float64).cumsum(axis=0).cumsum(axis=1)

    def along(t: np.ndarray, n: int, m: int) -> np.ndarray:  # t at m + 1 even cuts of n pixels
        at = np.arange(m + 1) * (n / m)
        lo = np.minimum(at.astype(np.int64), n - 1)
        part = (at - lo).reshape(-1, *[1] * (t.ndim - 1))
        return t[lo] * (1 - part) + t[lo + 1] * part

    cuts = along(table, h, height)
    cuts = along(cuts.swapaxes(0, 1), w, width).swapaxes(0, 1)
    sums = cuts[1:, 1:] - cuts[:-1, 1:] - cuts[1:, :-1] + cuts[:-1, :-1]
    return np.clip(np.rint(sums * (height * width / (h * w))), 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, hex: is each of 8 x 9 grey cells brighter than its right neighbour."""
    weights = np.array([0.299, 0.587, 0.114]) if pixels.shape[2] == 3 else np.full(pixels.shape[2], 1 / pixels.shape[2])
    grey = np.rint(area_resize(pixels, 8, 9).astype(np.float64) @ weights)
    return np.packbits(grey[:, :-1] > grey[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def _media_rows(tile: int, keep_payload: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                p = decode(data)
                if p is None:
                    rows.append(dict.fromkeys(("height", "width", "channels", "tile", "feature", "payload")))
                else:
                    rows.append({"height": p.shape[0], "width": p.shape[1], "channels": p.shape[2], "tile": npy(area_resize(p, tile, tile)), "feature": difference_hash(p), "payload": p.tobytes() if keep_payload else None})
            col = lambda k, t: pa.array([r[k] for r in rows], t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(col(k, pa.int32()) for k in ("height", "width", "channels")), col("tile", pa.binary()), col("feature", pa.string()), col("payload", pa.binary())],
                names=["id", "media", "height", "width", "channels", "tile", "feature", "payload"],
            )

    return run


def media_columns(images: DataFrame, id_col: str, media_col: str, tile: int = TILE, keep_payload: bool = False) -> DataFrame:
    """(id, media, height, width, channels, tile, feature, payload), a row for each row of images.

    tile is the image area-resized to tile x tile, as NPY bytes; feature its difference hash; payload the
    decoded samples, if asked for. Null or undecodable media: null in all that is derived. Repeated rows and
    null ids pass through; extra columns are ignored.
    """
    text_batches(images.sparkSession)
    rows = images.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return rows.mapInArrow(_media_rows(tile, keep_payload), "id long, media binary, height int, width int, channels int, tile binary, feature string, payload binary").withColumnsRenamed({"id": id_col, "media": media_col})


def _image_rows(batches):
    for batch in batches:
        out = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            text = text or b""
            text += b" " * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))
            out.append(encode_ppm(np.frombuffer(text, np.uint8).reshape(-1, WIDTH, 3)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["id", "n_bytes", "media"])


def text_images(docs: DataFrame) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, filled with blanks to a multiple of 192, as a binary Netpbm image."""
    text_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(_image_rows, "id long, n_bytes long, media binary")


def _digest_rows(tile: int):
    decoded = _media_rows(tile, True)

    def run(batches):
        for batch in batches:
            for out in decoded([pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["id", "media"])]):
                media, payload = out.column("media").to_pylist(), out.column("payload").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(p) for p in payload], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payload]), pa.array([zlib.crc32(p[-16:]) for p in payload], pa.int64()),
                     pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), out.column("feature"), pa.array([hashlib.sha256(t).hexdigest() for t in out.column("tile").to_pylist()])],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"],
                )

    return run


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what media_columns' decoder reads back from each text's stored image."""
    stored = text_images(read(spark, sf_dir, "documents", "doc_id", "text"))
    return stored.mapInArrow(_digest_rows(TILE), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")
