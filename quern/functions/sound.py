"""Sound: WAV bytes to mono samples at one rate, in Arrow batches."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples a second that all sound is brought to; crossings of zero on either side of a filter's middle; outputs that are made at once.
RATE, ZEROS, BLOCK = 16_000, 16, 1 << 15


def wav(samples: np.ndarray, rate: int = RATE, channels: int = 1) -> bytes:
    """16-bit WAV bytes of samples between -1 and 1, those of the channels by turns."""
    data = np.clip(np.round(np.asarray(samples, np.float64) * 32767), -32768, 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(data))
    return head + data


def _frames(data: bytes, code: int, bits: int) -> np.ndarray | None:
    """Samples between -1 and 1 of PCM with 8, 16, 24 or 32 bits, or floats with 32 or 64."""
    if code == 3 and bits in (32, 64):
        return np.frombuffer(data, f"<f{bits // 8}").astype(np.float64)
    if code != 1 or bits not in (8, 16, 24, 32):
        return None
    if bits == 8:
        return (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        return wide.reshape(-1).view("<i4").astype(np.float64) / 2**31
    return np.frombuffer(data, f"<i{bits // 8}").astype(np.float64) / 2 ** (bits - 1)


def parsed(content: bytes | None) -> tuple[int, np.ndarray] | None:
    """(rate, mono samples) of WAV bytes, channels averaged; None for what isn't WAV or has a form that isn't known. Of a file cut short what is there counts."""
    if not content or len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            form = (struct.unpack_from("<H", body, 24)[0] if code == 0xFFFE and len(body) >= 26 else code, channels, rate, bits)
        elif name == b"data":
            if not form or not form[1] or not form[2] or form[3] % 8 or not form[3]:
                return None
            code, channels, rate, bits = form
            width = channels * bits // 8
            frames = _frames(body[: len(body) // width * width], code, bits)
            return None if frames is None else (rate, frames.reshape(-1, channels).mean(axis=1) if len(frames) else frames)
        at += 8 + size + size % 2
    return None


def resampled(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Samples at another rate, by a windowed sinc: of up / down in lowest terms there are `up` filters, one for each place between two samples that an output can have.

    The cut-off is half of the lower rate, so going down doesn't fold high tones over low ones. Work and memory are in proportion to the outputs, BLOCK at a time."""
    if rate == to or not len(samples):
        return samples
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    scale = min(1.0, to / rate)
    half = math.ceil(ZEROS / scale)
    offsets = np.arange(-half + 1, half + 1)
    distance = offsets[None, :] - np.arange(up)[:, None] / up
    window = np.where(np.abs(distance) < half, np.cos(np.pi * distance / (2 * half)) ** 2, 0.0)
    filters = scale * np.sinc(scale * distance) * window
    padded = np.concatenate((np.zeros(half), samples, np.zeros(half + 1)))
    out = np.empty(-(-len(samples) * up // down))
    for first in range(0, len(out), BLOCK):
        n = np.arange(first, min(len(out), first + BLOCK)) * down
        out[first : first + len(n)] = np.einsum("ij,ij->i", padded[(n // up)[:, None] + offsets + half], filters[n % up])
    return out


def _sound_rows(rate: int):
    def run(batches):
        for batch in batches:
            found = [parsed(x) for x in batch.column(1).to_pylist()]
            samples = [None if f is None else resampled(f[1], f[0], rate) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f and f[0] for f in found], pa.int32()), pa.array([None if s is None else s.astype(np.float32) for s in samples], pa.list_(pa.float32()))], names=["id", "rate", "samples"]
            )

    return run


def sounds(files: DataFrame, id_col: str = "id", content_col: str = "content", rate: int = RATE) -> DataFrame:
    """(id, rate, samples) of WAV files: what rate they had, and their mono samples at the one asked for, a row for each row.

    Missing and broken files have null rate and samples; an empty one has no samples. Repeated rows and null ids pass through; other columns are ignored."""
    rows = files.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("content"))
    return rows.mapInArrow(_sound_rows(rate), f"id {dict(files.dtypes)[id_col]}, rate int, samples array<float>").withColumnRenamed("id", id_col)
