"""Comparison of images: pixels as rows, or pairs of images in batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
THRESHOLD, MOST_PIXELS = 32, 16 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pixel_diff(a: DataFrame, b: DataFrame, key: str, channels: list[str], threshold: int = THRESHOLD) -> DataFrame:
    """One row per image from pixels as rows (key, x, y, channels).

    A pixel that only one image has differs; of others the largest distance of a
    channel decides.  Gives total, mismatched, similarity in percent to two
    places, and the box around the differences (null without any).
    """
    left = a.select(key, "x", "y", *[F.col(c).alias(f"a_{c}") for c in channels], F.lit(1).alias("in_a"))
    right = b.select(key, "x", "y", *[F.col(c).alias(f"b_{c}") for c in channels], F.lit(1).alias("in_b"))
    far = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in channels]) if len(channels) > 1 else F.abs(F.col(f"a_{channels[0]}") - F.col(f"b_{channels[0]}"))
    bad = F.col("in_a").isNull() | F.col("in_b").isNull() | (far > threshold)
    rows = left.join(right, [key, "x", "y"], "full").withColumn("bad", bad)
    edge = lambda f, c: f(F.when(F.col("bad"), F.col(c)))
    sums = rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if("bad").alias("mismatched"), edge(F.min, "x").alias("min_x"), edge(F.max, "x").alias("max_x"), edge(F.min, "y").alias("min_y"), edge(F.max, "y").alias("max_y"))
    return sums.withColumn("similarity", F.round((F.col("total") - F.col("mismatched")) / F.col("total") * 100, 2))


def is_layout_shift(width, height, total, mismatched, min_x, max_x, min_y, max_y):
    """Whether the differences span half of a side and two pixels in a hundred."""
    wide = ((max_x - min_x + 1) * 2 >= width) | ((max_y - min_y + 1) * 2 >= height)
    return wide & (mismatched * 50 >= total)


def rgba_diff(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Rows (key, total, mismatched, similarity, error) from pairs (key, a, b) of structs (width, height, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, a, b in zip(batch["key"], batch["a"], batch["b"], strict=True):
                out.append((key, *_diff(a, b, threshold)))
            yield pd.DataFrame(out, columns=["key", "total", "mismatched", "similarity", "error"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "a", "b").mapInPandas(run, f"key {kind}, total bigint, mismatched bigint, similarity double, error string")


def _diff(a, b, threshold: int) -> tuple:
    images = []
    for x in (a, b):
        if x is None or x["data"] is None or len(x["data"]) != x["width"] * x["height"] * 4:
            return None, None, None, "invalid_image"
        images.append(np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], 4).astype(np.int16))
    height, width = (max(i.shape[k] for i in images) for k in (0, 1))
    total = height * width
    if total > MOST_PIXELS:
        return None, None, None, "too_large"
    if not total:
        return 0, 0, 100.0, None
    h, w = (min(i.shape[k] for i in images) for k in (0, 1))
    same = np.abs(images[0][:h, :w] - images[1][:h, :w]).max(axis=2, initial=0) <= threshold
    bad = total - int(same.sum())
    return total, bad, round((total - bad) / total * 100, 2), None


def encode_png(width: int, height: int, rgba: bytes) -> bytes:
    """A PNG of 8-bit RGBA with unfiltered lines."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + rgba[i * width * 4 : (i + 1) * width * 4] for i in range(height))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and RGBA of an 8-bit RGB or RGBA image that is not interlaced."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise ValueError("unsupported PNG")
    width, height, step = head[0], head[1], 4 if head[3] == 6 else 3
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width * step + 1)
    above = np.zeros(width * step, np.uint8)
    out = np.empty((height, width, step), np.uint8)
    for y in range(height):
        above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
        out[y] = above.reshape(width, step)
    if step == 3:
        out = np.concatenate((out, np.full((height, width, 1), 255, np.uint8)), axis=2)
    return width, height, out.tobytes()


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(line) + step, np.int32)
    up = np.concatenate((np.zeros(step, np.int32), above.astype(np.int32)))
    for i in range(step, len(out)):
        a, b, c = int(out[i - step]), int(up[i]), int(up[i - step])
        if kind == 3:
            guess = (a + b) // 2
        else:
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out[i] = (int(line[i - step]) + guess) & 255
    return out[step:].astype(np.uint8)


def _mapped(rows: DataFrame, key: str, inner: list[str], make, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [make(*x) for x in zip(*(batch[c] for c in inner), strict=True)]
            out = pd.DataFrame(made, columns=names)
            out.insert(0, "key", batch["key"].to_numpy())
            yield out

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), *inner).mapInPandas(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def encoded(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, png) of images (key, width, height, rgba); null where the sizes do not fit."""
    good = lambda w, h, d: d is not None and w > 0 and h > 0 and len(d) == w * h * 4
    return _mapped(rows, key, ["width", "height", "rgba"], lambda w, h, d: (encode_png(int(w), int(h), bytes(d)) if good(w, h, d) else None,), "png binary")


def decoded(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, width, height, rgba, error) of files (key, png); error tells of files that cannot be read."""

    def one(png):
        try:
            return (*decode_png(bytes(png)), None)
        except (TypeError, ValueError, struct.error, zlib.error):
            return None, None, None, "invalid_image"

    return _mapped(rows, key, ["png"], one, "width int, height int, rgba binary, error string")
