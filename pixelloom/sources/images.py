"""Image scans: folders, single files, rows; labels; unions of labelled sources; and an image sink."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

SCHEMA = "img_id long, path string, h int, w int, channels int, data array<double>"


def _decoded(df: DataFrame, strict: bool) -> DataFrame:
    """Rows of Spark's image source as RGB planes; an undecodable file raises if strict, else keeps null data."""
    im = df.select("image.*")
    bad = F.col("nChannels") < 1
    if strict:
        im = im.withColumn("nChannels", F.when(bad, F.raise_error(F.concat(F.lit("cannot decode "), F.col("origin"))).cast("int")).otherwise(F.col("nChannels")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 16):
                out = []
                for key, path, h, w, c, raw in zip(*(x.to_pylist() for x in b.slice(at, 16).columns)):
                    data = None
                    if c and c > 0:
                        a = np.frombuffer(raw, np.uint8).reshape(h, w, c)
                        data = (a[..., [2, 1, 0]] if c >= 3 else np.repeat(a[..., :1], 3, -1)).astype(float).ravel()
                    out.append((key, path, h, w, 3 if data is not None else 0, data))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    key = F.xxhash64("origin").alias("img_id")
    return im.select(key, F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("c"), F.col("data").alias("raw")).mapInArrow(run, SCHEMA)


def read_images(spark: SparkSession, path: str, label: int | None = None, strict: bool = True) -> DataFrame:
    """Images of a folder (not of its subfolders) or of one file, by suffix in any case, with a label column if given.

    Suffixes that the JVM has no reader for, webp among them, come back as undecodable.
    """
    local = path.removeprefix("file://")
    if "://" not in path and not os.path.exists(local):
        raise ValueError(f"no such image file or folder: {path}")
    scan = spark.read.format("image").option("dropInvalid", False).load(path)
    out = _decoded(scan.where(tables.has_image_suffix(F.col("image.origin"))), strict)
    return out if label is None else out.withColumn("label", F.lit(label).cast("int"))


def from_rows(spark: SparkSession, rows: list[dict], label: int | None = None) -> DataFrame:
    """Images from dicts with an `image` array (h, w[, channels]) of 0 .. 255."""
    out = []
    for i, r in enumerate(rows):
        a = np.asarray(r["image"], float)
        a = a[..., None] if a.ndim == 2 else a
        out.append((i, None, *a.shape, a.ravel().tolist()))
    df = spark.createDataFrame(out, SCHEMA)
    return df if label is None else df.withColumn("label", F.lit(label).cast("int"))


def labelled_union(spark: SparkSession, genuine: list[str], synthetic: list[str]) -> DataFrame:
    """All folders, genuine ones (label 0) first, with the folder as source."""
    if not genuine and not synthetic:
        raise ValueError("no source given")
    return tables.union_sources([(read_images(spark, p), p, k) for paths, k in ((genuine, 0), (synthetic, 1)) for p in paths])


def inverted(images: DataFrame) -> DataFrame:
    return images.withColumn("data", F.transform("data", lambda v: 255 - v))


def to_png(a: np.ndarray) -> bytes:
    """An 8-bit RGB or gray PNG."""
    a = a.astype(np.uint8)
    a = a[..., None] if a.ndim == 2 else a
    raw = b"".join(b"\0" + r.tobytes() for r in a)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2 if a.shape[2] == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encoded(images: DataFrame) -> DataFrame:
    """(img_id, png) of images, to be written by any binary sink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            png = [to_png(np.asarray(d.values, float).reshape(h.as_py(), w.as_py(), c.as_py())) for h, w, c, d in zip(*b.columns[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(png, pa.binary())], names=["img_id", "png"])

    return images.select(F.col("img_id").cast("long").alias("img_id"), "h", "w", "channels", F.col("data").cast("array<double>").alias("data")).mapInArrow(run, "img_id long, png binary")
