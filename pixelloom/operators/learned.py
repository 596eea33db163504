"""Learned extractors as plug-ins, with stand-ins that need no weights.

A backend maps an array (n, h, w, 3) of images to vectors (n, d); it is made
once in each Python worker. Networks can be registered under their names; the
built-in ones are fixed projections, so plans and tests run anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

Backend = Callable[[np.ndarray], np.ndarray]
_BACKENDS: dict[str, Callable[[], Backend]] = {}
#: Channel means and deviations that pretrained networks expect.
CHANNEL_MEAN, CHANNEL_STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def register(name: str, make: Callable[[], Backend]) -> None:
    _BACKENDS[name] = make


def maker(name: str) -> Callable[[], Backend]:
    """What makes a backend; plans carry it to the workers, which don't know what the driver has registered."""
    if name not in _BACKENDS:
        raise NotImplementedError(f"no backend named {name}; registered: {sorted(_BACKENDS)}")
    return _BACKENDS[name]


def backend(name: str) -> Backend:
    return maker(name)()


def _projection(dim: int, seed: int, side: int = 32) -> Callable[[], Backend]:
    def make() -> Backend:
        w = np.random.default_rng(seed).normal(0, 1 / side, (side * side * 3, dim))

        def run(images: np.ndarray) -> np.ndarray:
            small = np.stack([np.stack([K.resize(im[..., c], side, side) for c in range(3)], -1) for im in images])
            return ((small / 255 - CHANNEL_MEAN) / CHANNEL_STD).reshape(len(images), -1) @ w

        return run

    return make


register("projection768", _projection(768, 1))
register("projection64", _projection(64, 2))


def _size(net: Backend) -> int:
    """The length of a backend's vectors, from a gray image of a size that networks expect."""
    for side in (224, 32, 16):
        try:
            return len(net(np.full((1, side, side, 3), 128.0))[0])
        except ValueError:
            continue
    return 0


def vectors(images: DataFrame, name: str = "projection768", batch: int = 32) -> DataFrame:
    """(img_id, vector) for images(img_id, h, w, channels, data); an image that the backend refuses gives zeros."""
    make = maker(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = make()
        dim = _size(net)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                out = []
                for h, w, c, data in zip(*(part.column(i) for i in range(1, 5))):
                    a = np.asarray(data.values, float).reshape(h.as_py(), w.as_py(), c.as_py())
                    a = a if a.shape[-1] == 3 else np.repeat(a[..., :1], 3, -1)
                    try:
                        v = net(a[None])[0]
                    except ValueError:
                        v = None
                    out.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.zeros(dim) if v is None else v for v in out], pa.list_(pa.float64()))], names=["img_id", "vector"])

    cols = [F.col("img_id").cast("long").alias("img_id"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col("channels").cast("int").alias("channels"), F.col("data").cast("array<double>").alias("data")]
    return images.select(*cols).mapInArrow(run, "img_id long, vector array<double>")


def summary(vectors_: DataFrame, prefix: str) -> DataFrame:
    """Mean and deviation of each vector; an empty one gives nulls."""
    n = F.size("vector")
    mean = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v) / F.when(n > 0, n)
    std = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / F.when(n > 0, n))
    return vectors_.withColumn("m", mean).select("img_id", F.col("m").alias(f"{prefix}_mean"), std.alias(f"{prefix}_std"))


def distances(a: str, b: str) -> dict[str, object]:
    """Cosine distance, L2, largest and mean absolute difference of two array columns."""
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    dot = lambda x, y: total(F.zip_with(x, y, lambda u, v: u * v))
    gap = F.zip_with(a, b, lambda u, v: F.abs(u - v))
    return {"perturb_cosine": 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), "perturb_l2": F.sqrt(dot(gap, gap)), "perturb_max": F.array_max(gap), "perturb_mean": total(gap) / F.size(gap)}


def perturbed(images: DataFrame, sigma: float = 5.0, seed: int = 42) -> DataFrame:
    """Images with Gaussian noise of a fixed seed, clipped to 0 .. 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("data")
            out = []
            for data in b.column(i):
                v = np.asarray(data.values, float)
                out.append(np.clip(v + np.random.RandomState(seed).normal(0, sigma, len(v)), 0, 255))
            yield b.set_column(i, "data", pa.array(out, pa.list_(pa.float64())))

    plain = images.withColumn("data", F.col("data").cast("array<double>"))
    return plain.mapInArrow(run, plain.schema)
