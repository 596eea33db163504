"""Patch selection and wavelet perturbation of whole images: the 26-number row of an image.

An image is resized to dim_factor * dim_patch, cut into patches, and the patch
of the largest Fourier magnitude is compared with itself less part of its high
frequencies, by a learned backend, its residuals, and the drift of a low-rank
reconstruction. Patches of top magnitude beside it are condensed to one vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import learned
from .features import residual_pairs

_PAIRS = [*(f"{n}_mean" for n in ("image", "diff", "laplace", "sobel")), *(f"{n}_tc" for n in ("image", "diff", "laplace", "sobel", "spectral"))]
_DRIFT = ("bce_loss", "l1_mean", "mse_mean", "kl_loss")
SCHEMA = ", ".join(["img_id long", *(f"{n} double" for n in ("min_warp", "max_warp", "min_base", "max_base", "image_mean_ff", "image_std")), *(f"{n} array<long>" for n in _PAIRS), *(f"{p}{n} double" for p in ("", "perturbed_") for n in _DRIFT), "features_dc array<double>", "selected_patch_idx int", "max_fourier_magnitude double"])


def patchify(a: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Patches (n, size, size, channels) in row order; what doesn't fill one is dropped."""
    ys, xs = range(0, a.shape[0] - size + 1, stride), range(0, a.shape[1] - size + 1, stride)
    return np.stack([a[y : y + size, x : x + size] for y in ys for x in xs]) if ys and xs else np.zeros((0, size, size, a.shape[2]))


def select(patches: np.ndarray, top_k: int) -> tuple[int, float, list[int]]:
    """The patch of the largest Fourier magnitude, that magnitude, and the next ones of the top_k largest."""
    if not len(patches) or top_k < 1:
        raise RuntimeError("no patch to select from")
    mags = [float(np.abs(np.fft.fft2(K.gray709(p))).max()) for p in patches]
    order = sorted(range(len(mags)), key=lambda i: (-mags[i], i))[:top_k]
    return order[0], mags[order[0]], order[1:] or order[:1]


def crop_select(image: np.ndarray, size: int = 512, top_k: int = 5, radius: int = 50) -> tuple[np.ndarray, list[int]]:
    """The top_k tiles whose spectrum departs most and then the top_k whose departs least, and their numbers in row order.

    Tiles cover the image, padded with zeros below and to the right. A tile's
    departure is the distance of its mean Fourier magnitude within the radius
    around the centre from that outside; ties go to the first tile.
    """
    h, w, c = image.shape
    rows, cols = -(-h // size), -(-w // size)
    wide = np.zeros((rows * size, cols * size, c))
    wide[:h, :w] = image
    tiles = wide.reshape(rows, size, cols, size, c).swapaxes(1, 2).reshape(rows * cols, size, size, c)
    y, x = np.ogrid[:size, :size]
    near = (y - size // 2) ** 2 + (x - size // 2) ** 2 <= radius**2
    gaps = []
    for tile in tiles:
        m = np.abs(np.fft.fftshift(np.fft.fft2(K.gray709(tile))))
        gaps.append(abs(m[near].mean() - (m[~near].mean() if not near.all() else 0.0)))
    order = sorted(range(len(gaps)), key=lambda i: (-gaps[i], i))
    least = sorted(range(len(gaps)), key=lambda i: (gaps[i], i))
    chosen = order[:top_k] + least[:top_k]
    return tiles[chosen], chosen


def soften(a: np.ndarray, alpha: float = 0.5, levels: int = 2) -> np.ndarray:
    """a less alpha times its high frequencies, which Haar levels take to be all but the means of 2**levels blocks."""
    s = 2**levels
    h, w = -a.shape[0] % s, -a.shape[1] % s
    p = np.pad(a, ((0, h), (0, w), (0, 0)), mode="symmetric")
    low = p.reshape(p.shape[0] // s, s, p.shape[1] // s, s, -1).mean((1, 3)).repeat(s, 0).repeat(s, 1)[: a.shape[0], : a.shape[1]]
    return a - alpha * (a - low)


def sim_extrema(base: np.ndarray, warp: np.ndarray) -> dict[str, float]:
    """Cosine similarity of matching vectors: mean, mean, and the places of the least and the most similar; zeros if there is none."""
    if len(warp) < len(base):
        raise IndexError("fewer warped vectors than base vectors")
    if not len(base):
        return dict.fromkeys(("min_warp", "max_warp", "min_base", "max_base"), 0.0)
    warp = warp[: len(base)]
    s = (base * warp).sum(-1) / np.maximum(np.linalg.norm(base, axis=-1) * np.linalg.norm(warp, axis=-1), 1e-8)
    return {"min_warp": float(s.mean()), "max_warp": float(s.mean()), "min_base": float(s.argmin()), "max_base": float(s.argmax())}


def drift(x: np.ndarray, rank: int = 8) -> dict[str, float]:
    """Losses between x in [0, 1] and its reconstruction of a low rank, channel by channel."""
    back = np.empty(x.shape)
    for c in range(x.shape[-1]):
        u, s, v = np.linalg.svd(x[..., c], full_matrices=False)
        back[..., c] = (u[:, :rank] * s[:rank]) @ v[:rank]
    q = np.clip(back, 1e-7, 1 - 1e-7)
    logs = lambda a: a - np.log(np.exp(a).sum(-1, keepdims=True))
    lx, lb = logs(x), logs(back)
    return {"bce_loss": float(-(x * np.log(q) + (1 - x) * np.log(1 - q)).mean()), "l1_mean": float(np.abs(x - back).mean()), "mse_mean": float(((x - back) ** 2).mean()), "kl_loss": float((np.exp(lx) * (lx - lb)).sum() / x.shape[0])}


def condense(vectors: np.ndarray, factor: int, top_k: int) -> np.ndarray:
    """Every factor-th value averaged with its neighbours' mean: the mean vector, strided, and cut to top_k values (64 if 0)."""
    mean = vectors.mean(0)
    return mean[::factor][: top_k or 64] if factor > 0 else mean


def row(image: np.ndarray, net: learned.Backend, dim_patch: int = 256, dim_factor: int = 3, top_k: int = 4, alpha: float = 0.5, condense_factor: int = 2) -> dict:
    side = dim_patch * dim_factor
    big = np.stack([K.resize(image[..., c], side, side) for c in range(3)], -1)
    patches = patchify(big, dim_patch, dim_patch)
    at, mag, others = select(patches / 255, top_k)
    x = patches[at]
    y = soften(x, alpha)
    out: dict = sim_extrema(net(x[None]), net(y[None])) | residual_pairs(K.gray709(x))
    out |= drift(x / 255) | {f"perturbed_{k}": v for k, v in drift(y / 255).items()}
    return out | {"features_dc": condense(net(patches[others]), condense_factor, 0).tolist(), "selected_patch_idx": at, "max_fourier_magnitude": mag}


def analyse(images: DataFrame, backend: str = "projection64", **options) -> DataFrame:
    """The wavelet row of each of images(img_id, h, w, channels, data)."""
    make = learned.maker(backend)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = make()
        for b in batches:
            rows = []
            for i, h, w, c, data in zip(*b.columns):
                a = np.asarray(data.values, float).reshape(h.as_py(), w.as_py(), c.as_py())
                rows.append({"img_id": i.as_py(), **row(a if a.shape[-1] == 3 else np.repeat(a[..., :1], 3, -1), net, **options)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.rsplit(" ", 1) for c in SCHEMA.split(", "))])
    cols = [F.col("img_id").cast("long").alias("img_id"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col("channels").cast("int").alias("channels"), F.col("data").cast("array<double>").alias("data")]
    return images.select(*cols).mapInArrow(run, SCHEMA)
