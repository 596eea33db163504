"""Image kernels on numpy arrays, for use inside Arrow-batched functions.

Each follows the public definition of the operator it is named after; edges are
mirrored with the edge pixel repeated unless said otherwise.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, cos, exp, floor, pi, sin, sqrt

import numpy as np

SMOOTH = 1e-10


# ---- resampling and colour ----------------------------------------------------------------------

@lru_cache(maxsize=64)
def _bicubic(n: int, m: int) -> np.ndarray:
    """Weights (m, n) that resample n values to m with Keys' kernel, a = -0.5, widened when shrinking."""
    scale = n / m
    support = 2.0 * max(scale, 1.0)
    out = np.zeros((m, n))
    for i in range(m):
        centre = (i + 0.5) * scale
        lo, hi = max(0, int(centre - support + 0.5)), min(n, int(centre + support + 0.5))
        x = np.abs((np.arange(lo, hi) - centre + 0.5) / max(scale, 1.0))
        w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))
        out[i, lo:hi] = w / w.sum()
    return out


def resize(plane: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bicubic resize of a plane of 0 .. 255, rounded to whole numbers after each axis as 8-bit images are."""
    wide = np.clip(np.floor(plane @ _bicubic(plane.shape[1], w).T + 0.5), 0, 255)
    return np.clip(np.floor(_bicubic(plane.shape[0], h) @ wide + 0.5), 0, 255)


def luma(rgb: np.ndarray) -> np.ndarray:
    """ITU-R 601 luma of 0 .. 255 colours, as whole numbers."""
    return np.floor((rgb[..., 0] * 19595 + rgb[..., 1] * 38470 + rgb[..., 2] * 7471 + 0x8000) / 65536)


def gray709(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.2125, 0.7154, 0.0721])


def rgb_to_hsv(rgb: np.ndarray) -> np.ndarray:
    hi, lo = rgb.max(-1), rgb.min(-1)
    span = hi - lo
    safe = np.where(span == 0, 1, span)
    r, g, b = np.moveaxis(rgb, -1, 0)
    hue = np.where(hi == r, ((g - b) / safe) % 6, np.where(hi == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    return np.stack([np.where(span == 0, 0, hue), np.where(hi == 0, 0, span / np.where(hi == 0, 1, hi)), hi], -1)


def hsv_to_rgb(hsv: np.ndarray) -> np.ndarray:
    h, s, v = np.moveaxis(hsv, -1, 0)
    k = (np.array([5.0, 3.0, 1.0]) + h[..., None] * 6) % 6
    return v[..., None] * (1 - s[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1))


_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.95047, 1.0, 1.08883])


def rgb_to_lab(rgb: np.ndarray) -> np.ndarray:
    lin = np.where(rgb > 0.04045, ((np.maximum(rgb, 0) + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    t = lin @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


# ---- filters ------------------------------------------------------------------------------------

def _along(a: np.ndarray, w: np.ndarray, axis: int, mode: str = "symmetric") -> np.ndarray:
    """Correlation with odd weights along an axis."""
    r = len(w) // 2
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r, r)
    p = np.pad(a, pad, mode=mode)
    n = a.shape[axis]
    out = np.zeros(a.shape)
    for k, x in enumerate(w):
        if x:
            out += x * (p[k : k + n] if axis == 0 else p[:, k : k + n])
    return out


def gaussian(a: np.ndarray, sigma: float, mode: str = "symmetric", truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    w = np.array([exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)])
    w /= w.sum()
    return _along(_along(a, w, 0, mode), w, 1, mode)


_DIFF, _SMOOTH3 = np.array([-1.0, 0, 1]), np.array([1.0, 2, 1])


def sobel(a: np.ndarray, axis: int) -> np.ndarray:
    return _along(_along(a, _DIFF, axis), _SMOOTH3, 1 - axis)


def sobel_magnitude(a: np.ndarray) -> np.ndarray:
    return np.hypot(sobel(a, 0), sobel(a, 1))


def laplace(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="symmetric")
    return 4 * a - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:]


def difference_of_gaussians(a: np.ndarray, low: float) -> np.ndarray:
    return gaussian(a, low, "edge") - gaussian(a, 1.6 * low, "edge")


def canny(a: np.ndarray, sigma: float = 1.0, low: float = 0.1, high: float = 0.2) -> np.ndarray:
    """Edges: smoothing that ignores what lies outside, thinning across the gradient, and hysteresis."""
    ones = np.ones(a.shape)
    bleed = gaussian(ones, sigma, "constant")
    s = gaussian(a, sigma, "constant") / (bleed + np.finfo(float).eps)
    gy, gx = sobel(s, 0), sobel(s, 1)
    m = np.hypot(gy, gx)
    h, w = a.shape
    if h < 3 or w < 3:
        return np.zeros(a.shape, bool)
    inner = np.zeros(a.shape, bool)
    inner[1:-1, 1:-1] = True
    p = np.pad(m, 1)
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    ay, ax = np.abs(gy), np.abs(gx)
    same = gy * gx >= 0
    steep = ay >= ax
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.where(steep, np.where(ay > 0, ax / ay, 0), np.where(ax > 0, ay / ax, 0))
    # The two neighbours on each side that the gradient points between.
    sx = np.where(same, 1, -1)
    ahead = np.where(steep, at(1, 0) * (1 - f) + np.where(sx > 0, at(1, 1), at(1, -1)) * f, at(0, 1) * (1 - f) + np.where(sx > 0, at(1, 1), at(-1, 1)) * f)
    behind = np.where(steep, at(-1, 0) * (1 - f) + np.where(sx > 0, at(-1, -1), at(-1, 1)) * f, at(0, -1) * (1 - f) + np.where(sx > 0, at(-1, -1), at(1, -1)) * f)
    peak = inner & (m >= ahead) & (m >= behind) & (m > 0)
    weak, strong = peak & (m >= low), peak & (m >= high)
    labels, n = label(weak, diagonal=True)
    keep = np.zeros(n + 1, bool)
    keep[np.unique(labels[strong])] = True
    keep[0] = False
    return keep[labels]


def label(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, int]:
    """Connected components, numbered in row order of their first pixel."""
    h, w = mask.shape
    idx = np.full((h + 2, w + 2), -1, np.int64)
    idx[1:-1, 1:-1][mask] = np.arange(int(mask.sum()))
    n = int(mask.sum())
    root = np.arange(n)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    here = idx[1:-1, 1:-1]
    links = []
    for dy, dx in steps:
        there = idx[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        ok = (here >= 0) & (there >= 0)
        links.append(np.stack([here[ok], there[ok]], 1))
    links = np.concatenate(links) if links else np.zeros((0, 2), np.int64)
    while len(links):  # hook to the smaller root, then follow roots
        a, b = root[links[:, 0]], root[links[:, 1]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        ok = lo < hi
        if not ok.any():
            break
        np.minimum.at(root, hi[ok], lo[ok])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        links = links[ok]
    names, number = np.unique(root, return_inverse=True)
    out = np.zeros((h, w), np.int64)
    out[mask] = number + 1
    return out, len(names)


def dilate(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        p = np.pad(mask, 1)
        mask = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return mask


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the nearest one of the mask."""
    h, w = mask.shape
    if not mask.any():
        return np.full(mask.shape, np.hypot(h, w))
    big = float(h + w) ** 2
    row = np.where(mask, 0.0, np.inf)
    for y in range(1, h):
        row[y] = np.minimum(row[y], row[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        row[y] = np.minimum(row[y], row[y + 1] + 1)
    g = np.minimum(row * row, big)
    x = np.arange(w)
    return np.sqrt(np.stack([(g + (x - k) ** 2).min(1) for k in range(w)], 1))


# ---- texture ------------------------------------------------------------------------------------

def lbp(a: np.ndarray, points: int, radius: float, uniform: bool = True) -> np.ndarray:
    """Local binary patterns; neighbours are blended bilinearly and rounded to nine digits, outside is 0."""
    h, w = a.shape
    r = ceil(radius) + 1
    p = np.pad(a.astype(float), r)
    bits = []
    for k in range(points):
        dy, dx = round(-radius * sin(2 * pi * k / points), 5), round(radius * cos(2 * pi * k / points), 5)
        y0, x0 = floor(dy), floor(dx)
        fy, fx = dy - y0, dx - x0
        cut = lambda y, x: p[r + y : r + y + h, r + x : r + x + w]
        y1, x1 = ceil(dy), ceil(dx)
        if not fy and not fx:
            bits.append(np.round(cut(y0, x0), 9) - a >= 0)
            continue
        top, bottom = (1 - fx) * cut(y0, x0) + fx * cut(y0, x1), (1 - fx) * cut(y1, x0) + fx * cut(y1, x1)
        bits.append(np.round((1 - fy) * top + fy * bottom, 9) - a >= 0)
    b = np.stack(bits)
    if not uniform:
        return np.tensordot(2.0 ** np.arange(points), b.astype(float), 1)
    changes = (b[1:] != b[:-1]).sum(0)
    return np.where(changes <= 2, b.sum(0), points + 1).astype(float)


def glcm(a: np.ndarray, distances: list[int], angles: list[float], levels: int) -> dict[str, np.ndarray]:
    """Contrast, correlation, energy and homogeneity of symmetric normed co-occurrence matrices, one for each distance and angle."""
    a = a.astype(np.int64)
    h, w = a.shape
    out = {k: [] for k in ("contrast", "correlation", "energy", "homogeneity")}
    i = np.arange(levels)
    d2 = (i[:, None] - i[None, :]) ** 2
    for d in distances:
        for t in angles:
            dy, dx = round(sin(t) * d), round(cos(t) * d)
            y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
            one, two = a[y0:y1, x0:x1], a[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
            m = np.bincount((one * levels + two).ravel(), minlength=levels * levels).reshape(levels, levels).astype(float)
            m += m.T
            m /= max(m.sum(), 1)
            mu = (m.sum(1) * i).sum()
            var = (m.sum(1) * (i - mu) ** 2).sum()
            out["contrast"].append((m * d2).sum())
            out["homogeneity"].append((m / (1 + d2)).sum())
            out["energy"].append(np.sqrt((m * m).sum()))
            out["correlation"].append(1.0 if var < 1e-15 else ((i - mu)[:, None] * (i - mu)[None, :] * m).sum() / var)
    return {k: np.array(v) for k, v in out.items()}


def hog(a: np.ndarray, cell: int, block: int = 2, orientations: int = 9, eps: float = 1e-5) -> np.ndarray:
    """Histograms of oriented gradients: mean magnitude by cell, blocks normalised by clipped L2; empty if no block fits."""
    gy, gx = np.zeros(a.shape), np.zeros(a.shape)
    gy[1:-1] = a[2:] - a[:-2]
    gx[:, 1:-1] = a[:, 2:] - a[:, :-2]
    m = np.hypot(gy, gx)
    angle = np.rad2deg(np.arctan2(gy, gx)) % 180
    ny, nx = a.shape[0] // cell, a.shape[1] // cell
    if ny < block or nx < block:
        return np.zeros(0)
    bin_ = np.minimum((angle / (180 / orientations)).astype(int), orientations - 1)[: ny * cell, : nx * cell]
    m = m[: ny * cell, : nx * cell]
    cell_of = (np.arange(ny * cell) // cell * nx)[:, None] + np.arange(nx * cell) // cell
    cells = np.bincount((cell_of * orientations + bin_).ravel(), m.ravel(), ny * nx * orientations).reshape(ny, nx, orientations) / (cell * cell)
    v = np.lib.stride_tricks.sliding_window_view(cells, (block, block), (0, 1)).transpose(0, 1, 3, 4, 2).reshape(-1, block * block * orientations)
    for most in (0.2, np.inf):
        v = np.minimum(v / np.sqrt((v * v).sum(1, keepdims=True) + eps * eps), most)
    return v.ravel()


@lru_cache(maxsize=256)
def _gabor_axis(n: int, r: int, deviation: float, turn: float, imaginary: bool) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Matrix that filters n values, edges mirrored, by one part of a Gaussian times a wave; and its bands of rows and the columns that they read."""
    x = np.arange(-r, r + 1)
    w = np.exp(-0.5 * (x / deviation) ** 2) / (sqrt(2 * pi) * deviation) * (np.sin if imaginary else np.cos)(2 * pi * turn * x)
    p = np.pad(np.eye(n), ((r, r), (0, 0)), mode="symmetric")
    m = sum(w[k] * p[k : k + n] for k in range(2 * r + 1))
    return m, [(a, min(n, a + 64), max(0, a - r), min(n, a + 64 + r)) for a in range(0, n, 64)]


def _filtered(a: np.ndarray, how: tuple, axis: int) -> np.ndarray:
    m, bands = _gabor_axis(a.shape[axis], *how)
    out = np.empty(a.shape)
    for y0, y1, x0, x1 in bands:
        if axis:
            np.matmul(a[:, x0:x1], m[y0:y1, x0:x1].T, out=out[:, y0:y1])
        else:
            np.matmul(m[y0:y1, x0:x1], a[x0:x1], out=out[y0:y1])
    return out


def gabor_energies(a: np.ndarray, frequencies: tuple[float, ...], thetas: tuple[float, ...]) -> list[float]:
    """Mean magnitudes of the complex Gabor responses, by frequency, then angle; bandwidth 1 and three deviations.

    The Gaussian is round, so each kernel is a complex column times a complex row; angles that mirror each other share their products.
    """
    out, parts = [], {}
    for f in frequencies:
        s = 1 / pi * np.sqrt(np.log(2) / 2) * 3 / f
        for t in thetas:
            c, d = round(cos(t), 15), round(sin(t), 15)
            r = ceil(max(3 * s * abs(cos(t)), 3 * s * abs(sin(t)), 1))
            if (key := (f, r, abs(c), abs(d))) not in parts:
                columns = [_filtered(a, (r, s, f * abs(d), i), 0) for i in (False, True)[: 1 + (d != 0)]]
                parts[key] = [[_filtered(v, (r, s, f * abs(c), i), 1) for i in (False, True)[: 1 + (c != 0)]] for v in columns]
            q = parts[key]
            if len(q) == 1 or len(q[0]) == 1:
                re, im = q[0][0], (q[0][1] if len(q[0]) > 1 else q[1][0] if len(q) > 1 else 0.0)
            else:
                turn = 1 if c * d > 0 else -1
                re, im = q[0][0] - turn * q[1][1], turn * q[1][0] + q[0][1]
            out.append(float(np.sqrt(re * re + im * im).mean()))
    return out


def gabor_energy(a: np.ndarray, frequency: float, theta: float) -> float:
    """Mean magnitude of the complex Gabor response."""
    return gabor_energies(a, (frequency,), (theta,))[0]


# ---- transforms ---------------------------------------------------------------------------------

@lru_cache(maxsize=16)
def _cosines(n: int) -> np.ndarray:
    k, i = np.mgrid[:n, :n]
    c = np.sqrt(2 / n) * np.cos(pi * (2 * i + 1) * k / (2 * n))
    c[0] /= np.sqrt(2)
    return c


def dct(a: np.ndarray) -> np.ndarray:
    return _cosines(a.shape[0]) @ a @ _cosines(a.shape[1]).T


def haar(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Approximation and the horizontal, vertical and diagonal details; odd sides repeat their last row or column."""
    a = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), mode="edge")
    p, q, r, s = a[::2, ::2], a[::2, 1::2], a[1::2, ::2], a[1::2, 1::2]
    return (p + q + r + s) / 2, (p + q - r - s) / 2, (p - q + r - s) / 2, (p - q - r + s) / 2


#: The high-pass filter of the Daubechies wavelet with two vanishing moments.
_DB2_HIGH = np.array([-0.48296291314469025, 0.836516303737469, -0.22414386804185735, -0.12940952255092145])


def noise_sigma(a: np.ndarray) -> float:
    """Noise deviation from the median of the absolute diagonal details, zeros left out, over 0.6745."""
    p = np.pad(a, 3, mode="symmetric")
    n = (a.shape[0] + 3) // 2, (a.shape[1] + 3) // 2
    w = _DB2_HIGH
    rows = sum(w[k] * p[4 - k : 4 - k + 2 * n[0] : 2][: n[0]] for k in range(4))
    both = sum(w[k] * rows[:, 4 - k : 4 - k + 2 * n[1] : 2][:, : n[1]] for k in range(4))
    d = np.abs(both[both != 0])
    return float(np.median(d) / 0.6744897501960817) if d.size else 0.0


#: The standard JPEG quantisation tables for brightness and colour, row by row.
_Q_LUMA = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]).reshape(8, 8)
_Q_CHROMA = np.full((8, 8), 99)
_Q_CHROMA[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]


def _quantised(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    c = _cosines(8)
    f = np.round((c @ b @ c.T) / table) * table
    return (c.T @ f @ c).transpose(0, 2, 1, 3).reshape(p.shape)[:h, :w] + 128


def jpeg_like(rgb: np.ndarray, quality: int) -> np.ndarray:
    """What JPEG at a quality leaves of 0 .. 255 colours: 4:2:0 chroma and quantised 8 x 8 cosines; entropy coding is lossless."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip(np.floor((t * scale + 50) / 100), 1, 255) for t in (_Q_LUMA, _Q_CHROMA)]
    r, g, b = np.moveaxis(rgb.astype(float), -1, 0)
    y, cb, cr = 0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
    y = _quantised(np.round(y), tables[0])
    h, w = y.shape
    chroma = []
    for c in (cb, cr):
        p = np.pad(np.round(c), ((0, h % 2), (0, w % 2)), mode="edge")
        small = p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3))
        chroma.append(np.repeat(np.repeat(_quantised(np.round(small), tables[1]), 2, 0), 2, 1)[:h, :w] - 128)
    cb, cr = chroma
    return np.clip(np.round(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)), 0, 255)


# ---- statistics ---------------------------------------------------------------------------------

def entropy(counts: np.ndarray, base2: bool = True) -> float:
    p = (counts + SMOOTH) / (counts + SMOOTH).sum()
    return float(-(p * (np.log2(p) if base2 else np.log(p))).sum())


def skewness(v: np.ndarray) -> float:
    d = v - v.mean()
    var = (d * d).mean()
    return float((d * d * d).mean() / var**1.5) if var > 1e-30 else 0.0


def kurtosis(v: np.ndarray) -> float:
    d = v - v.mean()
    d *= d
    var = d.mean()
    return float((d * d).mean() / var**2 - 3) if var > 1e-30 else 0.0


def box_dimension(mask: np.ndarray, sizes: tuple[int, ...] = (2, 4, 8, 16, 32, 64)) -> float:
    """Slope of log occupied boxes over log inverse size; 1 with fewer than two usable sizes."""
    x, y = [], []
    for s in sizes:
        ny, nx = mask.shape[0] // s, mask.shape[1] // s
        n = int(mask[: ny * s, : nx * s].reshape(ny, s, nx, s).any((1, 3)).sum()) if ny and nx else 0
        if n:
            x.append(-np.log(s))
            y.append(np.log(n))
    return float(np.polyfit(x, y, 1)[0]) if len(x) >= 2 else 1.0


@lru_cache(maxsize=16)
def radius_map(h: int, w: int) -> tuple[np.ndarray, float]:
    """Distance of each shifted frequency from zero's place, and the largest of it on the axes' ends."""
    cy, cx = h // 2, w // 2
    y, x = np.ogrid[:h, :w]
    return np.hypot(y - cy, x - cx), float(np.hypot(cy, cx))
