"""Planes of pixels as dense arrays, and pixel rows with their neighbours.

A plane is one row: img_id, h, w, data (row-major doubles). Neighbours are read
from the row's own array before it is exploded, so that local operators need no
self-join and no shuffle; only their grouped results move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import cleaned


def planes(df: DataFrame, key: str, data: str, h: int, w: int) -> DataFrame:
    """Planes of a column of arrays with h * w values."""
    return df.select(F.col(key).alias("img_id"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.transform(data, lambda v: v.cast("double")).alias("data"))


def unit(ps: DataFrame) -> DataFrame:
    """Planes min-max scaled to [0, 1]; a constant plane is 0."""
    lo, hi = F.array_min("data"), F.array_max("data")
    return ps.withColumn("data", F.when(hi > lo, F.transform("data", lambda v: (v - lo) / (hi - lo))).otherwise(F.transform("data", lambda v: F.lit(0.0))))


def levels(ps: DataFrame, n: int = 256) -> DataFrame:
    """Planes of whole numbers 0 .. n - 1 from planes in [0, 1], truncated."""
    return ps.withColumn("data", F.transform("data", lambda v: F.floor(cleaned(v) * (n - 1)).cast("double")))


def at(y: Column, x: Column, edge: str) -> Column:
    """The value at (y, x) of the row's plane; outside it 0 ("zero"), null ("none") or the nearest pixel's ("near")."""
    h, w = F.col("h"), F.col("w")
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    cy, cx = F.greatest(F.lit(0), F.least(y, h - 1)), F.greatest(F.lit(0), F.least(x, w - 1))
    value = F.get("data", (cy * w + cx).cast("int"))
    if edge == "near":
        return value
    return F.when(inside, value) if edge == "none" else F.when(inside, value).otherwise(F.lit(0.0))


def pixels(ps: DataFrame, **near: tuple[int, int] | tuple[int, int, str]) -> DataFrame:
    """One row per pixel: img_id, y, x, v, and a column for each named neighbour (dy, dx, edge; "near" if not given)."""
    def cell(i: Column) -> Column:
        y, x = F.floor(i / F.col("w")).cast("int"), (i % F.col("w")).cast("int")
        more = [at(y + o[0], x + o[1], o[2] if len(o) > 2 else "near").alias(n) for n, o in near.items()]
        return F.struct(y.alias("y"), x.alias("x"), F.get("data", i).alias("v"), *more)

    # The size comes from the array, so a plane without values gives no pixel.
    index = F.when(F.size("data") > 0, F.sequence(F.lit(0), F.size("data") - 1))
    return ps.select("img_id", F.explode(F.transform(index, cell)).alias("p")).select("img_id", "p.*")


def channels(ps: DataFrame, shift: int) -> DataFrame:
    """Colour pixels img_id, i, r, g, b of a plane: its values, and those shift and 2 * shift places on, around the end."""
    n = F.size("data")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    pick = lambda i, k: F.get("data", ((i + k * shift) % n).cast("int"))
    return ps.select("img_id", F.explode(F.transform(index, lambda i: F.struct(i.alias("i"), pick(i, 0).alias("r"), pick(i, 1).alias("g"), pick(i, 2).alias("b")))).alias("p")).select("img_id", "p.*")


def tiles(px: DataFrame, size: int, stride: int | None = None, whole: bool = True, h: int | None = None, w: int | None = None, drop_last: bool = False) -> DataFrame:
    """Pixels with tile (ty, tx) and place in it (py, px_); a pixel stands once for each tile it is in.

    whole leaves out tiles that reach over the edge; drop_last also those that end at it.
    """
    stride = stride or size
    # Tiles whose start is in (y - size, y], as multiples of the stride.
    starts = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - size) / stride) + 1), F.floor(F.col(c) / stride))
    out = px.withColumn("ty", F.explode(starts("y"))).withColumn("tx", F.explode(starts("x")))
    out = out.withColumn("py", (F.col("y") - F.col("ty") * stride).cast("int")).withColumn("px_", (F.col("x") - F.col("tx") * stride).cast("int"))
    if whole and h and w:
        last = 1 if drop_last else 0
        out = out.where((F.col("ty") * stride + size + last <= h) & (F.col("tx") * stride + size + last <= w))
    return out


def twiddles(spark: SparkSession, n: int) -> DataFrame:
    """(k, i, c, s): cosine and minus sine of 2 pi k i / n, n * n rows."""
    angle = -2 * F.lit(3.141592653589793) * (F.col("k") * F.col("i") % n) / n
    return spark.range(n * n).select((F.col("id") / n).cast("int").alias("k"), (F.col("id") % n).cast("int").alias("i")).select("k", "i", F.cos(angle).alias("c"), F.sin(angle).alias("s"))


def dft(px: DataFrame, n: int, by: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """(by, u, v, re, im): the two-dimensional DFT of n * n planes, one axis after the other. n * n twiddles are broadcast."""
    t = F.broadcast(twiddles(px.sparkSession, n))
    rows = px.join(t.select(F.col("i").alias(x), F.col("k").alias("v_"), "c", "s"), x).groupBy(*by, y, "v_").agg(F.sum(F.col("v") * F.col("c")).alias("a"), F.sum(F.col("v") * F.col("s")).alias("b"))
    cols = rows.join(t.select(F.col("i").alias(y), F.col("k").alias("u_"), "c", "s"), y).groupBy(*by, "u_", "v_").agg(F.sum(F.col("a") * F.col("c") - F.col("b") * F.col("s")).alias("re"), F.sum(F.col("a") * F.col("s") + F.col("b") * F.col("c")).alias("im"))
    return cols.withColumnRenamed("u_", "u").withColumnRenamed("v_", "v")


def dct(px: DataFrame, n: int, by: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """(by, u, v, d): the orthonormal DCT-II of n * n planes. n * n cosines are broadcast."""
    scale = F.when(F.col("k") == 0, F.sqrt(F.lit(1.0 / n))).otherwise(F.sqrt(F.lit(2.0 / n)))
    base = px.sparkSession.range(n * n).select((F.col("id") / n).cast("int").alias("k"), (F.col("id") % n).cast("int").alias("i"))
    t = F.broadcast(base.select("k", "i", (scale * F.cos(F.lit(3.141592653589793) * (2 * F.col("i") + 1) * F.col("k") / (2 * n))).alias("c")))
    rows = px.join(t.select(F.col("i").alias(x), F.col("k").alias("v_"), "c"), x).groupBy(*by, y, "v_").agg(F.sum(F.col("v") * F.col("c")).alias("a"))
    cols = rows.join(t.select(F.col("i").alias(y), F.col("k").alias("u_"), "c"), y).groupBy(*by, "u_", "v_").agg(F.sum(F.col("a") * F.col("c")).alias("d"))
    return cols.withColumnRenamed("u_", "u").withColumnRenamed("v_", "v")


def convolve_rows(ps: DataFrame, weights: list[float]) -> DataFrame:
    """Planes convolved with symmetric weights along both axes; the edge is mirrored, the edge pixel included."""
    r = len(weights) // 2

    def mirrored(i: Column, n: Column) -> Column:
        m = F.pmod(i, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)

    def along(vertical: bool):
        def cell(i: Column) -> Column:
            y, x = F.floor(i / F.col("w")).cast("int"), (i % F.col("w")).cast("int")
            total = F.lit(0.0)
            for k, wt in enumerate(weights):
                j = mirrored(y + (k - r), F.col("h")) * F.col("w") + x if vertical else y * F.col("w") + mirrored(x + (k - r), F.col("w"))
                total = total + F.lit(wt) * F.get("data", j.cast("int"))
            return total

        return F.transform(F.sequence(F.lit(0), F.size("data") - 1), cell)

    return ps.withColumn("data", along(True)).withColumn("data", along(False))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    from math import exp

    r = int(truncate * sigma + 0.5)
    w = [exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def neighbour_pairs(ps: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(img_id, o, a, b): values of pixel pairs at each offset, both ways round."""
    px = pixels(ps, **{f"n{k}": (dy, dx, "none") for k, (dy, dx) in enumerate(offsets)})
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("o"), F.col(a).alias("a"), F.col(b).alias("b")) for k in range(len(offsets)) for a, b in (("v", f"n{k}"), (f"n{k}", "v"))]))
    return px.select("img_id", both.alias("q")).select("img_id", "q.*").where("a is not null and b is not null")


def glcm(ps: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(img_id, o, contrast, correlation, energy, homogeneity) of the symmetric normed co-occurrence matrix of each offset."""
    cells = neighbour_pairs(ps, offsets).groupBy("img_id", "o", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    d2 = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))
    n = F.col("n")
    s = cells.groupBy("img_id", "o").agg(F.sum("n").alias("t"), F.sum(n * d2).alias("con"), F.sum(n / (1 + d2)).alias("hom"), F.sum(n * n).alias("sq"), F.sum(n * F.col("a")).alias("sa"), F.sum(n * F.col("a") * F.col("a")).alias("saa"), F.sum(n * F.col("a") * F.col("b")).alias("sab"))
    mu = F.col("sa") / F.col("t")
    var = F.col("saa") / F.col("t") - mu * mu
    corr = F.when(var < 1e-15, F.lit(1.0)).otherwise((F.col("sab") / F.col("t") - mu * mu) / var)
    return s.select("img_id", "o", (F.col("con") / F.col("t")).alias("contrast"), corr.alias("correlation"), (F.sqrt(F.col("sq")) / F.col("t")).alias("energy"), (F.col("hom") / F.col("t")).alias("homogeneity"))


def lbp_offsets(points: int, radius: float) -> list[tuple[float, float]]:
    from math import cos, pi, sin

    return [(round(-radius * sin(2 * pi * p / points), 5), round(radius * cos(2 * pi * p / points), 5)) for p in range(points)]


def lbp(ps: DataFrame, points: int = 8, radius: float = 1.0, uniform: bool = True) -> DataFrame:
    """(img_id, y, x, code): local binary patterns with bilinear neighbours and zeros outside.

    Neighbour values are rounded to nine digits, so that a flat region compares equal.
    """
    from math import ceil, floor

    near, blends = {}, []
    for dy, dx in lbp_offsets(points, radius):
        y0, y1, x0, x1 = floor(dy), ceil(dy), floor(dx), ceil(dx)
        fy, fx = dy - y0, dx - x0
        names = []
        for y in (y0, y1):
            for x in (x0, x1):
                name = f"n{y}_{x}".replace("-", "m")
                near[name] = (y, x, "zero")
                names.append(name)
        tl, tr, bl, br = (F.col(n) for n in names)
        top, bottom = (1 - fx) * tl + fx * tr, (1 - fx) * bl + fx * br
        blends.append(F.round((1 - fy) * top + fy * bottom, 9))
    px = pixels(ps, **near)
    bits = [F.when(b - F.col("v") >= 0, 1).otherwise(0) for b in blends]
    px = px.select("img_id", "y", "x", *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    b = [F.col(f"b{i}") for i in range(points)]
    if not uniform:
        code = sum((x.cast("long") * (1 << i) for i, x in enumerate(b)), F.lit(0).cast("long"))
    else:
        changes = sum((F.abs(b[i] - b[i + 1]) for i in range(points - 1)), F.lit(0))
        code = F.when(changes <= 2, sum(b, F.lit(0))).otherwise(points + 1)
    return px.select("img_id", "y", "x", code.cast("double").alias("code"))


def haar(px: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, x, a, h, v, d): one level of the two-dimensional Haar transform of even planes."""
    sy, sx = F.when(F.col("y") % 2 == 0, 1).otherwise(-1), F.when(F.col("x") % 2 == 0, 1).otherwise(-1)
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    return px.groupBy(*by, half("y").alias("y"), half("x").alias("x")).agg((F.sum("v") / 2).alias("a"), (F.sum(sy * F.col("v")) / 2).alias("h"), (F.sum(sx * F.col("v")) / 2).alias("w"), (F.sum(sy * sx * F.col("v")) / 2).alias("d"))


def hsv() -> dict[str, Column]:
    """Hue, saturation and value of columns r, g, b in [0, 1]; hue 0 where there is no colour."""
    r, g, b = (F.col(c) for c in "rgb")
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = hi - lo
    hue = F.when(span == 0, F.lit(0.0)).when(hi == r, F.pmod((g - b) / span, F.lit(6.0))).when(hi == g, (b - r) / span + 2).otherwise((r - g) / span + 4) / 6
    return {"hue": hue, "saturation": F.when(hi == 0, F.lit(0.0)).otherwise(span / hi), "value": hi}


def lab() -> dict[str, Column]:
    """CIE Lab (D65) of sRGB columns r, g, b in [0, 1]."""
    lin = [F.when(F.col(c) > 0.04045, F.pow((F.col(c) + 0.055) / 1.055, F.lit(2.4))).otherwise(F.col(c) / 12.92) for c in "rgb"]
    m = [(0.412453, 0.357580, 0.180423, 0.95047), (0.212671, 0.715160, 0.072169, 1.0), (0.019334, 0.119193, 0.950227, 1.08883)]
    f = []
    for a, b, c, white in m:
        t = (a * lin[0] + b * lin[1] + c * lin[2]) / white
        f.append(F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116))
    return {"l": 116 * f[1] - 16, "a": 500 * (f[0] - f[1]), "bb": 200 * (f[1] - f[2])}
