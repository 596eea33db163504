"""Queries on the 8 x 8 planes of `embeddings`: one for each pixel and signal operator, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.stats import rounded as R
from ..operators import planes as P

N = 8
GLCM_LEVELS = 16
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---- the planes, in both languages -------------------------------------------------------------

_IM = "im AS (SELECT vec_id AS img_id, [CAST(e AS DOUBLE) FOR e IN embedding] AS d FROM embeddings)"
_UN = _IM + ", un AS (SELECT img_id, [CASE WHEN list_max(d) > list_min(d) THEN (e - list_min(d)) / (list_max(d) - list_min(d)) ELSE 0.0 END FOR e IN d] AS d FROM im)"


def _LV(n: int) -> str:
    return _UN + f", lv AS (SELECT img_id, [floor(least(greatest(e, 0.0), 1.0) * {n - 1}) FOR e IN d] AS d FROM un)"


def _PX(src: str, name: str = "px", more: str = "") -> str:
    return f"{name} AS (SELECT img_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, d[i] AS v{more} FROM {src}, range(1, 65) r(i))"


def _at(dy: int, dx: int, edge: str = "near") -> str:
    y, x = f"((i - 1) // 8 + {dy})", f"((i - 1) % 8 + {dx})"
    if edge == "near":
        return f"d[greatest(0, least(7, {y})) * 8 + greatest(0, least(7, {x})) + 1]"
    out = "NULL" if edge == "none" else "0.0"
    return f"CASE WHEN {y} BETWEEN 0 AND 7 AND {x} BETWEEN 0 AND 7 THEN d[greatest(0, least(7, {y})) * 8 + greatest(0, least(7, {x})) + 1] ELSE {out} END"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.planes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", "embedding", N, N)


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unit(raw(spark, sf_dir))


def leveled(spark: SparkSession, sf_dir: str, n: int = 256) -> DataFrame:
    return P.levels(unit(spark, sf_dir), n)


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


_SKEW = "avg((v - m) * (v - m) * (v - m)) / pow(var_pop(v), 1.5)"


# ---- statistics ---------------------------------------------------------------------------------

@query("moments_per_plane", f"""WITH {_IM}, {_PX('im')}, q AS (SELECT *, avg(v) OVER (PARTITION BY img_id) AS m FROM px)
SELECT img_id, {_r('avg(v)', 'mean')}, {_r('var_pop(v)', 'var')}, {_r('stddev_pop(v)', 'std')}, {_r(_SKEW, 'skew')}, {_r('kurtosis_pop(v)', 'kurt')} FROM q GROUP BY img_id""")
def moments_per_plane(spark, sf_dir):
    m = S.moments("v")
    return P.pixels(raw(spark, sf_dir)).groupBy("img_id").agg(*[R(c).alias(n) for n, c in m.items()])


def _entropy_sql(src: str, by: str, bins: int, log: str = "log2") -> str:
    return f"""t AS (SELECT *, n + 1e-10 AS c, sum(n) OVER (PARTITION BY {by}) + {bins} * 1e-10 AS s FROM {src}),
e AS (SELECT {by}, -sum(c / s * {log}(c / s)) - ({bins} - count(*)) * (1e-10 / any_value(s)) * {log}(1e-10 / any_value(s)) AS entropy FROM t GROUP BY {by})"""


@query("entropy_hist_1d", f"""WITH {_UN}, {_PX('un')}, h AS (SELECT img_id, least(floor(v * 256), 255) AS b, count(*) AS n FROM px GROUP BY ALL), {_entropy_sql('h', 'img_id', 256)}
SELECT img_id, {_r('entropy', 'entropy_brightness')} FROM e""")
def entropy_hist_1d(spark, sf_dir):
    h = P.pixels(unit(spark, sf_dir)).groupBy("img_id", S.bin_of(F.col("v"), F.lit(0.0), F.lit(1.0), 256).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return S.entropy(h, ["img_id"], "n", 256).select("img_id", R(F.col("entropy")).alias("entropy_brightness"))


_RGB = _UN + ", rgb AS (SELECT img_id, i - 1 AS i, d[i] AS r, d[(i - 1 + 21) % 64 + 1] AS g, d[(i - 1 + 42) % 64 + 1] AS b FROM un, range(1, 65) r(i))"


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.channels(unit(spark, sf_dir), 21)


@query("entropy_hist_3d", f"""WITH {_RGB}, h AS (SELECT img_id, least(floor(r * 32), 31) AS x, least(floor(g * 32), 31) AS y, least(floor(b * 32), 31) AS z, count(*) AS n FROM rgb GROUP BY ALL), {_entropy_sql('h', 'img_id', 32768)}
SELECT img_id, {_r('entropy', 'rgb_entropy')} FROM e""")
def entropy_hist_3d(spark, sf_dir):
    cells = [S.bin_of(F.col(c), F.lit(0.0), F.lit(1.0), 32).alias(f"{c}_") for c in "rgb"]
    h = rgb(spark, sf_dir).groupBy("img_id", *cells).agg(F.count(F.lit(1)).alias("n"))
    return S.entropy(h, ["img_id"], "n", 32768).select("img_id", R(F.col("entropy")).alias("rgb_entropy"))


@query("entropy_data_range", f"""WITH {_IM}, {_PX('im')}, m AS (SELECT *, min(v) OVER (PARTITION BY img_id) AS lo, max(v) OVER (PARTITION BY img_id) AS hi FROM px),
h AS (SELECT img_id, least(floor((v - lo) / (hi - lo) * 50), 49) AS b, count(*) AS n FROM m GROUP BY ALL), {_entropy_sql('h', 'img_id', 50, 'ln')}
SELECT img_id, {_r('entropy', 'hog_style_entropy')} FROM e""")
def entropy_data_range(spark, sf_dir):
    w = Window.partitionBy("img_id")
    px = P.pixels(raw(spark, sf_dir)).withColumn("lo", F.min("v").over(w)).withColumn("hi", F.max("v").over(w))
    h = px.groupBy("img_id", S.bin_of(F.col("v"), F.col("lo"), F.col("hi"), 50).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return S.entropy(h, ["img_id"], "n", 50, base2=False).select("img_id", R(F.col("entropy")).alias("hog_style_entropy"))


@query("colour_moments", f"""WITH {_RGB}, u AS (SELECT img_id, c, v FROM (UNPIVOT rgb ON r, g, b INTO NAME c VALUE v)), q AS (SELECT *, avg(v) OVER (PARTITION BY img_id, c) AS m FROM u)
SELECT img_id, c AS channel, {_r('avg(v)', 'mean')}, {_r('var_pop(v)', 'variance')}, {_r('kurtosis_pop(v)', 'kurtosis')}, {_r(_SKEW, 'skewness')} FROM q GROUP BY img_id, c""")
def colour_moments(spark, sf_dir):
    long = rgb(spark, sf_dir).select("img_id", F.expr("stack(3, 'r', r, 'g', g, 'b', b) AS (channel, v)"))
    return long.groupBy("img_id", "channel").agg(R(F.avg("v")).alias("mean"), R(F.var_pop("v")).alias("variance"), R(F.kurtosis("v")).alias("kurtosis"), R(F.skewness("v")).alias("skewness"))


_HSV = """hs AS (SELECT img_id, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS sp, r, g, b FROM rgb),
hv AS (SELECT img_id, (CASE WHEN sp = 0 THEN 0.0 WHEN hi = r THEN (g - b) / sp + CASE WHEN g < b THEN 6.0 ELSE 0.0 END WHEN hi = g THEN (b - r) / sp + 2 ELSE (r - g) / sp + 4 END) / 6 AS hue,
  CASE WHEN hi = 0 THEN 0.0 ELSE sp / hi END AS saturation, hi AS value FROM hs)"""


@query("hsv_moments", f"""WITH {_RGB}, {_HSV}, u AS (SELECT img_id, c, v FROM (UNPIVOT hv ON hue, saturation, value INTO NAME c VALUE v)), q AS (SELECT *, avg(v) OVER (PARTITION BY img_id, c) AS m FROM u)
SELECT img_id, c AS channel, {_r('var_pop(v)', 'variance')}, {_r('kurtosis_pop(v)', 'kurtosis')}, {_r(_SKEW, 'skewness')} FROM q GROUP BY img_id, c""")
def hsv_moments(spark, sf_dir):
    px = rgb(spark, sf_dir).select("img_id", *[c.alias(n) for n, c in P.hsv().items()])
    long = px.select("img_id", F.expr("stack(3, 'hue', hue, 'saturation', saturation, 'value', value) AS (channel, v)"))
    return long.groupBy("img_id", "channel").agg(R(F.var_pop("v")).alias("variance"), R(F.kurtosis("v")).alias("kurtosis"), R(F.skewness("v")).alias("skewness"))


def _lin(c: str) -> str:
    return f"CASE WHEN {c} > 0.04045 THEN pow(({c} + 0.055) / 1.055, 2.4) ELSE {c} / 12.92 END"


def _labf(t: str) -> str:
    return f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116 END"


@query("lab_means", f"""WITH {_RGB}, li AS (SELECT img_id, {_lin('r')} AS r, {_lin('g')} AS g, {_lin('b')} AS b FROM rgb),
xy AS (SELECT img_id, (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.95047 AS x, 0.212671 * r + 0.715160 * g + 0.072169 * b AS y, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.08883 AS z FROM li),
f AS (SELECT img_id, {_labf('x')} AS x, {_labf('y')} AS y, {_labf('z')} AS z FROM xy)
SELECT img_id, {_r('avg(116 * y - 16)', 'l_mean')}, {_r('avg(500 * (x - y))', 'a_mean')}, {_r('avg(200 * (y - z))', 'b_mean')}, {_r('avg(sqrt(pow(500 * (x - y), 2) + pow(200 * (y - z), 2)))', 'chroma_mean')} FROM f GROUP BY img_id""")
def lab_means(spark, sf_dir):
    px = rgb(spark, sf_dir).select("img_id", *[c.alias(n + "_") for n, c in P.lab().items()])
    return px.groupBy("img_id").agg(R(F.avg("l_")).alias("l_mean"), R(F.avg("a_")).alias("a_mean"), R(F.avg("bb_")).alias("b_mean"), R(F.avg(F.sqrt(F.col("a_") * F.col("a_") + F.col("bb_") * F.col("bb_")))).alias("chroma_mean"))


@query("luma_planes", f"""WITH {_RGB} SELECT img_id, {_r('avg(0.299 * r + 0.587 * g + 0.114 * b)', 'luma601')}, {_r('avg(0.2125 * r + 0.7154 * g + 0.0721 * b)', 'luma709')},
{_r('avg((r - 0.485) / 0.229)', 'norm_r')}, {_r('avg((g - 0.456) / 0.224)', 'norm_g')}, {_r('avg((b - 0.406) / 0.225)', 'norm_b')}, {_r('avg(255 - trunc(r * 255))', 'inverted_r')} FROM rgb GROUP BY img_id""")
def luma_planes(spark, sf_dir):
    r, g, b = (F.col(c) for c in "rgb")
    return rgb(spark, sf_dir).groupBy("img_id").agg(
        R(F.avg(0.299 * r + 0.587 * g + 0.114 * b)).alias("luma601"), R(F.avg(0.2125 * r + 0.7154 * g + 0.0721 * b)).alias("luma709"),
        R(F.avg((r - 0.485) / 0.229)).alias("norm_r"), R(F.avg((g - 0.456) / 0.224)).alias("norm_g"), R(F.avg((b - 0.406) / 0.225)).alias("norm_b"), R(F.avg(255 - F.floor(r * 255))).alias("inverted_r"),
    )


@query("minmax_u8", f"""WITH {_LV(256)}, {_PX('lv')} SELECT img_id, CAST(min(v) AS INTEGER) AS lo, CAST(max(v) AS INTEGER) AS hi, CAST(sum(v) AS BIGINT) AS total, CAST(255 * count(*) FILTER (v >= 128) AS BIGINT) AS edgelen FROM px GROUP BY img_id""")
def minmax_u8(spark, sf_dir):
    return P.pixels(leveled(spark, sf_dir)).groupBy("img_id").agg(F.min("v").cast("int").alias("lo"), F.max("v").cast("int").alias("hi"), F.sum("v").cast("long").alias("total"), (255 * F.count_if(F.col("v") >= 128)).cast("long").alias("edgelen"))


# ---- texture ------------------------------------------------------------------------------------

def _glcm_sql(offsets: list[tuple[int, int]], n: int) -> str:
    pairs = " UNION ALL ".join(f"SELECT img_id, {k} AS o, d[i] AS a, {_at(dy, dx, 'none')} AS b FROM lv, range(1, 65) r(i)" for k, (dy, dx) in enumerate(offsets))
    return f"""{_LV(n)}, p0 AS ({pairs}), p1 AS (SELECT * FROM p0 WHERE b IS NOT NULL), p2 AS (SELECT * FROM p1 UNION ALL SELECT img_id, o, b, a FROM p1),
c AS (SELECT img_id, o, a, b, count(*) AS n FROM p2 GROUP BY ALL),
s AS (SELECT img_id, o, sum(n) AS t, sum(n * (a - b) * (a - b)) AS con, sum(n / (1 + (a - b) * (a - b))) AS hom, sum(n * n) AS sq, sum(n * a) AS sa, sum(n * a * a) AS saa, sum(n * a * b) AS sab FROM c GROUP BY ALL),
g AS (SELECT img_id, o, con / t AS contrast, CASE WHEN saa / t - (sa / t) * (sa / t) < 1e-15 THEN 1.0 ELSE (sab / t - (sa / t) * (sa / t)) / (saa / t - (sa / t) * (sa / t)) END AS correlation, sqrt(sq) / t AS energy, hom / t AS homogeneity FROM s)"""


_PROPS = ("contrast", "correlation", "energy", "homogeneity")
_EIGHT = [(0, 1), (1, 1), (1, 0), (1, -1), (0, 3), (2, 2), (3, 0), (2, -2)]


@query("glcm_props", f"WITH {_glcm_sql([(0, 1)], 256)} SELECT img_id, {', '.join(_r(p, p) for p in _PROPS)} FROM g")
def glcm_props(spark, sf_dir):
    return P.glcm(leveled(spark, sf_dir), [(0, 1)]).select("img_id", *[R(F.col(p)).alias(p) for p in _PROPS])


@query("glcm_multi", f"WITH {_glcm_sql(_EIGHT, GLCM_LEVELS)} SELECT img_id, {', '.join(_r(f'avg({p})', f'{p}_mean') + ', ' + _r(f'stddev_pop({p})', f'{p}_std') for p in _PROPS)} FROM g GROUP BY img_id")
def glcm_multi(spark, sf_dir):
    return P.glcm(leveled(spark, sf_dir, GLCM_LEVELS), _EIGHT).groupBy("img_id").agg(*[x for p in _PROPS for x in (R(F.avg(p)).alias(f"{p}_mean"), R(F.stddev_pop(p)).alias(f"{p}_std"))])


def _lbp_sql(points: int, radius: float, uniform: bool = True, src: str = "lv") -> str:
    from math import ceil, floor

    cols = []
    for k, (dy, dx) in enumerate(P.lbp_offsets(points, radius)):
        y0, y1, x0, x1 = floor(dy), ceil(dy), floor(dx), ceil(dx)
        fy, fx = dy - y0, dx - x0
        tl, tr, bl, br = (f"({_at(y, x, 'zero')})" for y in (y0, y1) for x in (x0, x1))
        lerp = lambda a, b: f"((1 - CAST({fx!r} AS DOUBLE)) * {a} + CAST({fx!r} AS DOUBLE) * {b})"
        cols.append(f"CASE WHEN round((1 - CAST({fy!r} AS DOUBLE)) * {lerp(tl, tr)} + CAST({fy!r} AS DOUBLE) * {lerp(bl, br)}, 9) - d[i] >= 0 THEN 1 ELSE 0 END AS b{k}")
    if uniform:
        changes = " + ".join(f"abs(b{k} - b{k + 1})" for k in range(points - 1))
        code = f"CASE WHEN {changes} <= 2 THEN {' + '.join(f'b{k}' for k in range(points))} ELSE {points + 1} END"
    else:
        code = " + ".join(f"CAST(b{k} AS BIGINT) * {1 << k}" for k in range(points))
    return f"bits AS (SELECT img_id, i, {', '.join(cols)} FROM {src}, range(1, 65) r(i)), codes AS (SELECT img_id, CAST({code} AS DOUBLE) AS code FROM bits)"


def _code_entropy(codes: DataFrame, bins: int) -> DataFrame:
    w = Window.partitionBy("img_id")
    h = codes.withColumn("lo", F.min("code").over(w)).withColumn("hi", F.max("code").over(w)).groupBy("img_id", S.bin_of(F.col("code"), F.col("lo"), F.col("hi"), bins).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return S.entropy(h, ["img_id"], "n", bins)


def _code_entropy_sql(bins: int) -> str:
    return f"""m AS (SELECT *, min(code) OVER (PARTITION BY img_id) AS lo, max(code) OVER (PARTITION BY img_id) AS hi FROM codes),
m2 AS (SELECT img_id, code, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM m),
h AS (SELECT img_id, least(floor((code - lo) / (hi - lo) * {bins}), {bins - 1}) AS b, count(*) AS n FROM m2 GROUP BY ALL), {_entropy_sql('h', 'img_id', bins)}"""


@query("lbp_uniform", f"WITH {_LV(256)}, {_lbp_sql(8, 1)}, {_code_entropy_sql(10)}, v AS (SELECT img_id, var_pop(code) AS lbp_variance FROM codes GROUP BY img_id) SELECT e.img_id, {_r('entropy', 'lbp_entropy')}, {_r('lbp_variance', 'lbp_variance')} FROM e JOIN v USING (img_id)")
def lbp_uniform(spark, sf_dir):
    codes = P.lbp(leveled(spark, sf_dir), 8, 1)
    return _code_entropy(codes, 10).join(codes.groupBy("img_id").agg(R(F.var_pop("code")).alias("lbp_variance")), "img_id").select("img_id", R(F.col("entropy")).alias("lbp_entropy"), "lbp_variance")


@query("lbp_coarse", f"WITH {_LV(256)}, {_lbp_sql(16, 2)}, {_code_entropy_sql(18)} SELECT img_id, {_r('entropy', 'lbp_coarse_entropy')} FROM e")
def lbp_coarse(spark, sf_dir):
    return _code_entropy(P.lbp(leveled(spark, sf_dir), 16, 2), 18).select("img_id", R(F.col("entropy")).alias("lbp_coarse_entropy"))


@query("lbp_multiscale", " UNION ALL ".join(f"(WITH {_LV(256)}, {_lbp_sql(p, r)} SELECT img_id, '{s}' AS scale, {_r('avg(code)', 'mean')}, {_r('var_pop(code)', 'var')} FROM codes GROUP BY img_id)" for p, r, s in ((8, 1, "s1"), (16, 2, "s2"), (24, 3, "s3"))))
def lbp_multiscale(spark, sf_dir):
    one = lambda p, r, s: P.lbp(leveled(spark, sf_dir), p, r).groupBy("img_id").agg(R(F.avg("code")).alias("mean"), R(F.var_pop("code")).alias("var")).withColumn("scale", F.lit(s))
    return reduce(DataFrame.unionByName, [one(8, 1, "s1"), one(16, 2, "s2"), one(24, 3, "s3")])


@query("residual_lbp24", f"WITH {_LV(256)}, {_lbp_sql(24, 3, False)}, s AS (SELECT img_id, avg(code) AS m, sum(code) AS t FROM codes GROUP BY img_id) SELECT img_id, CAST(trunc((m + t) / 2) AS BIGINT) AS image_mean_half, CAST(trunc(m + t) AS BIGINT) AS image_mean_sum FROM s")
def residual_lbp24(spark, sf_dir):
    s = P.lbp(leveled(spark, sf_dir), 24, 3, uniform=False).groupBy("img_id").agg(F.avg("code").alias("m"), F.sum("code").alias("t"))
    return s.select("img_id", ((F.col("m") + F.col("t")) / 2).cast("long").alias("image_mean_half"), (F.col("m") + F.col("t")).cast("long").alias("image_mean_sum"))


@query("texture_complexity", f"""WITH {_LV(256)}, {_PX('lv')}, t AS (SELECT img_id, y // 4 AS ty, x // 4 AS tx, 1 - avg(v * v) / 65025.0 AS t FROM px GROUP BY ALL),
k AS (SELECT img_id, avg(CASE WHEN t > 0 AND t < 1 THEN ln(t / (1 - t)) + 4 END) AS c FROM t GROUP BY img_id)
SELECT img_id, {_r('coalesce(c, 0.0)', 'complexity')}, CAST(trunc(coalesce(c, 0.0)) AS BIGINT) AS truncated FROM k""")
def texture_complexity(spark, sf_dir):
    tile = P.tiles(P.pixels(leveled(spark, sf_dir)), 4, h=N, w=N).groupBy("img_id", "ty", "tx").agg((1 - F.avg(F.col("v") * F.col("v")) / 65025.0).alias("t"))
    c = tile.groupBy("img_id").agg(F.coalesce(F.avg(F.when((F.col("t") > 0) & (F.col("t") < 1), F.log(F.col("t") / (1 - F.col("t"))) + 4)), F.lit(0.0)).alias("c"))
    return c.select("img_id", R(F.col("c")).alias("complexity"), F.col("c").cast("long").alias("truncated"))


# ---- gradients and filters ----------------------------------------------------------------------

_NEAR = {f"n{dy + 1}{dx + 1}": (dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)}
_NEAR_SQL = ", ".join(f"{_at(dy, dx)} AS {n}" for n, (dy, dx) in _NEAR.items())
_GX = "(n02 + 2 * n12 + n22 - n00 - 2 * n10 - n20)"
_GY = "(n20 + 2 * n21 + n22 - n00 - 2 * n01 - n02)"


@query("sobel_mag", f"""WITH {_UN}, px AS (SELECT img_id, {_NEAR_SQL} FROM un, range(1, 65) r(i)), g AS (SELECT img_id, sqrt({_GX} * {_GX} + {_GY} * {_GY}) AS m FROM px)
SELECT img_id, {_r('avg(m)', 'mean')}, {_r('stddev_pop(m)', 'std')}, {_r('max(m)', 'top')}, {_r('quantile_cont(m, 0.8)', 'p80')} FROM g GROUP BY img_id""")
def sobel_mag(spark, sf_dir):
    px = P.pixels(unit(spark, sf_dir), **_NEAR)
    g = px.select("img_id", F.sqrt(F.expr(f"{_GX} * {_GX} + {_GY} * {_GY}")).alias("m"))
    return g.groupBy("img_id").agg(R(F.avg("m")).alias("mean"), R(F.stddev_pop("m")).alias("std"), R(F.max("m")).alias("top"), R(F.expr("percentile(m, 0.8)")).alias("p80"))


@query("laplace_resid", f"""WITH {_UN}, px AS (SELECT img_id, 4 * d[i] - {_at(-1, 0)} - {_at(1, 0)} - {_at(0, -1)} - {_at(0, 1)} AS v FROM un, range(1, 65) r(i))
SELECT img_id, {_r('avg(abs(v))', 'mean_abs')}, {_r('stddev_pop(v)', 'std')} FROM px GROUP BY img_id""")
def laplace_resid(spark, sf_dir):
    px = P.pixels(unit(spark, sf_dir), u=(-1, 0), b=(1, 0), l=(0, -1), r=(0, 1))
    v = 4 * F.col("v") - F.col("u") - F.col("b") - F.col("l") - F.col("r")
    return px.select("img_id", v.alias("v")).groupBy("img_id").agg(R(F.avg(F.abs("v"))).alias("mean_abs"), R(F.stddev_pop("v")).alias("std"))


def _smooth_sql(src: str, out: str, sigma: float) -> str:
    w = P.gaussian_weights(sigma)
    r = len(w) // 2
    mirror = lambda i: f"(CASE WHEN ({i} + 64) % 16 < 8 THEN ({i} + 64) % 16 ELSE 15 - ({i} + 64) % 16 END)"
    col = " + ".join(f"CAST({x!r} AS DOUBLE) * d[{mirror(f'(k // 8 + {j - r})')} * 8 + k % 8 + 1]" for j, x in enumerate(w))
    row = " + ".join(f"CAST({x!r} AS DOUBLE) * d[(k // 8) * 8 + {mirror(f'(k % 8 + {j - r})')} + 1]" for j, x in enumerate(w))
    return f"{out}0 AS (SELECT img_id, [{col} FOR k IN range(0, 64)] AS d FROM {src}), {out} AS (SELECT img_id, [{row} FOR k IN range(0, 64)] AS d FROM {out}0)"


@query("dog_resid", f"""WITH {_UN}, {_smooth_sql('un', 'a', 1.5)}, {_smooth_sql('un', 'b', 2.4)}, q AS (SELECT a.img_id, a.d[i] - b.d[i] AS v FROM a JOIN b USING (img_id), range(1, 65) r(i))
SELECT img_id, {_r('avg(abs(v))', 'mean_abs')}, {_r('stddev_pop(v)', 'std')} FROM q GROUP BY img_id""")
def dog_resid(spark, sf_dir):
    u = unit(spark, sf_dir)
    a, b = (P.convolve_rows(u, P.gaussian_weights(s)) for s in (1.5, 2.4))
    both = a.join(b.select("img_id", F.col("data").alias("wide")), "img_id").select("img_id", F.explode(F.zip_with("data", "wide", lambda x, y: x - y)).alias("v"))
    return both.groupBy("img_id").agg(R(F.avg(F.abs("v"))).alias("mean_abs"), R(F.stddev_pop("v")).alias("std"))


@query("acf_lags", f"""WITH {_UN}, {_smooth_sql('un', 'a', 1.5)}, rs AS (SELECT un.img_id, [un.d[k] - a.d[k] FOR k IN range(1, 65)] AS d FROM un JOIN a USING (img_id)),
{_PX('rs')}, p AS (SELECT a.img_id, b.x - a.x AS lag, a.v AS u, b.v AS w FROM px a JOIN px b ON a.img_id = b.img_id AND a.y = b.y AND b.x > a.x AND b.x - a.x < 6)
SELECT img_id, CAST(lag AS INTEGER) AS lag, {_r('corr(u, w)', 'acf')} FROM p GROUP BY img_id, lag""")
def acf_lags(spark, sf_dir):
    u = unit(spark, sf_dir)
    smooth = P.convolve_rows(u, P.gaussian_weights(1.5)).select("img_id", F.col("data").alias("s"))
    rs = u.join(smooth, "img_id").withColumn("data", F.zip_with("data", "s", lambda a, b: a - b)).drop("s")
    px = P.pixels(rs, **{f"l{k}": (0, k, "none") for k in range(1, 6)})
    long = px.select("img_id", F.col("v").alias("u"), F.expr("stack(5, " + ", ".join(f"{k}, l{k}" for k in range(1, 6)) + ") AS (lag, w)")).where("w is not null")
    return long.groupBy("img_id", "lag").agg(R(F.corr("u", "w")).alias("acf"))


@query("acf_peaks", f"""WITH {_IM}, {_PX('im')}, p AS (SELECT a.img_id, b.x - a.x AS lag, a.v AS u, b.v AS w FROM px a JOIN px b ON a.img_id = b.img_id AND a.y = b.y AND b.x > a.x),
c AS (SELECT img_id, lag, round(corr(u, w), 6) AS acf FROM p GROUP BY img_id, lag), n AS (SELECT *, lag(acf) OVER (PARTITION BY img_id ORDER BY lag) AS prev, lead(acf) OVER (PARTITION BY img_id ORDER BY lag) AS next FROM c)
SELECT img_id, count(*) FILTER (acf > prev AND acf > next) AS n_peaks, {_r('coalesce(max(acf) FILTER (acf > prev AND acf > next), 0.0)', 'max_peak')}, {_r('max(acf) FILTER (lag = 1) - max(acf) FILTER (lag = 6)', 'decay')} FROM n GROUP BY img_id""")
def acf_peaks(spark, sf_dir):
    px = P.pixels(raw(spark, sf_dir), **{f"l{k}": (0, k, "none") for k in range(1, 8)})
    long = px.select("img_id", F.col("v").alias("u"), F.expr("stack(7, " + ", ".join(f"{k}, l{k}" for k in range(1, 8)) + ") AS (lag, w)")).where("w is not null")
    acf = long.groupBy("img_id", "lag").agg(F.round(F.corr("u", "w"), 6).alias("acf"))
    w = Window.partitionBy("img_id").orderBy("lag")
    peak = (F.col("acf") > F.lag("acf").over(w)) & (F.col("acf") > F.lead("acf").over(w))
    at = lambda k: F.max(F.when(F.col("lag") == k, F.col("acf")))
    return acf.withColumn("peak", F.coalesce(peak, F.lit(False))).groupBy("img_id").agg(F.count_if("peak").alias("n_peaks"), R(F.coalesce(F.max(F.when(F.col("peak"), F.col("acf"))), F.lit(0.0))).alias("max_peak"), R(at(1) - at(6)).alias("decay"))


# ---- wavelets -----------------------------------------------------------------------------------

def _haar_sql(src: str, out: str) -> str:
    s = lambda c: f"CASE WHEN {c} % 2 = 0 THEN 1 ELSE -1 END"
    return f"{out} AS (SELECT img_id, y // 2 AS y, x // 2 AS x, sum(v) / 2 AS v, sum({s('y')} * v) / 2 AS h, sum({s('x')} * v) / 2 AS w, sum({s('y')} * {s('x')} * v) / 2 AS d FROM {src} GROUP BY ALL)"


def _bands(cols=("h", "w", "d")) -> str:
    return ", ".join(_r(f"avg(abs({c}))", f"{b}_mean") + ", " + _r(f"stddev_pop({c})", f"{b}_std") for c, b in zip(cols, ("lh", "hl", "hh")))


@query("haar_subbands", f"""WITH {_UN}, {_PX('un')}, {_haar_sql('px', 'l1')}, {_haar_sql('l1', 'l2')}
SELECT img_id, 1 AS level, {_bands()} FROM l1 GROUP BY img_id UNION ALL SELECT img_id, 2 AS level, {_bands()} FROM l2 GROUP BY img_id""")
def haar_subbands(spark, sf_dir):
    l1 = P.haar(P.pixels(unit(spark, sf_dir)), ["img_id"])
    l2 = P.haar(l1.select("img_id", "y", "x", F.col("a").alias("v")), ["img_id"])
    stat = lambda df, k: df.groupBy("img_id").agg(*[x for c, b in zip("hwd", ("lh", "hl", "hh")) for x in (R(F.avg(F.abs(c))).alias(f"{b}_mean"), R(F.stddev_pop(c)).alias(f"{b}_std"))]).withColumn("level", F.lit(k))
    return stat(l1, 1).unionByName(stat(l2, 2))


_WARP = _UN + f", {_PX('un')}, wp AS (SELECT img_id, y, x, v, v - 0.5 * (v - avg(v) OVER (PARTITION BY img_id, y // 4, x // 4)) AS w FROM px)"


def warped(spark: SparkSession, sf_dir: str, alpha: float = 0.5, block: int = 4) -> DataFrame:
    """Pixels v with w: v less alpha times what two Haar levels call high frequency, v minus its block's mean."""
    by = Window.partitionBy("img_id", F.floor(F.col("y") / block), F.floor(F.col("x") / block))
    return P.pixels(unit(spark, sf_dir)).withColumn("w", F.col("v") - alpha * (F.col("v") - F.avg("v").over(by)))


@query("haar_perturb", f"WITH {_WARP} SELECT img_id, {_r('avg(w)', 'mean')}, {_r('stddev_pop(w)', 'std')}, {_r('max(abs(v - w))', 'moved')} FROM wp GROUP BY img_id")
def haar_perturb(spark, sf_dir):
    return warped(spark, sf_dir).groupBy("img_id").agg(R(F.avg("w")).alias("mean"), R(F.stddev_pop("w")).alias("std"), R(F.max(F.abs(F.col("v") - F.col("w")))).alias("moved"))


@query("cosine_sim", f"WITH {_WARP} SELECT img_id, {_r('sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w)))', 'similarity')} FROM wp GROUP BY img_id")
def cosine_sim(spark, sf_dir):
    v, w = F.col("v"), F.col("w")
    return warped(spark, sf_dir).groupBy("img_id").agg(R(F.sum(v * w) / (F.sqrt(F.sum(v * v)) * F.sqrt(F.sum(w * w)))).alias("similarity"))


@query("sim_extrema", f"""WITH {_WARP}, s AS (SELECT img_id, y, round(sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w))), 9) AS s FROM wp GROUP BY img_id, y)
SELECT img_id, {_r('avg(s)', 'min_warp')}, {_r('avg(s)', 'max_warp')}, CAST(arg_min(y, (s, y)) AS INTEGER) AS min_base, CAST(arg_min(y, (-s, y)) AS INTEGER) AS max_base FROM s GROUP BY img_id""")
def sim_extrema(spark, sf_dir):
    v, w = F.col("v"), F.col("w")
    s = warped(spark, sf_dir).groupBy("img_id", "y").agg(F.round(F.sum(v * w) / (F.sqrt(F.sum(v * v)) * F.sqrt(F.sum(w * w))), 9).alias("s"))
    return s.groupBy("img_id").agg(R(F.avg("s")).alias("min_warp"), R(F.avg("s")).alias("max_warp"), F.min_by("y", F.struct("s", "y")).cast("int").alias("min_base"), F.min_by("y", F.struct(-F.col("s"), "y")).cast("int").alias("max_base"))


@query("perturb_distance", f"WITH {_WARP} SELECT img_id, {_r('1 - sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w)))', 'cosine_distance')}, {_r('sqrt(sum((v - w) * (v - w)))', 'l2')}, {_r('max(abs(v - w))', 'max_delta')}, {_r('avg(abs(v - w))', 'mean_delta')} FROM wp GROUP BY img_id")
def perturb_distance(spark, sf_dir):
    v, w = F.col("v"), F.col("w")
    return warped(spark, sf_dir).groupBy("img_id").agg(R(1 - F.sum(v * w) / (F.sqrt(F.sum(v * v)) * F.sqrt(F.sum(w * w)))).alias("cosine_distance"), R(F.sqrt(F.sum((v - w) * (v - w)))).alias("l2"), R(F.max(F.abs(v - w))).alias("max_delta"), R(F.avg(F.abs(v - w))).alias("mean_delta"))


@query("drift_losses", f"""WITH {_WARP}, s AS (SELECT *, greatest(1e-7, least(1 - 1e-7, w)) AS q, exp(v) / sum(exp(v)) OVER (PARTITION BY img_id) AS pv, exp(w) / sum(exp(w)) OVER (PARTITION BY img_id) AS pw FROM wp)
SELECT img_id, {_r('avg(abs(v - w))', 'l1_mean')}, {_r('avg((v - w) * (v - w))', 'mse_mean')}, {_r('avg(-(v * ln(q) + (1 - v) * ln(1 - q)))', 'bce_loss')}, {_r('sum(pv * (ln(pv) - ln(pw)))', 'kl_loss')} FROM s GROUP BY img_id""")
def drift_losses(spark, sf_dir):
    by = Window.partitionBy("img_id")
    v, w, q = F.col("v"), F.col("w"), F.col("q")
    s = warped(spark, sf_dir).withColumn("q", F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), w))).withColumn("pv", F.exp(v) / F.sum(F.exp(v)).over(by)).withColumn("pw", F.exp(w) / F.sum(F.exp(w)).over(by))
    return s.groupBy("img_id").agg(R(F.avg(F.abs(v - w))).alias("l1_mean"), R(F.avg((v - w) * (v - w))).alias("mse_mean"), R(F.avg(-(v * F.log(q) + (1 - v) * F.log(1 - q)))).alias("bce_loss"), R(F.sum(F.col("pv") * (F.log("pv") - F.log("pw")))).alias("kl_loss"))


# ---- spectra ------------------------------------------------------------------------------------

def _dft_sql(src: str, out: str, n: int, by: str) -> str:
    tw = f"(SELECT k, i, cos(-2 * pi() * ((k * i) % {n}) / {n}) AS c, sin(-2 * pi() * ((k * i) % {n}) / {n}) AS s FROM range({n}) a(k), range({n}) b(i))"
    return f"""{out}r AS (SELECT {by}, y, t.k AS fv, sum(v * c) AS a, sum(v * s) AS b FROM {src} JOIN {tw} t ON t.i = x GROUP BY ALL),
{out} AS (SELECT {by}, t.k AS u, fv, sum(a * c - b * s) AS re, sum(a * s + b * c) AS im FROM {out}r JOIN {tw} t ON t.i = y GROUP BY ALL)"""


def _shifted(n: int) -> tuple[str, str]:
    """Power and radius after moving frequency zero to the middle."""
    return "re * re + im * im", f"sqrt(pow((u + {n // 2}) % {n} - {n // 2}, 2) + pow((fv + {n // 2}) % {n} - {n // 2}, 2))"


_P, _RAD = _shifted(N)
_MAXR = "sqrt(32.0)"


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.dft(P.pixels(unit(spark, sf_dir)), N, ["img_id"]).withColumnRenamed("v", "fv")
    return f.withColumn("p", F.expr(_P)).withColumn("r", F.expr(_RAD)).withColumn("r_max", F.expr(_MAXR))


_SPEC = f"{_UN}, {_PX('un')}, {_dft_sql('px', 'ft', N, 'img_id')}, sp AS (SELECT *, {_P} AS p, {_RAD} AS r, {_MAXR} AS R_ FROM ft)"
_band = lambda lo, hi, R_="R_": f"sum(CASE WHEN r >= {lo} * {R_} AND r < {hi} * {R_} THEN p ELSE 0 END)"


@query("dft_radial_bands", f"""WITH {_SPEC} SELECT img_id, {_r(_band(0, 0.2) + ' / (sum(p) + 1e-10)', 'low')}, {_r(_band(0.2, 0.6) + ' / (sum(p) + 1e-10)', 'mid')}, {_r(_band(0.6, 9) + ' / (sum(p) + 1e-10)', 'high')},
{_r('sum(p * (abs(CASE WHEN u >= 4 THEN u - 8 ELSE u END) + abs(CASE WHEN fv >= 4 THEN fv - 8 ELSE fv END)) / 8.0) / (2 * sum(p) + 1e-10)', 'power_centroid')} FROM sp GROUP BY img_id""")
def dft_radial_bands(spark, sf_dir):
    b = lambda lo, hi: F.expr(_band(lo, hi, "r_max"))
    total = F.sum("p") + 1e-10
    cent = F.expr("sum(p * (abs(CASE WHEN u >= 4 THEN u - 8 ELSE u END) + abs(CASE WHEN fv >= 4 THEN fv - 8 ELSE fv END)) / 8.0D) / (2 * sum(p) + 1e-10D)")
    return spectrum(spark, sf_dir).groupBy("img_id").agg(R(b(0, 0.2) / total).alias("low"), R(b(0.2, 0.6) / total).alias("mid"), R(b(0.6, 9) / total).alias("high"), R(cent).alias("power_centroid"))


_EDGES = [(0, 0.1), (0.1, 0.25), (0.25, 0.45), (0.45, 0.7), (0.7, 1.0)]
_WANT = [0.65, 0.20, 0.10, 0.035, 0.015]


@query("dft_midband", f"""WITH {_SPEC}, b AS (SELECT img_id, {', '.join(f'{_band(lo, hi)} AS e{k}' for k, (lo, hi) in enumerate(_EDGES))} FROM sp GROUP BY img_id),
q AS (SELECT img_id, {', '.join(f'e{k} / (e0 + e1 + e2 + e3 + e4 + 1e-10) AS q{k}' for k in range(5))} FROM b)
SELECT img_id, {_r('q2', 'midband_energy_ratio')}, {_r('q2 - 0.1', 'midband_deviation')}, {_r('sqrt(list_var_pop([' + ', '.join(f'q{k} - {w}' for k, w in enumerate(_WANT)) + ']))', 'spectral_slope_deviation')}, {_r('q4 / (q2 + 1e-10)', 'high_to_mid_ratio')} FROM q""")
def dft_midband(spark, sf_dir):
    b = spectrum(spark, sf_dir).groupBy("img_id").agg(*[F.expr(_band(lo, hi, "r_max")).alias(f"e{k}") for k, (lo, hi) in enumerate(_EDGES)])
    total = sum((F.col(f"e{k}") for k in range(5)), F.lit(0.0)) + 1e-10
    q = b.select("img_id", *[(F.col(f"e{k}") / total).alias(f"q{k}") for k in range(5)])
    dev = [F.col(f"q{k}") - w for k, w in enumerate(_WANT)]
    mean = sum(dev, F.lit(0.0)) / 5
    var = sum(((d - mean) * (d - mean) for d in dev), F.lit(0.0)) / 5
    return q.select("img_id", R(F.col("q2")).alias("midband_energy_ratio"), R(F.col("q2") - 0.1).alias("midband_deviation"), R(F.sqrt(var)).alias("spectral_slope_deviation"), R(F.col("q4") / (F.col("q2") + 1e-10)).alias("high_to_mid_ratio"))


_QUAD = "sum(CASE WHEN u {op} 4 AND fv {op} 4 THEN p ELSE 0 END)"


@query("dft_discrepancy", f"""WITH {_SPEC} SELECT img_id, {_r(_QUAD.format(op='>=') + ' / sum(p)', 'high_freq_ratio')}, {_r(_QUAD.format(op='<'), 'low_freq_energy')}, {_r('max(sqrt(p))', 'max_magnitude')}, {_r('avg(ln(sqrt(p) + 1))', 'mean_log1p_magnitude')} FROM sp GROUP BY img_id""")
def dft_discrepancy(spark, sf_dir):
    return spectrum(spark, sf_dir).groupBy("img_id").agg(R(F.expr(_QUAD.format(op=">=") + " / sum(p)")).alias("high_freq_ratio"), R(F.expr(_QUAD.format(op="<"))).alias("low_freq_energy"), R(F.max(F.sqrt("p"))).alias("max_magnitude"), R(F.avg(F.log(F.sqrt("p") + 1))).alias("mean_log1p_magnitude"))


@query("spectral_residual", f"""WITH {_SPEC}, s AS (SELECT img_id, 20 * ln(sqrt(p) + 1) AS v FROM sp), m AS (SELECT *, min(v) OVER (PARTITION BY img_id) AS lo, max(v) OVER (PARTITION BY img_id) AS hi FROM s),
n AS (SELECT img_id, v, (v - lo) / (hi - lo + 1e-10) AS n FROM m) SELECT img_id, {_r('avg(v)', 'mean')}, {_r('max(v)', 'top')}, {_r('-sum(n * ln(n + 1e-10))', 'spectral_entropy')} FROM n GROUP BY img_id""")
def spectral_residual(spark, sf_dir):
    w = Window.partitionBy("img_id")
    s = spectrum(spark, sf_dir).select("img_id", (20 * F.log(F.sqrt("p") + 1)).alias("v"))
    n = s.withColumn("n", (F.col("v") - F.min("v").over(w)) / (F.max("v").over(w) - F.min("v").over(w) + 1e-10))
    return n.groupBy("img_id").agg(R(F.avg("v")).alias("mean"), R(F.max("v")).alias("top"), R(-F.sum(F.col("n") * F.log(F.col("n") + 1e-10))).alias("spectral_entropy"))


def _dct_sql(src: str, out: str, n: int, by: str) -> str:
    tw = f"(SELECT k, i, CASE WHEN k = 0 THEN sqrt(1.0 / {n}) ELSE sqrt(2.0 / {n}) END * cos(pi() * (2 * i + 1) * k / (2 * {n})) AS c FROM range({n}) a(k), range({n}) b(i))"
    return f"""{out}r AS (SELECT {by}, y, t.k AS fv, sum(v * c) AS a FROM {src} JOIN {tw} t ON t.i = x GROUP BY ALL),
{out} AS (SELECT {by}, t.k AS u, fv, sum(a * c) AS d FROM {out}r JOIN {tw} t ON t.i = y GROUP BY ALL)"""


@query("dct_ratios", f"""WITH {_UN}, {_PX('un')}, {_dct_sql('px', 'dc', N, 'img_id')}, m AS (SELECT *, max(abs(d)) OVER (PARTITION BY img_id) AS top FROM dc),
s AS (SELECT img_id, sum(d * d) AS t, max(CASE WHEN u = 0 AND fv = 0 THEN d * d END) AS z, sum(CASE WHEN u >= 4 AND fv >= 4 THEN d * d ELSE 0 END) AS h, avg(CASE WHEN abs(d) < 0.01 * top THEN 1.0 ELSE 0.0 END) AS sparse FROM m GROUP BY img_id)
SELECT img_id, {_r('(t - z) / (z + 1e-10)', 'dct_ac_dc_ratio')}, {_r('h / t', 'dct_high_freq_energy')}, {_r('sparse', 'dct_sparsity')} FROM s""")
def dct_ratios(spark, sf_dir):
    d = P.dct(P.pixels(unit(spark, sf_dir)), N, ["img_id"]).withColumn("top", F.max(F.abs("d")).over(Window.partitionBy("img_id")))
    dd = F.col("d") * F.col("d")
    s = d.groupBy("img_id").agg(F.sum(dd).alias("t"), F.max(F.when((F.col("u") == 0) & (F.col("v") == 0), dd)).alias("z"), F.sum(F.when((F.col("u") >= 4) & (F.col("v") >= 4), dd).otherwise(0.0)).alias("h"), F.avg((F.abs("d") < 0.01 * F.col("top")).cast("double")).alias("sparse"))
    return s.select("img_id", R((F.col("t") - F.col("z")) / (F.col("z") + 1e-10)).alias("dct_ac_dc_ratio"), R(F.col("h") / F.col("t")).alias("dct_high_freq_energy"), R(F.col("sparse")).alias("dct_sparsity"))


@query("block_dct_energy", f"""WITH {_UN}, {_PX('un', 'pz')}, px AS (SELECT img_id, y // 2 AS ty, x // 2 AS tx, y % 2 AS y, x % 2 AS x, v FROM pz WHERE y // 2 * 2 < 6 AND x // 2 * 2 < 6), {_dct_sql('px', 'dc', 2, 'img_id, ty, tx')},
b AS (SELECT img_id, ty, tx, sum(d * d) - max(CASE WHEN u = 0 AND fv = 0 THEN d * d END) AS e FROM dc GROUP BY img_id, ty, tx) SELECT img_id, {_r('avg(e)', 'dct_block_energy_mean')}, {_r('stddev_pop(e)', 'dct_block_energy_std')} FROM b GROUP BY img_id""")
def block_dct_energy(spark, sf_dir):
    t = P.tiles(P.pixels(unit(spark, sf_dir)), 2, h=N, w=N, drop_last=True).select("img_id", "ty", "tx", F.col("py").alias("y"), F.col("px_").alias("x"), "v")
    d = P.dct(t, 2, ["img_id", "ty", "tx"])
    dd = F.col("d") * F.col("d")
    e = d.groupBy("img_id", "ty", "tx").agg((F.sum(dd) - F.max(F.when((F.col("u") == 0) & (F.col("v") == 0), dd))).alias("e"))
    return e.groupBy("img_id").agg(R(F.avg("e")).alias("dct_block_energy_mean"), R(F.stddev_pop("e")).alias("dct_block_energy_std"))


# ---- patches ------------------------------------------------------------------------------------

@query("patchify_stats", f"""WITH {_UN}, {_PX('un')}, t AS (SELECT img_id, a.a AS ty, b.b AS tx, v FROM px JOIN range(3) a(a) ON y BETWEEN a.a * 2 AND a.a * 2 + 2 JOIN range(3) b(b) ON x BETWEEN b.b * 2 AND b.b * 2 + 2)
SELECT img_id, CAST(ty * 3 + tx AS INTEGER) AS patch, count(*) AS n, {_r('avg(v)', 'mean')}, {_r('var_pop(v)', 'var')} FROM t GROUP BY ALL""")
def patchify_stats(spark, sf_dir):
    t = P.tiles(P.pixels(unit(spark, sf_dir)), 3, 2, h=N, w=N)
    return t.groupBy("img_id", (F.col("ty") * 3 + F.col("tx")).cast("int").alias("patch")).agg(F.count(F.lit(1)).alias("n"), R(F.avg("v")).alias("mean"), R(F.var_pop("v")).alias("var"))


_TILE4 = f"{_UN}, {_PX('un', 'pz')}, px AS (SELECT img_id, y // 4 * 2 + x // 4 AS tile, y % 4 AS y, x % 4 AS x, v FROM pz), {_dft_sql('px', 'ft', 4, 'img_id, tile')}"


def tile_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.tiles(P.pixels(unit(spark, sf_dir)), 4, h=N, w=N).select("img_id", (F.col("ty") * 2 + F.col("tx")).cast("int").alias("tile"), F.col("py").alias("y"), F.col("px_").alias("x"), "v")
    return P.dft(t, 4, ["img_id", "tile"]).withColumnRenamed("v", "fv").withColumn("mag", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


@query("topk_patch", f"""WITH {_TILE4}, m AS (SELECT img_id, tile, round(max(sqrt(re * re + im * im)), 6) AS mag FROM ft GROUP BY img_id, tile), k AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY mag DESC, tile) AS place FROM m)
SELECT img_id, CAST(tile AS INTEGER) AS tile, mag + 0.0 AS max_fourier_magnitude, place = 1 AS selected FROM k WHERE place <= 3""")
def topk_patch(spark, sf_dir):
    m = tile_spectra(spark, sf_dir).groupBy("img_id", "tile").agg(R(F.max("mag")).alias("max_fourier_magnitude"))
    place = F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("max_fourier_magnitude"), "tile"))
    return m.withColumn("place", place).where("place <= 3").select("img_id", "tile", "max_fourier_magnitude", (F.col("place") == 1).alias("selected"))


_R4 = "sqrt(pow((u + 2) % 4 - 2, 2) + pow((fv + 2) % 4 - 2, 2))"


@query("extreme_patches", f"""WITH {_TILE4}, m AS (SELECT img_id, tile, sqrt(re * re + im * im) AS g, {_R4} AS r FROM ft),
d AS (SELECT img_id, tile, round(abs(avg(CASE WHEN r < 1.5 THEN g END) - avg(CASE WHEN r >= 1.5 THEN g END)), 6) AS div FROM m GROUP BY img_id, tile),
k AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY div DESC, tile) AS a, row_number() OVER (PARTITION BY img_id ORDER BY div, tile DESC) AS b FROM d)
SELECT img_id, CAST(tile AS INTEGER) AS tile, div + 0.0 AS divergence, 'most' AS side FROM k WHERE a <= 1 UNION ALL SELECT img_id, CAST(tile AS INTEGER), div + 0.0, 'least' FROM k WHERE b <= 1""")
def extreme_patches(spark, sf_dir):
    m = tile_spectra(spark, sf_dir).withColumn("r", F.expr(_R4))
    d = m.groupBy("img_id", "tile").agg(R(F.abs(F.avg(F.when(F.col("r") < 1.5, F.col("mag"))) - F.avg(F.when(F.col("r") >= 1.5, F.col("mag"))))).alias("divergence"))
    w = Window.partitionBy("img_id")
    k = d.withColumn("a", F.row_number().over(w.orderBy(F.desc("divergence"), "tile"))).withColumn("b", F.row_number().over(w.orderBy("divergence", F.desc("tile"))))
    pick = lambda c, s: k.where(F.col(c) <= 1).select("img_id", "tile", "divergence", F.lit(s).alias("side"))
    return pick("a", "most").union(pick("b", "least"))


@query("patch_consistency", f"""WITH {_TILE4}, s AS (SELECT img_id, tile, avg(v) AS m, stddev_pop(v) AS s FROM px GROUP BY img_id, tile),
f AS (SELECT img_id, tile, sum(sqrt(re * re + im * im) * {_R4} / 4) / (sum(sqrt(re * re + im * im)) + 1e-10) AS c FROM ft GROUP BY img_id, tile)
SELECT img_id, {_r('stddev_pop(m) / (abs(avg(m)) + 1e-10)', 'patch_mean_cv')}, {_r('stddev_pop(s) / (abs(avg(s)) + 1e-10)', 'patch_std_cv')}, {_r('stddev_pop(c) / (abs(avg(c)) + 1e-10)', 'patch_freq_centroid_cv')}, {_r('max(c) - min(c)', 'patch_freq_centroid_range')}, {_r('corr(m, s)', 'patch_coherence_score')}
FROM s JOIN f USING (img_id, tile) GROUP BY img_id""")
def patch_consistency(spark, sf_dir):
    px = P.tiles(P.pixels(unit(spark, sf_dir)), 4, h=N, w=N).groupBy("img_id", (F.col("ty") * 2 + F.col("tx")).cast("int").alias("tile")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    f = tile_spectra(spark, sf_dir).groupBy("img_id", "tile").agg((F.expr(f"sum(mag * {_R4} / 4)") / (F.sum("mag") + 1e-10)).alias("c"))
    cv = lambda c: R(F.stddev_pop(c) / (F.abs(F.avg(c)) + 1e-10))
    return px.join(f, ["img_id", "tile"]).groupBy("img_id").agg(cv("m").alias("patch_mean_cv"), cv("s").alias("patch_std_cv"), cv("c").alias("patch_freq_centroid_cv"), R(F.max("c") - F.min("c")).alias("patch_freq_centroid_range"), R(F.corr("m", "s")).alias("patch_coherence_score"))


@query("box_counting", f"""WITH {_UN}, {_PX('un', 'pz')}, px AS (SELECT *, median(v) OVER (PARTITION BY img_id) AS med FROM pz), b AS (SELECT img_id, s, count(DISTINCT (y // s, x // s)) AS n FROM px, (VALUES (2), (4), (8)) z(s) WHERE v > med GROUP BY img_id, s)
SELECT img_id, {_r('CASE WHEN count(*) < 2 THEN 1.0 ELSE regr_slope(ln(n), ln(1.0 / s)) END', 'fractal_dim_gray')} FROM b GROUP BY img_id""")
def box_counting(spark, sf_dir):
    ps = unit(spark, sf_dir)
    mid = ps.select("img_id", F.explode("data").alias("v")).groupBy("img_id").agg(F.expr("percentile(v, 0.5)").alias("med"))
    px = P.pixels(ps).join(mid, "img_id").where("v > med").withColumn("s", F.explode(F.array(*[F.lit(k) for k in (2, 4, 8)])))
    boxes = px.select("img_id", "s", F.floor(F.col("y") / F.col("s")).alias("a"), F.floor(F.col("x") / F.col("s")).alias("b")).distinct().groupBy("img_id", "s").agg(F.count(F.lit(1)).alias("n"))
    slope = F.regr_slope(F.log("n"), F.log(1.0 / F.col("s")))
    return boxes.groupBy("img_id").agg(R(F.when(F.count(F.lit(1)) < 2, F.lit(1.0)).otherwise(slope)).alias("fractal_dim_gray"))


@query("condense_vectors", f"""WITH {_IM} SELECT img_id, {_r('list_avg([d[k] FOR k IN range(1, 65, 2)])', 'stride_mean')}, {_r('list_avg(d[1:32])', 'kept_mean')}, {_r('sqrt(list_var_pop(d[1:32]))', 'kept_std')} FROM im""")
def condense_vectors(spark, sf_dir):
    strided = F.filter("data", lambda v, i: i % 2 == 0)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    kept = F.slice("data", 1, 32)
    return raw(spark, sf_dir).withColumn("s", strided).withColumn("k", kept).withColumn("m", mean(F.col("k"))).select("img_id", R(mean(F.col("s"))).alias("stride_mean"), R(F.col("m")).alias("kept_mean"), R(F.sqrt(F.aggregate("k", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / F.size("k"))).alias("kept_std"))
