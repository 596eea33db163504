"""Feature extraction and learning queries; beyond SQL, so held by tests instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rounded as R
from ..operators import extractor, features, learned, ml, wavelet
from ..operators import planes as P
from ..sources.tables import Options

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
N = 8


def embedded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an 8 x 8 gray image of 0 .. 255, in as many partitions as there are cores."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    u = P.levels(P.unit(P.planes(e, "vec_id", "embedding", N, N)), 256)
    images = u.join(e.select(F.col("vec_id").alias("img_id"), (F.col("label") % 2).cast("int").alias("label")), "img_id")
    return images.select("img_id", "h", "w", F.lit(1).alias("channels"), "data", "label").repartition(spark.sparkContext.defaultParallelism)


def _extract(*families: str, side: int | None = features.SIDE):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features.extract(embedded_images(spark, sf_dir), list(families), side)

    return run


QUERIES["surface_features"] = _extract("surface")
QUERIES["complex_features"] = _extract("complex")
QUERIES["edge_features"] = _extract("edge")
QUERIES["enhanced_features"] = _extract("enhanced")
QUERIES["gabor_wavelet_features"] = _extract("gabor")
QUERIES["hog_jpeg_features"] = _extract("hog")
QUERIES["linework_features"] = _extract("linework")
QUERIES["patch_features"] = _extract("patch")
QUERIES["residual_features"] = _extract("residual", "discrepancy")
QUERIES["style_features"] = _extract("style")


def learned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of each image's vector, and its distance from that of the image with seeded noise."""
    images = embedded_images(spark, sf_dir)
    a = learned.vectors(images, "projection64").withColumnRenamed("vector", "a")
    b = learned.vectors(learned.perturbed(images.drop("label")), "projection64").withColumnRenamed("vector", "b")
    d = a.join(b, "img_id").select("img_id", *[R(c).alias(n) for n, c in learned.distances("a", "b").items()])
    s = learned.summary(a.withColumnRenamed("a", "vector"), "vector")
    return d.join(s.select("img_id", R(F.col("vector_mean")).alias("vector_mean"), R(F.col("vector_std")).alias("vector_std")), "img_id")


def wavelet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.analyse(embedded_images(spark, sf_dir), dim_patch=32)


_COLUMNS = [f"d{i}" for i in range(16)]


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("img_id"), (F.col("label") % 2).cast("int").alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(_COLUMNS)])


def trained_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of a trained model: one row for each."""
    t = ml.train(vector_table(spark, sf_dir), _COLUMNS, Options(), rounds=10)
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(t.metrics.items())], "metric string, value double")


def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.cross_validate(vector_table(spark, sf_dir), _COLUMNS, Options(folds=3, hidden=16), rounds=5)


def unified_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two summary modules of every image, joined."""
    return extractor.unified(embedded_images(spark, sf_dir).drop("label"), ["vae", "vit"])


def reconciled_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trained models on the same vectors, and the surer one's verdict on each."""
    rows = vector_table(spark, sf_dir)
    a, b = (ml.train(rows, c, Options(max_depth=2, seed=k), rounds=4) for k, c in enumerate((_COLUMNS[:8], _COLUMNS[8:])))
    return extractor.infer_pair(rows, a, b, label="label")


QUERIES |= {"unified_summary": unified_summary, "reconciled_pair": reconciled_pair, "learned_vectors": learned_vectors, "wavelet_rows": wavelet_rows, "trained_model": trained_model, "out_of_fold": out_of_fold}
