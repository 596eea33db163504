"""Sources and sinks for feature rows, metrics, plot frames, run folders and configurations."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import finite_or_zero

IMAGE_SUFFIXES = (".jpg", ".webp", ".jpeg", ".png", ".tif", ".tiff")
RUN_NAME = r"^\d{8}_\d{6}$"

#: One partial result of an image; keys that a stage doesn't produce are null.
RESULT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("bce_loss", "image_mean_ff", "max_base", "max_warp", "min_base", "min_warp")] + [T.StructField("sobel", T.ArrayType(T.LongType()))])
RESULTS = T.StructType([T.StructField("results", T.ArrayType(RESULT))])


def has_image_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)).isin(*IMAGE_SUFFIXES)


def is_run_name(name: Column) -> Column:
    return name.rlike(RUN_NAME)


def latest_runs(names: DataFrame, column: str = "name", n: int = 2) -> DataFrame:
    return names.where(is_run_name(F.col(column))).orderBy(F.desc(column)).limit(n)


def union_sources(parts: list[tuple[DataFrame, str, int | None]]) -> DataFrame:
    """A bag union by name, each part with its source's name and label, in the order given."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(s)).withColumn("label", F.lit(k).cast("int")) for df, s, k in parts])


def read_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested results as one struct list per image, from JSON lines or from one JSON list."""
    return spark.read.schema(RESULTS).option("multiLine", multi_line).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flatten(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One numeric row per partial result: lists become their mean, missing and non-finite values 0."""
    keep = keep or []
    flat = results.select(*keep, F.inline("results"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.when(F.size(c) > 0, F.size(c))
    return flat.select(*keep, *[finite_or_zero(mean(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)).alias(f.name) for f in flat.schema if f.name not in keep])


def as_strings(df: DataFrame) -> DataFrame:
    """One row of metrics with every value as text, in the order of names."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in sorted(df.columns)])


def write_metrics(df: DataFrame, path: str) -> None:
    as_strings(df).coalesce(1).write.mode("overwrite").json(path)  # one row


def write_frame(df: DataFrame, model_name: str, path: str) -> None:
    df.withColumn("model_name", F.lit(model_name)).write.mode("overwrite").json(path)


def read_frame(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """A plot frame without its model's name, and the names."""
    df = spark.read.schema(f"{schema}, model_name string").json(path)
    return df.drop("model_name"), df.select("model_name")


@dataclass(frozen=True)
class Options:
    """Settings of extraction and training; a section or key that a file leaves out keeps its default."""

    alpha: float = 0.5
    batch_size: int = 0
    condense_factor: int = 2
    dim_factor: int = 3
    dim_patch: int = 256
    top_k: int = 4
    dtype: str = "float64"
    max_depth: int = 4
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    rounds: int = 200
    early_stopping: int = 10
    variance: float = 0.95
    test_size: float = 0.2
    seed: int = 0
    folds: int = 5
    abstain: float = 0.3
    hidden: int = 100
    svm_c: float = 10.0
    calibration_folds: int = 3
    datasets: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.dtype == "bfloat16":
            raise ValueError("bfloat16 has no column type")


def load_options(path: str | None = None, **changes) -> Options:
    """Options from a TOML file: the keys of all its sections, whatever the section's name."""
    known, found = {f.name for f in fields(Options)}, {}
    if path:
        with open(path, "rb") as f:
            for name, section in tomllib.load(f).items():
                if name == "datasets":
                    found["datasets"] = section
                elif isinstance(section, dict):
                    found |= {k: v for k, v in section.items() if k in known}
    return Options(**(found | changes))
