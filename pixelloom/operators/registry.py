"""Feature modules by name, and their singles and pairs."""

from __future__ import annotations

from itertools import combinations as _pairs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Modules in the order they run, with the number of features each one gives.
FEATURE_COUNTS = {"artwork": 49, "learned": 768, "residual": 11, "wavelet": 26, "vae": 2, "vit": 2}


def enabled(names: list[str] | None = None) -> list[str]:
    """The modules to run, in the fixed order; None means all of them, and names are taken in any case."""
    if names is None:
        return list(FEATURE_COUNTS)
    wanted = {n.lower() for n in names}
    unknown = wanted - set(FEATURE_COUNTS)
    if unknown:
        raise ValueError(f"unknown modules: {sorted(unknown)}")
    return [n for n in FEATURE_COUNTS if n in wanted]


def combinations(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """(modules, n_features, size) for every module and every pair of modules, joined on their order."""
    m = spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(counts.items())], "ord int, name string, n int")
    a, b = m.toDF("oa", "na", "ca"), m.toDF("ob", "nb", "cb")
    pairs = a.join(b, F.col("oa") < F.col("ob")).select(F.concat_ws("+", "na", "nb").alias("modules"), (F.col("ca") + F.col("cb")).alias("n_features"), F.lit(2).alias("size"))
    return m.select(F.col("name").alias("modules"), F.col("n").alias("n_features"), F.lit(1).alias("size")).union(pairs)


def module_sets(names: list[str] | None = None) -> list[tuple[str, ...]]:
    on = enabled(names)
    return [(n,) for n in on] + list(_pairs(on, 2))
