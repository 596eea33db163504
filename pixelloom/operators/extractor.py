"""All feature modules behind one call, their combinations, and inference with a pair of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decide, features, learned, wavelet
from .ml import Trained
from .registry import enabled, module_sets


def _wavelet(images: DataFrame, **options) -> DataFrame:
    """The wavelet rows as numbers: lists become their mean."""
    rows = wavelet.analyse(images, **options)
    lists = [f.name for f in rows.schema if f.dataType.typeName() == "array"]
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(c)
    return rows.select("img_id", *[(mean(c.name) if c.name in lists else F.col(c.name).cast("double")).alias(f"wavelet_{c.name}") for c in rows.schema if c.name != "img_id"])


def _learned(images: DataFrame) -> DataFrame:
    v = learned.vectors(images, "projection768")
    return v.select("img_id", *[F.get("vector", F.lit(i)).alias(f"cnxt_{i}") for i in range(768)])


MODULES = {
    "artwork": lambda images: features.extract(images, ["surface"]),
    "learned": _learned,
    "residual": lambda images: features.extract(images, ["residual"]).select("img_id", *[F.col(n).alias(f"residual_{n}") for n in features.NAMES["residual"]]),
    "wavelet": lambda images: _wavelet(images, dim_patch=32),
    "vae": lambda images: learned.summary(learned.vectors(images, "projection64"), "vae"),
    "vit": lambda images: learned.summary(learned.vectors(images, "projection768"), "vit"),
}


def unified(images: DataFrame, modules: list[str] | None = None) -> DataFrame:
    """img_id and the features of the modules, each computed once and joined by img_id; no module gives img_id alone."""
    parts = [MODULES[m](images) for m in enabled(modules)]
    return reduce(lambda a, b: a.join(b, "img_id"), parts, images.select("img_id"))


def combination_sizes(images: DataFrame, modules: list[str] | None = None) -> dict[str, int]:
    """Number of features of each single module and each pair, from the schemas; nothing is computed twice, or at all."""
    size = {m: len(MODULES[m](images).columns) - 1 for m in enabled(modules)}
    return {"+".join(s): sum(size[m] for m in s) for s in module_sets(modules)}


def combinations(images: DataFrame, modules: list[str] | None = None) -> dict[str, DataFrame]:
    """The features of each single module and each pair of modules, by name ("a", "a+b"); a pair joins what its modules give alone.

    Tables are lazy. To run several without computing a module twice, write the single ones and pass those read back to pair().
    """
    single = {m: MODULES[m](images) for m in enabled(modules)}
    return {"+".join(s): pair(*(single[m] for m in s)) for s in module_sets(modules)}


def pair(*parts: DataFrame) -> DataFrame:
    """Feature tables joined by img_id."""
    return reduce(lambda a, b: a.join(b, "img_id"), parts)


def run_combinations(images: DataFrame, path: str, modules: list[str] | None = None) -> dict[str, dict]:
    """Every module's table, written to path once, and from these the features of all modules and pairs.

    single_modules and module_pairs hold tables by name, summary their numbers and counts of features.
    """
    spark = images.sparkSession
    single = {}
    for m in enabled(modules):
        MODULES[m](images).write.mode("overwrite").parquet(f"{path}/{m}")
        single[m] = spark.read.parquet(f"{path}/{m}")
    pairs = {"+".join(s): pair(*(single[m] for m in s)) for s in module_sets(modules) if len(s) == 2}
    count = lambda tables: {k: len(t.columns) - 1 for k, t in tables.items()}
    summary = {"total_single_modules": len(single), "total_module_pairs": len(pairs), "single_module_feature_counts": count(single), "pair_feature_counts": count(pairs)}
    return {"single_modules": single, "module_pairs": pairs, "summary": summary}


def infer_pair(rows: DataFrame, ae: Trained, dc: Trained, key: str = "img_id", label: str | None = None) -> DataFrame:
    """key, model, num and origin (and match, if there is a label) of the surer of two models that read the same features."""
    scored = dc.score(ae.score(rows, "p_ae").drop("origin"), "p_dc").drop("origin")
    best = decide.reconcile(F.col("p_ae"), F.col("p_dc"))
    out = scored.withColumns({f"best_{k}": c for k, c in best.items()})
    more = [(F.col("best_origin") == F.col(label)).cast("int").alias("match")] if label else []
    return out.select(key, *[F.col(f"best_{k}").alias(k) for k in best], *more)
