"""Learning on feature tables: splits, PCA by variance, boosted trees, kernel SVM, network, votes and calibration."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..sources.tables import Options
from . import folds as joint


def clean(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing and non-finite features are 0."""
    return df.select(*[c for c in df.columns if c not in features], *[S.finite_or_zero(F.col(c)).alias(c) for c in features])


def standardise(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature; a deviation of 0 counts as 1."""
    r = train.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (r[f"m{i}"] or 0.0, r[f"s{i}"] or 1.0) for i, c in enumerate(features)}


def scaled(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in scale], *[((F.col(c) - m) / s).alias(c) for c, (m, s) in scale.items()])


def split(df: DataFrame, label: str, key: str, test_size: float, seed: int) -> DataFrame:
    """df with `train`: false for test_size of each label's rows, the first of a seeded shuffle."""
    at = S.stratified(df, label, key, seed)
    return at.withColumn("train", F.col("turn") >= F.round(F.col("size") * F.lit(float(test_size)))).drop("turn", "size")


def folded(df: DataFrame, label: str, key: str, folds: int, seed: int) -> DataFrame:
    """df with `fold`, dealt out in a seeded shuffle of each label, so that folds have equal shares of it."""
    at = S.stratified(df, label, key, seed)
    return at.withColumn("fold", F.pmod("turn", F.lit(folds)).cast("int")).drop("turn", "size")


def pca_by_variance(train: DataFrame, features: list[str], variance: float = 0.95) -> tuple[PipelineModel, np.ndarray]:
    """Centring, then the fewest components that explain the variance, fitted on train; and the explained shares."""
    n = len(features)
    assembled = VectorAssembler(inputCols=features, outputCol="raw")
    full = PCA(k=n, inputCol="raw", outputCol="pc").fit(assembled.transform(train))
    share = full.explainedVariance.toArray()
    k = int(min(n, np.searchsorted(np.cumsum(share), variance - 1e-12) + 1))
    return Pipeline(stages=[assembled, full, VectorSlicer(inputCol="pc", outputCol="x", indices=list(range(k)))]).fit(train), share[:k]


def centred(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """The means of features, as scales of deviation 1: Spark's PCA projects without centring."""
    return {c: (m, 1.0) for c, (m, _) in standardise(train, features).items()}


def class_weight(df: DataFrame, label: str) -> Column:
    """n0 / n1 for positives and 1 for negatives, so that both classes weigh alike."""
    r = df.agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b")).first()
    return F.when(F.col(label) == 1, F.lit(r["a"] / r["b"] if r["a"] and r["b"] else 1.0)).otherwise(F.lit(1.0))


def boosted(options: Options, features: str = "x", label: str = "label", weight: str | None = None, rounds: int | None = None, held: str | None = None) -> GBTClassifier:
    """Boosted trees; if held names a column, rows where it is true only stop them, as soon as a tree no longer lowers their error."""
    g = GBTClassifier(featuresCol=features, labelCol=label, maxDepth=options.max_depth, stepSize=options.learning_rate, subsamplingRate=options.subsample, featureSubsetStrategy=str(options.colsample), maxIter=rounds or options.rounds, seed=options.seed)
    if held:
        g = g.setValidationIndicatorCol(held).setParams(validationTol=0.0)
    return g.setWeightCol(weight) if weight else g


def fourier_phases(dim: int, gamma: float, d: int = 128, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (dim, d)), rng.uniform(0, 2 * np.pi, d)


def fourier_features(df: DataFrame, column: str, dim: int, gamma: float, out: str, d: int = 128, seed: int = 3) -> DataFrame:
    """Random Fourier features of a vector column, whose dot products approach exp(-gamma |x - y|^2)."""
    w, b = fourier_phases(dim, gamma, d, seed)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        y = np.sqrt(2 / d) * np.cos(np.stack(x.to_numpy()) @ w + b) if len(x) else np.zeros((0, d))
        return pd.Series(list(y))

    return df.withColumn(out, array_to_vector(lift(vector_to_array(F.col(column)))))


def svm(train: DataFrame, dim: int, options: Options, label: str = "label", key: str = "img_id"):
    """An RBF support vector machine by random features, with its margin calibrated by a logistic curve; returns score(df, name)."""
    gamma = 1.0 / max(1, dim)

    def fit(rows: DataFrame):
        margin = LinearSVC(featuresCol="rff", labelCol=label, regParam=1.0 / (options.svm_c * 100), maxIter=50).fit(fourier_features(rows, "x", dim, gamma, "rff"))
        return lambda df: margin.transform(fourier_features(df, "x", dim, gamma, "rff")).withColumn("margin", F.get(vector_to_array("rawPrediction"), F.lit(1))).drop("rff", "rawPrediction", "prediction")

    return _calibrated(fit, train, label, key, options)


def network(train: DataFrame, dim: int, options: Options, label: str = "label", key: str = "img_id"):
    """One hidden layer, calibrated; returns score(df, name)."""
    logit = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))

    def fit(rows: DataFrame):
        net = MultilayerPerceptronClassifier(featuresCol="x", labelCol=label, layers=[dim, options.hidden, 2], maxIter=60, seed=options.seed or 1).fit(rows)
        return lambda df: net.transform(df).withColumn("margin", logit(F.get(vector_to_array("probability"), F.lit(1)))).drop("rawPrediction", "probability", "prediction")

    return _calibrated(fit, train, label, key, options)


def _calibrated(fit, train: DataFrame, label: str, key: str, options: Options):
    """score(df, name) of a model fitted on all of train; its logistic curve is fitted on margins of models that haven't seen the rows."""
    n = max(2, options.calibration_folds)
    rows = folded(train, label, key, n, options.seed + 1).withColumnRenamed("fold", "inner").select(key, label, "x", "inner")
    unseen = reduce(DataFrame.unionByName, [fit(rows.where(F.col("inner") != k))(rows.where(F.col("inner") == k)) for k in range(n)])
    one = VectorAssembler(inputCols=["margin"], outputCol="m")
    curve = LogisticRegression(featuresCol="m", labelCol=label, maxIter=50).fit(one.transform(unseen))
    a, b, raw = float(curve.coefficients[0]), float(curve.intercept), fit(train)
    return lambda df, name: raw(df).withColumn(name, 1 / (1 + F.exp(-(F.col("margin") * a + b)))).drop("margin")


def logistic(train: DataFrame, label: str = "label"):
    model = LogisticRegression(featuresCol="x", labelCol=label, maxIter=50).fit(train)
    return lambda df, name: model.transform(df).withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")


@dataclass
class Trained:
    """A fitted model: the feature names, their centres, the projection, the trees, and what training found out."""

    features: list[str]
    centre: dict[str, tuple[float, float]]
    projection: PipelineModel
    model: object
    explained: list[float]
    metrics: dict[str, float] = field(default_factory=dict)

    def score(self, df: DataFrame, name: str = "probability_synthetic") -> DataFrame:
        """df with the model's probability and its origin."""
        x = self.projection.transform(scaled(clean(df, self.features), self.centre))
        out = self.model.transform(x).withColumn(name, F.get(vector_to_array("probability"), F.lit(1)))
        return out.drop("raw", "pc", "x", "rawPrediction", "probability", "prediction").withColumn("origin", F.when(F.col(name) > 0.5, 1).otherwise(0))

    def save(self, path: str) -> None:
        import json

        from pyspark.sql import SparkSession

        self.projection.write().overwrite().save(f"{path}/projection")
        self.model.write().overwrite().save(f"{path}/model")
        meta = json.dumps({"features": self.features, "centre": self.centre, "explained": self.explained, "metrics": self.metrics})
        SparkSession.active().createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(path: str) -> Trained:
    import json

    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.sql import SparkSession

    meta = json.loads(SparkSession.active().read.text(f"{path}/metadata").first()["value"])
    return Trained(meta["features"], {k: tuple(v) for k, v in meta["centre"].items()}, PipelineModel.load(f"{path}/projection"), GBTClassificationModel.load(f"{path}/model"), meta["explained"], meta["metrics"])


def train(df: DataFrame, features: list[str], options: Options, label: str = "label", key: str = "img_id", rounds: int | None = None) -> Trained:
    """Split, centre, project, boost, evaluate: the whole trainer.

    Unless options.early_stopping is 0, a tenth of the training rows stops the boosting; the test rows only evaluate.
    """
    began = time.time()
    parted = split(clean(df, features), label, key, options.test_size, options.seed)
    parted = S.stratified(parted, "train", key, options.seed + 1).withColumn("held", F.col("train") & (F.col("turn") < F.floor(F.col("size") / 10)) & F.lit(options.early_stopping > 0)).drop("turn", "size").cache()
    fit = parted.where("train")
    centre = centred(fit, features)
    projection, share = pca_by_variance(scaled(fit, centre), features, options.variance)
    weight = class_weight(fit, label)
    x = projection.transform(scaled(fit, centre)).withColumn("weight", weight)
    model = boosted(options, label=label, weight="weight", rounds=rounds, held="held" if options.early_stopping else None).fit(x)
    out = Trained(features, centre, projection, model, [float(s) for s in share])
    test = out.score(parted.where(~F.col("train")), "p")
    out.metrics = report(test, label, "p") | _shape(parted, label, features, share) | {"best_iter": model.getNumTrees, "seed": options.seed, "time_elapsed": time.time() - began, "timestamp": began}
    counts = fit.groupBy(label).count().collect()
    n = {r[label]: r["count"] for r in counts}
    out.metrics["scale_pos_weight"] = n.get(0, 0) / n[1] if n.get(1) else 1.0
    parted.unpersist()
    return out


def report(scored: DataFrame, label: str, score: str) -> dict[str, float]:
    """Accuracy, F1, AUC and log-loss of scored rows (label, score, origin)."""
    f1 = S.prf(scored, label, "origin")
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    whole = f1.agg(F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy")).first().asDict()
    loss = scored.agg(F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss")).first()["loss"]
    return whole | {"roc_auc": S.roc_auc(scored, [], label, score).first()["auc"], "best_score": loss}


def _shape(rows: DataFrame, label: str, features: list[str], share: np.ndarray) -> dict[str, float]:
    n = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    a, b = n.get(0, 0), n.get(1, 0)
    whole = {"n_genuine": a, "n_synthetic": b, "pct_genuine": 100 * a / max(1, a + b), "pct_synthetic": 100 * b / max(1, a + b), "imbalance_ratio": a / b if b else 0.0, "labels_shape": a + b, "feature_rows": a + b, "feature_columns": len(features)}
    return whole | {"original_dim": len(features), "pca_dim": len(share), "n_components": len(share), "explained_variance": float(sum(share))} | {f"cumulative_{i + 1}": float(v) for i, v in enumerate(np.cumsum(share))}


def final_model(df: DataFrame, features: list[str], options: Options, label: str = "label", rounds: int = 100) -> Trained:
    """Trees on all rows with standardised features, without a split, a projection or a stop: the model to keep once folds have judged it."""
    rows = clean(df, features)
    scale = standardise(rows, features)
    projection = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x")]).fit(rows)
    model = boosted(options, label=label, rounds=rounds).fit(projection.transform(scaled(rows, scale)))
    return Trained(features, scale, projection, model, [])


def cross_validate(df: DataFrame, features: list[str], options: Options, label: str = "label", key: str = "img_id", rounds: int = 20) -> DataFrame:
    """Out-of-fold probabilities of three models and their mean vote: key, fold, label, p_svm, p_mlp, p_gbt, p_ens, pred (-1: abstains).

    The machines and networks are those of `svm` and `network`; those of all folds are fitted together, see `folds`.
    """
    n, dim = max(2, options.calibration_folds), len(features)
    rows = folded(clean(df, features), label, key, options.folds, options.seed)
    scale = standardise(clean(df, features), features)
    table = VectorAssembler(inputCols=features, outputCol="x").transform(scaled(rows, scale)).select(key, label, "fold", "x").cache()
    plain = joint.inner_folds(table, label, key, "fold", options.folds, n, options.seed + 1).withColumn("x", vector_to_array("x"))
    fitted = joint.fit(joint.fewer(plain, table.count()), label, dim, options.hidden, options.folds, n, 1.0 / (options.svm_c * 100), options.seed or 1, fourier_phases(dim, 1.0 / max(1, dim)))
    parts = []
    for k in range(options.folds):  # folds are few and fixed; the rows of each stay distributed
        gbt = boosted(options, label=label, rounds=rounds).fit(table.where(F.col("fold") != k))
        out = gbt.transform(table.where(F.col("fold") == k)).withColumn("p_gbt", F.get(vector_to_array("probability"), F.lit(1)))
        parts.append(fitted.score(out.select(key, label, "fold", "p_gbt", vector_to_array("x").alias("x")), k))
    every = reduce(DataFrame.unionByName, parts)
    p = (F.col("p_svm") + F.col("p_mlp") + F.col("p_gbt")) / 3
    every = every.withColumn("p_ens", p)
    t = options.abstain
    return every.select(key, "fold", label, "p_svm", "p_mlp", "p_gbt", "p_ens", F.when((p > t) & (p < 1 - t), -1).otherwise(F.when(p > 0.5, 1).otherwise(0)).alias("pred"))


def importances(model: GBTClassifier, names: list[str], n: int = 20) -> list[tuple[str, float]]:
    """The n features of the largest gain, by name."""
    v = model.featureImportances.toArray()
    order = sorted(range(len(v)), key=lambda i: (-v[i], i))[:n]
    return [(names[i] if i < len(names) else f"f{i}", float(v[i])) for i in order]


__all__ = ["Trained", "boosted", "class_weight", "clean", "cross_validate", "final_model", "folded", "importances", "load", "logistic", "network", "pca_by_variance", "report", "scaled", "split", "standardise", "svm", "train"]
