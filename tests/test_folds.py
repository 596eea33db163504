"""Machines and networks of all folds fitted together: against Spark's own fits, and in few passes."""

import time

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pixelloom.operators import folds, ml
from pixelloom.sources import tables

DIM, HIDDEN, FOLDS, INNER = 4, 5, 3, 3


@pytest.fixture(scope="module")
def made(spark):
    """Vectors with folds and inner folds, and what is fitted on them."""
    rng = np.random.default_rng(5)
    n = 600
    y = rng.integers(0, 2, n)
    x = rng.normal(0, 1, (n, DIM)) + y[:, None] * np.array([1.0, 0, -0.5, 0])
    df = spark.createDataFrame([(i, int(a), [*map(float, v)]) for i, (a, v) in enumerate(zip(y, x, strict=True))], "img_id long, label int, x array<double>").repartition(5)
    df = folds.inner_folds(ml.folded(df, "label", "img_id", FOLDS, 0), "label", "img_id", "fold", FOLDS, INNER, 1).cache()
    return df, folds.fit(df, "label", DIM, HIDDEN, FOLDS, INNER, 0.001, 1, ml.fourier_phases(DIM, 1 / DIM))


def test_inner_folds_equal_those_of_each_fold_alone(spark, made):
    df, _ = made
    for k in range(FOLDS):
        rest = df.where(F.col("fold") != k)
        alone = ml.folded(rest.drop("fold", "inner"), "label", "img_id", INNER, 1)
        a, b = ({r[0]: r[1] for r in d.collect()} for d in (alone.select("img_id", "fold"), rest.select("img_id", F.get("inner", F.lit(k)))))
        assert a == b
        assert {r[0] for r in df.where(F.col("fold") == k).select(F.get("inner", F.lit(k))).collect()} == {-1}


def test_gradients():
    rng = np.random.default_rng(6)
    shape = folds.Shape(DIM, HIDDEN, FOLDS, INNER, *ml.fourier_phases(DIM, 0.5, 7))
    x, y, keep = rng.normal(0, 1, (40, DIM)), rng.integers(0, 2, 40).astype(float), rng.random((40, 3)) < 0.7
    z = shape.lift(x)
    assert np.abs(z - np.sqrt(2 / 7) * np.cos(x @ shape.w + shape.b)).max() < 3e-7
    for loss, at in ((lambda p: shape.hinge(z, y, keep, p), rng.normal(0, 1, (3, 8))), (lambda p: shape.entropy(x, y, keep, p), np.stack([shape.start(s) for s in range(3)]))):
        whole = loss(at)
        for i in range(at.shape[1]):
            step = np.zeros_like(at)
            step[:, i] = 1e-6
            assert np.allclose((loss(at + step)[:, 0] - loss(at - step)[:, 0]) / 2e-6, whole[:, 1 + i], atol=1e-5)


def test_planes_reach_sparks_loss(made):
    df, fitted = made
    rows = df.withColumn("x", array_to_vector("x"))
    for k in range(FOLDS):
        lifted = ml.fourier_features(rows.where(F.col("fold") != k), "x", DIM, 1 / DIM, "rff").cache()
        model = LinearSVC(featuresCol="rff", labelCol="label", regParam=0.001, maxIter=50).fit(lifted)
        got = lifted.select("label", vector_to_array("rff").alias("z")).toPandas()
        z, s = np.stack(got.z), 2 * got.label.to_numpy() - 1

        def loss(u, c, z=z, s=s):
            return np.maximum(0, 1 - s * (z @ u + c)).mean() + 0.0005 * np.sum((u * z.std(0, ddof=1)) ** 2)

        own, spark_loss = loss(fitted.planes[k][:-1], fitted.planes[k][-1]), loss(model.coefficients.toArray(), model.intercept)
        assert own < spark_loss * 1.01


def test_networks_reach_sparks_loss(made):
    df, fitted = made
    rows = df.withColumn("x", array_to_vector("x"))
    start = fitted.shape.start(1)
    for k in range(FOLDS):
        rest = rows.where(F.col("fold") != k).cache()
        model = MultilayerPerceptronClassifier(featuresCol="x", labelCol="label", layers=[DIM, HIDDEN, 2], maxIter=60, initialWeights=Vectors.dense(start)).fit(rest)
        got = model.transform(rest).select("label", vector_to_array("probability").alias("p"), vector_to_array("x").alias("x")).toPandas()
        f = fitted.shape.margins(np.stack(got.x), fitted.nets[k : k + 1])[:, 0]
        own = np.mean(np.logaddexp(0, f) - got.label * f)
        theirs = -np.mean(np.log([p[y] for p, y in zip(got.p, got.label, strict=True)]))
        assert own < theirs * 1.02
        # The margin of the same weights is that of Spark's network.
        f = fitted.shape.margins(np.stack(got.x), np.array([model.weights.toArray()]))[:, 0]
        assert np.allclose(1 / (1 + np.exp(-f)), [p[1] for p in got.p], atol=1e-9)


def test_curves_equal_sparks_on_unseen_margins(spark, made):
    """Margins of one network and one plane, one row each: the curves are those of Spark's regression, also if a class is missing."""
    rng = np.random.default_rng(7)
    blocks, rows = [], []
    for fold in range(FOLDS):
        m, y = rng.normal(0, 2, (90, 2 * (FOLDS - 1))), rng.integers(0, 2, 90).astype(float)
        m[:, 0] += 1.5 * y
        blocks.append((fold, y, m))
        for i, k in enumerate(k for k in range(FOLDS) if k != fold):
            rows += [("svm", k, float(a), Vectors.dense([b])) for a, b in zip(y, m[:, 2 * i], strict=True)]
            rows += [("mlp", k, float(a), Vectors.dense([b])) for a, b in zip(y, m[:, 2 * i + 1], strict=True)]
    curves = folds._curves(spark.sparkContext.parallelize(blocks, 2), FOLDS, 50)
    df = spark.createDataFrame(rows, ["kind", "k", "label", "features"]).cache()
    for (kind, k), (a, b) in curves.items():
        model = LogisticRegression(maxIter=50).fit(df.where((F.col("kind") == kind) & (F.col("k") == k)))
        assert np.allclose((a, b), (model.coefficients[0], model.intercept), atol=1e-4)
    one = folds._curves(spark.sparkContext.parallelize([(f, np.ones(4), np.ones((4, 2 * FOLDS - 2))) for f in range(FOLDS)]), FOLDS, 50)
    assert set(one.values()) == {(0.0, np.inf)}


def test_scores_and_odd_partitions(spark, made):
    """Every row of a fold gets its scores, from empty partitions too; labels other than 0 and 1 are refused."""
    df, fitted = made
    a, b = ({r.img_id: (r.p_svm, r.p_mlp) for r in fitted.score(df.where("fold = 1").repartition(n).select("img_id", "fold", "x"), 1).collect()} for n in (1, 300))
    assert len(a) == 200 and a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-12) and 0 <= min(a[k]) <= max(a[k]) <= 1 for k in a)
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        folds.fit(df.withColumn("label", F.lit(2)), "label", DIM, HIDDEN, FOLDS, INNER, 0.001, 1, ml.fourier_phases(DIM, 1 / DIM))


def test_all_folds_in_few_jobs(spark):
    """Fitted one by one, twelve machines and twelve networks took over a thousand jobs, each with a pass over the rows."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, *map(float, rng.normal(0, 1, 4) + i % 2)) for i in range(240)]
    names = [f"f{i}" for i in range(4)]
    df = spark.createDataFrame(rows, "img_id long, label int, " + ", ".join(f"{c} double" for c in names))
    group = f"folds-{time.time()}"
    spark.sparkContext.setJobGroup(group, "all folds")
    out = ml.cross_validate(df, names, tables.Options(folds=3, hidden=4, max_depth=2), rounds=2)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = out.collect()
    assert jobs < 400
    assert sorted(r.img_id for r in got) == list(range(240)) and np.mean([(r.p_ens > 0.5) == r.label for r in got]) > 0.7


def test_many_small_partitions_are_few_tasks(spark, made):
    df, _ = made
    many = df.repartition(60)
    assert folds.fewer(many, df.count()).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert folds.fewer(many, 20 * folds.TASK + 1).rdd.getNumPartitions() == 21
    assert sorted(r.img_id for r in folds.fewer(many, 600).collect()) == list(range(600))
