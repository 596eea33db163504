import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import stats as S
from pixelloom.operators import decide as D
from pixelloom.operators import features, learned, ml, registry, wavelet
from pixelloom.operators import planes as P
from pixelloom.sources import images, tables
from pixelloom.streaming import extract_stream, score_stream

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("images")
    for name, colour in (("a.png", (255, 0, 0)), ("b.PNG", (0, 10, 20)), ("c.png", (128, 128, 128))):
        (path / name).write_bytes(images.to_png(np.tile(np.array(colour), (30, 40, 1))))
    (path / "notes.txt").write_text("no image")
    return path


def test_scan_label_invert(spark, folder):
    df = images.read_images(spark, str(folder), label=42)
    got = {r.path.rsplit("/", 1)[-1]: r for r in df.collect()}
    assert set(got) == {"a.png", "b.PNG", "c.png"} and {r.label for r in got.values()} == {42}
    assert got["a.png"].data[:3] == [255, 0, 0] and (got["a.png"].h, got["a.png"].w) == (30, 40)
    flipped = {r.path.rsplit("/", 1)[-1]: r.data[:3] for r in images.inverted(df).collect()}
    assert flipped["a.png"] == [0, 255, 255] and flipped["c.png"] == [127, 127, 127]
    assert images.read_images(spark, str(folder / "a.png")).count() == 1
    assert images.labelled_union(spark, [str(folder)], [str(folder)]).groupBy("label").count().count() == 2
    with pytest.raises(ValueError):
        images.read_images(spark, str(folder / "missing"))


def test_undecodable(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"not an image")
    assert images.read_images(spark, str(tmp_path), strict=False).first().data is None
    with pytest.raises(Exception, match="cannot decode"):
        images.read_images(spark, str(tmp_path)).collect()


def test_extract_matches_kernels(spark):
    arrays = [RNG.integers(0, 256, (20, 24, 3)), RNG.integers(0, 256, (16, 16))]
    df = images.from_rows(spark, [{"image": a} for a in arrays])
    got = {r.img_id: r.asDict() for r in features.extract(df, ["surface", "edge"], side=64).collect()}
    for i, a in enumerate(arrays):
        p = features.Planes((a if a.ndim == 3 else a[..., None]).astype(float), 64)
        want = features.surface(p) | features.edge_cooccurrence(p)
        assert all(np.isclose(got[i][k], v, rtol=1e-6, equal_nan=True) or not np.isfinite(v) for k, v in want.items())
    assert images.encoded(df).first().png.startswith(b"\x89PNG")


def test_planes_agree_with_kernels(spark):
    from pixelloom.functions import kernels as K

    a = RNG.integers(0, 256, (8, 8)).astype(float)
    ps = spark.createDataFrame([(1, 8, 8, a.ravel().tolist())], "img_id int, h int, w int, data array<double>")
    codes = np.array([r.code for r in P.lbp(ps, 16, 2).orderBy("y", "x").collect()]).reshape(8, 8)
    assert (codes == K.lbp(a, 16, 2)).all()
    g = P.glcm(ps, [(0, 1)]).first()
    want = K.glcm(a, [1], [0], 256)
    assert all(np.isclose(g[k], want[k][0]) for k in want)
    smooth = P.convolve_rows(ps, P.gaussian_weights(1.5)).first().data
    assert np.allclose(smooth, K.gaussian(a, 1.5).ravel())
    spectrum = {(r.u, r.v): complex(r.re, r.im) for r in P.dft(P.pixels(ps), 8, ["img_id"]).collect()}
    assert np.allclose([[spectrum[u, v] for v in range(8)] for u in range(8)], np.fft.fft2(a))
    ragged = P.tiles(P.pixels(ps), 3, h=8, w=8).groupBy("ty", "tx").count().collect()
    assert len(ragged) == 4 and {r["count"] for r in ragged} == {9}


def test_auc_of_perfect_and_tied(spark):
    df = spark.createDataFrame([("p", y, float(y)) for y in (0, 0, 1, 1)] + [("t", y, 0.5) for y in (0, 0, 1, 1)], "m string, y int, s double")
    assert {r.m: r.auc for r in S.roc_auc(df, ["m"], "y", "s").collect()} == {"p": 1.0, "t": 0.5}


def test_decisions(spark):
    df = spark.createDataFrame([(0.5, 0.9), (0.1, 0.2), (0.7, 0.2)], "a double, d double")
    out = df.select(*[c.alias(k) for k, c in D.reconcile(F.col("a"), F.col("d")).items()], D.abstain(F.col("a"), 0.3).alias("v"), D.confidence(F.col("a")).alias("c")).collect()
    assert [r.v for r in out] == [-1, 0, -1 if 0.7 < 0.7 else 1] and out[0].c == 50
    assert [r.origin for r in out][:2] == [1, 0]


def test_nested_round_trip(spark, tmp_path):
    rows = [{"results": [{"image_mean_ff": 1.5, "sobel": [2, 4]}, {"bce_loss": -3.0}]}, {"results": [{"max_warp": 0.5}]}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "list.json").write_text(json.dumps(rows, indent=1))
    for name, multi in (("lines.json", False), ("list.json", True)):
        flat = tables.flatten(tables.read_results(spark, str(tmp_path / name), multi)).collect()
        assert len(flat) == 3 and sum(r.sobel for r in flat) == 3.0 and sum(r.bce_loss for r in flat) == -3.0 and sum(r.min_base for r in flat) == 0
    frame = spark.createDataFrame([("m", 3)], "metric string, value long")
    tables.write_frame(frame, "net", str(tmp_path / "frame"))
    back, names = tables.read_frame(spark, str(tmp_path / "frame"), "metric string, value long")
    assert back.collect() == frame.collect() and names.first().model_name == "net"
    tables.write_metrics(spark.createDataFrame([(0.5, 2)], "b double, a long"), str(tmp_path / "metrics"))
    assert json.loads(spark.read.text(str(tmp_path / "metrics")).first().value) == {"a": "2", "b": "0.5"}


def test_options(tmp_path):
    (tmp_path / "c.toml").write_text("[wavelet]\nalpha = 0.666\ndim_factor = 666\n[datasets]\nx = ['y']\n")
    o = tables.load_options(str(tmp_path / "c.toml"), top_k=7)
    assert (o.alpha, o.dim_factor, o.top_k, o.folds) == (0.666, 666, 7, 5) and o.datasets == {"x": ["y"]}
    with pytest.raises(ValueError):
        tables.load_options(dtype="bfloat16")


def test_registry():
    assert registry.enabled(["VIT", "artwork"]) == ["artwork", "vit"] and registry.enabled([]) == [] and len(registry.module_sets()) == 21
    with pytest.raises(ValueError):
        registry.enabled(["nothing"])


def test_learned_and_wavelet_rows(spark):
    df = images.from_rows(spark, [{"image": RNG.integers(0, 256, (12, 12, 3))} for _ in range(3)])
    v = learned.vectors(df).collect()
    assert {len(r.vector) for r in v} == {768}
    with pytest.raises(NotImplementedError):
        learned.backend("none")
    rows = wavelet.analyse(df, dim_patch=16).collect()
    assert len(rows) == 3 and all(0 <= r.selected_patch_idx < 9 and r.image_mean[1] - 2 * r.image_mean[0] in (0, 1) and len(r.features_dc) == 32 for r in rows)


def test_training(spark, tmp_path):
    n = 240
    y = RNG.integers(0, 2, n)
    x = RNG.normal(0, 1, (n, 3)) + y[:, None] * np.array([2.5, 0, 1.0])
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], "img_id long, label int, a double, b double, c double").repartition(2)
    t = ml.train(df, ["a", "b", "c"], tables.Options(max_depth=2), rounds=4)
    assert t.metrics["accuracy"] > 0.75 and t.metrics["roc_auc"] > 0.8
    t.save(str(tmp_path / "m"))
    a, b = (sorted((r.img_id, r.origin) for r in m.score(df).collect()) for m in (t, ml.load(str(tmp_path / "m"))))
    assert a == b and len(a) == n
    assert [k for k, _ in ml.importances(t.model, ["p0", "p1", "p2"], 2)][0].startswith("p")


def test_stream(spark, tmp_path):
    df = images.from_rows(spark, [{"image": RNG.integers(0, 256, (10, 10))} for _ in range(4)])
    df.drop("path").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.drop("path").schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, lambda b: features.extract(b, ["discrepancy"], side=None), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert extract_stream(stream, ["discrepancy"], None).isStreaming


def test_unified_and_pairs(spark):
    from pixelloom.operators import extractor

    df = images.from_rows(spark, [{"image": RNG.integers(0, 256, (12, 12, 3))} for _ in range(2)])
    sizes = extractor.combination_sizes(df)
    assert sizes["artwork"] == 49 and sizes["learned"] == 768 and sizes["residual"] == 11 and sizes["wavelet"] == 26 and sizes["vae+vit"] == 4 and len(sizes) == 21
    out = extractor.unified(df, ["VIT", "vae"]).collect()
    assert len(out) == 2 and set(out[0].asDict()) == {"img_id", "vae_mean", "vae_std", "vit_mean", "vit_std"}
    assert extractor.unified(df, []).columns == ["img_id"]


def test_training_is_stratified_and_stops(spark):
    n = 400
    df = spark.createDataFrame([(i, int(i % 8 == 0), float(RNG.normal()), float(RNG.normal())) for i in range(n)], "img_id long, label int, a double, b double")
    parted = ml.split(df, "label", "img_id", 0.2, 3).groupBy("label").agg(F.count_if(~F.col("train")).alias("test"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r.label, r.test, r.n) for r in parted} == {(0, 70, 350), (1, 10, 50)}
    per = ml.folded(df, "label", "img_id", 5, 3).groupBy("fold", "label").count().collect()
    assert {(r.label, r["count"]) for r in per} == {(0, 70), (1, 10)} and len(per) == 10
    # On noise more trees only add error, so held rows stop them early; without them all rounds run.
    stopped, whole = (ml.train(df, ["a", "b"], tables.Options(max_depth=3, early_stopping=e), rounds=25).metrics for e in (10, 0))
    assert stopped["best_iter"] < 25 and whole["best_iter"] == 25
    assert set(stopped) >= set("accuracy best_iter best_score cumulative_1 explained_variance f1_macro f1_weighted feature_rows feature_columns n_genuine n_synthetic pct_genuine pct_synthetic imbalance_ratio labels_shape n_components original_dim pca_dim roc_auc scale_pos_weight seed time_elapsed timestamp".split())
    assert stopped["scale_pos_weight"] == 7 and stopped["imbalance_ratio"] == 7


def test_calibration_uses_unseen_margins(spark):
    """Labels are noise: a curve fitted on the margins of the training rows would be sure of them, one of unseen rows isn't."""
    rows = [(i, int(RNG.integers(0, 2)), *map(float, RNG.normal(0, 1, 12))) for i in range(160)]
    names = [f"f{i}" for i in range(12)]
    df = spark.createDataFrame(rows, "img_id long, label int, " + ", ".join(f"{c} double" for c in names))
    out = ml.cross_validate(df, names, tables.Options(folds=2, hidden=6, calibration_folds=3, max_depth=2), rounds=3).collect()
    assert len(out) == 160 and {r.img_id for r in out} == set(range(160))
    assert np.mean([abs(r.p_svm - 0.5) for r in out]) < 0.25 and np.mean([abs(r.p_mlp - 0.5) for r in out]) < 0.25
    assert all(abs(r.p_ens - (r.p_svm + r.p_mlp + r.p_gbt) / 3) < 1e-12 for r in out)


def test_final_model_reads_all_rows(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2) + 0.1 * float(RNG.normal())) for i in range(80)], "img_id long, label int, a double")
    model = ml.final_model(df, ["a"], tables.Options(max_depth=2), rounds=3)
    assert all(r.origin == r.label for r in model.score(df).collect()) and model.model.getNumTrees == 3


def test_percentiles_equal_numpy(spark):

    values = {0: RNG.normal(0, 5, 301), 1: np.r_[np.zeros(50), 1e9], 2: np.array([3.0]), None: np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [(0, None)], "g int, v double").repartition(3)
    shares = {"a": 0.0, "b": 0.33, "c": 0.5, "d": 0.951, "e": 1.0}
    for r in S.percentiles(df, ["g"], "v", shares).collect():
        assert r.n == len(values[r.g]) and np.allclose([r[k] for k in shares], np.quantile(values[r.g], list(shares.values())), rtol=1e-12)
    whole = S.percentiles(df, [], "v", shares).first()
    assert np.allclose([whole[k] for k in shares], np.quantile(np.concatenate(list(values.values())), list(shares.values())))


def test_auc_over_all_rows(spark):

    y, p = RNG.integers(0, 2, 500), np.round(RNG.random(500), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(S.roc_auc(df, [], "y", "p").first()["auc"] - want) < 1e-12


def test_refused_images_give_zeros_of_the_right_length(spark):
    def make():
        def net(x):
            if x.shape[1] < 16:
                raise ValueError("too small")
            return x.mean((1, 2))

        return net

    learned.register("picky", make)
    df = images.from_rows(spark, [{"image": np.full((8, 8), 9)}, {"image": np.full((16, 16), 9)}]).repartition(2)
    assert sorted(r.vector for r in learned.vectors(df, "picky").collect()) == [[0.0] * 3, [9.0] * 3]


def test_residual_subset():
    g = RNG.random((40, 40)) * 255
    every, some = features.residual_pairs(g), features.residual_pairs(g, only=("sobel", "spectral"))
    assert set(some) == {"image_mean_ff", "image_std", "sobel_mean", "sobel_tc", "spectral_tc"} and all(every[k] == v for k, v in some.items())
    with pytest.raises(ValueError):
        features.residual_pairs(g, only=("fourier",))


def test_crop_select():
    flat, busy = np.full((64, 64, 3), 100.0), RNG.random((64, 64, 3)) * 255
    image = np.concatenate([np.concatenate([flat, busy], 1), np.concatenate([flat[:30], flat[:30]], 1)], 0)
    tiles, at = wavelet.crop_select(image, 64, 1, 5)
    assert tiles.shape == (2, 64, 64, 3) and len(at) == 2 and len(set(at)) == 2
    gaps = []
    for k in range(4):
        t = np.zeros((64, 64, 3))
        part = image[k // 2 * 64 : k // 2 * 64 + 64, k % 2 * 64 : k % 2 * 64 + 64]
        t[: part.shape[0]] = part
        m = np.abs(np.fft.fftshift(np.fft.fft2(t @ np.array([0.2126, 0.7152, 0.0722]))))
        near = np.hypot(*np.mgrid[-32:32, -32:32]) <= 5
        gaps.append(abs(m[near].mean() - m[~near].mean()))
    assert at == [int(np.argmax(gaps)), int(np.argmin(gaps))]


def test_combinations_run(spark, tmp_path):
    from pixelloom.operators import extractor

    df = images.from_rows(spark, [{"image": RNG.integers(0, 256, (12, 12, 3))} for _ in range(2)])
    out = extractor.run_combinations(df, str(tmp_path), ["vae", "vit", "residual"])
    assert out["summary"]["total_single_modules"] == 3 and out["summary"]["total_module_pairs"] == 3
    assert out["summary"]["pair_feature_counts"]["vae+vit"] == 4 and all(t.count() == 2 for t in out["module_pairs"].values())
    assert sorted(extractor.combinations(df, ["vae", "vit"])) == ["vae", "vae+vit", "vit"]


def test_public_names_and_verbs(spark, tmp_path):
    import pixelloom
    from pixelloom import __main__ as cli
    from pixelloom.sources.images import to_png

    assert all(getattr(pixelloom, name) is not None for name in pixelloom.__all__)
    with pytest.raises(AttributeError):
        pixelloom.nothing
    folder = tmp_path / "img"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.png").write_bytes(to_png(RNG.integers(0, 256, (20, 20, 3)).astype(np.uint8)))
    assert cli.main(["extract", str(folder), str(tmp_path / "f"), "--families", "surface", "--label", "1"]) == 0
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    spark.createDataFrame([(i, i % 2, i % 2 + 0.01 * i) for i in range(60)], "img_id long, label int, a double").write.parquet(str(tmp_path / "t"))
    assert cli.main(["train", str(tmp_path / "t"), str(tmp_path / "m"), "--rounds", "2"]) == 0
    assert cli.main(["infer", str(tmp_path / "t"), str(tmp_path / "m"), str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).where("origin = label").count() >= 55
