import numpy as np
import pytest

from pixelloom.functions import kernels as K
from pixelloom.operators import features as X
from pixelloom.operators import wavelet as W

RNG = np.random.default_rng(0)


def test_feature_counts():
    counts = {k: len(v) for k, v in X.NAMES.items()}
    assert counts == {"surface": 49, "complex": 15, "edge": 8, "enhanced": 14, "gabor": 30, "hog": 10, "linework": 8, "patch": 18, "residual": 11, "discrepancy": 6, "style": 15}


def test_constant_plane():
    p = X.Planes(np.tile(np.array([255.0, 0, 0]), (100, 100, 1)))
    assert p.gray.shape == (255, 255) and p.rgb.shape == (255, 255, 3)
    f = X.surface(p)
    assert f["red_mean"] == 1 and f["green_mean"] == 0 and f["red_variance"] == 0 and f["contrast"] == 0
    assert all(np.isfinite(v) for g in X.FAMILIES.values() for v in g(p).values())


def test_hsv_round_trip():
    rgb = RNG.random((9, 7, 3))
    assert np.allclose(K.hsv_to_rgb(K.rgb_to_hsv(rgb)), rgb)


def test_lab_of_white_and_black():
    lab = K.rgb_to_lab(np.array([[[1.0, 1, 1], [0, 0, 0]]]))
    assert np.allclose(lab[0, 0], [100, 0, 0], atol=0.01) and np.allclose(lab[0, 1], 0, atol=1e-9)


def test_transforms():
    a = RNG.random((16, 16))
    d = K.dct(a)
    assert np.isclose((d * d).sum(), (a * a).sum()) and np.isclose(d[0, 0], a.sum() / 16)
    approx, h, v, dd = K.haar(a)
    assert np.isclose(sum((x * x).sum() for x in (approx, h, v, dd)), (a * a).sum())
    board = np.indices((8, 8)).sum(0) % 2.0
    _, h, v, dd = K.haar(board)
    assert not h.any() and not v.any() and np.abs(dd).min() > 0


def test_filters_on_a_ramp():
    ramp = np.tile(np.arange(20.0), (20, 1))
    assert np.allclose(K.sobel(ramp, 1)[:, 1:-1], 8) and np.allclose(K.sobel(ramp, 0), 0)
    assert np.allclose(K.laplace(ramp)[1:-1, 1:-1], 0)
    assert np.isclose(K.gaussian(np.ones((30, 30)), 2).max(), 1)


def test_canny_finds_a_step():
    a = np.zeros((40, 40))
    a[:, 20:] = 1
    e = K.canny(a, 1.0)
    assert e[5:-5].any(1).all() and set(np.nonzero(e)[1]) <= {19, 20}
    assert not K.canny(np.zeros((20, 20))).any()


@pytest.mark.parametrize("diagonal", [False, True])
def test_label(diagonal):
    mask = RNG.random((25, 31)) < 0.45
    names, n = K.label(mask, diagonal)
    seen = np.zeros(mask.shape, int)
    k = 0
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        k += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < 25 and 0 <= b < 31 and mask[a, b] and not seen[a, b]:
                seen[a, b] = k
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not (i and j)]
    assert k == n and (seen == names).all()


def test_distance():
    mask = RNG.random((15, 18)) < 0.05
    mask[3, 4] = True
    y, x = np.nonzero(mask)
    slow = np.array([[np.hypot(y - i, x - j).min() for j in range(18)] for i in range(15)])
    assert np.allclose(K.distance_to(mask), slow)


def test_glcm_of_two_levels():
    a = np.array([[0, 0, 1], [0, 1, 1]])
    g = K.glcm(a, [1], [0], 2)
    assert np.isclose(g["contrast"][0], 0.5) and np.isclose(g["energy"][0], 0.5) and np.isclose(g["homogeneity"][0], 0.75)
    assert np.isclose(K.glcm(np.zeros((4, 4)), [1], [0], 2)["correlation"][0], 1)


def test_lbp_flat_is_all_ones_inside():
    codes = K.lbp(np.full((9, 9), 7.0), 8, 1)
    assert (codes[1:-1, 1:-1] == 8).all()


def test_box_dimension():
    assert np.isclose(K.box_dimension(np.ones((128, 128), bool)), 2)
    assert abs(K.box_dimension(np.eye(128, dtype=bool)) - 1) < 0.05
    assert K.box_dimension(np.zeros((64, 64), bool)) == 1


def test_resize_keeps_constants_and_size():
    assert (K.resize(np.full((10, 13), 77.0), 255, 255) == 77).all()


def test_noise_estimate():
    a = RNG.normal(0.5, 0.1, (255, 255))
    assert abs(K.noise_sigma(a) - 0.1) < 0.01


def test_jpeg_loses_more_at_low_quality():
    rgb = RNG.integers(0, 256, (40, 40, 3)).astype(float)
    e = [np.abs(rgb - K.jpeg_like(rgb, q)).mean() for q in (10, 50, 90)]
    assert e[0] > e[1] > e[2]


def test_gabor_prefers_its_frequency():
    x = np.arange(128)
    wave = np.tile(np.cos(2 * np.pi * 0.2 * x), (128, 1))
    e = [K.gabor_energy(wave, f, 0.0) for f in (0.1, 0.2, 0.4)]
    assert e[1] == max(e)


def test_residual_pairs_invariants():
    r = X.residual_pairs(RNG.integers(0, 256, (64, 64)).astype(float))
    for k, v in r.items():
        if k.endswith("_mean") and isinstance(v, list):
            assert v[1] - 2 * v[0] in (0, 1)
        if k.endswith("_tc"):
            assert v[0] == v[1]


def test_wavelet_parts():
    a = RNG.random((20, 20, 3))
    assert W.patchify(a, 8, 8).shape == (4, 8, 8, 3) and len(W.patchify(a, 8, 4)) == 16 and len(W.patchify(a, 21, 21)) == 0
    soft = W.soften(a[:16, :16], 1.0, 2)
    assert np.allclose(soft[:4, :4], a[:4, :4].mean((0, 1)))
    best, mag, others = W.select(np.stack([a[:8, :8] * k for k in (1, 3, 2)]), 2)
    assert best == 1 and others == [2] and mag > 0
    assert W.sim_extrema(np.zeros((0, 4)), np.zeros((0, 4))) == {"min_warp": 0, "max_warp": 0, "min_base": 0, "max_base": 0}
    with pytest.raises(IndexError):
        W.sim_extrema(np.ones((2, 4)), np.ones((1, 4)))
    with pytest.raises(RuntimeError):
        W.select(np.zeros((0, 8, 8, 3)), 2)


def test_gabor_is_the_plain_correlation(monkeypatch):
    """Energies equal sums over the whole kernel at each pixel, without a transform of spectra, also where a plane is smaller than the kernel."""
    rng = np.random.default_rng(1)
    for shape in ((40, 70), (9, 12), (1, 5)):
        a = rng.random(shape)
        for f, t in ((0.1, 0.0), (0.2, np.pi / 4), (0.3, np.pi / 2), (0.2, 3 * np.pi / 4), (0.4, 1.0)):
            s = np.sqrt(np.log(2) / 2) * 3 / f / np.pi
            r = int(np.ceil(max(3 * s * abs(np.cos(t)), 3 * s * abs(np.sin(t)), 1)))
            y, x = np.mgrid[-r : r + 1, -r : r + 1]
            k = np.exp(-0.5 * (x * x + y * y) / s**2 + 2j * np.pi * f * (x * np.cos(t) + y * np.sin(t))) / (2 * np.pi * s * s)
            seen = np.lib.stride_tricks.sliding_window_view(np.pad(a, r, mode="symmetric"), k.shape)
            want = np.abs(np.einsum("ijkl,kl->ij", seen, k)).mean()
            monkeypatch.setattr(np.fft, "fft2", None)
            assert abs(K.gabor_energies(a, (f,), (t,))[0] - want) < 1e-10 * want
            monkeypatch.undo()


def test_gray_images_take_each_plane_once(monkeypatch):
    """A gray image's surface features equal those of the same image in three colours, from one resize."""
    rng = np.random.default_rng(2)
    gray = np.floor(rng.random((8, 8, 1)) * 255)
    want = X.surface(X.Planes(np.repeat(gray, 3, -1), 64))
    calls, resize = [], K.resize
    monkeypatch.setattr(K, "resize", lambda *a: calls.append(1) or resize(*a))
    got = X.surface(X.Planes(gray, 64))
    assert len(calls) == 1 and all(abs(got[k] - want[k]) < 1e-12 * max(1, abs(want[k])) for k in want)
