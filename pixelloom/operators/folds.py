"""Support vector machines and networks of all folds and their inner folds, fitted together.

A pass over the rows evaluates every model that isn't done, so the number of passes is that of one fit. Rows lie in blocks
of one fold, which workers take one at a time; the driver holds weights and gradients only.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, rows that a worker lifts at once, rows that a task should have, and partitions whose sums the driver adds up itself.
BLOCK, ROWS, TASK, DIRECT = 8192, 512, 65536, 64
#: Margins of a network stay within the logits of 1e-9 and 1 - 1e-9.
SURE = float(np.log(1e9))


def inner_folds(rows: DataFrame, label: str, key: str, fold: str, folds: int, n: int, seed: int) -> DataFrame:
    """rows with `inner`, an array: at k the inner fold of n that the row has when fold k is held out, -1 in fold k itself.

    They are what `ml.folded` deals out of the other folds' rows for each k, but from one shuffle.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    at = rows.withColumn("__order", order).withColumn("__part", F.substring("__order", 1, 3))
    other = [(F.col(fold) != k).cast("long") for k in range(folds)]
    earlier = Window.unboundedPreceding, -1
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(*earlier)), F.lit(0))
    parts = at.groupBy(label, "__part").agg(*[F.sum(c).alias(f"__n{k}") for k, c in enumerate(other)])
    along = Window.partitionBy(label).orderBy("__part")
    parts = parts.select(F.col(label).alias("__label"), F.col("__part").alias("__own"), *[before(F.col(f"__n{k}"), along).alias(f"__before{k}") for k in range(folds)])
    inside = Window.partitionBy(label, "__part").orderBy("__order", key)
    at = at.select("*", *[before(c, inside).alias(f"__inside{k}") for k, c in enumerate(other)])
    out = at.join(parts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__part") == F.col("__own")))
    turn: list[Column] = [F.when(F.col(fold) == k, F.lit(-1)).otherwise(F.pmod(F.col(f"__before{k}") + F.col(f"__inside{k}"), F.lit(n))).cast("int") for k in range(folds)]
    return out.select(*rows.columns, F.array(*turn).alias("inner"))


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows, in at most a partition for each core or TASK rows: every step of a fit is a job over all partitions."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK)))


def minimise(x: np.ndarray, most: int, tol: float = 1e-6, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS with strong Wolfe steps as a generator: yields a point, is sent its value and gradient, returns the last point.

    It stops as Spark's does: after `most` steps, once the gradient is below tol of the value, once 20 values differ by less
    than tol of the first, or when no step is found from the plain gradient.
    """
    value, grad = yield x
    first, values, pairs, failed = abs(value), [value], [], False
    for _ in range(most):
        if np.linalg.norm(grad) <= max(tol * abs(value), 1e-8) or len(values) > 1 and abs(value - max(values)) <= tol * first:
            break
        step = None
        while step is None:
            d = _direction(grad, pairs)
            step = yield from _wolfe(x, d, value, grad, 1.0 if pairs else 1.0 / np.linalg.norm(d))
            if step is None and (failed or not pairs):
                return x
            if step is None:
                pairs, failed = [], True
        t, v, g = step
        if t * np.linalg.norm(grad) < 1e-10:
            return x
        moved = t * d
        pairs = [*pairs, (moved, g - grad)][-memory:]
        x, value, grad, failed = x + moved, v, g, False
        values = [*values, value][-20:]
    return x


def _direction(grad: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    d, along = -grad, []
    for s, y in reversed(pairs):
        a = (s @ d) / (s @ y) if s @ y else 0.0
        along.append(a)
        d = d - a * y
    if pairs:
        s, y = pairs[-1]
        d = d * ((s @ y) / (y @ y) if y @ y and s @ y else 1.0)
    for (s, y), a in zip(pairs, reversed(along), strict=True):
        d = d + s * (a - (y @ d) / (s @ y) if s @ y else 0.0)
    return d


def _wolfe(x: np.ndarray, d: np.ndarray, value: float, grad: np.ndarray, t: float, c1: float = 1e-4, c2: float = 0.9, tries: int = 10):
    """(step, value, gradient) by bracketing and cubic interpolation; None if there is none."""
    slope = float(grad @ d)
    if not slope < 0:
        return None
    low, hi = (0.0, value, slope), None
    for i in range(tries):
        v, g = yield x + t * d
        if not np.isfinite(v):
            t /= 2
            continue
        c = (t, v, float(g @ d))
        if v > value + c1 * t * slope or (v >= low[1] and i):
            hi = c
            break
        if abs(c[2]) <= c2 * abs(slope):
            return t, v, g
        if c[2] >= 0:
            low, hi = c, low
            break
        low, t = c, t * 1.5
    if hi is None:
        return None
    for _ in range(tries):
        t = _between(*((hi, low) if low[0] > hi[0] else (low, hi)))
        v, g = yield x + t * d
        c = (t, v, float(g @ d))
        if not v <= value + c1 * t * slope or v >= low[1]:
            hi = c
            continue
        if abs(c[2]) <= c2 * abs(slope):
            return t, v, g
        if c[2] * (hi[0] - low[0]) >= 0:
            hi = low
        low = c
    return None


def _between(l: tuple, r: tuple) -> float:
    """The minimum of the cubic through two points with slopes, not within a tenth of either end."""
    wide = r[0] - l[0]
    d1 = l[2] + r[2] - 3 * (l[1] - r[1]) / (l[0] - r[0])
    d2 = np.sqrt(max(d1 * d1 - l[2] * r[2], 0.0))
    below = r[2] - l[2] + 2 * d2
    t = r[0] - wide * (r[2] + d2 - d1) / below if below and np.isfinite(below) else l[0] + wide / 2
    return float(np.clip(t, l[0] + 0.1 * wide, l[0] + 0.9 * wide))


def together(problems: dict, evaluate: Callable[[dict], dict]) -> dict:
    """The results of generators as `minimise` makes them; evaluate gets the points of all that aren't done at once."""
    points, done = {k: next(g) for k, g in problems.items()}, {}
    while points:
        found = evaluate(points)
        ahead = {}
        for k in points:
            try:
                ahead[k] = problems[k].send(found[k])
            except StopIteration as e:
                done[k] = e.value
        points = ahead
    return done


@dataclass(frozen=True)
class Shape:
    """Widths of the vectors, the hidden layer and the Fourier features; folds, inner folds and the features' phases."""

    dim: int
    hidden: int
    folds: int
    inner: int
    w: np.ndarray
    b: np.ndarray

    def models(self) -> list[tuple[int, int]]:
        """(k, j): fold k held out, and inner fold j too unless it is -1."""
        return [(k, j) for k in range(self.folds) for j in (-1, *range(self.inner))]

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features; the cosine, of a phase within one turn, has single precision (2e-7)."""
        turns = x @ (self.w / (2 * np.pi)) + self.b / (2 * np.pi)
        turns -= np.rint(turns)
        z = np.cos((turns * (2 * np.pi)).astype(np.float32)).astype(np.float64)
        z *= np.sqrt(2 / self.w.shape[1])
        return z

    def start(self, seed: int) -> np.ndarray:
        """First weights of a network: uniform within 2.4 over the width that a layer reads."""
        rng, parts = np.random.default_rng(seed), []
        for i, o in ((self.dim, self.hidden), (self.hidden, 2)):
            parts.append(rng.uniform(-2.4, 2.4, (i + 1) * o) / i)
        return np.concatenate(parts)

    def layers(self, nets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Weights and biases of the hidden layers side by side, and of what the second output has over the first."""
        m, d, h = len(nets), self.dim, self.hidden
        w, b, v, c = np.split(nets, np.cumsum([d * h, h, 2 * h]), axis=1)
        v = v.reshape(m, h, 2)
        return w.reshape(m, d, h).transpose(1, 0, 2).reshape(d, m * h), b.reshape(-1), v[:, :, 1] - v[:, :, 0], c[:, 1] - c[:, 0]

    def hidden_of(self, x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        a = x @ w
        a += b
        np.negative(a, out=a)
        np.exp(np.minimum(a, 700.0, out=a), out=a)
        a += 1
        np.reciprocal(a, out=a)
        return a.reshape(len(x), -1, self.hidden)

    def margins(self, x: np.ndarray, nets: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers(nets)
        return np.clip(np.einsum("nmh,mh->nm", self.hidden_of(x, w, b), v) + c, -SURE, SURE)

    def hinge(self, z: np.ndarray, y: np.ndarray, keep: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """Of each plane (weights, then intercept) the loss and its gradient, summed over the rows kept."""
        s = (2 * y - 1)[:, None]
        t = 1 - s * (z @ planes[:, :-1].T + planes[:, -1])
        on = keep & (t > 0)
        r = np.where(on, -s, 0.0)
        return np.column_stack([np.where(on, t, 0.0).sum(0), r.T @ z, r.sum(0)])

    def entropy(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, nets: np.ndarray) -> np.ndarray:
        """Of each network the cross-entropy and its gradient, summed over the rows kept."""
        m, d, h = len(nets), self.dim, self.hidden
        w, b, v, c = self.layers(nets)
        act = self.hidden_of(x, w, b)
        f = np.einsum("nmh,mh->nm", act, v) + c
        e = np.exp(-np.abs(f))
        loss = np.where(keep, np.maximum(f, 0) - y[:, None] * f + np.log1p(e), 0.0).sum(0)
        r = np.where(keep, np.where(f >= 0, 1.0, e) / (1 + e) - y[:, None], 0.0)
        dv = np.einsum("nm,nmh->mh", r, act)
        back = act * (1 - act)
        back *= v
        back *= r[:, :, None]
        back = back.reshape(len(x), m * h)
        dw, rest = (x.T @ back).reshape(d, m, h).transpose(1, 0, 2).reshape(m, d * h), r.sum(0)
        return np.column_stack([loss, dw, back.sum(0).reshape(m, h), np.stack([-dv, dv], axis=2).reshape(m, 2 * h), -rest, rest])


def blocks_of(table: DataFrame, label: str, shape: Shape) -> RDD:
    """(fold, inner folds, labels, vectors) of up to BLOCK rows each; table has `fold`, `inner`, `x` as arrays and the label."""
    dim, folds = shape.dim, shape.folds
    names = ["fold", "inner", "y", "x"]
    schema = pa.schema([("fold", pa.int32()), ("inner", pa.binary()), ("y", pa.binary()), ("x", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def out(k: int) -> pa.RecordBatch:
            parts = [np.concatenate(p) for p in zip(*waiting.pop(k), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], schema=schema)

        for batch in batches:
            fold, y = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            if not np.isin(y, (0, 1)).all():
                raise ValueError("labels must be 0 or 1")
            inner = batch.column(1).flatten().to_numpy().reshape(-1, folds).astype(np.int8)
            x = batch.column(3).flatten().to_numpy().reshape(-1, dim)
            for k in np.unique(fold):
                own = fold == k
                waiting.setdefault(int(k), []).append((inner[own], y[own].astype(np.float64), x[own]))
                if sum(len(p[1]) for p in waiting[int(k)]) >= BLOCK:
                    yield out(int(k))
        for k in sorted(waiting):
            yield out(k)

    rows = table.select("fold", "inner", F.col(label).cast("double").alias("y"), "x").mapInArrow(pack, "fold int, inner binary, y binary, x binary")
    return rows.select(*names).rdd.map(lambda r: (r[0], np.frombuffer(r[1], np.int8).reshape(-1, folds), np.frombuffer(r[2]), np.frombuffer(r[3]).reshape(-1, dim)))


def summed(rows: RDD, each: Callable, size: int) -> np.ndarray:
    """The sum of each(item), an array of that size, over all items."""

    def run(items: Iterator) -> Iterator[np.ndarray]:
        total = np.zeros(size)
        for item in items:
            total += each(item)
        yield total

    parts = rows.mapPartitions(run)
    return parts.treeReduce(lambda a, b: a + b) if rows.getNumPartitions() > DIRECT else np.sum(parts.collect(), axis=0)


def _pieces(block: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(0, len(block[2]), ROWS):
        yield tuple(a[i : i + ROWS] for a in block[1:])


def _kept(fold: int, inner: np.ndarray, models: list[tuple[int, int]]) -> tuple[list[int], np.ndarray]:
    """Places of the models that see rows of the fold, and which rows each of them sees."""
    at = [i for i, (k, _) in enumerate(models) if k != fold]
    return at, np.stack([inner[:, models[i][0]] != models[i][1] for i in at], axis=1) if at else np.zeros((len(inner), 0), bool)


@dataclass(frozen=True)
class Fitted:
    """Of each fold the plane, the network and their logistic curves (slope, intercept)."""

    shape: Shape
    planes: np.ndarray
    nets: np.ndarray
    curves: dict[tuple[str, int], tuple[float, float]]

    def score(self, part: DataFrame, k: int) -> DataFrame:
        """part, which has `x` as an array, with p_svm and p_mlp by the models that haven't seen fold k instead of x."""
        shape, plane, net = self.shape, self.planes[k], self.nets[k : k + 1]
        (sa, sb), (na, nb) = self.curves["svm", k], self.curves["mlp", k]
        rest = [c for c in part.columns if c != "x"]
        sure = lambda f, a, b: 1 / (1 + np.exp(-np.clip(f * a + b, -700, 700)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(len(rest)).flatten().to_numpy().reshape(-1, shape.dim)
                f = [np.column_stack([shape.lift(y) @ plane[:-1] + plane[-1], shape.margins(y, net)[:, 0]]) for y in (x[i : i + ROWS] for i in range(0, len(x), ROWS))]
                f = np.concatenate(f) if f else np.zeros((0, 2))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(sure(f[:, 0], sa, sb)), pa.array(sure(f[:, 1], na, nb))], names=[*rest, "p_svm", "p_mlp"])

        kinds = ", ".join(f"`{c}` {part.schema[c].dataType.simpleString()}" for c in rest)
        return part.select(*rest, "x").mapInArrow(run, f"{kinds}, p_svm double, p_mlp double")


def fit(table: DataFrame, label: str, dim: int, hidden: int, folds: int, inner: int, penalty: float, seed: int, phases: tuple[np.ndarray, np.ndarray], svm_steps: int = 50, net_steps: int = 60, curve_steps: int = 50) -> Fitted:
    """Planes on Fourier features (hinge loss, penalised in units of deviations) and networks for every fold, and their curves.

    Curves are fitted on margins of models that haven't seen the rows: those of the inner folds. table: as for `blocks_of`.
    """
    shape = Shape(dim, hidden, folds, inner, *phases)
    blocks = blocks_of(table, label, shape).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        planes, nets = _weights(blocks, shape, penalty, seed, svm_steps, net_steps)
        models = shape.models()
        seen = _unseen_margins(blocks, shape, planes, nets).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            curves = _curves(seen, folds, curve_steps)
        finally:
            seen.unpersist()
    finally:
        blocks.unpersist()
    whole = [i for i, (_, j) in enumerate(models) if j < 0]
    return Fitted(shape, planes[whole], nets[whole], curves)


def _weights(blocks: RDD, shape: Shape, penalty: float, seed: int, svm_steps: int, net_steps: int) -> tuple[np.ndarray, np.ndarray]:
    models, d = shape.models(), shape.w.shape[1]
    width = 1 + 2 * d

    def spread(block: tuple) -> np.ndarray:
        out = np.zeros((len(models), width))
        for inner, _, x in _pieces(block):
            at, keep = _kept(block[0], inner, models)
            z, on = shape.lift(x), keep.T.astype(float)
            out[at] += np.column_stack([on.sum(1), on @ z, on @ (z * z)])
        return out.ravel()

    sums = summed(blocks, spread, len(models) * width).reshape(-1, width)
    n = np.maximum(sums[:, 0], 1)
    mean = sums[:, 1 : 1 + d] / n[:, None]
    std = np.sqrt(np.maximum(sums[:, 1 + d :] - n[:, None] * mean**2, 0) / np.maximum(n - 1, 1)[:, None])
    per = np.divide(1.0, std, out=np.zeros_like(std), where=std > 1e-12)

    def plane(i: int, p: np.ndarray) -> np.ndarray:
        u = p[:-1] * per[i]
        return np.append(u, p[-1] - mean[i] @ u)

    size = 1 + (shape.dim + 1) * shape.hidden + 2 * (shape.hidden + 1)

    def evaluate(points: dict) -> dict:
        own = {kind: [i for what, i in points if what == kind] for kind in ("svm", "mlp")}
        flats = np.array([plane(i, points["svm", i]) for i in own["svm"]]).reshape(-1, d + 1)
        nets = np.array([points["mlp", i] for i in own["mlp"]]).reshape(-1, size - 1)
        flat_models, net_models = [models[i] for i in own["svm"]], [models[i] for i in own["mlp"]]

        def losses(block: tuple) -> np.ndarray:
            a, b = np.zeros((len(flats), d + 2)), np.zeros((len(nets), size))
            for inner, y, x in _pieces(block):
                at, keep = _kept(block[0], inner, flat_models)
                if at:
                    a[at] += shape.hinge(shape.lift(x), y, keep, flats[at])
                at, keep = _kept(block[0], inner, net_models)
                if at:
                    b[at] += shape.entropy(x, y, keep, nets[at])
            return np.concatenate([a.ravel(), b.ravel()])

        found = summed(blocks, losses, flats.shape[0] * (d + 2) + len(nets) * size)
        a, b = found[: len(flats) * (d + 2)].reshape(-1, d + 2), found[len(flats) * (d + 2) :].reshape(-1, size)
        out = {}
        for i, r in zip(own["svm"], a / n[own["svm"], None], strict=True):
            w = points["svm", i][:-1]
            out["svm", i] = r[0] + penalty / 2 * (w @ w), np.append((r[1:-1] - mean[i] * r[-1]) * per[i] + penalty * w, r[-1])
        for i, r in zip(own["mlp"], b / n[own["mlp"], None], strict=True):
            out["mlp", i] = r[0], r[1:]
        return out

    start = shape.start(seed)
    problems = {("svm", i): minimise(np.zeros(d + 1), svm_steps) for i in range(len(models))} | {("mlp", i): minimise(start.copy(), net_steps) for i in range(len(models))}
    done = together(problems, evaluate)
    return np.array([plane(i, done["svm", i]) for i in range(len(models))]), np.array([done["mlp", i] for i in range(len(models))])


def _unseen_margins(blocks: RDD, shape: Shape, planes: np.ndarray, nets: np.ndarray) -> RDD:
    """(fold, labels, margins): for every other fold k, in order, the margins of both inner models that haven't seen the row."""
    models = shape.models()

    def margins(block: tuple) -> tuple[int, np.ndarray, np.ndarray]:
        out = []
        for inner, _, x in _pieces(block):
            z, cols = shape.lift(x), []
            for k in (k for k in range(shape.folds) if k != block[0]):
                at = [i for i, (a, j) in enumerate(models) if a == k and j >= 0]
                own = inner[:, k].astype(int)[:, None]
                for f in (z @ planes[at, :-1].T + planes[at, -1], shape.margins(x, nets[at])):
                    cols.append(np.take_along_axis(f, own, axis=1)[:, 0])
            out.append(np.column_stack(cols))
        return block[0], block[2], np.concatenate(out)

    return blocks.map(margins)


def _curves(seen: RDD, folds: int, steps: int) -> dict[tuple[str, int], tuple[float, float]]:
    """Slope and intercept of each logistic curve; of one class only the curve is certain of it."""
    names = [(kind, k) for k in range(folds) for kind in ("svm", "mlp")]
    place = lambda fold: [i for i, (_, k) in enumerate(names) if k != fold]

    def spread(item: tuple) -> np.ndarray:
        out, m = np.zeros((len(names), 4)), item[2]
        out[place(item[0])] = np.column_stack([np.full(m.shape[1], len(m)), np.full(m.shape[1], item[1].sum()), m.sum(0), (m * m).sum(0)])
        return out.ravel()

    n, ones, total, squares = summed(seen, spread, 4 * len(names)).reshape(-1, 4).T
    count = np.maximum(n, 1)
    mean = total / count
    std = np.sqrt(np.maximum(squares - count * mean**2, 0) / np.maximum(count - 1, 1))
    per = np.divide(1.0, std, out=np.zeros_like(std), where=std > 1e-12)
    mixed = [i for i in range(len(names)) if 0 < ones[i] < n[i]]

    def evaluate(points: dict) -> dict:
        own = sorted(points)
        a = np.array([points[i][0] * per[i] for i in own])
        b = np.array([points[i][1] for i in own]) - a * mean[own]

        def losses(item: tuple) -> np.ndarray:
            out, all_of = np.zeros((len(own), 3)), place(item[0])
            at = [i for i, x in enumerate(own) if x in all_of]
            m, y = item[2][:, [all_of.index(own[i]) for i in at]], item[1][:, None]
            f = m * a[at] + b[at]
            e = np.exp(-np.abs(f))
            r = np.where(f >= 0, 1.0, e) / (1 + e) - y
            out[at] = np.column_stack([(np.maximum(f, 0) - y * f + np.log1p(e)).sum(0), (r * m).sum(0), r.sum(0)])
            return out.ravel()

        found = summed(seen, losses, 3 * len(own)).reshape(-1, 3) / count[own, None]
        return {i: (r[0], np.array([(r[1] - mean[i] * r[2]) * per[i], r[2]])) for i, r in zip(own, found, strict=True)}

    done = together({i: minimise(np.array([0.0, np.log(ones[i] / (n[i] - ones[i]))]), steps) for i in mixed}, evaluate)
    curves = {}
    for i, name in enumerate(names):
        a = done[i][0] * per[i] if i in done else 0.0
        curves[name] = (float(a), float(done[i][1] - a * mean[i])) if i in done else (0.0, np.inf if ones[i] else -np.inf)
    return curves


__all__ = ["Fitted", "fewer", "fit", "inner_folds", "minimise", "together"]
