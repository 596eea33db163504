"""Decision rules: heuristics, range maps, votes, abstention, and the reconciliation of two models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENUINE, SYNTHETIC = 0, 1


def weight_dc(max_warp: Column, diff_tc: Column, max_base: Column, laplace_mean: Column) -> Column:
    """Evidence for a genuine image from DC features: 0.66 for each of four signs."""
    signs = [(max_warp > 0.4) & (max_warp < 0.6), F.exists(diff_tc, lambda v: v < 20), max_base > 10300, F.exists(laplace_mean, lambda v: v > 7)]
    return sum((F.when(s, 0.66).otherwise(0.0) for s in signs), F.lit(0.0))


def weight_ae(laplace_mean: Column, sobel_mean: Column, max_magnitude: Column, bce: Column, perturbed_bce: Column, image_mean: Column) -> Column:
    """Evidence for a genuine image from AE features."""
    near = lambda c: (F.abs(c) > 40) & (F.abs(c) < 60)
    signs = [(F.exists(laplace_mean, lambda v: v > 4.25), 0.8), (F.exists(sobel_mean, lambda v: v < 4), 0.66), (max_magnitude >= 150000, 0.7), (near(bce) & near(perturbed_bce), 0.66), (F.exists(image_mean, lambda v: v >= 5), 0.66)]
    return sum((F.when(s, w).otherwise(0.0) for s, w in signs), F.lit(0.0))


def to_range(c: Column, lo: float, hi: float, out_lo: float = 0.01, out_hi: float = 1.0) -> Column:
    """An affine map of [lo, hi] to [out_lo, out_hi], without clipping."""
    return out_lo + (c - lo) * (out_hi - out_lo) / (hi - lo)


def origin(c: Column, low: float, high: float, middle: float = 0.4) -> Column:
    return F.when(c < low, GENUINE).when(c > high, SYNTHETIC).when(c < middle, GENUINE).otherwise(SYNTHETIC)


def reconcile(ae: Column, dc: Column, ae_range=(0.02, 0.90), dc_range=(0.15, 0.80), ae_marks=(0.4, 0.48), dc_marks=(0.39, 0.43)) -> dict[str, Column]:
    """model, num and origin of the surer of two models; of equal origins the first model's, else that farthest from one of its marks."""
    a, d = to_range(ae, *ae_range), to_range(dc, *dc_range)
    oa, od = origin(a, *ae_marks), origin(d, *dc_marks)
    far = lambda c, marks: F.greatest(F.abs(c - marks[0]), F.abs(c - marks[1]))
    first = (oa == od) | (far(a, ae_marks) >= far(d, dc_marks))
    return {"model": F.when(first, "ae").otherwise("dc"), "num": F.when(first, a).otherwise(d), "origin": F.when(first, oa).otherwise(od)}


def label_of(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p > threshold, SYNTHETIC).otherwise(GENUINE)


def confidence(p: Column, threshold: float = 0.5) -> Column:
    """Whole percent of the likelier class, rounded half to even."""
    return F.bround(F.when(p < threshold, 1 - p).otherwise(p) * 100).cast("int")


def soft_vote(*ps: Column) -> Column:
    return sum(ps[1:], ps[0]) / len(ps)


def abstain(p: Column, margin: float) -> Column:
    """-1 strictly between margin and 1 - margin, else the label."""
    return F.when((p > margin) & (p < 1 - margin), -1).otherwise(label_of(p))


def agreement(*ps: Column) -> Column:
    return F.size(F.array_distinct(F.array(*[(p > 0.5).cast("int") for p in ps]))) == 1
