"""Statistics as Column expressions and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMOOTH = 1e-10
#: Ranges of values that running sums are taken over first.
RANGES = 1024


def rounded(c: Column, digits: int = 6) -> Column:
    """c with so many digits and without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def cleaned(c: Column) -> Column:
    """NaN to 0, infinities to 1 and 0, then clipped to [0, 1]."""
    return F.least(F.greatest(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def finite_or_zero(c: Column) -> Column:
    """Null, NaN and infinities to 0."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(0.0)).otherwise(d)


def bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The histogram bin of v in [lo, hi]; the last bin holds hi. An empty range is widened by one half each way."""
    flat = lo == hi
    low, high = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)
    return F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")


def entropy(counts: DataFrame, by: list[str], n: str, bins: int, name: str = "entropy", base2: bool = True) -> DataFrame:
    """Entropy of histograms with SMOOTH added to every one of `bins` bins; counts holds those that aren't empty."""
    log = F.log2 if base2 else F.log
    total = F.sum(n).over(Window.partitionBy(*by)) + bins * SMOOTH
    p = (F.col(n) + SMOOTH) / F.col("__total")
    empty = SMOOTH / F.first("__total")
    return counts.withColumn("__total", total).groupBy(*by).agg((-F.sum(p * log(p)) - (bins - F.count(F.lit(1))) * empty * log(empty)).alias(name))


def moments(v: str) -> dict[str, Column]:
    """Population mean, variance, deviation, skewness and excess kurtosis."""
    return {"mean": F.avg(v), "var": F.var_pop(v), "std": F.stddev_pop(v), "skew": F.skewness(v), "kurt": F.kurtosis(v)}


def cohens_d(values: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    """|mean1 - mean0| over the pooled sample deviation per metric; 0 if a class has one value or the deviation is 0."""
    per = values.groupBy(metric).agg(*[f.alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg(F.when(F.col(label) == k, F.col(value)))), ("s", F.stddev_samp(F.when(F.col(label) == k, F.col(value)))), ("n", F.count(F.when(F.col(label) == k, F.col(value)))))])
    pooled = F.sqrt((F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1")) / 2)
    return per.select(metric, F.when((F.col("n0") > 1) & (F.col("n1") > 1) & (pooled > 0), F.abs(F.col("m1") - F.col("m0")) / pooled).otherwise(F.lit(0.0)).alias("cohens_d"))


def ahead(at: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """at with `__ahead`: the sum of n over the rows of the group with a smaller value. at has one row for each value of a group.

    Sums of RANGES ranges of values are added up first, so that no window holds a whole group.
    """
    keys = by or ["__all"]
    rows = at if by else at.withColumn("__all", F.lit(0))
    ends = rows.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    both = lambda x, y, on: x.join(y.withColumnsRenamed({k: f"__r{k}" for k in on}), [F.col(k).eqNullSafe(F.col(f"__r{k}")) for k in on]).drop(*[f"__r{k}" for k in on])  # noqa: E731  null groups meet too
    rows = both(rows, ends, keys)
    place = F.floor((F.col(value).cast("double") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * RANGES)
    rows = rows.withColumn("__range", F.when(F.col("__hi") > F.col("__lo"), F.least(place, F.lit(RANGES - 1))).otherwise(F.lit(0)).cast("int")).drop("__lo", "__hi")
    earlier = Window.unboundedPreceding, -1
    sums = rows.groupBy(*keys, "__range").agg(F.sum(n).alias("__n"))
    sums = sums.select(*keys, "__range", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(*earlier)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(*earlier)), F.lit(0))
    return both(rows.withColumn("__inside", inside), sums, [*keys, "__range"]).withColumn("__ahead", F.col("__before") + F.col("__inside")).drop("__before", "__inside", "__range", "__all")


def percentiles(values: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, a column for each share, and n: exact percentiles with linear interpolation; nulls don't count.

    They are read off the running counts of distinct values, so that no group is gathered in one task.
    """
    at = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    total = at.groupBy(*by).agg(F.sum("__c").alias("n"))
    rows = ahead(at, by, value, "__c")
    rows = rows.join(total.withColumnsRenamed({k: f"__t{k}" for k in by}), [F.col(k).eqNullSafe(F.col(f"__t{k}")) for k in by]) if by else rows.withColumn("n", F.lit(total.first()["n"] or 0))
    holds = lambda rank: F.max(F.when((F.col("__ahead") <= rank) & (rank < F.col("__ahead") + F.col("__c")), F.col(value)))
    place = {k: F.lit(float(p)) * (F.col("n") - 1) for k, p in shares.items()}
    found = rows.groupBy(*by, "n").agg(*[holds(f(place[k])).alias(f"__{side}{k}") for k in shares for side, f in (("l", F.floor), ("h", F.ceil))])
    return found.select(*by, *[(F.col(f"__l{k}") + (place[k] - F.floor(place[k])) * (F.col(f"__h{k}") - F.col(f"__l{k}"))).alias(k) for k in shares], "n")


def tail_separation(values: DataFrame, metric: str, label: str, value: str, least: int = 5) -> DataFrame:
    """Tail heaviness and separation of two classes per metric, best first.

    tail = (P95 - median) / IQR averaged over the classes; separation = distance
    of medians over the mean IQR, 1 if that is 0; score = tail * separation.
    no_overlap keeps the sign it is known by; classes_disjoint says what it seems to.
    """
    per = percentiles(values, [metric, label], value, {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    per = per.where(F.col("n") >= least).withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("tail", F.when(F.col("iqr") > 0, (F.col("p95") - F.col("p50")) / F.col("iqr")).otherwise(F.lit(0.0)))
    pick = lambda c, k: F.max(F.when(F.col(label) == k, F.col(c)))
    wide = per.groupBy(metric).agg(F.count(F.lit(1)).alias("classes"), F.avg("tail").alias("tail_score"), F.avg("iqr").alias("iqr"), F.max("p05").alias("hi05"), F.min("p95").alias("lo95"), pick("p50", 0).alias("m0"), pick("p50", 1).alias("m1")).where("classes = 2")
    separation = F.when(F.col("iqr") > 0, F.abs(F.col("m1") - F.col("m0")) / F.col("iqr")).otherwise(F.lit(1.0))
    overlap = F.col("hi05") - F.col("lo95")
    out = wide.select(metric, "tail_score", separation.alias("separation"), (overlap < 0).alias("no_overlap"), (overlap > 0).alias("classes_disjoint"), (F.col("tail_score") * F.greatest(separation, F.lit(0.0))).alias("combined_score"))
    return out.orderBy(F.desc("combined_score"), metric)


def roc_auc(scored: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks; ties count one half. Ranks come from one row per distinct score."""
    at = scored.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    at, below = ahead(at, by, score, "neg"), F.col("__ahead")
    sums = at.withColumn("__won", F.col("pos") * (below + F.col("neg") / 2)).groupBy(*by).agg(F.sum("__won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(*by, F.when(F.col("p") * F.col("n") > 0, F.col("won") / (F.col("p") * F.col("n"))).alias("auc"))


def prf(pairs: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of every class, 0 where a denominator is."""
    hit = pairs.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    true = hit.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    said = hit.groupBy(F.col(pred).alias("class")).agg(F.sum("n").alias("said"))
    both = true.join(said, "class", "left").na.fill(0, ["said"])
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return both.select("class", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def stratified(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """rows with `turn`, the place from 0 in a seeded shuffle within the label, and `size`, the rows of the label.

    Places are counted within ranges of the shuffle's hash, 4096 for each label, so that no label is sorted in one task.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    at = rows.withColumn("__order", order).withColumn("__part", F.substring("__order", 1, 3))
    parts = at.groupBy(label, "__part").agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(label)
    before = F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col(label).alias("__label"), F.col("__part").alias("__own"), before.alias("__before"), F.sum("__n").over(own).alias("size"))
    inside = F.row_number().over(Window.partitionBy(label, "__part").orderBy("__order", key)) - 1
    out = at.withColumn("__inside", inside).join(parts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__part") == F.col("__own")))
    return out.withColumn("turn", F.col("__before") + F.col("__inside")).drop("__order", "__part", "__label", "__own", "__before", "__inside")
