"""Decision, evaluation and reporting queries, with SQL for DuckDB.

Scores stand in for model outputs: three values of an embedding, moved to
[0, 1], are the probabilities of three models, and label % 2 is the class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.stats import rounded as R
from ..operators import decide as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED, FOLDS = 42, 5


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


_UNIT = "least(greatest(CAST(embedding[{}] AS DOUBLE) + 0.5, 0.0), 1.0)"
_SC = f"sc AS (SELECT vec_id AS id, CAST(label % 2 AS INTEGER) AS y, label, {_UNIT.format(1)} AS p1, {_UNIT.format(2)} AS p2, {_UNIT.format(3)} AS p3 FROM embeddings), vo AS (SELECT *, (p1 + p2 + p3) / 3 AS p, CASE WHEN (p1 + p2 + p3) / 3 > 0.5 THEN 1 ELSE 0 END AS pred FROM sc)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    p = lambda k: F.least(F.greatest(F.get("embedding", F.lit(k)).cast("double") + 0.5, F.lit(0.0)), F.lit(1.0))
    return e.select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("int").alias("y"), "label", p(0).alias("p1"), p(1).alias("p2"), p(2).alias("p3"))


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).withColumn("p", D.soft_vote(F.col("p1"), F.col("p2"), F.col("p3")))
    return s.withColumn("pred", D.label_of(F.col("p")))


@query("soft_vote", f"WITH {_SC} SELECT id, y, {_r('p', 'p_ens')}, pred FROM vo")
def soft_vote(spark, sf_dir):
    return voted(spark, sf_dir).select("id", "y", R(F.col("p")).alias("p_ens"), "pred")


@query("class_balance", f"""WITH {_SC}, c AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM sc)
SELECT n0, n1, {_r('100.0 * n0 / (n0 + n1)', 'pct0')}, {_r('n0 / n1', 'scale_pos_weight')} FROM c""")
def class_balance(spark, sf_dir):
    c = scores(spark, sf_dir).agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    return c.select("n0", "n1", R(100.0 * F.col("n0") / (F.col("n0") + F.col("n1"))).alias("pct0"), R(F.col("n0") / F.col("n1")).alias("scale_pos_weight"))


@query("confusion", f"WITH {_SC} SELECT y, count(*) FILTER (pred = 0) AS said_genuine, count(*) FILTER (pred = 1) AS said_synthetic FROM vo GROUP BY y")
def confusion(spark, sf_dir):
    c = voted(spark, sf_dir).groupBy("y").pivot("pred", [0, 1]).count()
    return c.select("y", F.coalesce("0", F.lit(0)).alias("said_genuine"), F.coalesce("1", F.lit(0)).alias("said_synthetic"))


_PRF = """cl AS (SELECT k AS class, count(*) FILTER (y = k) AS support, count(*) FILTER (pred = k) AS said, count(*) FILTER (y = k AND pred = k) AS tp FROM vo, (VALUES (0), (1)) v(k) GROUP BY k),
pr AS (SELECT class, support, CASE WHEN said > 0 THEN tp / said ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM cl),
fs AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pr)"""


@query("classification_report", f"WITH {_SC}, {_PRF} SELECT class, {_r('p', 'precision')}, {_r('r', 'recall')}, {_r('f', 'f1')}, support FROM fs")
def classification_report(spark, sf_dir):
    return S.prf(voted(spark, sf_dir), "y", "pred").select("class", R(F.col("precision")).alias("precision"), R(F.col("recall")).alias("recall"), R(F.col("f1")).alias("f1"), "support")


@query("prf_macro_weighted", f"WITH {_SC}, {_PRF} SELECT {_r('avg(f)', 'f1_macro')}, {_r('sum(f * support) / sum(support)', 'f1_weighted')}, {_r('(SELECT avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) FROM vo)', 'accuracy')} FROM fs")
def prf_macro_weighted(spark, sf_dir):
    f = S.prf(voted(spark, sf_dir), "y", "pred")
    # Accuracy is the recall weighted by support.
    return f.agg(R(F.avg("f1")).alias("f1_macro"), R(F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"), R(F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"))


@query("roc_auc", f"""WITH {_SC}, l AS (SELECT id, y, m, s FROM (UNPIVOT sc ON p1, p2, p3 INTO NAME m VALUE s)), a AS (SELECT m, s, sum(y) AS pos, sum(1 - y) AS neg FROM l GROUP BY m, s),
w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY m ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a) SELECT m AS model, {_r('sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))', 'auc')} FROM w GROUP BY m""")
def roc_auc(spark, sf_dir):
    long = scores(spark, sf_dir).select("y", F.expr("stack(3, 'p1', p1, 'p2', p2, 'p3', p3) AS (model, s)"))
    return S.roc_auc(long, ["model"], "y", "s").select("model", R(F.col("auc")).alias("auc"))


@query("roc_points", f"""WITH {_SC}, a AS (SELECT round(p, 2) AS t, sum(y) AS pos, sum(1 - y) AS neg FROM vo GROUP BY round(p, 2)), c AS (SELECT t, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM a WINDOW w AS (ORDER BY t DESC))
SELECT t + 0.0 AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {_r('tp / np', 'tpr')}, {_r('fp / nn', 'fpr')}, {_r('tp / (tp + fp)', 'precision')} FROM c""")
def roc_points(spark, sf_dir):
    a = voted(spark, sf_dir).groupBy(R(F.col("p"), 2).alias("threshold")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    # 101 thresholds at most, so one task is enough.
    w, whole = Window.orderBy(F.desc("threshold")), Window.partitionBy()
    c = a.select("threshold", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(whole).alias("np"), F.sum("neg").over(whole).alias("nn"))
    return c.select("threshold", "tp", "fp", R(F.col("tp") / F.col("np")).alias("tpr"), R(F.col("fp") / F.col("nn")).alias("fpr"), R(F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


@query("abstention", f"""WITH {_SC}, a AS (SELECT *, CASE WHEN p > 0.45 AND p < 0.55 THEN -1 ELSE pred END AS v FROM vo)
SELECT count(*) AS n, count(*) FILTER (v = -1) AS n_abstained, {_r('count(*) FILTER (v = -1) / count(*)', 'abstention_rate')}, {_r('coalesce(avg(CASE WHEN v = -1 THEN NULL WHEN v = y THEN 1.0 ELSE 0.0 END), 0.0)', 'accuracy')} FROM a""")
def abstention(spark, sf_dir):
    a = voted(spark, sf_dir).withColumn("v", D.abstain(F.col("p"), 0.45))
    out = F.col("v") == -1
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("n_abstained"), R(F.count_if(out) / F.count(F.lit(1))).alias("abstention_rate"), R(F.coalesce(F.avg(F.when(~out, (F.col("v") == F.col("y")).cast("double"))), F.lit(0.0))).alias("accuracy"))


@query("agreement", f"WITH {_SC} SELECT y, count(*) AS n, count(*) FILTER ((p1 > 0.5) = (p2 > 0.5) AND (p2 > 0.5) = (p3 > 0.5)) AS n_agree FROM sc GROUP BY y")
def agreement(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if(D.agreement(F.col("p1"), F.col("p2"), F.col("p3"))).alias("n_agree"))


_WC = """a AS (SELECT id, y, 0.01 + (p1 - 0.02) * 0.99 / 0.88 AS a, 0.01 + (p2 - 0.15) * 0.99 / 0.65 AS d FROM sc),
o AS (SELECT *, CASE WHEN a < 0.4 THEN 0 WHEN a > 0.48 THEN 1 WHEN a < 0.4 THEN 0 ELSE 1 END AS oa, CASE WHEN d < 0.39 THEN 0 WHEN d > 0.43 THEN 1 WHEN d < 0.4 THEN 0 ELSE 1 END AS od FROM a),
f AS (SELECT *, oa = od OR greatest(abs(a - 0.4), abs(a - 0.48)) >= greatest(abs(d - 0.39), abs(d - 0.43)) AS first FROM o)"""


@query("weighted_certainty", f"WITH {_SC}, {_WC} SELECT id, CASE WHEN first THEN 'ae' ELSE 'dc' END AS model, {_r('CASE WHEN first THEN a ELSE d END', 'num')}, CASE WHEN first THEN oa ELSE od END AS origin, CASE WHEN (CASE WHEN first THEN oa ELSE od END) = y THEN 1 ELSE 0 END AS match FROM f")
def weighted_certainty(spark, sf_dir):
    s = scores(spark, sf_dir)
    ae, dc = s.select("id", "y", F.col("p1").alias("ae")), s.select("id", F.col("p2").alias("dc"))
    both = ae.join(dc, "id")
    c = D.reconcile(F.col("ae"), F.col("dc"))
    return both.select("id", c["model"].alias("model"), R(c["num"]).alias("num"), c["origin"].alias("origin"), (c["origin"] == F.col("y")).cast("int").alias("match"))


@query("model_confidence", f"WITH {_SC}, c AS (SELECT id, p1, pred, round_even((CASE WHEN p1 < 0.5 THEN 1 - p1 ELSE p1 END) * 100, 0) AS c FROM vo) SELECT CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS origin, CAST(c AS INTEGER) AS confidence, count(*) AS n FROM c GROUP BY ALL")
def model_confidence(spark, sf_dir):
    return scores(spark, sf_dir).groupBy(D.label_of(F.col("p1")).alias("origin"), D.confidence(F.col("p1")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("heuristic_dc", """SELECT vec_id AS id, round(CAST((CASE WHEN abs(embedding[1]) > 0.4 AND abs(embedding[1]) < 0.6 THEN 0.66 ELSE 0 END) + (CASE WHEN embedding[2] * 100 < 20 OR embedding[3] * 100 < 20 THEN 0.66 ELSE 0 END)
 + (CASE WHEN CAST(embedding[4] AS DOUBLE) * 100000 > 10300 THEN 0.66 ELSE 0 END) + (CASE WHEN CAST(embedding[5] AS DOUBLE) * 50 > 7 OR CAST(embedding[6] AS DOUBLE) * 50 > 7 THEN 0.66 ELSE 0 END) AS DOUBLE), 6) + 0.0 AS weight FROM embeddings""")
def heuristic_dc(spark, sf_dir):
    e = lambda k: F.get("embedding", F.lit(k - 1))
    d = lambda k, m: e(k).cast("double") * m
    w = D.weight_dc(F.abs(e(1)), F.array(e(2) * 100, e(3) * 100), d(4, 100000), F.array(d(5, 50), d(6, 50)))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), R(w).alias("weight"))


@query("heuristic_ae", """WITH v AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)
SELECT id, round(CAST((CASE WHEN e[1] * 20 > 4.25 OR e[2] * 20 > 4.25 THEN 0.8 ELSE 0 END) + (CASE WHEN e[3] * 40 < 4 OR e[4] * 40 < 4 THEN 0.66 ELSE 0 END) + (CASE WHEN e[5] * 1000000 >= 150000 THEN 0.7 ELSE 0 END)
 + (CASE WHEN abs(e[6] * 300) > 40 AND abs(e[6] * 300) < 60 AND abs(e[7] * 300) > 40 AND abs(e[7] * 300) < 60 THEN 0.66 ELSE 0 END) + (CASE WHEN e[8] * 30 >= 5 OR e[9] * 30 >= 5 THEN 0.66 ELSE 0 END) AS DOUBLE), 6) + 0.0 AS weight FROM v""")
def heuristic_ae(spark, sf_dir):
    d = lambda k, m: F.get("embedding", F.lit(k - 1)).cast("double") * m
    w = D.weight_ae(F.array(d(1, 20), d(2, 20)), F.array(d(3, 40), d(4, 40)), d(5, 1000000), d(6, 300), d(7, 300), F.array(d(8, 30), d(9, 30)))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), R(w).alias("weight"))


# ---- metrics by class ---------------------------------------------------------------------------

_KEYS = list(range(1, 9))
_LONG = f"lo AS (SELECT 'k' || k AS metric, CAST(label % 2 AS INTEGER) AS y, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, {len(_KEYS) + 1}) r(k))"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric, y, v: the first eight values of every embedding as metrics."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    parts = F.array(*[F.struct(F.lit(f"k{k}").alias("metric"), F.get("embedding", F.lit(k - 1)).cast("double").alias("v")) for k in _KEYS])
    return e.select((F.col("label") % 2).cast("int").alias("y"), F.explode(parts).alias("m")).select("m.metric", "y", "m.v")


@query("cohens_d", f"""WITH {_LONG}, a AS (SELECT metric, avg(v) FILTER (y = 0) AS m0, avg(v) FILTER (y = 1) AS m1, stddev_samp(v) FILTER (y = 0) AS s0, stddev_samp(v) FILTER (y = 1) AS s1 FROM lo GROUP BY metric)
SELECT metric, {_r('abs(m1 - m0) / sqrt((s0 * s0 + s1 * s1) / 2)', 'cohens_d')} FROM a""")
def cohens_d(spark, sf_dir):
    return S.cohens_d(metrics(spark, sf_dir), "metric", "y", "v").select("metric", R(F.col("cohens_d")).alias("cohens_d"))


@query("tail_separation", f"""WITH {_LONG}, q AS (SELECT metric, y, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.25) AS b, median(v) AS c, quantile_cont(v, 0.75) AS d, quantile_cont(v, 0.95) AS e FROM lo GROUP BY ALL HAVING count(*) >= 5),
t AS (SELECT *, d - b AS iqr, CASE WHEN d > b THEN (e - c) / (d - b) ELSE 0.0 END AS tail FROM q),
w AS (SELECT metric, avg(tail) AS tail, avg(iqr) AS iqr, max(a) - min(e) AS ov, max(c) FILTER (y = 0) AS m0, max(c) FILTER (y = 1) AS m1 FROM t GROUP BY metric HAVING count(*) = 2),
s AS (SELECT *, CASE WHEN iqr > 0 THEN abs(m1 - m0) / iqr ELSE 1.0 END AS sep FROM w)
SELECT metric, {_r('tail', 'tail_score')}, {_r('sep', 'separation')}, ov < 0 AS no_overlap, ov > 0 AS classes_disjoint, {_r('tail * greatest(sep, 0.0)', 'combined_score')} FROM s""")
def tail_separation(spark, sf_dir):
    t = S.tail_separation(metrics(spark, sf_dir), "metric", "y", "v")
    return t.select("metric", R(F.col("tail_score")).alias("tail_score"), R(F.col("separation")).alias("separation"), "no_overlap", "classes_disjoint", R(F.col("combined_score")).alias("combined_score"))


@query("hist_density_by_label", f"""WITH {_LONG}, m AS (SELECT *, min(v) OVER (PARTITION BY metric, y) AS a, max(v) OVER (PARTITION BY metric, y) AS b, count(*) OVER (PARTITION BY metric, y) AS t FROM lo)
SELECT metric, y, CAST(least(floor((v - a) / (b - a) * 50), 49) AS INTEGER) AS bin, count(*) AS n, {_r('count(*) / (any_value(t) * (any_value(b) - any_value(a)) / 50)', 'density')} FROM m GROUP BY ALL""")
def hist_density_by_label(spark, sf_dir):
    long = metrics(spark, sf_dir)
    ends = long.groupBy("metric", "y").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("t"))
    bins = long.join(ends, ["metric", "y"]).groupBy("metric", "y", S.bin_of(F.col("v"), F.col("a"), F.col("b"), 50).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("t").alias("t"))
    return bins.select("metric", "y", "bin", "n", R(F.col("n") / (F.col("t") * (F.col("b") - F.col("a")) / 50)).alias("density"))


@query("box_summary_by_label", f"WITH {_LONG} SELECT metric, y, {_r('min(v)', 'lo')}, {_r('quantile_cont(v, 0.25)', 'q1')}, {_r('median(v)', 'mid')}, {_r('quantile_cont(v, 0.75)', 'q3')}, {_r('max(v)', 'hi')}, {_r('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)', 'iqr')}, {_r('stddev_samp(v)', 'std')} FROM lo GROUP BY metric, y")
def box_summary_by_label(spark, sf_dir):
    long = metrics(spark, sf_dir)
    ends = long.groupBy("metric", "y").agg(R(F.min("v")).alias("lo"), R(F.max("v")).alias("hi"), R(F.stddev_samp("v")).alias("std"))
    q = S.percentiles(long, ["metric", "y"], "v", {"q1": 0.25, "mid": 0.5, "q3": 0.75})
    return ends.join(q, ["metric", "y"]).select("metric", "y", "lo", R(F.col("q1")).alias("q1"), R(F.col("mid")).alias("mid"), R(F.col("q3")).alias("q3"), "hi", R(F.col("q3") - F.col("q1")).alias("iqr"), "std")


@query("kde_by_label", f"""WITH {_LONG}, s AS (SELECT metric, y, stddev_samp(v) * pow(count(*), -0.2) AS h, count(*) AS n FROM lo GROUP BY metric, y)
SELECT metric, y, CAST(g AS INTEGER) AS point, {_r('sum(exp(-0.5 * pow((g * 0.1 - 0.5 - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 'density')} FROM lo JOIN s USING (metric, y), range(11) r(g) GROUP BY ALL""")
def kde_by_label(spark, sf_dir):
    long = metrics(spark, sf_dir)
    s = long.groupBy("metric", "y").agg((F.stddev_samp("v") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h"), F.count(F.lit(1)).alias("n"))
    grid = long.join(s, ["metric", "y"]).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(10))))
    z = (F.col("point") * 0.1 - 0.5 - F.col("v")) / F.col("h")
    return grid.groupBy("metric", "y", "point").agg(R(F.sum(F.exp(-0.5 * z * z)) / (F.first("n") * F.first("h") * F.sqrt(2 * F.pi()))).alias("density"))


@query("standard_scale", f"""WITH {_LONG}, s AS (SELECT *, avg(v) OVER (PARTITION BY metric) AS m, stddev_pop(v) OVER (PARTITION BY metric) AS d FROM lo) SELECT metric, y, {_r('avg((v - m) / d)', 'mean_z')}, {_r('max((v - m) / d)', 'max_z')} FROM s GROUP BY metric, y""")
def standard_scale(spark, sf_dir):
    long = metrics(spark, sf_dir)
    s = long.groupBy("metric").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
    z = (F.col("v") - F.col("m")) / F.col("d")
    return long.join(s, "metric").groupBy("metric", "y").agg(R(F.avg(z)).alias("mean_z"), R(F.max(z)).alias("max_z"))


_TURN = f"row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}|' || CAST(id AS VARCHAR)), id) - 1"


@query("stratified_folds", f"WITH {_SC} SELECT id, y, CAST({_TURN} AS INTEGER) % {FOLDS} AS fold FROM sc")
def stratified_folds(spark, sf_dir):
    return S.stratified(scores(spark, sf_dir).select("id", "y"), "y", "id", SEED).select("id", "y", (F.col("turn") % FOLDS).cast("int").alias("fold"))


@query("train_test_split", f"WITH {_SC}, t AS (SELECT id, y, {_TURN} AS turn, count(*) OVER (PARTITION BY y) AS n FROM sc) SELECT y, turn < floor(0.8 * n) AS train, count(*) AS n FROM t GROUP BY ALL")
def train_test_split(spark, sf_dir):
    t = S.stratified(scores(spark, sf_dir).select("id", "y"), "y", "id", SEED)
    return t.groupBy("y", (F.col("turn") < F.floor(0.8 * F.col("size"))).alias("train")).agg(F.count(F.lit(1)).alias("n"))


@query("examples_per_class", f"WITH {_SC}, t AS (SELECT id, label, pred, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM vo) SELECT label, id, pred FROM t WHERE k <= 4")
def examples_per_class(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return voted(spark, sf_dir).withColumn("k", k).where("k <= 4").select("label", "id", "pred")


@query("cumulative_variance", f"""WITH e AS (SELECT k, var_pop(CAST(embedding[k] AS DOUBLE)) AS v FROM embeddings, range(1, 65) r(k) GROUP BY k), r AS (SELECT k, v, sum(v) OVER (ORDER BY v DESC, k) / sum(v) OVER () AS c, row_number() OVER (ORDER BY v DESC, k) AS place FROM e)
SELECT CAST(place AS INTEGER) AS place, {_r('v', 'variance')}, {_r('c', 'cumulative')}, c - v / (SELECT sum(v) FROM e) < 0.95 AS kept FROM r""")
def cumulative_variance(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.posexplode("embedding").alias("k", "v")).groupBy("k").agg(F.var_pop(F.col("v").cast("double")).alias("v"))
    # One row per dimension, so one task is enough.
    order, whole = Window.orderBy(F.desc("v"), "k"), Window.partitionBy()
    c = F.sum("v").over(order) / F.sum("v").over(whole)
    return e.select(F.row_number().over(order).alias("place"), R(F.col("v")).alias("variance"), R(c).alias("cumulative"), (c - F.col("v") / F.sum("v").over(whole) < 0.95).alias("kept"))


@query("importance_names", """WITH g AS (SELECT 'f' || (label * 3) AS code, sum(abs(CAST(embedding[1] AS DOUBLE))) AS gain FROM embeddings GROUP BY 1), n AS (SELECT 'f' || k AS code, 'feature_' || k AS name FROM range(20) r(k))
SELECT coalesce(name, g.code) AS name, round(gain, 6) + 0.0 AS gain FROM g LEFT JOIN n ON g.code = n.code ORDER BY gain DESC LIMIT 20""")
def importance_names(spark, sf_dir):
    g = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.concat(F.lit("f"), F.col("label") * 3).alias("code")).agg(F.sum(F.abs(F.get("embedding", F.lit(0)).cast("double"))).alias("gain"))
    names = spark.range(20).select(F.concat(F.lit("f"), "id").alias("code"), F.concat(F.lit("feature_"), "id").alias("name"))
    return g.join(names, "code", "left").select(F.coalesce("name", "code").alias("name"), R(F.col("gain")).alias("gain")).orderBy(F.desc("gain")).limit(20)
