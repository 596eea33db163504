"""Relational steps around the kernels: sources, predicates, nested results, registries; with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.stats import rounded as R
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("union_sources", """SELECT source, label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT text, 'documents' AS source, CAST(1 AS INTEGER) AS label FROM documents
UNION ALL SELECT text, 'benchmark', 0 FROM benchmark UNION ALL SELECT text, 'conversations', 0 FROM conversations) GROUP BY source, label""")
def union_sources(spark, sf_dir):
    parts = [(_t(spark, sf_dir, n).select("text"), n, k) for n, k in (("documents", 1), ("benchmark", 0), ("conversations", 0))]
    return T.union_sources(parts).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


_NAME = "(url || CASE page_id % 8 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' WHEN 3 THEN '.TiFF' WHEN 4 THEN '.webp' WHEN 5 THEN '.gif' WHEN 6 THEN '' ELSE '.jpeg.zip' END)"


@query("ext_filter", f"""SELECT lower(regexp_extract(name, '\\.[^./]+$')) AS suffix, count(*) AS n FROM (SELECT {_NAME} AS name FROM pages) WHERE lower(regexp_extract(name, '\\.[^./]+$')) IN ('.jpg', '.webp', '.jpeg', '.png', '.tif', '.tiff') GROUP BY 1""")
def ext_filter(spark, sf_dir):
    named = _t(spark, sf_dir, "pages").select(F.expr(_NAME.replace("||", "||")).alias("name"))
    return named.where(T.has_image_suffix(F.col("name"))).groupBy(F.lower(F.regexp_extract("name", r"\.[^./]+$", 0)).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


@query("run_dirs_desc", """SELECT name FROM (SELECT DISTINCT strftime(ts, '%Y%m%d_%H%M%S') || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'x' END AS name FROM events) WHERE regexp_full_match(name, '\\d{8}_\\d{6}') ORDER BY name DESC LIMIT 2""")
def run_dirs_desc(spark, sf_dir):
    name = F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.when(F.col("event_id") % 3 == 0, "").otherwise("x"))
    return T.latest_runs(_t(spark, sf_dir, "events").select(name.alias("name")).distinct())


_COERCE = """c AS (SELECT event_id, event_type, CASE event_id % 7 WHEN 0 THEN 'x' || value WHEN 1 THEN 'Infinity' WHEN 2 THEN 'NaN' WHEN 3 THEN NULL ELSE CAST(value AS VARCHAR) END AS raw FROM events),
d AS (SELECT *, try_cast(raw AS DOUBLE) AS v FROM c)"""


@query("coerce_and_clean", f"""WITH {_COERCE} SELECT event_type, count(*) AS n, count(v) FILTER (NOT isnan(v)) AS n_numeric, count(*) FILTER (v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)) AS n_finite,
round(sum(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0 ELSE v END), 4) + 0.0 AS zero_filled, round(sum(CASE WHEN v IS NULL THEN 0 WHEN isnan(v) THEN 0 ELSE least(greatest(v, 0), 1) END), 4) + 0.0 AS clipped FROM d GROUP BY event_type""")
def coerce_and_clean(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", F.expr("CASE event_id % 7 WHEN 0 THEN 'x' || value WHEN 1 THEN 'Infinity' WHEN 2 THEN 'NaN' WHEN 3 THEN NULL ELSE CAST(value AS STRING) END").alias("raw"))
    d = e.withColumn("v", F.expr("try_cast(raw AS DOUBLE)"))
    v = F.col("v")
    number = v.isNotNull() & ~F.isnan(v)
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(number).alias("n_numeric"), F.count_if(number & (F.abs(v) < float("inf"))).alias("n_finite"), R(F.sum(S.finite_or_zero(v)), 4).alias("zero_filled"), R(F.sum(F.when(v.isNull(), 0.0).otherwise(S.cleaned(v))), 4).alias("clipped"))


_NESTED = """n AS (SELECT event_id, [{'k': CAST(json_extract(props, '$.k') AS DOUBLE), 'v': NULL, 's': [CAST(event_id AS BIGINT), CAST(user_id AS BIGINT)]}, {'k': NULL, 'v': CAST(value AS DOUBLE), 's': NULL}] AS results FROM events),
u AS (SELECT event_id, unnest(results) AS r FROM n)"""


@query("flatten_results", f"""WITH {_NESTED} SELECT event_id, coalesce(r.k, 0.0) AS k, round(coalesce(r.v, 0.0), 6) + 0.0 AS v, coalesce(list_avg(r.s), 0.0) AS s FROM u""")
def flatten_results(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    null = lambda t: F.lit(None).cast(t)
    one = F.struct(k.alias("k"), null("double").alias("v"), F.array(F.col("event_id").cast("long"), F.col("user_id").cast("long")).alias("s"))
    two = F.struct(null("double").alias("k"), F.col("value").cast("double").alias("v"), null("array<bigint>").alias("s"))
    return T.flatten(e.select("event_id", F.array(one, two).alias("results")), ["event_id"]).select("event_id", "k", R(F.col("v")).alias("v"), "s")


@query("key_lookup", f"""WITH {_NESTED} SELECT round(avg(r.k), 6) + 0.0 AS mean_k, count(r.v) AS n_v, round(avg(list_avg(r.s)), 4) + 0.0 AS mean_s, count(*) AS n FROM u""")
def key_lookup(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    maps = F.array(F.create_map(F.lit("k"), F.array(F.get_json_object("props", "$.k").cast("double")), F.lit("s"), F.array(F.col("event_id").cast("double"), F.col("user_id").cast("double"))), F.create_map(F.lit("v"), F.array(F.col("value").cast("double"))))
    r = e.select(F.explode_outer(maps).alias("r"))
    mean = lambda key: F.aggregate(F.col("r")[key], F.lit(0.0), lambda a, v: a + v) / F.size(F.col("r")[key])
    return r.agg(R(F.avg(mean("k"))).alias("mean_k"), F.count(mean("v")).alias("n_v"), R(F.avg(mean("s")), 4).alias("mean_s"), F.count(F.lit(1)).alias("n"))


@query("module_pairs", """WITH m AS (SELECT * FROM (VALUES (0, 'artwork', 49), (1, 'learned', 768), (2, 'residual', 11), (3, 'wavelet', 26), (4, 'vae', 2), (5, 'vit', 2)) t(ord, name, n))
SELECT name AS modules, CAST(n AS INTEGER) AS n_features, 1 AS size FROM m UNION ALL SELECT a.name || '+' || b.name, CAST(a.n + b.n AS INTEGER), 2 FROM m a JOIN m b ON a.ord < b.ord""")
def module_pairs(spark, sf_dir):
    from ..operators.registry import FEATURE_COUNTS, combinations

    return combinations(spark, FEATURE_COUNTS)


@query("config_keys", """WITH c AS (SELECT source AS model, concat_ws('|', lang, CAST(n_chars % 3 AS VARCHAR), CAST(doc_id % 2 AS VARCHAR)) AS key FROM documents) SELECT key, count(*) AS n_rows, count(DISTINCT model) AS n_models, min(model) AS owner FROM c GROUP BY key""")
def config_keys(spark, sf_dir):
    c = _t(spark, sf_dir, "documents").select(F.col("source").alias("model"), F.concat_ws("|", "lang", (F.col("n_chars") % 3).cast("string"), (F.col("doc_id") % 2).cast("string")).alias("key"))
    return c.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("model").alias("n_models"), F.min("model").alias("owner"))


@query("labelled_join", """SELECT lang, quality, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality""")
def labelled_join(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("document_bytes", """WITH b AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), h AS (SELECT doc_id, unicode(c) % 256 AS v, count(*) AS n FROM b WHERE c <> '' GROUP BY ALL),
t AS (SELECT *, n + 1e-10 AS k, sum(n) OVER (PARTITION BY doc_id) + 256e-10 AS s FROM h)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, round(-sum(k / s * log2(k / s)) - (256 - count(*)) * (1e-10 / any_value(s)) * log2(1e-10 / any_value(s)), 6) + 0.0 AS entropy, round(sum(n * v) / sum(n), 6) + 0.0 AS mean FROM t GROUP BY doc_id""")
def document_bytes(spark, sf_dir):
    """Whole texts as one-row planes of code points modulo 256: size, entropy and mean."""
    c = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    h = c.groupBy("doc_id", (F.ascii("c") % 256).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    e = S.entropy(h, ["doc_id"], "n", 256)
    m = h.groupBy("doc_id").agg(F.sum("n").alias("n"), R(F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"))
    return m.join(e, "doc_id").select("doc_id", "n", R(F.col("entropy")).alias("entropy"), "mean")


@query("event_moments", """WITH q AS (SELECT event_type, CAST(value AS DOUBLE) AS v, avg(CAST(value AS DOUBLE)) OVER (PARTITION BY event_type) AS m FROM events)
SELECT event_type, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(avg((v - m) * (v - m) * (v - m)) / pow(var_pop(v), 1.5), 6) + 0.0 AS skew, round(kurtosis_pop(v), 6) + 0.0 AS kurt,
round(quantile_cont(v, 0.95), 6) + 0.0 AS p95, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) + 0.0 AS iqr, round(stddev_pop(v) / (abs(avg(v)) + 1e-10), 6) + 0.0 AS cv FROM q GROUP BY event_type""")
def event_moments(spark, sf_dir):
    q = _t(spark, sf_dir, "events").select("event_type", F.col("value").cast("double").alias("v"))
    m = S.moments("v")
    rest = q.groupBy("event_type").agg(R(m["mean"]).alias("mean"), R(m["std"]).alias("std"), R(m["skew"]).alias("skew"), R(m["kurt"]).alias("kurt"), R(m["std"] / (F.abs(m["mean"]) + 1e-10)).alias("cv"))
    p = S.percentiles(q, ["event_type"], "v", {"a": 0.25, "b": 0.75, "p95": 0.95})
    return rest.join(p.select("event_type", R(F.col("p95")).alias("p95"), R(F.col("b") - F.col("a")).alias("iqr")), "event_type")


@query("price_tiles", """WITH t AS (SELECT l_orderkey % 1000 AS ty, l_linenumber AS tx, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem) SELECT CAST(ty AS BIGINT) AS ty, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(var_pop(v) / 1e6, 6) + 0.0 AS var, round(max(v), 4) + 0.0 AS top FROM t GROUP BY ty""")
def price_tiles(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).cast("long").alias("ty"), F.col("l_extendedprice").cast("double").alias("v"))
    return t.groupBy("ty").agg(F.count(F.lit(1)).alias("n"), R(F.avg("v")).alias("mean"), R(F.var_pop("v") / 1e6).alias("var"), R(F.max("v"), 4).alias("top"))


@query("path_ends", """WITH e AS (SELECT user_id, event_id, CAST(value AS DOUBLE) AS v FROM events), p AS (SELECT user_id, arg_min(v, event_id) AS a, arg_max(v, event_id) AS b, count(*) AS n FROM e GROUP BY user_id),
i AS (SELECT e.user_id, e.v, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) - 1 AS k, a, b, n FROM e JOIN p USING (user_id) WHERE n >= 3)
SELECT user_id, round(avg(abs(v - (a + k / (n - 1) * (b - a)))), 6) + 0.0 AS off_chord, round(min(v) / ((any_value(a) + any_value(b)) / 2), 6) + 0.0 AS dip FROM i GROUP BY user_id""")
def path_ends(spark, sf_dir):
    """Each user's values as a path: mean distance to the straight line between its ends, and its dip."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").cast("double").alias("v"))
    p = e.groupBy("user_id").agg(F.min_by("v", "event_id").alias("a"), F.max_by("v", "event_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    i = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).join(p, "user_id")
    off = F.abs(F.col("v") - (F.col("a") + F.col("k") / (F.col("n") - 1) * (F.col("b") - F.col("a"))))
    return i.groupBy("user_id").agg(R(F.avg(off)).alias("off_chord"), R(F.min("v") / ((F.first("a") + F.first("b")) / 2)).alias("dip"))


@query("turning_angles", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 60000000.0 AS x, CAST(value AS DOUBLE) AS v FROM events), d AS (SELECT user_id, event_id, atan2(v - lag(v) OVER w, x - lag(x) OVER w) AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT user_id, abs(a - lag(a) OVER (PARTITION BY user_id ORDER BY event_id)) AS t FROM d) SELECT user_id, count(t) AS n, round(avg(least(t, 2 * pi() - t)), 6) + 0.0 AS curvature FROM t GROUP BY user_id""")
def turning_angles(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 60000000.0).alias("x"), F.col("value").cast("double").alias("v"))
    d = e.select("user_id", "event_id", F.atan2(F.col("v") - F.lag("v").over(w), F.col("x") - F.lag("x").over(w)).alias("a"))
    t = d.select("user_id", F.abs(F.col("a") - F.lag("a").over(w)).alias("t"))
    return t.groupBy("user_id").agg(F.count("t").alias("n"), R(F.avg(F.least(F.col("t"), 2 * F.pi() - F.col("t")))).alias("curvature"))


@query("metrics_as_text", """SELECT CAST(count(*) AS VARCHAR) AS n, CAST(min(event_type) AS VARCHAR) AS first_type, CAST(count(DISTINCT user_id) AS VARCHAR) AS users FROM events""")
def metrics_as_text(spark, sf_dir):
    return T.as_strings(_t(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.min("event_type").alias("first_type"), F.countDistinct("user_id").alias("users")))


@query("merge_features", """SELECT doc_id, map(['n', 'lang'], [CAST(n_chars AS VARCHAR), coalesce(CAST(quality AS VARCHAR), lang)])['lang'] AS lang, CAST(n_chars AS VARCHAR) AS n FROM documents LEFT JOIN labels USING (doc_id)""")
def merge_features(spark, sf_dir):
    """Two feature maps per document; the right one wins."""
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    left = F.create_map(F.lit("n"), F.col("n_chars").cast("string"), F.lit("lang"), F.col("lang"))
    right = F.when(F.col("quality").isNotNull(), F.create_map(F.lit("lang"), F.col("quality").cast("string")))
    merged = F.map_zip_with(left, F.coalesce(right, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))
    return d.select("doc_id", merged.alias("m")).select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["n"].alias("n"))
