"""The queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_names, language, main_text, mixing, packing, repetition, simhash, site_quality, toxicity, warc
from . import common as C


def op7_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = block_names.dedup(C.read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.scratch_path(spark, "warc")
    warc.write_archives(C.read(spark, sf_dir, "pages"), path)
    C.drop_at_end(spark, path)
    return warc.read_archives(spark, path)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(C.read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(C.read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: op3's target weights; a source weighs as much as any other of its language.
MIX = {"domain": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 0.8, 2.0, 7


def mix_domain() -> Column:
    """The domain of a source: two halves of its md5."""
    return F.when(F.md5(F.coalesce(F.col("source"), F.lit("")).cast("binary")) < "8", "a").otherwise("b")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    out = mixing.select(docs, MIX, mix_domain(), F.col("lang"), F.col("source"), budget=MIX_BUDGET, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return out.select(F.col("id").alias("doc_id"), "domain", "lang", "source", "epoch", F.col("start").alias("token_start"), "tokens")


def _share_sql(depth: int) -> str:
    keys, above = mixing.LEVELS[:depth], mixing.LEVELS[: depth - 1]
    cols, by = ", ".join(keys), f"PARTITION BY {', '.join(above)}" if above else ""
    weights = MIX.get(keys[-1], {})
    weight = "CASE " + " ".join(f"WHEN {keys[-1]} = '{k}' THEN CAST({v} AS DOUBLE)" for k, v in weights.items()) + " ELSE 1.0 END" if weights else "CAST(1.0 AS DOUBLE)"
    budget = f"(SELECT CAST({MIX_BUDGET} AS DOUBLE) * CAST(sum(supply) AS DOUBLE) FROM leaves)" if not above else f"(SELECT budget FROM b{depth - 1} p WHERE {' AND '.join(f'p.{k} = c.{k}' for k in above)})"
    return f"""c{depth} AS (SELECT {cols}, sum(supply) AS supply, sum(cap) AS cap, {weight} AS weight FROM leaves GROUP BY {cols}),
w{depth} AS (SELECT *, {budget} AS total FROM c{depth} c),
l{depth} AS (SELECT *, (total - coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER ({by} ORDER BY cap / weight, {cols} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER ({by} ORDER BY cap / weight, {cols}) AS place FROM w{depth}),
o{depth} AS (SELECT *, min(CASE WHEN cap > weight * level THEN place END) OVER ({by}) AS first_open FROM l{depth}),
b{depth} AS (SELECT *, CASE WHEN first_open IS NULL OR place < first_open THEN cap
  ELSE least(cap, weight * max(CASE WHEN place = first_open THEN level END) OVER ({by})) END AS budget FROM o{depth})"""


OP3_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, CASE WHEN md5(coalesce(source, '')) < '8' THEN 'a' ELSE 'b' END AS domain,
         coalesce(lang, '<null>') AS lang, coalesce(source, '<null>') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS tokens
  FROM documents
),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply, CAST(sum(tokens) * {MIX_EPOCHS} AS DOUBLE) AS cap FROM sizes GROUP BY ALL),
{_share_sql(1)},
{_share_sql(2)},
{_share_sql(3)},
epochs AS (
  SELECT domain, lang, source, supply, CAST(e.e AS INTEGER) AS epoch, budget - e.e * supply AS room
  FROM b3, unnest(range(0, greatest(1, CAST(ceil(budget / supply) AS BIGINT)))) AS e(e) WHERE budget > 0
),
placed AS (
  SELECT s.doc_id, s.domain, s.lang, s.source, epoch, tokens, room,
         CAST(coalesce(sum(tokens) OVER (PARTITION BY s.domain, s.lang, s.source, epoch ORDER BY md5('{MIX_SEED}|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_start
  FROM sizes s JOIN epochs x ON s.domain = x.domain AND s.lang = x.lang AND s.source = x.source WHERE room > 0
)
SELECT doc_id, domain, lang, source, epoch, token_start, CAST(tokens AS BIGINT) AS tokens FROM placed WHERE token_start < room
"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    model = language.train(docs.where(C.crc_mod(F.col("doc_id"), 4) != 2))
    out = language.predict(docs, model)
    return out.select(F.col("id").alias("doc_id"), (C.crc_mod(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score", "spans")


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.rules(C.read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered", "longest")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(C.crc_mod(F.col("doc_id"), 5) != 0))
    out = toxicity.score(docs, model)
    return out.select(F.col("id").alias("doc_id"), (C.crc_mod(F.col("id"), 5) == 0).alias("held_out"), "score", "predicted", "offending")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.read(spark, sf_dir, "pages")
    return main_text.main_texts(pages, main_text.learn(pages))


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources, paths are languages within a source; rows whose crc32(doc_id) mod 5 is 0 don't train."""
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    weights = site_quality.train(docs, labels.where(C.crc_mod(F.col("doc_id"), 5) != 0))
    out = site_quality.classify(docs, weights, F.col("source"), F.col("lang"))
    return out.select(F.col("id").alias("doc_id"), (C.crc_mod(F.col("id"), 5) == 0).alias("held_out"), "evidence", "path_mean", "posterior", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_language": op4_language,
    "op5_repetition": op5_repetition,
    "op6_best_fit": op6_best_fit,
    "op7_block_names": op7_block_names,
    "op8_toxicity": op8_toxicity,
    "op9_main_text": op9_main_text,
    "op10_site_quality": op10_site_quality,
}
SQL: dict[str, str] = {"op3_mixing": OP3_SQL, "op7_block_names": OP7_SQL}
