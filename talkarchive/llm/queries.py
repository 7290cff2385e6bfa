"""Queries opN_<name>: each applies its operator to the whole intended table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import decontamination, filter_audit, language_id, lm_scoring, preference_format, quality_rules, simhash, source_divergence, source_mixing, substring_dedup, suffix_dedup, toxicity, url_filters
from .sql import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _table(spark, sf_dir, "labels").where("quality = 1")
    out = lm_scoring.cross_entropy_difference(_table(spark, sf_dir, "documents"), target)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = language_id.held_out(5, 0)
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted", "evidence")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_windows(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(3, 1)))
    return language_id.identify(docs, model).withColumn("held_out", language_id.held_out(3, 1)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference_format.format_preferences(preference_format.answers_swapped(_table(spark, sf_dir, "conversations")))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({c: written(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents")).drop("ratios")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(_table(spark, sf_dir, "documents"), source_mixing.label_quality(_table(spark, sf_dir, "labels")))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filters.fit(url_filters.labelled_urls(spark))
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"), url_filters.RULES, model).withColumn("score", F.round("score", 3))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_lm_scoring, op3_toxicity, op4_substring_dedup, op5_language_id, op6_preference_format, op7_quality_rules, op8_suffix_dedup, op9_simhash, op10_source_mixing, op11_url_filters, op12_filter_audit, op13_source_divergence, pipeline)}
ORACLE_SQL = {k: v for k, v in {**SQL, "pipeline": corpus_pipeline.ORACLE_SQL}.items() if v}
