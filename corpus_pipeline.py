"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, mixing; each stage over all it gets.

Every stage but the last returns the columns of documents. Its result is written as Parquet and read again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkarchive.llm import decontamination, language_id, near_copies, source_mixing, substring_dedup
from talkarchive.llm._chunks import remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(df: DataFrame) -> DataFrame:
    """df(doc_id, text, rest) as documents, with n_chars of the text it has now."""
    return df.select("doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("long").alias("n_chars"))


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct("lang", "source").alias("rest"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (`und`: null or letterless texts); the others get the language found."""
    model = language_id.fit(docs.where(~language_id.held_out(3, 1)))
    out = language_id.identify(_packed(docs), model, carry="rest").where("lang_pred <> 'und'")
    return out.select("doc_id", "text", F.col("lang_pred").alias("lang"), "rest.source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, Jaccard 0.8 or more), the one of least id.

    SimHash with vantage-point trees finds the candidates within its radius, min-hashes those beyond it, and an exact
    comparison decides. Rows are judged by their texts: of different texts under one id, or without ids, all stay.
    """
    return near_copies.first_of_copies(docs.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier in the corpus; the words kept are joined by one space.

    A document that loses nothing keeps its text as it is; one that loses all stays, with an empty text.
    """
    out = substring_dedup.remove_repeated_windows(_packed(docs), carry="rest")
    return _as_documents(out.select("doc_id", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "rest"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that hold benchmark windows."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _as_documents(decontamination.find_contamination(_packed(docs), bench, cut=True, carry="rest"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, by source targets and label quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return source_mixing.mix_sources(docs, source_mixing.label_quality(labels))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources", mix),
]

#: Language ID and near-dedup have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages hand on lies in the folder of spark.checkpoint.dir, until the next is written;
    the last one's input stays, since its rows are read when they are asked for."""
    folder, path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, path = path, f"{folder}/{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
    return docs
