"""Typed records from JSON columns and files; replace and delete by recording (snapshots.py writes such tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: The typed forms of the JSON columns of a recording.
TRANSCRIPT = "struct<segments: array<struct<start: double, end: double, text: string, speaker: string>>>"
SUMMARY = "struct<executive_summary: string, key_points: array<string>, action_items: array<string>, decisions: array<string>, topics: array<struct<timestamp: string, topic: string, summary: string, speakers: array<string>>>>"
SLIDES = "array<struct<timestamp: double, title: string, content: string, key_points: array<string>>>"
COLUMNS = {"transcript": TRANSCRIPT, "summary": SUMMARY, "slides": SLIDES}


def typed_recordings(rows: DataFrame) -> DataFrame:
    """Recordings with their JSON columns as typed nested ones; null and unreadable JSON is null."""
    typed = {c: F.from_json(F.col(c), kind) for c, kind in COLUMNS.items() if c in rows.columns}
    return rows.withColumns(typed)


def step_files(spark: SparkSession, pattern: str, schema: str, stream: bool = False) -> DataFrame:
    """One row a JSON file of a step, `.../<video_id>/<name>.json` (or `.../video_id=<video_id>/<name>`); an unreadable file
    gives nulls, not a failure. As a stream, each file is read once, when it appears; the checkpoint knows which were."""
    rows = (spark.readStream if stream else spark.read).schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(pattern)
    return rows.select(F.regexp_extract("_metadata.file_path", r"/(?:video_id=)?([^/]+)/[^/]+$", 1).alias("video_id"), *schema_names(schema))


def schema_names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


def replace_chunks(old: DataFrame, new: DataFrame, namespace: str) -> DataFrame:
    """The index after new chunks of some recordings replace the old ones of one model's namespace; others stay."""
    ids = new.select("video_id").distinct().withColumn("namespace", F.lit(namespace))
    return old.join(ids, ["namespace", "video_id"], "left_anti").unionByName(new.withColumn("namespace", F.lit(namespace)), allowMissingColumns=True)


def without_recordings(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of some recordings, in every namespace; rows of no recording stay."""
    ids = gone.select("video_id").distinct()
    return {name: df.join(ids, "video_id", "left_anti") for name, df in tables.items()}
