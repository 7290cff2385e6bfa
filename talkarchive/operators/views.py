"""Views and decisions on recordings, to-dos and uploads: filters, lookups and one shuffle by key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import records as R, text as T
from .jobs import ACTIVE, counted_page


def search_candidates(recordings: DataFrame, ids: DataFrame | None = None, tags: list[str] | None = None) -> DataFrame:
    """Recordings that search may look at: with content, not suppressed unless asked for by id, with all the tags."""
    rows = recordings.where(F.coalesce("transcript", "summary", "slides").isNotNull())
    if ids is None:
        rows = rows.where(~F.coalesce("suppressed", F.lit(False)))
    else:
        rows = rows.join(ids.select("video_id"), "video_id", "left_semi")
    return rows.where(R.has_all_tags(F.col("tags"), tags)) if tags else rows


def chunk_filter(chunks: DataFrame, video_ids=(), kind: str | None = None) -> DataFrame:
    """Chunks of some recordings and of one type; an empty list of ids is no filter."""
    rows = chunks.where(F.col("video_id").isin(sorted(set(video_ids)))) if video_ids else chunks
    return rows.where(F.col("type") == kind) if kind else rows


def in_time(items: DataFrame, start: float, end: float) -> DataFrame:
    return items.where(F.col("timestamp").between(start, end))


def dispatch_list(jobs: DataFrame, batch) -> DataFrame:
    """Queued jobs of a batch, oldest first."""
    return jobs.where((F.col("batch_id") == batch) & (F.col("status") == "queued")).orderBy("created_at", "job_id")


def duplicate_view(notes: DataFrame, recordings: DataFrame) -> DataFrame:
    """What may be shown of a duplicate note: the representative's title is the current one, else the one stored."""
    titles = recordings.select(F.col("video_id").alias("representative_id"), F.col("title").alias("_now"))
    rows = notes.join(titles, "representative_id", "left")
    return rows.select("video_id", "classification", F.col("score").try_cast("double").alias("score"), "suppressed", F.col("representative_id").alias("duplicate_of"), F.coalesce("_now", "representative_title").alias("duplicate_title"))


def action_items(items: DataFrame, recordings: DataFrame, completed: bool | None, needle: str, tags: list[str], order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of to-dos with their recordings' titles, and the number of all that match."""
    rows = items.join(recordings.select("video_id", F.coalesce("title", "filename").alias("title"), "tags"), "video_id").where(F.contains(F.lower("text"), F.lit(needle.lower())))
    if completed is not None:
        rows = rows.where(F.col("completed") == completed)
    if tags:
        rows = rows.where(R.has_any_tag(F.col("tags"), tags))
    return counted_page(rows, number, size, *order).drop("tags")


def promote_items(summaries: DataFrame, existing: DataFrame) -> DataFrame:
    """To-dos of summaries (video_id, action_items) that the recording does not have yet, each once."""
    norm = F.lower(T.fold("text")).alias("norm")
    rows = summaries.select("video_id", F.posexplode("action_items").alias("item_idx", "text")).withColumn("norm", norm).where("norm <> ''")
    first = Window.partitionBy("video_id", F.xxhash64("norm"), "norm").orderBy("item_idx")
    rows = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return rows.join(existing.select("video_id", norm), ["video_id", "norm"], "left_anti").withColumn("source", F.lit("summary")).drop("norm")


def reprocess(recordings: DataFrame, jobs: DataFrame) -> DataFrame:
    """What a request to process again does: recordings (video_id, has_file, forced)."""
    have = jobs.groupBy("video_id").agg(F.bool_or(F.col("status").isin(*ACTIVE)).alias("_active"), F.bool_or(F.col("status") == "completed").alias("_done"))
    decision = F.when(F.col("_active"), "running").when(F.col("_done") & ~F.col("forced"), "refused: completed").when(~F.col("has_file"), "refused: no file").otherwise("queued")
    return recordings.join(have, "video_id", "left").select("video_id", decision.alias("decision"))


def admit_uploads(files: DataFrame) -> DataFrame:
    """Files with the reason of refusal, and their batch's message if all of it is refused; names get an extension."""
    c = F.col
    rows = files.withColumn("reason", R.refusal(c("filename"), c("content_type"), c("size"), c("duration"), c("width"), c("height")))
    name = F.when(c("filename").contains("."), c("filename")).otherwise(F.concat("filename", F.lit(".mp4")))
    by = rows.groupBy("batch_id").agg(F.count_if(c("reason").isNull()).alias("_ok"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("_all"))
    return rows.withColumn("stored_name", F.when(c("reason").isNull(), name)).join(by, "batch_id").withColumn("batch_error", F.when(c("_ok") == 0, c("_all"))).drop("_ok", "_all")


_TOPICS = "array<struct<timestamp:string,topic:string,summary:string,speakers:array<string>>>"


def full_view(recordings: DataFrame, segments: DataFrame, slides: DataFrame) -> DataFrame:
    """What is shown and exported of a recording, one row each.

    recordings: video_id, title, filename, duration, speakers array<struct<name>>, summary struct or null; segments:
    video_id, seg_idx, start, end, speaker, text; slides: video_id, timestamp, path, ocr_text, description. The title falls
    back to the file name, a speaker's name to its place, missing parts of a summary to empty ones, paths to their last part.
    """
    none = F.array().cast("array<string>")
    said = F.struct("seg_idx", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("start", "end")], "speaker", F.coalesce("text", F.lit("")).alias("text"))
    lines = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(said)).alias("_t"))
    seen = F.struct("timestamp", F.element_at(F.split("path", "/"), -1).alias("image"), "ocr_text", "description")
    shown = slides.groupBy("video_id").agg(F.array_sort(F.collect_list(seen)).alias("_s"))
    rows = recordings.join(lines, "video_id", "left").join(shown, "video_id", "left")
    names = F.transform("speakers", lambda s, i: F.coalesce(s["name"], F.concat(F.lit("Speaker "), (i + 1).cast("string"))))
    part = lambda c, kind: F.coalesce(F.col(f"summary.{c}"), F.array().cast(kind)).alias(c)
    summary = F.struct(F.coalesce("summary.executive_summary", F.lit("")).alias("executive_summary"), *[part(c, "array<string>") for c in ("key_points", "action_items", "decisions")], part("topics", _TOPICS))
    transcript = F.transform("_t", lambda t: F.struct(*[t[c].alias(c) for c in ("start", "end", "speaker", "text")]))
    return rows.select(
        "video_id", F.coalesce("title", "filename").alias("title"), T.clock(F.col("duration")).alias("duration"), F.coalesce(names, none).alias("speakers"), F.when(F.col("summary").isNotNull(), summary).alias("summary"),
        F.coalesce(transcript, F.array().cast("array<struct<start:double,end:double,speaker:string,text:string>>")).alias("transcript"), F.coalesce("_s", F.array().cast("array<struct<timestamp:double,image:string,ocr_text:string,description:string>>")).alias("slides"),
    )


def export_json(view: DataFrame) -> DataFrame:
    """(video_id, json) of full_view's rows."""
    return view.select("video_id", F.to_json(F.struct(*[c for c in view.columns if c != "video_id"])).alias("json"))


def export_markdown(view: DataFrame) -> DataFrame:
    """(video_id, markdown) of full_view's rows: header, the sections of the summary that have content, the transcript."""
    some = lambda c, mark: F.transform(F.col(f"summary.{c}"), lambda x: F.concat(F.lit(mark), x))
    head = F.array(F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Video Summary"))), F.lit(""), F.concat(F.lit("**Duration:** "), "duration"), F.concat(F.lit("**Speakers:** "), F.when(F.size("speakers") > 0, F.array_join("speakers", ", ")).otherwise("N/A")), F.lit(""))
    titled = lambda name, lines, when: F.when(when, F.concat(F.array(F.lit(""), F.lit(f"## {name}"), F.lit("")), lines)).otherwise(F.array().cast("array<string>"))
    topics = F.flatten(F.transform("summary.topics", lambda t: F.array(F.concat(F.lit("### "), t["topic"], F.lit(" ("), F.coalesce(t["timestamp"], F.lit("")), F.lit(")")), F.lit(""), F.coalesce(t["summary"], F.lit("")), F.lit(""))))
    summary = F.concat(
        F.array(F.lit("## Executive Summary"), F.lit(""), F.col("summary.executive_summary"), F.lit(""), F.lit("## Key Points"), F.lit("")), some("key_points", "- "),
        titled("Action Items", some("action_items", "- [ ] "), F.size("summary.action_items") > 0), titled("Decisions", some("decisions", "- "), F.size("summary.decisions") > 0), titled("Topic Breakdown", topics, F.size("summary.topics") > 0),
    )
    said = F.transform("transcript", lambda t: F.concat(F.lit("**["), T.short_clock(t["start"]), F.lit("] "), F.coalesce(F.nullif(t["speaker"], F.lit("")), F.lit("Unknown")), F.lit(":** "), t["text"]))
    spoken = F.when(F.size("transcript") > 0, F.concat(F.array(F.lit("## Full Transcript"), F.lit("")), said, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(head, F.when(F.col("summary").isNotNull(), summary).otherwise(F.array().cast("array<string>")), spoken)
    return view.select("video_id", F.array_join(lines, "\n").alias("markdown"))


def chunk_sources(spoken: DataFrame, summaries: DataFrame, slides: DataFrame) -> DataFrame:
    """All pieces of recordings to index, in one table, each folded text once a recording: the first by kind and place.

    spoken: video_id, place, text; summaries: video_id, executive_summary, key_points and topics (topic, summary) if there
    are any; slides: video_id, place, title, content. Topics and slides are joined as `title: content`. Empty texts go.
    """
    line = lambda df, kind, n, place, text: df.select("video_id", F.lit(kind).alias("type"), F.lit(n).alias("_n"), place.cast("long").alias("place"), T.fold(text).alias("text"))
    points = summaries.select("video_id", F.posexplode("key_points").alias("place", "text"))
    both = lambda a, b: F.concat_ws(": ", F.nullif(T.fold(F.coalesce(a, F.lit(""))), F.lit("")), F.nullif(T.fold(F.coalesce(b, F.lit(""))), F.lit("")))
    rows = line(spoken, "transcript", 0, F.col("place"), F.col("text")).unionByName(line(summaries, "summary", 1, F.lit(0), F.col("executive_summary")))
    rows = rows.unionByName(line(points, "summary", 2, F.col("place"), F.col("text"))).unionByName(line(slides, "slide", 4, F.col("place"), both(F.col("title"), F.col("content"))))
    if "topics" in summaries.columns:
        topics = summaries.select("video_id", F.posexplode("topics").alias("place", "t"))
        rows = rows.unionByName(line(topics, "topic", 3, F.col("place"), both(F.col("t.topic"), F.col("t.summary"))))
    rows = rows.where("text <> ''")
    key = F.lower("text")
    first = Window.partitionBy("video_id", F.xxhash64(key), key).orderBy("_n", "place")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_n")
