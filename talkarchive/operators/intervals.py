"""Joins of timed rows: speaker labels, point lookups, overlapping windows, neighbours.

Range joins have the recording and a time bucket as equi keys, so a long recording is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T

BUCKET = 60.0


def _buckets(start: str, end: str):
    return F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor(F.col(end) / BUCKET)))


def label_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Each segment with the speaker of the turn of largest overlap; ties to the first turn; no overlap: null."""
    s = segments.select("video_id", "seg_idx", "start", "end", _buckets("start", "end").alias("b"))
    t = turns.select("video_id", F.col("turn_idx"), F.col("start").alias("t0"), F.col("end").alias("t1"), "speaker", _buckets("start", "end").alias("b"))
    overlap = F.least("end", "t1") - F.greatest("start", "t0")
    best = s.join(t, ["video_id", "b"]).where(overlap > 0).groupBy("video_id", "seg_idx").agg(F.max_by("speaker", F.struct(overlap, -F.col("turn_idx"))).alias("speaker"))
    return segments.join(best, ["video_id", "seg_idx"], "left")


def talk_time(labelled: DataFrame) -> DataFrame:
    """Seconds a speaker and recording; speakers are named by their order."""
    total = labelled.where("speaker is not null").groupBy("video_id", "speaker").agg(F.round(F.sum(F.col("end") - F.col("start")), 2).alias("total_time"))
    return total.withColumn("name", F.concat(F.lit("Speaker "), F.row_number().over(Window.partitionBy("video_id").orderBy("speaker")).cast("string")))


def segment_at(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points (video_id, at, needle) with seg_idx: the first segment around the time, else the first that contains the
    needle; none: null. A segment without an end ends at its start; a null or empty needle is in no segment.

    Times meet in buckets; only points without a hit in time look at their recording's texts.
    """
    s = segments.select("video_id", "seg_idx", "start", F.coalesce("end", "start").alias("end"), "text")
    times = points.select("video_id", "at").distinct().withColumn("b", F.floor(F.col("at") / BUCKET))
    timed = times.join(s.drop("text").withColumn("b", _buckets("start", "end")), ["video_id", "b"]).where("start <= at and at <= end")
    near = timed.groupBy("video_id", "at").agg(F.min("seg_idx").alias("_near"))
    rows = points.join(near, ["video_id", "at"], "left")
    rest = rows.where("_near is null and needle <> ''").select("video_id", "needle").distinct()
    said = rest.join(s.select("video_id", "seg_idx", "text"), "video_id").where(F.contains("text", "needle")).groupBy("video_id", "needle").agg(F.min("seg_idx").alias("_said"))
    return rows.join(said, ["video_id", "needle"], "left").withColumn("seg_idx", F.coalesce("_near", "_said")).drop("_near", "_said")


def section(segments: DataFrame, start: float, end: float) -> DataFrame:
    """Segments that lie whole inside [start, end]."""
    return segments.where((F.col("start") >= start) & (F.col("end") <= end))


def split_windows(segments: DataFrame, length: float = 360.0, overlap: float = 36.0) -> DataFrame:
    """Segments once for each overlapping window that they touch; window k spans [k * step, k * step + length]."""
    step = length - overlap if length > overlap else length
    last = F.max("end").over(Window.partitionBy("video_id"))
    rows = segments.withColumn("_last", last)
    k = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("start") - length) / step)), F.floor(F.least("end", "_last") / step)))
    return rows.select("*", k.alias("window")).drop("_last")


def with_context(segments: DataFrame) -> DataFrame:
    """Each segment with the texts before and after it, joined by ` [...] `; empty where there are none.

    Of segments with equal start and text, all have the neighbours of the first.
    """
    w, same = Window.partitionBy("video_id").orderBy("seg_idx"), Window.partitionBy("video_id", "start", F.xxhash64("text"), "text").orderBy("seg_idx")
    around = F.concat_ws(" [...] ", F.lag(F.coalesce("text", F.lit(""))).over(w), F.lead(F.coalesce("text", F.lit(""))).over(w))
    return segments.withColumn("_around", around).withColumn("context", F.first("_around").over(same)).drop("_around")


def keep_until(lines: DataFrame, budget: int, keys: list[str], order: str, text: str) -> DataFrame:
    """The lines of each key, in order, up to the first that would exceed the budget of characters (one more a line)."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = F.coalesce(F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = lines.withColumn("_over", upto + F.length(text) > budget)
    first = F.min(F.when(F.col("_over"), F.col(order))).over(Window.partitionBy(*keys))
    return over.withColumn("_cut", first).where(F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))).drop("_over", "_cut")


#: Fixed value: the last line of a transcript that did not fit.
CUT_LINE = "... [transcript truncated for length]"


def transcript_text(segments: DataFrame, most: int = 50000) -> DataFrame:
    """(video_id, transcript): lines `[HH:MM:SS] speaker: text` up to the first that does not fit, then CUT_LINE."""
    line = F.concat(F.lit("["), T.clock(F.col("start")), F.lit("] "), F.coalesce("speaker", F.lit("Unknown")), F.lit(": "), T.stripped(F.coalesce("text", F.lit(""))))
    lines = segments.select("video_id", "seg_idx", line.alias("line"))
    kept = keep_until(lines, most, ["video_id"], "seg_idx", "line").groupBy("video_id").agg(F.count("*").alias("_kept"), F.array_sort(F.collect_list(F.struct("seg_idx", "line"))).alias("_l"))
    every = lines.groupBy("video_id").agg(F.count("*").alias("_all"))
    text = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    cut = F.when(F.col("_all") > F.coalesce("_kept", F.lit(0)), F.lit(CUT_LINE))
    return every.join(kept, "video_id", "left").select("video_id", F.concat_ws("\n", text, cut).alias("transcript"))


def slides_of(frames: DataFrame) -> DataFrame:
    """Frames (video_id, frame_id, timestamp, is_slide, low_relevance, slide_title, ocr_text) that are new slides.

    Frames of low relevance and others than slides are passed over; the title is the slide's, else the first 50
    characters that were read; a slide with the title of the slide before it is the same one.
    """
    rows = frames.where(F.coalesce("is_slide", F.lit(False)) & ~F.coalesce("low_relevance", F.lit(False)))
    title = F.coalesce(F.nullif("slide_title", F.lit("")), F.substring(F.coalesce("ocr_text", F.lit("")), 1, 50))
    rows = rows.withColumn("title", title).withColumn("content", F.coalesce("ocr_text", F.lit("")))
    w = Window.partitionBy("video_id").orderBy("timestamp", "frame_id")
    rows = rows.withColumn("_before", F.lag("title").over(w))
    return rows.where((F.col("title") == "") | F.col("_before").isNull() | (F.col("title") != F.col("_before"))).drop("_before")


def chat_history(turns: DataFrame, most: int = 8) -> DataFrame:
    """The last turns (conv_id, turn, role, text) of each conversation without reasoning marks and blanks, and how many
    from the end each is (back = 1 for the last one kept)."""
    last = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = turns.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= most)
    rows = rows.withColumn("text", T.stripped(T.without_reasoning(F.coalesce("text", F.lit(""))))).where("text <> ''")
    return rows.withColumn("back", F.row_number().over(last)).drop("_k")


def retrieval_queries(history: DataFrame, questions: DataFrame) -> DataFrame:
    """(conv_id, query): what the user said in the last 4 turns of chat_history, then the question, a line each."""
    said = history.where("back <= 4 and role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_s"))
    lines = F.concat(F.coalesce(F.transform("_s", lambda t: t["text"]), F.array().cast("array<string>")), F.array(T.stripped("question")))
    return questions.join(said, "conv_id", "left").select("conv_id", F.array_join(lines, "\n").alias("query"))


def chat_messages(history: DataFrame, questions: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<role, content>>): the last 6 turns of chat_history, then the question with its
    context (questions: conv_id, question, context)."""
    asked = F.struct(F.lit("user").alias("role"), F.concat(F.lit("Answer my next question using only the supplied context.\n\nContext:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "question").alias("content"))
    said = history.where("back <= 6").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("_s"))
    old = F.coalesce(F.transform("_s", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))), F.array().cast("array<struct<role:string,content:string>>"))
    return questions.join(said, "conv_id", "left").select("conv_id", F.concat(old, F.array(asked)).alias("messages"))
