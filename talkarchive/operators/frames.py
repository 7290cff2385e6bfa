"""Frames of recordings: relevance to speech, prompt lines, hints of a playing television, hashes and keyframes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.plans import frame_times
from .intervals import BUCKET

#: Words of chat and calendar windows, and of television in frames.
NOISE_WORDS = "slack teams discord dm lunch coffee calendar chat inbox".split()
TELEVISION = r"\b(tv|television|smart tv|roku|fire tv|apple tv|cable tv|broadcast|news channel|netflix|hulu|prime video)\b"
WIDTH, HEIGHT = 9, 8


def relevance(frames: DataFrame, segments: DataFrame, reach: float = 45.0, least: float = 0.05) -> DataFrame:
    """frames(video_id, frame_id, timestamp, ocr_text): the share of their words said within `reach` seconds.

    Words meet in an equi join on recording, time bucket and word, so no frame meets a whole recording. Frames without
    words and words said nowhere near score 0; frames of low score with a noise word are of low relevance. Frames of a
    recording without segments are left as they are: no score, and not of low relevance.
    """
    words = T.plain_tokens(F.coalesce("ocr_text", F.lit("")))
    f = frames.withColumn("_words", words).withColumn("_from", F.greatest(F.lit(0.0), F.col("timestamp") - reach)).withColumn("_to", F.col("timestamp") + reach)
    asked = f.select("video_id", "frame_id", "_from", "_to", F.explode("_words").alias("w")).withColumn("b", F.explode(F.sequence(F.floor(F.col("_from") / BUCKET), F.floor(F.col("_to") / BUCKET))))
    said = segments.select("video_id", "start", "end", F.explode(T.plain_tokens("text")).alias("w"))
    said = said.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET))))
    hit = asked.join(said, ["video_id", "b", "w"]).where((F.col("end") >= F.col("_from")) & (F.col("start") <= F.col("_to")))
    found = hit.select("video_id", "frame_id", "w").distinct().groupBy("video_id", "frame_id").agg(F.count("*").alias("_n"))
    score = F.when(F.size("_words") > 0, F.coalesce("_n", F.lit(0)) / F.size("_words")).otherwise(0.0)
    noisy = F.arrays_overlap("_words", F.array(*[F.lit(w) for w in NOISE_WORDS]))
    heard = segments.select("video_id").distinct().withColumn("_heard", F.lit(True))
    out = f.join(found, ["video_id", "frame_id"], "left").join(heard, "video_id", "left")
    out = out.withColumn("relevance_score", F.when(F.col("_heard"), F.round(score, 4)))
    return out.withColumn("low_relevance", F.coalesce("_heard", F.lit(False)) & (score < least) & noisy).drop("_words", "_from", "_to", "_n", "_heard")


def prompt_lines(frames: DataFrame, budget: int = 8000, most: int = 60) -> DataFrame:
    """The first lines of each recording's frames with text that fit the budget; the first that does not ends it."""
    parts = [F.concat(F.lit("["), T.clock(F.col("timestamp")), F.lit("] is_slide="), F.initcap(F.col("is_slide").cast("string")))]
    for name, c in (("title", "slide_title"), ("ocr", "ocr_text"), ("description", "description")):
        parts.append(F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), F.trim(c))))
    rows = frames.where((F.trim(F.coalesce("description", F.lit(""))) != "") | (F.trim(F.coalesce("ocr_text", F.lit(""))) != ""))
    rows = rows.select("video_id", "frame_id", "timestamp", T.fold(F.concat_ws("; ", *parts)).alias("line"))
    w = Window.partitionBy("video_id").orderBy("timestamp", "frame_id")
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("_sum", F.sum(F.length("line") + 1).over(w))
    return rows.where((F.col("place") <= most) & (F.col("_sum") <= budget)).drop("_sum")


def television_hint(frames: DataFrame, least: int = 3, share: float = 0.35) -> DataFrame:
    """A sentence for recordings whose frames (video_id, frame_id, timestamp, text, is_slide) often show a television."""
    seen = frames.where(~F.col("is_slide") & (F.col("text") != "")).withColumn("hit", F.lower("text").rlike(TELEVISION))
    first = Window.partitionBy("video_id", "hit").orderBy("frame_id")
    seen = seen.withColumn("_r", F.row_number().over(first))
    times = F.array_sort(F.collect_list(F.when(F.col("hit") & (F.col("_r") <= 3), F.struct("_r", T.clock(F.col("timestamp")).alias("t")))))
    by = seen.groupBy("video_id").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"), times.alias("times"))
    # Fixed value: the sentence that the prompt takes.
    hint = F.format_string(
        "Visuals show a TV/television playing content in %d/%d sampled non-slide frames (~%d%%). Audio is likely dominated by the TV during those segments. Example timestamps: %s.",
        "hits", "total", F.bround(F.col("hits") * 100 / F.col("total"), 0).cast("int"), F.array_join(F.transform("times", lambda x: x["t"]), ", "),
    )
    return by.where((F.col("hits") >= least) & (F.col("hits") / F.col("total") >= share)).select("video_id", "hits", "total", hint.alias("hint"))


def difference_hash(signature: Column) -> Column:
    """64 bits as text: is each of 9 x 8 grey values, row by row, brighter than the one to its left?"""
    at = [F.get(signature, F.lit(r * WIDTH + k)) > F.get(signature, F.lit(r * WIDTH + k - 1)) for r in range(HEIGHT) for k in range(1, WIDTH)]
    return F.concat(*[F.when(b, "1").otherwise("0") for b in at])


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hashes; 999 if one is missing."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.coalesce(F.size(F.filter(pairs, lambda p: p)), F.lit(999))


def mean_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def keyframes(frames: DataFrame, change: float = 12.0, stable: float = 6.0, apart: int = 4, most: int = 0) -> DataFrame:
    """(video_id, timestamp, signature): the first frame, and frames after which the picture changed and stayed.

    A frame that differs from the last kept picture opens a candidate; a next frame close to it keeps it, if its hash is
    new enough; otherwise the candidate is dropped or moves on. Frames without a signature are passed over.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp", kind="stable")
        pictures = np.stack(pdf.signature.to_numpy()).astype(np.float64)
        grey = pictures.reshape(-1, HEIGHT, WIDTH)
        bright = (grey[:, :, 1:] > grey[:, :, :-1]).reshape(len(pictures), -1)
        close = np.abs(np.diff(pictures, axis=0)).mean(1) <= stable  # of neighbouring pictures
        kept, seen, at = [0], 0, 1
        away = np.abs(pictures - pictures[0]).mean(1) >= change  # from the last kept picture
        while len(kept) != most:
            found = np.flatnonzero(away[at:-1])
            if not len(found):
                break
            i = at + int(found[0])  # a candidate, judged by the picture after it
            at = i + 2 if close[i] else i + 1
            if close[i] and (bright[i + 1] != bright[seen]).sum() >= apart:
                kept.append(i)
                seen, away = i + 1, np.abs(pictures - pictures[i]).mean(1) >= change
        out = pd.DataFrame({"video_id": pdf.video_id.iloc[0], "scene_idx": range(len(kept)), "timestamp": pdf.timestamp.to_numpy()[kept]})
        return out.assign(reason=["initial"] + ["change"] * (len(kept) - 1))

    rows = frames.where("video_id is not null and signature is not null").select("video_id", "timestamp", "signature")
    return rows.groupBy("video_id").applyInPandas(fold, "video_id long, scene_idx long, timestamp double, reason string")


def keyframes_or_intervals(frames: DataFrame, durations: DataFrame, interval: float = 5.0, most: int = 0, **rules) -> DataFrame:
    """keyframes, but evenly spaced frames for recordings (video_id, duration) with no keyframe, or with one only and longer
    than the interval: at most `most` of them, or as many as intervals begin in the duration."""
    found = keyframes(frames, most=most, **rules)
    n = found.groupBy("video_id").agg(F.count("*").alias("_n"))
    count = F.coalesce("_n", F.lit(0))
    poor = durations.join(n, "video_id", "left").where((count == 0) | ((count <= 1) & (F.col("duration") > interval))).select("video_id", "duration")
    even = poor.select("video_id", F.posexplode(frame_times(F.col("duration").cast("double"), interval, most or 2**31 - 1)).alias("scene_idx", "timestamp"))
    out = found.join(poor, "video_id", "left_anti")
    return out.unionByName(even.select("video_id", F.col("scene_idx").cast("long").alias("scene_idx"), "timestamp", F.lit("interval").alias("reason")))
