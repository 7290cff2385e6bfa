"""Audio scores of fixtures: series, prompt choice, threshold grid, profiles, and what a recording sounds like."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: The grids of the threshold search and the words of television and speech labels.
AGGREGATIONS = ("mean", "max", "top2_mean")
ABSOLUTE = (0.03, 0.05, 0.07, 0.09, 0.12, 0.15, 0.2)
RATIOS = (0.05, 0.08, 0.1, 0.12, 0.16, 0.2)
TELEVISION = ("television", "tv", "broadcast", "radio", "news", "talk show")
SPEECH = ("speech", "conversation", "narration", "monologue", "lecture", "meeting", "presentation")
BASE_PROFILE = {"version": 1, "primary_prompts": {}, "supporting_prompts": {}, "supporting_rules": {}, "metrics": {}}


def series(scores: DataFrame, *keys: str, value: str = "score") -> DataFrame:
    """mean, max and the mean of the two greatest values of each key."""
    top = scores.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc())))
    return top.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.avg(F.when(F.col("_r") <= 2, F.col(value))).alias("top2_mean"))


def window_max(scores: DataFrame, prompts: DataFrame) -> DataFrame:
    """Series over windows of the greatest score of a key's chosen prompts; scores: label, key, prompt, window_idx, score."""
    best = scores.join(F.broadcast(prompts.select("key", "prompt")), ["key", "prompt"], "left_semi").groupBy("label", "key", "window_idx").agg(F.max("score").alias("score"))
    return series(best, "label", "key")


def separation(scores: DataFrame, aggregation: str) -> DataFrame:
    """mean over the fixtures expected to have a key minus 0.6 of the mean over the others; null if none has it.

    scores: label, key, prompt, score, expected.
    """
    each = series(scores, "label", "key", "prompt", "expected").withColumn("s", F.round(aggregation, 12))
    yes, no = F.avg(F.when(F.col("expected"), F.col("s"))), F.coalesce(F.avg(F.when(~F.col("expected"), F.col("s"))), F.lit(0.0))
    return each.groupBy("key", "prompt").agg(F.round(yes - 0.6 * no, 9).alias("metric"))


def primary_prompts(scores: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """(key, prompt, metric): the prompt of each key that separates best, by the mean.

    variants: key, prompt, place, is_default. Of equal ones the first variant wins; a key without examples has its default
    prompt and no metric. Without variants, places are the order of the prompts' spelling and the first is the default.
    """
    made = _with_variants(separation(scores, "mean"), variants)
    w = Window.partitionBy("key").orderBy(F.col("metric").desc_nulls_last(), F.when(F.col("metric").isNull(), ~F.col("is_default")), "place")
    return made.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("key", "prompt", "metric")


def _with_variants(made: DataFrame, variants: DataFrame | None) -> DataFrame:
    if variants is None:
        w = Window.partitionBy("key").orderBy("prompt")
        return made.withColumn("place", F.row_number().over(w)).withColumn("is_default", F.col("place") == 1)
    return variants.select("key", "prompt", "place", "is_default").join(made, ["key", "prompt"], "left")


def supporting_prompts(scores: DataFrame, n: int = 2, variants: DataFrame | None = None) -> DataFrame:
    """(key, prompt, metric): up to n prompts a key that separate by the mean of their two greatest scores; else the key's
    default prompt. Of equal ones the greater prompt comes first. variants as in primary_prompts."""
    made = _with_variants(separation(scores, "top2_mean"), variants)
    w = Window.partitionBy("key").orderBy(F.col("metric").desc_nulls_last(), F.col("prompt").desc())
    some = F.coalesce(F.bool_or(F.col("metric") > 0).over(Window.partitionBy("key")), F.lit(False))
    ranked = made.withColumn("_r", F.row_number().over(w)).withColumn("_some", some)
    return ranked.where(F.when(F.col("_some"), (F.col("metric") > 0) & (F.col("_r") <= n)).otherwise(F.col("is_default"))).select("key", "prompt", "metric")


def grid_metrics(support: DataFrame, primary: DataFrame) -> DataFrame:
    """Precision, recall and F0.5 of every key and grid row.

    support: label, key, mean, max, top2_mean, expected; primary: label, primary_score. Every row meets the 126 grid rows
    by expansion, and counts are summed before they are shuffled.
    """
    rows = [F.struct(F.lit(i).alias("place"), F.lit(a).alias("aggregation"), F.lit(x).alias("absolute"), F.lit(r).alias("ratio")) for i, (a, x, r) in enumerate((a, x, r) for a in AGGREGATIONS for x in ABSOLUTE for r in RATIOS)]
    long = support.join(primary, "label").withColumn("g", F.explode(F.array(*rows))).select("key", "g.*", "mean", "max", "top2_mean", "expected", "primary_score")
    score = F.when(F.col("aggregation") == "mean", F.col("mean")).when(F.col("aggregation") == "max", F.col("max")).otherwise(F.col("top2_mean"))
    said = score >= F.greatest("absolute", F.col("primary_score") * F.col("ratio"))
    counts = long.groupBy("key", "place", "aggregation", "absolute", "ratio").agg(F.count_if(said & F.col("expected")).alias("tp"), F.count_if(said & ~F.col("expected")).alias("fp"), F.count_if(~said & F.col("expected")).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    made = counts.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))
    f = F.try_divide(1.25 * F.col("precision") * F.col("recall"), 0.25 * F.col("precision") + F.col("recall"))
    return made.withColumn("metric", F.round(F.coalesce(f, F.lit(0.0)), 12))


def grid_winner(metrics: DataFrame) -> DataFrame:
    """The grid row of each key by a walk in grid order.

    A row replaces the best one if its metric is greater, or equal with twice its precision plus a tenth of its recall
    above the best's single precision plus a tenth of its recall; the two sides differ, so the order counts.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        best = None
        for row in pdf.sort_values("place").itertuples(index=False):
            if best is None or row.metric > best.metric or (row.metric == best.metric and 2 * row.precision + 0.1 * row.recall > best.precision + 0.1 * best.recall):
                best = row
        return pd.DataFrame([best])[["key", "aggregation", "absolute", "ratio"]]

    return metrics.groupBy("key").applyInPandas(walk, "key string, aggregation string, absolute double, ratio double")


def profile(primary: DataFrame, supporting: DataFrame, rules: DataFrame, base: dict | None = None, metrics: dict | None = None) -> dict:
    """The calibration profile; its size is that of the lists of keys, prompts and rules, whatever the number of scores."""
    base = {**BASE_PROFILE, **(base or {})}
    prompts: dict[str, list[str]] = {}
    for r in supporting.orderBy("key", F.col("metric").desc(), F.col("prompt").desc()).collect():
        prompts.setdefault(r.key, []).append(r.prompt)
    found = {r.key: {"aggregation": r.aggregation, "absolute_min_score": r.absolute, "relative_ratio": r.ratio} for r in rules.collect()}
    return {
        **base,
        "primary_prompts": {**base["primary_prompts"], **{r.key: r.prompt for r in primary.collect()}},
        "supporting_prompts": {**base["supporting_prompts"], **prompts},
        "supporting_rules": {**base["supporting_rules"], **found},
        "metrics": {**base["metrics"], **(metrics or {})},
    }


def classify_logits(logits: DataFrame, names: DataFrame, least: float = 0.2, top: int = 8) -> DataFrame:
    """(label, class_id, logit) by window: the mean's softmax, its top classes, and sums of television and speech classes."""
    mean = logits.groupBy("label", "class_id").agg(F.avg("logit").alias("m"))
    w = Window.partitionBy("label")
    p = mean.withColumn("e", F.exp(F.col("m") - F.max("m").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w)).join(F.broadcast(names), "class_id")
    p = p.withColumn("rank", F.row_number().over(w.orderBy(F.col("p").desc(), "class_id")))
    total = lambda words: F.round(F.sum(F.when(F.lower("name").rlike("|".join(words)), F.col("p")).otherwise(0.0)), 9)
    out = p.groupBy("label").agg(total(TELEVISION).alias("tv_score"), total(SPEECH).alias("speech_score"), F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "name")))).alias("_top"))
    tv, speech = F.col("tv_score"), F.col("speech_score")
    hint = F.when((tv >= least) & (tv > speech), "television").when((speech >= least) & (speech >= tv), "speech")
    return out.select("label", "tv_score", "speech_score", F.array_join(F.transform("_top", lambda x: x["name"]), ", ").alias("top_labels"), hint.alias("hint"))


def confidence(score: Column, margin: Column) -> Column:
    return F.when((score >= 0.55) | (margin >= 0.25), "high").when((score >= 0.32) | (margin >= 0.12), "medium").otherwise("low")


def primary_context(scores: DataFrame, least: float = 0.2) -> DataFrame:
    """What each recording (label, key, score) sounds like: its best key; none below `least`.

    A software demo and a meeting that are close, and not below the others, become one merged key, whose margin is taken
    against all keys, its own parts too.
    """
    of = lambda k: F.coalesce(F.max(F.when(F.col("key") == k, F.col("score"))), F.lit(0.0)).alias(k)
    keys = ("software_demo", "meeting_room_speech", "podcast_voiceover", "broadcast_playback")
    wide = scores.groupBy("label").agg(*[of(k) for k in keys], F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "key"))).alias("_all"))
    demo, meeting, podcast, broadcast = (F.col(k) for k in keys)
    merged = (demo >= least) & (meeting >= least) & (F.round(F.abs(demo - meeting), 9) <= 0.12) & (F.greatest(demo, meeting) >= F.greatest(podcast, broadcast))
    key = F.when(merged, "software_demo_direct_speech").otherwise(F.get("_all", F.lit(0))["key"])
    score = F.when(merged, F.greatest(demo, meeting)).otherwise(-F.get("_all", F.lit(0))["s"])
    rival = F.when(merged, -F.get("_all", F.lit(0))["s"]).otherwise(F.coalesce(-F.get("_all", F.lit(1))["s"], F.lit(0.0)))
    out = wide.select("label", key.alias("key"), score.alias("score"), F.round(score - rival, 9).alias("margin"))
    return out.withColumn("confidence", confidence(F.col("score"), F.col("margin"))).where(F.col("score") >= least)


def supporting_context(scores: DataFrame, primary: DataFrame, rules: DataFrame, least: float = 0.2, n: int = 2) -> DataFrame:
    """Up to n supporting keys of each recording that has a primary one, with scores above their rule's cut-off."""
    rows = scores.join(primary.select("label", F.col("score").alias("_p")), "label").join(F.broadcast(rules), "key", "left")
    cut = F.greatest(F.coalesce("absolute", F.lit(least)), F.col("_p") * F.coalesce("ratio", F.lit(0.35)))
    w = Window.partitionBy("label").orderBy(F.col("score").desc(), "key")
    return rows.where(F.col("score") >= cut).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("label", "key", "score", "rank")


#: Which primary keys are heard from a television, and which are speech.
BROADCAST_KEYS, SPEECH_KEYS = ("broadcast_playback",), ("meeting_room_speech", "podcast_voiceover", "software_demo")


def audio_context(scores: DataFrame, primary: DataFrame, supporting: DataFrame, names: DataFrame) -> DataFrame:
    """(label, hints, summary_context, tv_score, speech_score) of each recording that has primary scores (label, key, score).

    names(key, name, summary_name, hint): what keys are called; the primary context goes by its name, supporting ones by
    their summary names. The first two different hints stay, the primary one before the others.
    """
    part = lambda keys, c: F.sum(F.when(F.col("key").isin(*keys), F.col("score")).otherwise(0.0)).alias(c)
    sums = scores.groupBy("label").agg(part(BROADCAST_KEYS, "tv_score"), part(SPEECH_KEYS, "speech_score"))
    first = primary.join(names, "key", "left").select("label", F.concat(F.lit("Primary audio context: "), "name", F.lit(" ("), "confidence", F.lit(" confidence).")).alias("_first"), F.col("hint").alias("_hint"))
    more = supporting.join(names, "key", "left").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "summary_name", "hint"))).alias("_more"))
    out = sums.join(first, "label", "left").join(more, "label", "left")
    cues = F.concat(F.lit("Supporting audio cues: "), F.array_join(F.transform("_more", lambda m: m["summary_name"]), "; "), F.lit("."))
    none = F.array().cast("array<string>")
    hints = F.concat(F.array("_hint"), F.coalesce(F.transform("_more", lambda m: m["hint"]), none))
    hints = F.slice(F.array_distinct(F.filter(hints, lambda x: x.isNotNull())), 1, 2)
    return out.select("label", hints.alias("hints"), F.concat_ws(" ", "_first", cues).alias("summary_context"), F.round("tv_score", 9).alias("tv_score"), F.round("speech_score", 9).alias("speech_score"))


def manifest_fixtures(manifest: DataFrame, folder: str) -> DataFrame:
    """Fixtures of a manifest row (fixtures: array of structs): path under the folder, name, sorted supporting keys, flag.

    A manifest without fixtures, a fixture without a path, and a manifest none of whose fixtures is flagged for calibration
    raise ValueError.
    """
    rows = manifest.select(F.explode_outer("fixtures").alias("f"))
    some = lambda c: F.nullif(F.col(f"f.{c}"), F.lit(""))
    path = F.coalesce(some("media_path"), some("audio_path"), some("video_path"))
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    keys = F.array_sort(F.filter(F.transform(F.coalesce("f.expected_supporting_keys", F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: k != ""))
    flag = F.coalesce("f.use_for_calibration", F.lit(True))
    seen = rows.agg(F.count("f").alias("n"), F.count_if(F.col("f").isNotNull() & path.isNull()).alias("bare"), F.count_if(F.col("f").isNotNull() & flag).alias("flagged")).first()
    for wrong, why in ((seen.n == 0, "the manifest has no fixtures"), (seen.bare > 0, "a fixture has no media path"), (seen.flagged == 0, "no fixture is flagged for calibration")):
        if wrong:
            raise ValueError(why)
    return rows.where("f is not null").select(F.coalesce(some("label"), stem).alias("label"), full.alias("path"), F.trim(some("expected_primary_key")).alias("expected_primary_key"), keys.alias("expected_supporting_keys"), flag.alias("use_for_calibration"))
