"""Reports on jobs, batches, labels and to-dos: one shuffle by key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Weights of the eight processing steps.
STEP_WEIGHTS = (5, 30, 15, 5, 10, 15, 15, 5)
ACTIVE = ("pending", "queued", "processing")


def display_job(jobs: DataFrame) -> DataFrame:
    """The job that stands for a recording: an active one first, then a completed one, then any; the newest of those."""
    rank = F.when(F.col("status").isin(*ACTIVE), 0).when(F.col("status") == "completed", 1).otherwise(2)
    w = Window.partitionBy("video_id").orderBy(rank, F.col("created_at").desc(), F.col("job_id").desc())
    return jobs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def display_status(recordings: DataFrame, jobs: DataFrame) -> DataFrame:
    """recordings (video_id, has_file) with job_id and status: that of display_job; no job: uploaded; no file: failed if
    there is a job, else missing."""
    rows = recordings.join(display_job(jobs).select("video_id", "job_id", F.col("status").alias("_s")), "video_id", "left")
    status = F.when(~F.col("has_file"), F.when(F.col("job_id").isNotNull(), "failed").otherwise("missing")).otherwise(F.coalesce("_s", F.lit("uploaded")))
    return rows.withColumn("status", status).drop("_s")


def completed(videos: DataFrame, jobs: DataFrame) -> DataFrame:
    """Recordings with a completed job."""
    return videos.join(jobs.where("status = 'completed'").select("video_id"), "video_id", "left_semi")


def never_enqueued(jobs: DataFrame) -> DataFrame:
    """Queued jobs that no task was made for."""
    return jobs.where("status = 'queued' and task_id is null")


def cancelled(jobs: DataFrame, job_id=None, batch_id=None) -> DataFrame:
    """The active jobs of one job id or of one batch, as cancelled; jobs that are over are refused: they don't come."""
    mine = F.col("job_id") == job_id if job_id is not None else F.col("batch_id") == batch_id
    return jobs.where(mine & F.col("status").isin(*ACTIVE)).withColumn("status", F.lit("cancelled"))


def cancelled_batch(batches: DataFrame, jobs: DataFrame, batch_id) -> DataFrame:
    """The batch as cancelled, with the number of its jobs that were; a batch that is not known gives no row."""
    mine = batches.where(F.col("batch_id") == batch_id).withColumn("status", F.lit("cancelled"))
    n = cancelled(jobs, batch_id=batch_id).groupBy("batch_id").agg(F.count("*").alias("cancelled_jobs"))
    return mine.join(n, "batch_id", "left").withColumn("cancelled_jobs", F.coalesce("cancelled_jobs", F.lit(0)))


def step_durations(events: DataFrame) -> DataFrame:
    """Seconds between the first and the last event (job_id, step, ts) of each step."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.groupBy("job_id", "step").agg(((F.max(micros) - F.min(micros)) / 1000000).alias("seconds"))


def within(events: DataFrame, days: int = 90, now: Column | None = None) -> DataFrame:
    """Events (ts) of the last days, before now or before the newest event."""
    if now is not None:
        return events.where(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))
    newest = events.agg(F.max("ts").alias("_newest"))  # one row
    return events.join(F.broadcast(newest), F.col("ts") >= F.col("_newest") - F.expr(f"INTERVAL {days} DAYS")).drop("_newest")


def counted_page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page and, in each of its rows, the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return page(rows, number, size, *order).join(F.broadcast(total), F.lit(True))


def recording_list(recordings: DataFrame, needle: str | None, number: int = 1, size: int = 20) -> DataFrame:
    """A page of recordings (video_id, original_filename, title, created_at) whose file name or title has the needle,
    whatever its case, newest first, with the total."""
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit((needle or "").lower()))
    return counted_page(recordings.where(has("original_filename") | has("title")), number, size, F.col("created_at").desc(), F.col("video_id").desc())


def batch_list(batches: DataFrame, status: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    """A page of batches (batch_id, status, created_at), of one status if given, newest first, with the total."""
    rows = batches if status is None else batches.where(F.col("status") == status)
    return counted_page(rows, number, size, F.col("created_at").desc(), F.col("batch_id"))


def batch_status(jobs: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c)
    s = F.col("status")
    out = jobs.groupBy("batch_id").agg(F.count("*").alias("total"), count(s == "completed").alias("completed"), count(s == "failed").alias("failed"), count(s == "cancelled").alias("cancelled"), count(s.isin(*ACTIVE)).alias("active"))
    status = F.when(F.col("active") > 0, "processing").when((F.col("total") > 0) & (F.col("cancelled") == F.col("total")), "cancelled").when(F.col("failed") + F.col("cancelled") > 0, "failed").otherwise("completed")
    return out.withColumn("status", status).withColumn("progress", F.round((F.col("completed") + F.col("failed")) / F.col("total") * 100, 4))


def overall_progress(steps: DataFrame) -> DataFrame:
    """Weighted progress of a job over (job_id, step 1..8, progress 0-100); steps without a row count as 0."""
    weight = F.element_at(F.array(*[F.lit(w) for w in STEP_WEIGHTS]), F.col("step"))
    each = steps.where("step between 1 and 8").groupBy("job_id", "step").agg(F.max("progress").alias("progress"))
    return each.groupBy("job_id").agg(F.round(F.sum(F.col("progress") * weight) / sum(STEP_WEIGHTS), 4).alias("overall"))


def completion_counts(videos: DataFrame, jobs: DataFrame) -> DataFrame:
    done = jobs.where("status = 'completed'").select("video_id").distinct().withColumn("_done", F.lit(True))
    n = F.count_if(F.col("_done").isNotNull())
    return videos.join(done, "video_id", "left").agg(F.count("*").alias("total"), n.alias("completed"), (F.count("*") - n).alias("waiting"))


def orphaned(jobs: DataFrame, videos: DataFrame) -> DataFrame:
    """Queued and processing jobs whose recording is gone, as cancelled."""
    return jobs.where(F.col("status").isin("queued", "processing")).join(videos.select("video_id"), "video_id", "left_anti").withColumn("status", F.lit("cancelled"))


def stale(jobs: DataFrame, active: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Processing jobs started more than `minutes` before now and unknown to the queue, queued once more."""
    old = jobs.where((F.col("status") == "processing") & F.col("started_at").isNotNull() & (F.col("started_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")))
    return old.join(active.select("job_id"), "job_id", "left_anti").withColumn("status", F.lit("queued")).withColumn("retry_count", F.col("retry_count") + 1)


def label_counts(tags: DataFrame) -> DataFrame:
    """Recordings by label, whatever its case; shown as first spelled (by video_id, then place)."""
    t = tags.select("video_id", "place", F.trim("tag").alias("tag")).where("tag <> ''").withColumn("key", F.lower("tag"))
    one = t.groupBy("video_id", "key").agg(F.min(F.struct("place", "tag")).alias("m"))
    return one.groupBy("key").agg(F.min_by("m.tag", F.struct("video_id", "m.place")).alias("label"), F.count("*").alias("n")).select("label", "n")


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of rows in a total order; only as many rows as the page needs are kept by each task."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def first_of_text(items: DataFrame) -> DataFrame:
    """To-dos of a recording that differ once trimmed, folded and lower-cased; the first one of each stays."""
    from ..functions.text import fold

    t = items.withColumn("norm", F.lower(fold("text"))).where("norm <> ''")
    w = Window.partitionBy("video_id", F.xxhash64("norm"), "norm").orderBy("item_idx")
    return t.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def to_retry(jobs: DataFrame) -> DataFrame:
    """The newest failed job of each recording that has no active job, queued once more: one retry more, and nothing left
    of the last run in its step, error and time columns."""
    w = Window.partitionBy("video_id").orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    newest = jobs.where("status = 'failed'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    active = jobs.where(F.col("status").isin(*ACTIVE)).select("video_id")
    out = newest.join(active, "video_id", "left_anti").withColumn("status", F.lit("queued"))
    count = F.coalesce("retry_count", F.lit(0)) + 1 if "retry_count" in jobs.columns else F.lit(1)
    cleared = {c: F.lit(None).cast(jobs.schema[c].dataType) for c in ("current_step", "error_message", "error_step", "started_at", "completed_at") if c in jobs.columns}
    return out.withColumns({**cleared, "retry_count": count})


def next_step(steps: DataFrame, count: int = 8) -> DataFrame:
    """The first step of each job (job_id, step 1..count, progress) that is not done; null if all are."""
    done = steps.where("progress >= 100").groupBy("job_id").agg(F.collect_set("step").alias("done"))
    left = F.array_except(F.sequence(F.lit(1), F.lit(count)), F.coalesce("done", F.array().cast("array<int>")))
    return steps.select("job_id").distinct().join(done, "job_id", "left").select("job_id", F.array_min(left).alias("next_step"))
