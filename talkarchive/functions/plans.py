"""Column functions that plan sampling and naming: offsets, chunk windows, frame times, namespaces, audit events."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_offsets(total: Column, sample: Column, n: Column) -> Column:
    """n evenly spaced offsets over total - sample, halves to even; short input: [0]; one sample: the centre."""
    room = (total - sample).cast("double")
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.greatest(F.lit(0.0), F.least(room, F.bround(k * room / (n - 1), 0))).cast("long"))
    return F.when(room <= 0, F.array(F.lit(0).cast("long"))).when(n <= 1, F.array(F.floor(room / 2).cast("long"))).otherwise(even)


def chunk_windows(total: Column, length: int, overlap: int) -> Column:
    """Windows [k * step, min(k * step + length, total)) over total samples; step = max(1, length - overlap)."""
    step = max(1, length - overlap)
    spans = F.transform(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(step).cast("long")), lambda a: F.struct(a.alias("start"), F.least(a + length, total).alias("end")))
    return F.when(total > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def frame_times(duration: Column, interval: float, most: int) -> Column:
    """min(most, floor(duration / interval) + 1) times, evenly duration / n apart."""
    n = F.least(F.lit(most), F.floor(duration / interval) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.round(k * duration / n, 6))


def every_interval(duration: Column, interval: float) -> Column:
    """0, interval, 2 intervals, .. below the duration; none for a duration of 0."""
    n = F.ceil(duration / interval).cast("int")
    return F.when(duration > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.round(k * F.lit(float(interval)), 6))).otherwise(F.array().cast("array<double>"))


def namespace(model: Column) -> Column:
    """The chunk namespace of a model: a readable part of at most 31 characters and 8 digits of the name's SHA-256."""
    slug = F.substring(F.regexp_replace(F.lower(model), "[^a-z0-9]+", "-"), 1, 31)
    return F.concat(F.lit("video_content--"), slug, F.lit("-"), F.substring(F.sha2(model, 256), 1, 8))


def match_weight(kind: Column, section: Column) -> Column:
    """Weight of a chunk as a match, by its type and section (fixed values)."""
    return F.when((kind == "summary") & (section == "key_points"), 1.0).when(kind == "transcript", 0.98).when(kind == "summary", 0.78).when(kind == "topic", 0.68).when(kind == "slide", 0.45).otherwise(0.65)
