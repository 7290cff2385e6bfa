"""Column functions on records: labels, model answers, duplicate notes, metadata, audit names. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import fold, without_reasoning

#: Media types that an upload may have.
MEDIA_TYPES = ("video/mp4", "video/webm", "video/quicktime", "video/x-msvideo", "video/x-matroska")
#: Path prefix and audit event of write requests.
AUDIT_EVENTS = {
    "/api/settings": "settings.write",
    "/api/action-items": "action_items.write",
    "/api/videos": "videos.write",
    "/api/jobs": "jobs.write",
    "/api/batch": "batch.write",
    "/api/search": "search.write",
}


def _if_any(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def clean_tags(tags: Column) -> Column:
    """Tags trimmed, without blanks and nulls, each once whatever its case, as first spelled; null if none is left."""
    kept = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    keys = F.transform(kept, lambda t: F.lower(t))
    return _if_any(F.filter(kept, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1))


def tag_filter(text: str | None) -> list[str]:
    """The tags of a comma list, trimmed, each once whatever its case, as first spelled; no text: none."""
    out: dict[str, str] = {}
    for t in (text or "").split(","):
        if t.strip():
            out.setdefault(t.strip().lower(), t.strip())
    return list(out.values())


def has_all_tags(tags: Column, wanted: list[str]) -> Column:
    """Does a recording have every tag, whatever its case? Without wanted tags all do; null tags are none."""
    have = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t))
    return F.size(F.array_except(F.array(*[F.lit(t.lower()) for t in wanted]), have)) == 0 if wanted else F.lit(True)


def has_any_tag(tags: Column, wanted: list[str]) -> Column:
    """Does a recording have one of the tags, whatever its case? Without wanted tags all do."""
    have = F.array_compact(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t)))
    return F.arrays_overlap(have, F.array(*[F.lit(t.lower()) for t in wanted])) if wanted else F.lit(True)


def summary_of(answer: Column) -> Column:
    """The summary struct in a model's answer: the outermost braces as JSON; bad JSON: its first 500 characters."""
    plain = without_reasoning(answer)
    body = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), "executive_summary string, key_points array<string>, action_items array<string>, decisions array<string>, topics array<struct<timestamp: string, topic: string, summary: string, speakers: array<string>>>")
    none = F.array().cast("array<string>")
    lists = [F.coalesce(parsed[k], none).alias(k) for k in ("key_points", "action_items", "decisions")]
    return F.struct(F.coalesce(parsed["executive_summary"], F.when(parsed.isNull(), F.substring(plain, 1, 500)), F.lit("")).alias("executive_summary"), *lists, F.coalesce(parsed["topics"], F.array().cast("array<struct<timestamp: string, topic: string, summary: string, speakers: array<string>>>")).alias("topics"))


def vision_answer(answer: Column) -> Column:
    """A vision model's JSON under its usual names, from any of the names that models use; other text is a description."""
    v = F.try_parse_json(answer)
    get = lambda key, kind: F.try_variant_get(v, f"$.{key}", kind)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    lines = F.array_join(F.filter(get("text_visible", "array<string>"), lambda t: t != ""), "\n")
    ocr = F.coalesce(get("ocr_text", "string"), lines, get("text_visible", "string"), get("ocr", "string"), get("text", "string"), F.lit(""))
    points = [F.coalesce(get(k, "array<string>"), F.when(get(k, "string").isNotNull(), F.array(get(k, "string")))) for k in ("key_points", "bullet_points", "bullets")]
    slide = F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "BOOLEAN", get(k, "boolean")) for k in ("is_slide", "is_presentation_slide")], F.lit(False))
    return F.struct(
        F.when(is_object, F.coalesce(get("description", "string"), F.lit(""))).otherwise(answer).alias("description"),
        F.when(is_object, ocr).otherwise("").alias("ocr_text"), (F.coalesce(is_object, F.lit(False)) & slide).alias("is_slide"),
        F.when(is_object, F.coalesce(get("slide_title", "string"), get("title", "string"))).alias("slide_title"),
        F.when(is_object, F.coalesce(*points, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("key_points"),
    )


def clean_number(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clean_text(c: Column) -> Column:
    return F.nullif(fold(c), F.lit(""))


def clean_list(c: Column) -> Column:
    """A list as JSON text without its nulls; null if nothing is left."""
    return F.to_json(_if_any(F.array_compact(c)))


def clean_map(c: Column) -> Column:
    """A map of strings as JSON text with its keys in order and without null values; null if nothing is left."""
    kept = F.array_sort(F.map_entries(F.map_filter(c, lambda k, v: v.isNotNull())))
    return F.when(F.size(kept) > 0, F.to_json(F.map_from_entries(kept)))


def audit_event(path: Column, method: Column) -> Column:
    out = F.when(path.startswith("/api/auth/"), F.concat(F.lit("auth."), F.element_at(F.split(path, "/"), -1)))
    for prefix, event in AUDIT_EVENTS.items():
        out = out.when(path.startswith(prefix), event)
    return out.otherwise(F.concat(F.lit("api."), F.lower(method)))


def refusal(filename: Column, media_type: Column, size: Column, duration: Column, width: Column, height: Column, most_gb: float = 10) -> Column:
    """Why an upload is refused; null if it is accepted."""
    return (
        F.when(F.coalesce(filename, F.lit("")) == "", "no filename")
        .when(~F.coalesce(media_type.isin(*MEDIA_TYPES), F.lit(False)), F.concat(F.lit("type not allowed: "), F.coalesce(media_type, F.lit("none"))))
        .when(size > most_gb * 2**30, "too large")
        .when(duration.isNull() | width.isNull() | height.isNull(), "invalid media")
    )
