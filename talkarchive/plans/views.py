"""Queries on views, records and decisions, and the same rows as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import views as V
from ..sources import tables as X
from .registry import query

_JOBS = "j AS (SELECT o_orderkey AS job_id, o_custkey AS video_id, o_orderpriority AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status, o_orderdate AS created_at FROM orders)"


def _documents(spark, d):
    return X.table(spark, d, "documents").withColumnRenamed("doc_id", "video_id")


@query("SELECT doc_id AS video_id FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 3 AND lower(lang) = 'en'")
def p1_search_candidates(spark, d):
    none = F.lit(None).cast("string")
    rows = _documents(spark, d).select("video_id", F.col("text").alias("transcript"), none.alias("summary"), none.alias("slides"), (F.col("video_id") % 10 == 3).alias("suppressed"), F.array("source", "lang").alias("tags"))
    return V.search_candidates(rows, tags=["EN"]).select("video_id")


@query("SELECT doc_id, nullif(concat_ws(',', nullif(trim(source), ''), CASE WHEN lower(trim(lang)) = lower(trim(source)) THEN NULL ELSE nullif(trim(lang), '') END), '') AS tags FROM documents")
def p4_clean_tags(spark, d):
    tags = F.array("source", F.concat(F.lit(" "), F.upper("source")), "lang", F.lit(" "), F.lit(None))
    return X.table(spark, d, "documents").select("doc_id", F.array_join(R.clean_tags(tags), ",").alias("tags"))


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 3) AND vec_id % 5 = 2")
def p5_chunk_filter(spark, d):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("transcript", "summary", "topic", "slide", "other")]), (F.col("vec_id") % 5 + 1).cast("int"))
    rows = X.table(spark, d, "embeddings").select("vec_id", F.col("label").alias("video_id"), kinds.alias("type"))
    return V.chunk_filter(rows, [3, 1, 3], "topic").select("vec_id")


@query("SELECT page_id FROM pages WHERE page_id % 7 <> 0 AND page_id BETWEEN 10 AND 100")
def p6_slides_in_time(spark, d):
    rows = X.table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 7 != 0, F.col("page_id")).alias("timestamp"))
    return V.in_time(rows, 10, 100).select("page_id")


@query(f"WITH {_JOBS} SELECT job_id, created_at FROM j WHERE batch_id = '2-HIGH' AND status = 'queued'")
def p16_dispatch(spark, d):
    return V.dispatch_list(X.jobs(spark, d), "2-HIGH").select("job_id", "created_at")


@query("""WITH t AS (SELECT conv_id AS v, string_agg(turn * 10 || '-' || turn * 10 + 10 || ' ' || role || ': ' || text, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY 1), p AS (SELECT page_id % 100 AS v, string_agg(page_id || ' ' || string_split(url, '/')[-1], ', ' ORDER BY page_id) AS f FROM pages GROUP BY 1)
SELECT v AS video_id, CASE WHEN v % 2 = 0 THEN 'talk ' || v ELSE v || '.mp4' END AS title, 'Ann, Speaker 2' AS speakers, sha256(said) AS transcript_sha, coalesce(f, '') AS slides, CASE WHEN v % 3 <> 0 THEN 'About ' || v END AS executive_summary, CASE WHEN v % 3 <> 0 THEN CASE WHEN v % 2 = 0 THEN 1 ELSE 0 END END AS n_items FROM t LEFT JOIN p USING (v)""")
def p10_summary_view(spark, d):
    line = lambda t: F.concat(t["start"].cast("int").cast("string"), F.lit("-"), t["end"].cast("int").cast("string"), F.lit(" "), t["speaker"], F.lit(": "), t["text"])
    slide = lambda s: F.concat(s["timestamp"].cast("int").cast("string"), F.lit(" "), s["image"])
    return _view(spark, d).select("video_id", "title", F.array_join("speakers", ", ").alias("speakers"), F.sha2(F.array_join(F.transform("transcript", line), "\n"), 256).alias("transcript_sha"), F.array_join(F.transform("slides", slide), ", ").alias("slides"), F.col("summary.executive_summary").alias("executive_summary"), F.when(F.col("summary").isNotNull(), F.size("summary.action_items")).alias("n_items"))


@query("""SELECT a.doc_id AS video_id, 'probable_duplicate' AS classification, CASE WHEN a.doc_id % 4 = 0 THEN NULL ELSE (a.doc_id % 100) / 100.0::DOUBLE END AS score, a.doc_id % 3 = 0 AS suppressed, a.doc_id // 2 AS duplicate_of, coalesce(b.source, 'stored') AS duplicate_title
FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id // 2 AND b.doc_id % 5 <> 0""")
def p11_j8_duplicate_view(spark, d):
    v = F.col("video_id")
    score = F.when(v % 4 == 0, "high").otherwise(((v % 100) / 100).cast("string"))
    notes = _documents(spark, d).select("video_id", F.lit("probable_duplicate").alias("classification"), score.alias("score"), (v % 3 == 0).alias("suppressed"), F.floor(v / 2).alias("representative_id"), F.lit("stored").alias("representative_title"))
    return V.duplicate_view(notes, _documents(spark, d).where("video_id % 5 <> 0").withColumn("title", F.col("source")))


@query("""WITH m AS (SELECT conv_id AS video_id, turn AS item, c.text, source || '-' || doc_id AS title FROM conversations c JOIN documents ON doc_id = conv_id WHERE turn % 2 = 1 AND contains(lower(c.text), 'en') AND lower(lang) IN ('fr', 'en'))
SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY title, item DESC LIMIT 50""")
def j7_a15_action_items(spark, d):
    items = X.table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("item"), "text", (F.col("turn") % 2 == 0).alias("completed"))
    recordings = _documents(spark, d).select("video_id", F.concat("source", F.lit("-"), "video_id").alias("title"), F.lit("file").alias("filename"), F.array("lang").alias("tags"))
    return V.action_items(items, recordings, False, "EN", ["fr", "EN"], [F.asc("title"), F.desc("item")]).drop("completed")


@query("""WITH s AS (SELECT doc_id, i - 1 AS k, ls[i] AS text, lower(trim(regexp_replace(ls[i], '\\s+', ' ', 'g'))) AS norm FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(i)),
f AS (SELECT * FROM s WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY k) = 1)
SELECT doc_id AS video_id, k::INT AS item_idx, 'summary' AS source FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = 0 AND s.doc_id % 2 = 0 AND s.doc_id = f.doc_id AND s.norm = f.norm)""")
def w10_promote_items(spark, d):
    summaries = _documents(spark, d).select("video_id", F.split("text", "\n").alias("action_items"))
    existing = X.segments(spark, d).where("seg_idx = 0 and video_id % 2 = 0")
    return V.promote_items(summaries, existing).select("video_id", "item_idx", "source")


@query(f"""WITH {_JOBS}, h AS (SELECT video_id, bool_or(status <> 'completed') AS a, bool_or(status = 'completed') AS c FROM j WHERE status = 'completed' OR job_id % 9 = 0 GROUP BY 1)
SELECT c_custkey AS video_id, CASE WHEN a THEN 'running' WHEN c AND c_custkey % 3 <> 0 THEN 'refused: completed' WHEN c_custkey % 4 = 0 THEN 'refused: no file' ELSE 'queued' END AS decision FROM customer LEFT JOIN h ON video_id = c_custkey WHERE c_custkey % 10 <> 0""")
def w13_reprocess(spark, d):
    v = F.col("video_id")
    return V.reprocess(X.videos(spark, d).select("video_id", (v % 4 != 0).alias("has_file"), (v % 3 == 0).alias("forced")), X.jobs(spark, d).where("status = 'completed' or job_id % 9 = 0"))


@query("""WITH u AS (SELECT page_id, page_id % 20 AS batch_id, nullif(regexp_extract(url, '/([^/?]*)[^/]*$', 1), '') AS filename, CASE WHEN page_id % 20 = 5 THEN 'text/plain' WHEN page_id % 3 = 0 THEN 'application/json' ELSE 'video/webm' END AS t, length(html) * 4000000 AS size, CASE WHEN page_id % 11 <> 0 THEN 1.0 END AS d FROM pages),
r AS (SELECT *, CASE WHEN coalesce(filename, '') = '' THEN 'no filename' WHEN t <> 'video/webm' THEN 'type not allowed: ' || t WHEN size > 10737418240 THEN 'too large' WHEN d IS NULL THEN 'invalid media' END AS reason FROM u)
SELECT page_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN contains(filename, '.') THEN filename ELSE filename || '.mp4' END END AS stored_name, CASE WHEN bool_and(reason IS NOT NULL) OVER (PARTITION BY batch_id) THEN (SELECT string_agg(DISTINCT x.reason, '; ' ORDER BY x.reason) FROM r x WHERE x.batch_id = r.batch_id) END AS batch_error FROM r""")
def s7_admit_uploads(spark, d):
    p = F.col("page_id")
    kind = F.when(p % 20 == 5, "text/plain").when(p % 3 == 0, "application/json").otherwise("video/webm")
    found = F.when(p % 11 != 0, 1.0)
    files = X.table(spark, d, "pages").select("page_id", (p % 20).alias("batch_id"), F.regexp_extract("url", "/([^/?]*)[^/]*$", 1).alias("filename"), kind.alias("content_type"), (F.length("html") * F.lit(4000000).cast("long")).alias("size"), found.alias("duration"), found.alias("width"), found.alias("height"))
    return V.admit_uploads(files).select("page_id", "reason", "stored_name", "batch_error")


def _view(spark, d):
    """Conversations as recordings with two speakers, a summary in two of three, and pages as slides of theirs."""
    v, none = F.col("video_id"), F.lit(None).cast("string")
    ids = X.turns(spark, d).select("video_id").distinct()
    topic = F.when(v % 4 == 1, F.array(F.struct(F.lit("00:10").alias("timestamp"), F.lit("Plan").alias("topic"), F.concat(F.lit("of "), "video_id").alias("summary"), F.array().cast("array<string>").alias("speakers"))))
    summary = F.struct(F.concat(F.lit("About "), "video_id").alias("executive_summary"), F.array(F.lit("first"), F.lit("second")).alias("key_points"), F.when(v % 2 == 0, F.array(F.lit("do it"))).alias("action_items"), F.when(v % 5 == 0, F.array(F.lit("yes"))).alias("decisions"), topic.alias("topics"))
    recordings = ids.select("video_id", F.when(v % 2 == 0, F.concat(F.lit("talk "), "video_id")).alias("title"), F.concat("video_id", F.lit(".mp4")).alias("filename"), (v * 10.0).alias("duration"), F.array(F.struct(F.lit("Ann").alias("name")), F.struct(none.alias("name"))).alias("speakers"), F.when(v % 3 != 0, summary).alias("summary"))
    slides = X.table(spark, d, "pages").select((F.col("page_id") % 100).alias("video_id"), F.col("page_id").cast("double").alias("timestamp"), F.col("url").alias("path"), none.alias("ocr_text"), none.alias("description"))
    return V.full_view(recordings, X.turns(spark, d), slides)


_HMS = "lpad(({0} // 3600)::VARCHAR, 2, '0') || ':' || lpad(({0} % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({0} % 60)::VARCHAR, 2, '0')"
_NL = "chr(10)"


@query(f"""WITH t AS (SELECT conv_id, string_agg('**[' || CASE WHEN turn < 360 THEN substr({_HMS.format('(turn * 10)')}, 4) ELSE {_HMS.format('(turn * 10)')} END || '] ' || role || ':** ' || text, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY 1)
SELECT conv_id AS video_id, sha256('# ' || CASE WHEN conv_id % 2 = 0 THEN 'talk ' || conv_id ELSE conv_id || '.mp4' END || chr(10) || chr(10) || '**Duration:** ' || {_HMS.format('(conv_id * 10)')} || chr(10) || '**Speakers:** Ann, Speaker 2' || chr(10) || chr(10)
 || CASE WHEN conv_id % 3 <> 0 THEN '## Executive Summary' || chr(10) || chr(10) || 'About ' || conv_id || chr(10) || chr(10) || '## Key Points' || chr(10) || chr(10) || '- first' || chr(10) || '- second' || chr(10)
 || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '## Action Items' || chr(10) || chr(10) || '- [ ] do it' || chr(10) ELSE '' END || CASE WHEN conv_id % 5 = 0 THEN chr(10) || '## Decisions' || chr(10) || chr(10) || '- yes' || chr(10) ELSE '' END
 || CASE WHEN conv_id % 4 = 1 THEN chr(10) || '## Topic Breakdown' || chr(10) || chr(10) || '### Plan (00:10)' || chr(10) || chr(10) || 'of ' || conv_id || chr(10) || chr(10) ELSE '' END ELSE '' END || '## Full Transcript' || chr(10) || chr(10) || said || chr(10)) AS markdown_sha FROM t""")
def s5_export_markdown(spark, d):
    return V.export_markdown(_view(spark, d)).select("video_id", F.sha2("markdown", 256).alias("markdown_sha"))


@query("""SELECT conv_id AS video_id, CASE WHEN conv_id % 2 = 0 THEN 'talk ' || conv_id ELSE conv_id || '.mp4' END AS title, count(*) AS n, CASE WHEN conv_id % 3 <> 0 THEN 'About ' || conv_id END AS about FROM conversations GROUP BY conv_id""")
def s5_export_json(spark, d):
    """What can be read back from the JSON form."""
    out = V.export_json(_view(spark, d))
    back = F.from_json("json", "title string, summary struct<executive_summary: string>, transcript array<struct<text: string>>")
    return out.select("video_id", back.alias("j")).select("video_id", "j.title", F.size("j.transcript").cast("long").alias("n"), F.col("j.summary.executive_summary").alias("about"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'auth.' || event_type WHEN 1 THEN 'settings.write' WHEN 2 THEN 'videos.write' WHEN 3 THEN 'action_items.write' ELSE 'api.post' END AS event FROM events""")
def f26_audit_event(spark, d):
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("/api/auth/", "/api/settings/", "/api/videos/", "/api/action-items/", "/api/other/")]), (F.col("event_id") % 5 + 1).cast("int"))
    return X.table(spark, d, "events").select("event_id", R.audit_event(F.concat(prefix, "event_type"), F.lit("POST")).alias("event"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(source, 'none') ELSE substr('not json {' || coalesce(source, 'none'), 1, 500) END AS executive_summary, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS n_points, CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, 'none') END AS topic FROM documents")
def f10_summary_json(spark, d):
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    good = F.concat(F.lit('<think>{"x": 1}</think>Here: {"executive_summary": "'), source, F.lit('", "key_points": ["a", "'), lang, F.lit('"], "topics": [{"timestamp": "00:10", "topic": "'), lang, F.lit('", "summary": "s", "speakers": []}]} done'))
    s = R.summary_of(F.when(F.col("doc_id") % 2 == 0, good).otherwise(F.concat(F.lit("not json {"), source)))
    return X.table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.executive_summary", F.size("s.key_points").alias("n_points"), F.get("s.topics", F.lit(0))["topic"].alias("topic"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 3 THEN 'just ' || lang ELSE '' END AS description, CASE doc_id % 4 WHEN 0 THEN source || chr(10) || lang WHEN 1 THEN source WHEN 2 THEN lang ELSE '' END AS ocr_text, doc_id % 4 = 0 AS is_slide, CASE doc_id % 4 WHEN 1 THEN lang END AS slide_title,
CASE doc_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'one' ELSE '' END AS points FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def f11_vision_answer(spark, d):
    a = [F.lit('{{"is_presentation_slide": true, "text_visible": ["{s}", "", "{l}"], "bullets": ["a", "b"], "description": "{l}"}}'), F.lit('{{"ocr": "{s}", "title": "{l}", "key_points": "one", "is_slide": "yes"}}'), F.lit('{{"text": "{l}"}}'), F.lit("just {l}")]
    made = F.element_at(F.array(*a), (F.col("doc_id") % 4 + 1).cast("int"))
    made = F.replace(F.replace(F.replace(F.replace(made, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")), F.lit("{s}"), F.col("source")), F.lit("{l}"), F.col("lang"))
    rows = X.table(spark, d, "documents").where("source is not null and lang is not null").select("doc_id", R.vision_answer(made).alias("v"))
    return rows.select("doc_id", "v.description", "v.ocr_text", "v.is_slide", "v.slide_title", F.array_join("v.key_points", ",").alias("points"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN n_chars::DOUBLE END AS number, nullif(trim(lang), '') AS word, CASE WHEN source IS NOT NULL THEN '["' || source || '"]' END AS list, CASE WHEN coalesce(source, lang) IS NOT NULL THEN '{' || concat_ws(',', '"a":"' || source || '"', '"b":"' || lang || '"') || '}' END AS map FROM documents""")
def f21_metadata(spark, d):
    number = F.when(F.col("doc_id") % 3 == 0, float("nan")).otherwise(F.col("n_chars").cast("double"))
    made = F.create_map(F.lit("b"), F.col("lang"), F.lit("c"), F.lit(None).cast("string"), F.lit("a"), F.col("source"))
    return X.table(spark, d, "documents").select("doc_id", R.clean_number(number).alias("number"), R.clean_text(F.concat(F.lit(" "), "lang", F.lit("\t"))).alias("word"), R.clean_list(F.array(F.lit(None), "source")).alias("list"), R.clean_map(made).alias("map"))


@query("""WITH a AS (SELECT conv_id AS v, 'transcript' AS type, 0 AS n, turn AS place, text AS t FROM conversations UNION ALL SELECT conv_id, 'summary', 1, 0, text FROM conversations WHERE turn = 1 UNION ALL SELECT conv_id, 'summary', 2, 0, 'Point ' || conv_id FROM conversations WHERE turn = 1
UNION ALL SELECT conv_id, 'summary', 2, 1, 'POINT ' || conv_id FROM conversations WHERE turn = 1 UNION ALL SELECT conv_id, 'topic', 3, 0, 'Topic: ' || conv_id FROM conversations WHERE turn = 1 UNION ALL SELECT conv_id, 'slide', 4, turn, role || ': ' || text FROM conversations),
f AS (SELECT v, type, n, place, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text FROM a) SELECT v AS video_id, type, place, text FROM f WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY v, lower(text) ORDER BY n, place) = 1""")
def u1_chunk_sources(spark, d):
    turns = X.turns(spark, d).withColumnRenamed("seg_idx", "place")
    summaries = turns.where("place = 1").select("video_id", F.col("text").alias("executive_summary"), F.array(F.concat(F.lit("Point "), "video_id"), F.concat(F.lit("POINT "), "video_id")).alias("key_points"), F.array(F.struct(F.lit("Topic").alias("topic"), F.col("video_id").cast("string").alias("summary"))).alias("topics"))
    return V.chunk_sources(turns, summaries, turns.select("video_id", "place", F.col("speaker").alias("title"), F.col("text").alias("content")))
