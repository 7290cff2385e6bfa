"""Queries on typed records, the chunk index and prompts, and the same rows as DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import prompts as P, text as T
from ..operators.settle import shared_folder
from ..sources import archive as A, snapshots, tables as X
from .registry import query


@query("SELECT conv_id AS video_id, count(*) AS n_segments, sum(length(text))::BIGINT AS chars, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'About ' || conv_id END AS summary FROM conversations GROUP BY conv_id")
def s1_typed_recordings(spark, d):
    turns = X.turns(spark, d).groupBy("video_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("start", "end", "text", "speaker"))).alias("segments"))).alias("transcript"))
    summary = F.when(F.col("video_id") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.concat(F.lit("About "), "video_id").alias("executive_summary"))))
    rows = A.typed_recordings(turns.withColumn("summary", summary))
    seg = F.col("transcript.segments")
    return rows.select("video_id", F.size(seg).cast("long").alias("n_segments"), F.aggregate(seg, F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"])).alias("chars"), F.col("summary.executive_summary").alias("summary"))


def _index(spark, d):
    rows = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("video_id"))
    return rows.withColumn("namespace", F.concat(F.lit("m"), F.col("chunk_id") % 2))


@query("SELECT vec_id AS chunk_id, label AS video_id, 'm' || vec_id % 2 AS namespace FROM embeddings WHERE NOT (vec_id % 2 = 1 AND label IN (2, 3)) UNION ALL SELECT vec_id + 1000000, label, 'm1' FROM embeddings WHERE label IN (2, 3)")
def s3_replace_chunks(spark, d):
    old = _index(spark, d)
    new = old.where("video_id in (2, 3)").drop("namespace").withColumn("chunk_id", F.col("chunk_id") + 1000000)
    return A.replace_chunks(old, new, "m1")


@query("SELECT 'chunks' AS kind, vec_id AS id FROM embeddings WHERE label NOT IN (1, 4) UNION ALL SELECT 'turns', conv_id * 1000 + turn FROM conversations WHERE conv_id NOT IN (1, 4)")
def s4_without_recordings(spark, d):
    turns = X.turns(spark, d).select("video_id", (F.col("video_id") * 1000 + F.col("seg_idx")).alias("id"))
    gone = turns.where("video_id in (1, 4)")
    left = A.without_recordings({"chunks": _index(spark, d).select("video_id", F.col("chunk_id").alias("id")), "turns": turns}, gone)
    return left["chunks"].select(F.lit("chunks").alias("kind"), "id").unionByName(left["turns"].select(F.lit("turns").alias("kind"), "id"))


@query("SELECT conv_id::VARCHAR AS video_id, CASE WHEN conv_id % 5 <> 0 THEN count(*) END AS n_segments, CASE WHEN conv_id % 5 <> 0 THEN coalesce(sum(length(text)), 0) END::BIGINT AS chars FROM conversations GROUP BY conv_id")
def s2_step_files(spark, d):
    """Conversations written as transcript files of their own folders in the shared folder, every fifth one torn, read back."""
    path = f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
    body = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("start", "end", "text", "speaker"))).alias("segments")))
    files = X.turns(spark, d).groupBy("video_id").agg(body.alias("value"))
    torn = F.when(F.col("video_id") % 5 == 0, F.substring("value", 1, 20)).otherwise(F.col("value"))
    files.select("video_id", torn.alias("value")).repartition("video_id").write.partitionBy("video_id").text(path)
    rows = A.step_files(spark, f"{path}/*", "segments " + A.TRANSCRIPT[len("struct<segments: ") : -1])
    chars = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.coalesce(F.length(s["text"]), F.lit(0)))
    return rows.select("video_id", F.when(F.col("segments").isNotNull(), F.size("segments")).cast("long").alias("n_segments"), chars.alias("chars"))


@query("SELECT vec_id AS chunk_id, label AS video_id, 'm' || vec_id % 2 AS namespace FROM embeddings WHERE label NOT IN (1, 4) AND NOT (vec_id % 2 = 1 AND label IN (2, 3)) UNION ALL SELECT vec_id + 1000000, label, 'm1' FROM embeddings WHERE label IN (2, 3)")
def s3_s4_snapshot_index(spark, d):
    """The index written to the shared folder, recordings replaced in one namespace, others deleted from all, and read back."""
    path, old = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", _index(spark, d).withColumn("video_id", F.col("video_id").cast("long"))
    snapshots.commit(path, old)
    new = old.where("video_id in (2, 3)").withColumn("chunk_id", F.col("chunk_id") + 1000000).withColumn("namespace", F.lit("m1"))
    snapshots.commit(path, new, new.select("namespace", "video_id").distinct())
    snapshots.delete(spark, path, old.where("video_id in (1, 4)").select("video_id").distinct())
    return snapshots.read(spark, path)


@query("""WITH r AS (SELECT conv_id, 'Title: talk ' || conv_id || chr(10) || 'Part ' || (conv_id % 3 + 1) || ' of 3 (00:00:00 - 00:01:00)' AS head, string_agg('[' || lpad((turn * 10 // 3600)::VARCHAR, 2, '0') || ':' || lpad((turn * 10 % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((turn * 10 % 60)::VARCHAR, 2, '0') || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS spoken FROM conversations GROUP BY 1)
SELECT conv_id AS video_id, head || chr(10) || chr(10) || 'Transcript:' || chr(10) || spoken || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || 'Slides:' || chr(10) || '- 00:00:10 Plan' ELSE '' END AS prompt, 20 AS frames, 2666 AS chars FROM r WHERE spoken IS NOT NULL""")
def f28_prompt(spark, d):
    from ..functions import text as T

    line = F.concat(F.lit("["), T.clock(F.col("start")), F.lit("] "), "speaker", F.lit(": "), "text")
    rows = X.turns(spark, d).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("l")))).alias("l"))
    spoken = F.array_join(F.transform("l", lambda x: x["l"]), "\n")
    slides = F.when(F.col("video_id") % 2 == 0, F.array(P.slide_line(F.lit(10.0), F.lit("Plan"), F.lit(""), F.array().cast("array<string>"))))
    head = P.prompt(F.concat(F.lit("talk "), "video_id"), F.col("video_id") % 3 + 1, F.lit(3), F.lit(0.0), F.lit(60.0), spoken, F.array_join(slides, "\n"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    frames, chars = P.window_budgets(F.lit(3))
    return rows.select("video_id", head.alias("prompt"), frames.alias("frames"), chars.alias("chars"))


@query("SELECT doc_id, array_to_string(CASE WHEN n_chars <= 300 THEN [0::BIGINT] ELSE list_transform(range(0, 5), lambda k: greatest(0, least(n_chars - 300, round_even(k * (n_chars - 300) / 4.0::DOUBLE, 0)))::BIGINT) END, ',') AS offsets FROM documents")
def f23_sample_offsets(spark, d):
    from ..functions import plans

    rows = X.table(spark, d, "documents").select("doc_id", plans.sample_offsets(F.col("n_chars"), F.lit(300), F.lit(5)).alias("o"))
    return rows.select("doc_id", F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("offsets"))


@query("""WITH s AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id AS video_id, count(*) FILTER (t = '' OR regexp_matches(t, '^[:;|/ -]+$') OR NOT regexp_matches(t, '[\\p{L}\\p{N}]')) AS n FROM s GROUP BY 1""")
def p12_low_signal(spark, d):
    from ..functions import text as T

    return X.segments(spark, d).groupBy("video_id").agg(F.count_if(T.low_signal("text")).alias("n"))


@query("WITH t AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT % 64) AS p FROM documents) SELECT doc_id, array_to_string(list_transform(range(64), lambda k: len(list_filter(p, lambda x: x = k))), ',') AS counts FROM t")
def e1_token_vectors(spark, d):
    """The token counts behind the default embedding of every text."""
    rows = X.table(spark, d, "documents")
    return rows.select("doc_id", F.array_join(F.transform(T.token_counts(F.col("text")), lambda n: n.cast("string")), ",").alias("counts"))
