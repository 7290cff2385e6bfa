"""Queries on frames and audio scores, and the same rows as DuckDB SQL.

Pages stand for frames, vectors for pictures (64 values and the first 8 again as 9 x 8) and for scores of prompts: label is
the fixture, vec_id the window and the place in the vector the key and prompt.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C, frames as R
from ..sources import tables as X
from .registry import query

_TURNS = "tn AS (SELECT conv_id AS video_id, text, turn * 10.0::DOUBLE AS \"start\", turn * 10.0::DOUBLE + 10 AS \"end\" FROM conversations)"
_FRAMES = "fr AS (SELECT page_id % 100 AS video_id, page_id AS frame_id, (page_id // 100 * 20)::DOUBLE AS tm, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') || CASE WHEN page_id % 3 = 0 THEN ' slack' ELSE '' END AS ocr FROM pages)"


def _frames(spark, d):
    p = F.col("page_id")
    title = F.coalesce(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(""))
    return X.table(spark, d, "pages").select((p % 100).alias("video_id"), p.alias("frame_id"), (F.floor(p / 100) * 20).cast("double").alias("timestamp"), F.concat(title, F.when(p % 3 == 0, " slack").otherwise("")).alias("ocr_text"))


@query(f"""WITH {_TURNS}, {_FRAMES}, k AS (SELECT * REPLACE (CASE WHEN frame_id % 9 = 4 THEN -1 - video_id ELSE video_id END AS video_id), list_distinct(list_filter(regexp_split_to_array(lower(ocr), '[^a-z0-9]+'), lambda w: w <> '')) AS ws FROM fr),
s AS (SELECT k.video_id, frame_id, list_distinct(flatten(list(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')))) AS said FROM k JOIN tn ON tn.video_id = k.video_id AND "end" >= greatest(0, tm - 45) AND "start" <= tm + 45 GROUP BY ALL),
r AS (SELECT k.*, CASE WHEN len(ws) > 0 THEN coalesce(len(list_intersect(ws, said)), 0)::DOUBLE / len(ws) ELSE 0 END AS x, video_id IN (SELECT video_id FROM tn) AS heard FROM k LEFT JOIN s USING (video_id, frame_id))
SELECT video_id, frame_id, CASE WHEN heard THEN round(x, 4) END AS relevance_score, heard AND x < 0.05 AND list_contains(ws, 'slack') AS low_relevance FROM r""")
def j2_frame_relevance(spark, d):
    """Every ninth frame is of a recording without speech."""
    silent = F.when(F.col("frame_id") % 9 == 4, -1 - F.col("video_id")).otherwise(F.col("video_id"))
    return R.relevance(_frames(spark, d).withColumn("video_id", silent), X.turns(spark, d)).select("video_id", "frame_id", "relevance_score", "low_relevance")


@query(f"""WITH {_FRAMES}, l AS (SELECT video_id % 10 AS video_id, frame_id, tm, trim(regexp_replace('[00:' || lpad((tm::INT // 60)::VARCHAR, 2, '0') || ':' || lpad((tm::INT % 60)::VARCHAR, 2, '0') || '] is_slide=False; ocr: ' || trim(ocr), '\\s+', ' ', 'g')) AS line FROM fr WHERE trim(ocr) <> ''),
c AS (SELECT *, row_number() OVER w AS place, sum(length(line) + 1) OVER w AS n FROM l WINDOW w AS (PARTITION BY video_id ORDER BY tm, frame_id))
SELECT video_id, frame_id, tm AS "timestamp", line, place::INT AS place FROM c WHERE n <= 800 AND place <= 12""")
def w7_frame_lines(spark, d):
    none = F.lit(None).cast("string")
    rows = _frames(spark, d).withColumn("video_id", F.col("video_id") % 10).withColumn("is_slide", F.lit(False)).withColumn("slide_title", none).withColumn("description", none)
    return R.prompt_lines(rows, 800, 12)


@query(f"""WITH {_FRAMES}, v AS (SELECT video_id % 10 AS video_id, frame_id, tm, (frame_id % 10 + frame_id // 10) % 2 = 0 AS hit FROM fr WHERE frame_id % 4 <> 1), t AS (SELECT video_id, count(*) FILTER (hit) AS hits, count(*) AS total FROM v GROUP BY 1),
x AS (SELECT video_id, string_agg('00:' || lpad((tm::INT // 60)::VARCHAR, 2, '0') || ':' || lpad((tm::INT % 60)::VARCHAR, 2, '0'), ', ' ORDER BY frame_id) AS times FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS r FROM v WHERE hit) WHERE r <= 3 GROUP BY 1)
SELECT video_id, hits, total, 'Visuals show a TV/television playing content in ' || hits || '/' || total || ' sampled non-slide frames (~' || round_even(hits * 100 / total, 0)::INT || '%). Audio is likely dominated by the TV during those segments. Example timestamps: ' || times || '.' AS hint FROM t JOIN x USING (video_id) WHERE hits >= 3 AND hits / total >= 0.35""")
def a9_television(spark, d):
    p = F.col("frame_id")
    text = F.concat("ocr_text", F.when((p % 10 + F.floor(p / 10)) % 2 == 0, F.lit(" on a Smart TV")).otherwise(" on a tvx"))
    return R.television_hint(_frames(spark, d).select((F.col("video_id") % 10).alias("video_id"), "frame_id", "timestamp", text.alias("text"), (p % 4 == 1).alias("is_slide")))


def _pictures(spark, d):
    grey = F.transform(F.concat("embedding", F.slice("embedding", 1, 8)), lambda x: F.floor(x.cast("double") * 100 + 100).cast("double"))
    return X.table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("video_id"), F.col("vec_id").cast("double").alias("timestamp"), grey.alias("signature"))


@query("""WITH s AS (SELECT vec_id, list_transform(list_concat(embedding, embedding[1:8]), lambda x: floor(x::DOUBLE * 100 + 100)) AS g FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN g[i // 8 * 9 + i % 8 + 2] > g[i // 8 * 9 + i % 8 + 1] THEN '1' ELSE '0' END), '') AS hash FROM s""")
def h9_difference_hash(spark, d):
    return _pictures(spark, d).select("vec_id", R.difference_hash(F.col("signature")).alias("hash"))


_AWAY = "list_sum(list_transform(range(1, 73), lambda k: abs({}[k] - {}[k]))) / 72"


@query(f"""WITH RECURSIVE p AS (SELECT label AS v, vec_id::DOUBLE AS tm, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, list_transform(list_concat(embedding, embedding[1:8]), lambda x: floor(x::DOUBLE * 100 + 100)) AS g FROM embeddings),
f AS (SELECT *, list_transform(range(0, 64), lambda i: g[i // 8 * 9 + i % 8 + 2] > g[i // 8 * 9 + i % 8 + 1]) AS h FROM p),
r AS (SELECT v, i, i AS base, i AS seen, NULL::BIGINT AS cand, i AS kept FROM f WHERE i = 1 UNION ALL
  SELECT v, i, CASE WHEN keep THEN cand ELSE base END, CASE WHEN keep THEN i ELSE seen END, CASE WHEN NOT near AND away THEN i END, CASE WHEN keep THEN cand END FROM
  (SELECT *, near AND len(list_filter(range(1, 65), lambda k: h[k] <> sh[k])) >= 4 AS keep FROM
  (SELECT c.v, c.i, c.h, s.h AS sh, base, seen, cand, coalesce({_AWAY.format('c.g', 'o.g')} <= 14, false) AS near, {_AWAY.format('c.g', 'b.g')} >= 8 AS away
   FROM r JOIN f c ON c.v = r.v AND c.i = r.i + 1 JOIN f b ON b.v = r.v AND b.i = base JOIN f s ON s.v = r.v AND s.i = seen LEFT JOIN f o ON o.v = r.v AND o.i = cand))),
k AS (SELECT r.v, tm, row_number() OVER (PARTITION BY r.v ORDER BY tm) - 1 AS scene_idx, CASE WHEN kept = 1 THEN 'initial' ELSE 'change' END AS reason FROM r JOIN f ON f.v = r.v AND f.i = kept WHERE kept IS NOT NULL),
d AS (SELECT v, max(tm) AS z, (SELECT count(*) FROM k WHERE k.v = f.v) AS n FROM f GROUP BY v), e AS (SELECT v, z, floor(z / 50)::BIGINT + 1 AS m FROM d WHERE n = 0 OR (n <= 1 AND z > 50))
SELECT v::BIGINT AS video_id, scene_idx, tm AS timestamp, reason FROM k WHERE v NOT IN (SELECT v FROM e) UNION ALL SELECT v, i, round(i * z / m, 6), 'interval' FROM e, unnest(range(0, m)) t(i)""")
def h8_keyframes(spark, d):
    """Frames kept of each label's pictures, and even ones where the walk keeps one at most; tests hold the walk against a
    plain statement of its rule."""
    pictures = _pictures(spark, d)
    return R.keyframes_or_intervals(pictures, pictures.groupBy("video_id").agg(F.max("timestamp").alias("duration")), 50.0, change=8.0, stable=14.0)


def _scores(spark, d, first: int, keys: int, variants: int):
    """(label, key, prompt, window_idx, score): sigmoid scores of keys * variants places from `first`."""
    rows = X.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("label"), F.col("vec_id").alias("window_idx"), F.posexplode(F.slice("embedding", first + 1, keys * variants)).alias("i", "v"))
    i = F.col("i")
    key = F.concat(F.lit("k"), F.floor(i / variants).cast("string"))
    return rows.select("label", key.alias("key"), F.concat(key, F.lit("p"), (i % variants).cast("string")).alias("prompt"), "window_idx", F.round(1 / (1 + F.exp(-F.col("v").cast("double") * 8)), 9).alias("score"))


_SCORES = """{n} AS (SELECT label::VARCHAR AS label, 'k' || i // {v} AS key, 'k' || i // {v} || 'p' || i % {v} AS prompt, vec_id AS window_idx, round(1 / (1 + exp(-embedding[i + 1 + {f}]::DOUBLE * 8)), 9) AS score FROM embeddings, unnest(range(0, {k} * {v})) t(i))"""
_PRIMARY = _SCORES.format(n="ps", f=0, k=4, v=3) + ", pe AS (SELECT *, label::INT % 4 || '' = key[2:] AND label::INT % 3 <> 0 AS expected FROM ps)"
_SUPPORT = _SCORES.format(n="ss", f=12, k=5, v=3) + ", se AS (SELECT *, label::INT % 5 || '' = key[2:] AND label::INT % 3 <> 0 AS expected FROM ss)"


def _series_sql(src, keys, out):
    return f"{out} AS (SELECT {keys}, avg(score) AS mean, max(score) AS max, list_avg(list_sort(list(score), 'DESC')[1:2]) AS top2_mean FROM {src} GROUP BY {keys})"


_A10 = f"WITH {_PRIMARY}, {_series_sql('pe', 'label, key, prompt, expected', 'pm')}, pp AS (SELECT key, prompt, round(avg(round(mean, 12)) FILTER (expected) - 0.6::DOUBLE * coalesce(avg(round(mean, 12)) FILTER (NOT expected), 0), 9) AS metric FROM pm GROUP BY ALL), pc AS (SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY key ORDER BY metric DESC NULLS LAST, prompt) = 1)"
_A11 = f", {_SUPPORT}, {_series_sql('se', 'label, key, prompt, expected', 'sm')}, sp AS (SELECT key, prompt, round(avg(round(top2_mean, 12)) FILTER (expected) - 0.6::DOUBLE * coalesce(avg(round(top2_mean, 12)) FILTER (NOT expected), 0), 9) AS metric FROM sm GROUP BY ALL), sr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY metric DESC NULLS LAST, prompt DESC) AS r, coalesce(bool_or(metric > 0) OVER (PARTITION BY key), false) AS got, min(prompt) OVER (PARTITION BY key) = prompt AS first FROM sp), sc AS (SELECT key, prompt, metric FROM sr WHERE (NOT got AND first) OR (got AND metric > 0 AND r <= 2))"
_A8 = f", wm AS (SELECT label, key, window_idx, max(score) AS score FROM ss JOIN sc USING (key, prompt) GROUP BY ALL), {_series_sql('wm', 'label, key', 'sup')}"
_A12 = """, prim AS (SELECT label, max(m) AS primary_score FROM (SELECT label, key, avg(score) AS m FROM ps JOIN pc USING (key, prompt) GROUP BY ALL) GROUP BY 1),
g AS (SELECT a.i * 42 + x.i * 6 + r.i AS place, ['mean', 'max', 'top2_mean'][a.i + 1] AS aggregation, [0.03, 0.05, 0.07, 0.09, 0.12, 0.15, 0.2][x.i + 1]::DOUBLE AS absolute, [0.05, 0.08, 0.1, 0.12, 0.16, 0.2][r.i + 1]::DOUBLE AS ratio FROM range(3) a(i), range(7) x(i), range(6) r(i)),
t AS (SELECT key, place, aggregation, absolute, ratio, label::INT % 5 || '' = key[2:] AND label::INT % 3 <> 0 AS e, CASE aggregation WHEN 'mean' THEN mean WHEN 'max' THEN max ELSE top2_mean END >= greatest(absolute, primary_score * ratio) AS p FROM sup JOIN prim USING (label), g),
c AS (SELECT key, place, count(*) FILTER (p AND e) AS tp, count(*) FILTER (p AND NOT e) AS fp, count(*) FILTER (NOT p AND e) AS fn FROM t GROUP BY ALL)
SELECT key, place::INT AS place, tp, fp, fn FROM c"""


def _expected(rows, keys: int):
    label = F.col("label").cast("int")
    return rows.withColumn("expected", (F.concat(F.lit("k"), (label % keys).cast("string")) == F.col("key")) & (label % 3 != 0))


def _primary(spark, d):
    return _expected(_scores(spark, d, 0, 4, 3), 4)


def _support(spark, d):
    return _expected(_scores(spark, d, 12, 5, 3), 5)


@query(_A10 + " SELECT * FROM pc")
def a10_primary_prompts(spark, d):
    return C.primary_prompts(_primary(spark, d))


@query(_A10 + _A11 + " SELECT * FROM sc")
def a11_supporting_prompts(spark, d):
    return C.supporting_prompts(_support(spark, d))


@query(_A10 + _A11 + _A8 + " SELECT label, key, round(mean, 9) AS mean, round(max, 9) AS max, round(top2_mean, 9) AS top2_mean FROM sup")
def a8_window_max(spark, d):
    rows = C.window_max(_support(spark, d), C.supporting_prompts(_support(spark, d)))
    return rows.select("label", "key", *[F.round(c, 9).alias(c) for c in C.AGGREGATIONS])


def _grid(spark, d):
    support = _expected(C.window_max(_support(spark, d), C.supporting_prompts(_support(spark, d))), 5)
    prompts = C.primary_prompts(_primary(spark, d))
    primary = C.series(_primary(spark, d).join(F.broadcast(prompts), ["key", "prompt"], "left_semi"), "label", "key").groupBy("label").agg(F.max("mean").alias("primary_score"))
    return C.grid_metrics(support, primary)


@query(_A10 + _A11 + _A8 + _A12)
def a12_threshold_grid(spark, d):
    return _grid(spark, d).select("key", "place", "tp", "fp", "fn")


_H6 = (_A10 + _A11 + _A8 + _A12).replace("WITH ", "WITH RECURSIVE ", 1).rpartition("\nSELECT")[0] + """,
q AS (SELECT key, place, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS rc FROM c),
v AS (SELECT *, CASE WHEN p + rc > 0 THEN round(1.25::DOUBLE * p * rc / (0.25::DOUBLE * p + rc), 12) ELSE 0 END::DOUBLE AS m FROM q),
r AS (SELECT key, place, place AS won, p, rc, m FROM v WHERE place = 0 UNION ALL
  SELECT key, place, CASE WHEN b THEN place ELSE won END, CASE WHEN b THEN p ELSE bp END, CASE WHEN b THEN rc ELSE brc END, CASE WHEN b THEN m ELSE bm END FROM
  (SELECT v.key, v.place, r.won, v.p, v.rc, v.m, r.p AS bp, r.rc AS brc, r.m AS bm, v.m > r.m OR (v.m = r.m AND 2 * v.p + 0.1::DOUBLE * v.rc > r.p + 0.1::DOUBLE * r.rc) AS b FROM r JOIN v ON v.key = r.key AND v.place = r.place + 1))
SELECT key, aggregation, absolute, ratio FROM r JOIN g ON g.place = r.won WHERE r.place = 125"""


@query(_H6)
def h6_grid_winner(spark, d):
    """The rule of each key; tests hold the walk against cases whose winners depend on the order."""
    return C.grid_winner(_grid(spark, d))


_NAMES = "['Television', 'Speech', 'Music', 'Radio', 'Lecture', 'Wind', 'Water', 'News'][i % 8 + 1]"


@query(f"""WITH m AS (SELECT label, i, avg(embedding[i + 1]::DOUBLE * 20) AS m FROM embeddings, unnest(range(0, 64)) t(i) GROUP BY ALL), e AS (SELECT *, exp(m - max(m) OVER (PARTITION BY label)) AS e FROM m), p AS (SELECT *, e / sum(e) OVER (PARTITION BY label) AS p FROM e),
r AS (SELECT *, {_NAMES} || ' ' || i AS name, row_number() OVER (PARTITION BY label ORDER BY p DESC, i) AS k FROM p), s AS (SELECT label, round(sum(p) FILTER (i % 8 IN (0, 3, 7)), 9) AS tv_score, round(sum(p) FILTER (i % 8 IN (1, 4)), 9) AS speech_score, string_agg(name, ', ' ORDER BY k) FILTER (k <= 8) AS top_labels FROM r GROUP BY 1)
SELECT *, CASE WHEN tv_score >= 0.2 AND tv_score > speech_score THEN 'television' WHEN speech_score >= 0.2 AND speech_score >= tv_score THEN 'speech' END AS hint FROM s""")
def a14_o7_classify_logits(spark, d):
    logits = X.table(spark, d, "embeddings").select("label", F.posexplode(F.transform("embedding", lambda x: x.cast("double") * 20)).alias("class_id", "logit"))
    kinds = F.element_at(F.array(*[F.lit(n) for n in ("Television", "Speech", "Music", "Radio", "Lecture", "Wind", "Water", "News")]), (F.col("class_id") % 8 + 1).cast("int"))
    names = logits.select("class_id").distinct().withColumn("name", F.concat(kinds, F.lit(" "), "class_id"))
    return C.classify_logits(logits, names)


_KEYS = ("software_demo", "meeting_room_speech", "podcast_voiceover", "broadcast_playback")
_F24 = f"""WITH s AS (SELECT vec_id AS label, list_transform(range(0, 4), lambda i: round(1 / (1 + exp(-embedding[i + 1]::DOUBLE * 8)), 9)) AS v FROM embeddings), k AS (SELECT label, v, list_reverse_sort(v) AS o, v[1] >= 0.6 AND v[2] >= 0.6 AND round(abs(v[1] - v[2]), 9) <= 0.12 AND greatest(v[1], v[2]) >= greatest(v[3], v[4]) AS mg FROM s),
n AS (SELECT label, CASE WHEN mg THEN 'software_demo_direct_speech' ELSE {list(_KEYS)}[list_position(v, o[1])] END AS key, CASE WHEN mg THEN greatest(v[1], v[2]) ELSE o[1] END AS score, round(CASE WHEN mg THEN greatest(v[1], v[2]) - o[1] ELSE o[1] - o[2] END, 9) AS margin FROM k),
p AS (SELECT *, CASE WHEN score >= 0.55 OR margin >= 0.25 THEN 'high' WHEN score >= 0.32 OR margin >= 0.12 THEN 'medium' ELSE 'low' END AS confidence FROM n WHERE score >= 0.6)"""


def _context(spark, d):
    named = F.element_at(F.array(*[F.lit(k) for k in _KEYS]), F.col("i") + 1)
    rows = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("label"), F.posexplode(F.slice("embedding", 1, 4)).alias("i", "v"))
    return C.primary_context(rows.select("label", named.alias("key"), F.round(1 / (1 + F.exp(-F.col("v").cast("double") * 8)), 9).alias("score")), 0.6)


@query(_F24 + " SELECT * FROM p")
def f24_primary_context(spark, d):
    return _context(spark, d)


@query(_F24 + """, u AS (SELECT vec_id AS label, 's' || i AS key, round(1 / (1 + exp(-embedding[i + 11]::DOUBLE * 8)), 9) AS x FROM embeddings, unnest(range(0, 5)) t(i)), c AS (SELECT u.label, u.key, x, CASE u.key WHEN 's1' THEN greatest(0.5, score * 0.9) WHEN 's2' THEN greatest(0.7, score * 0.1) ELSE greatest(0.2, score * 0.35) END::DOUBLE AS cut FROM u JOIN p USING (label))
SELECT label, key, x AS score, (row_number() OVER (PARTITION BY label ORDER BY x DESC, key))::INT AS "rank" FROM c WHERE x >= cut QUALIFY "rank" <= 2""")
def f25_supporting_context(spark, d):
    rows = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("label"), F.posexplode(F.slice("embedding", 11, 5)).alias("i", "v"))
    rows = rows.select("label", F.concat(F.lit("s"), "i").alias("key"), F.round(1 / (1 + F.exp(-F.col("v").cast("double") * 8)), 9).alias("score"))
    rules = spark.createDataFrame([("s1", 0.5, 0.9), ("s2", 0.7, 0.1)], "key string, absolute double, ratio double")
    return C.supporting_context(rows, _context(spark, d), rules)


@query(_F24 + """, u AS (SELECT vec_id AS label, 's' || i AS key, round(1 / (1 + exp(-embedding[i + 11]::DOUBLE * 8)), 9) AS x FROM embeddings, unnest(range(0, 5)) t(i)), c AS (SELECT u.label, u.key, x, CASE u.key WHEN 's1' THEN greatest(0.5, score * 0.9) WHEN 's2' THEN greatest(0.7, score * 0.1) ELSE greatest(0.2, score * 0.35) END::DOUBLE AS cut FROM u JOIN p USING (label)),
r AS (SELECT label, key, row_number() OVER (PARTITION BY label ORDER BY x DESC, key) AS k FROM c WHERE x >= cut QUALIFY k <= 2), m AS (SELECT label, string_agg('sum ' || key, '; ' ORDER BY k) AS cues, list('hint ' || key[2:]::INT // 2 ORDER BY k) AS hs FROM r GROUP BY label)
SELECT s.label, coalesce(array_to_string((SELECT list(h ORDER BY i) FROM (SELECT h, min(i) AS i FROM (SELECT unnest(list_filter([CASE WHEN p.key IS NOT NULL THEN 'hint ' || p.key END] || coalesce(hs, []), lambda h: h IS NOT NULL)) AS h, generate_subscripts(list_filter([CASE WHEN p.key IS NOT NULL THEN 'hint ' || p.key END] || coalesce(hs, []), lambda h: h IS NOT NULL), 1) AS i) GROUP BY h ORDER BY i LIMIT 2)), '|'), '') AS hints,
concat_ws(' ', 'Primary audio context: name ' || p.key || ' (' || p.confidence || ' confidence).', 'Supporting audio cues: ' || cues || '.') AS summary_context, v[4] AS tv_score, round(v[1] + v[2] + v[3], 9) AS speech_score FROM s LEFT JOIN p USING (label) LEFT JOIN m USING (label)""")
def f25_audio_context(spark, d):
    """Hints and sentences of each recording, with names made from keys; two supporting keys share each hint."""
    named = F.element_at(F.array(*[F.lit(k) for k in _KEYS]), F.col("i") + 1)
    score = F.round(1 / (1 + F.exp(-F.col("v").cast("double") * 8)), 9).alias("score")
    scores = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("label"), F.posexplode(F.slice("embedding", 1, 4)).alias("i", "v")).select("label", named.alias("key"), score)
    names = [(k, f"name {k}", f"sum {k}", f"hint {k}") for k in (*_KEYS, "software_demo_direct_speech")] + [(f"s{i}", "", f"sum s{i}", f"hint {i // 2}") for i in range(5)]
    names = spark.createDataFrame(names, "key string, name string, summary_name string, hint string")
    out = C.audio_context(scores, _context(spark, d), f25_supporting_context(spark, d), names)
    return out.withColumn("hints", F.array_join("hints", "|"))


@query(_A10 + _A11 + """ SELECT 'primary' AS part, key, prompt FROM pc UNION ALL SELECT 'supporting', key, prompt FROM sc""")
def a13_profile_prompts(spark, d):
    """The prompts of the calibration profile; its rules are h6_grid_winner's."""
    found = C.profile(C.primary_prompts(_primary(spark, d)), C.supporting_prompts(_support(spark, d)), C.grid_winner(_grid(spark, d)))
    rows = [("primary", k, p) for k, p in found["primary_prompts"].items()] + [("supporting", k, p) for k, ps in found["supporting_prompts"].items() for p in ps]
    return spark.createDataFrame(rows, "part string, key string, prompt string")


@query("SELECT coalesce(source, 'none') || '-' || doc_id AS label, '/media/' || coalesce(source, 'none') || '-' || doc_id || '.wav' AS path, lang AS expected_primary_key, CASE WHEN doc_id % 2 = 0 THEN 'music,speech' ELSE '' END AS keys, doc_id % 3 <> 0 AS use_for_calibration FROM documents")
def s6_manifest(spark, d):
    """A manifest with a fixture for every document."""
    v = F.col("doc_id")
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), "doc_id")
    keys = F.when(v % 2 == 0, F.array(F.lit(" speech "), F.lit("music"), F.lit("")))
    none = F.lit(None).cast("string")
    f = F.struct(none.alias("label"), F.when(v % 5 > 0, F.concat(name, F.lit(".wav"))).alias("media_path"), F.concat(F.lit("/media/"), name, F.lit(".wav")).alias("audio_path"), none.alias("video_path"), F.col("lang").alias("expected_primary_key"), keys.alias("expected_supporting_keys"), F.when(v % 3 == 0, False).alias("use_for_calibration"))
    made = C.manifest_fixtures(X.table(spark, d, "documents").select(F.array(f).alias("fixtures")), "/media/")
    return made.select("label", "path", "expected_primary_key", F.array_join("expected_supporting_keys", ",").alias("keys"), "use_for_calibration")
