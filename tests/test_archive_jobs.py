"""Jobs without SQL against plain forms, and edge cases of the others."""

import hashlib
import random
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkarchive.functions import prompts, records, sequence, text as T
from talkarchive.operators import alike, blocks, calibration, duplicates, folds, frames, jobs, ranking, views
from talkarchive.sources import archive

RECORDING = "video_id long, segments array<string>, points array<string>, title string"


def _recordings(spark, rng, n=40):
    bases = [[" ".join(f"word{rng.randrange(60)}" for _ in range(8)) for _ in range(4)] for _ in range(6)]
    rows = []
    for i in range(n):
        segs = [s if rng.random() > 0.15 else s + f" extra{rng.randrange(9)}" for s in rng.choice(bases)]
        rows.append((i, segs, [], "t"))
    return rows + [(n, None, None, None), (n + 1, [], ["same point of one kind"], "x"), (n + 2, ["", None], ["same point of one kind"], "y"), (n + 3, rows[0][1], [], "t")]


def _score(a, b):
    toks = lambda s: [w for w in s.split() if len(w) > 2 and w not in T.DUPLICATE_STOPWORDS]
    (sa, pa), (sb, pb) = a, b
    ta, tb = toks(f"{sa} {pa}"), toks(f"{sb} {pb}")
    x, y = set(ta), set(tb)
    if not x & y:
        return 0.0
    if sa and sa == sb:
        return 1.0
    ba, bb = set(zip(ta, ta[1:])), set(zip(tb, tb[1:]))
    r = SequenceMatcher(None, (sa or pa)[:4000], (sb or pb)[:4000]).ratio()
    s = 0.4 * len(x & y) / min(len(x), len(y)) + 0.3 * r + (0.2 * len(ba & bb) / len(ba | bb) if ba | bb else 0) + 0.1 * len(x & y) / len(x | y)
    if sa and sb:
        u, v = set(toks(sa)), set(toks(sb))
        s = max(s, 0.55 * len(u & v) / min(len(u), len(v)) + 0.45 * r)
    return min(s, 1.0)


def _directed(text):
    return {(a, b): _score(text[a], text[b]) for a in text for b in text if a != b}


def test_duplicate_jobs_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = _recordings(spark, rng)
    # the same speech with key points that differ, and recordings that share key points only
    many = lambda k: [f"point{k}x{j} other{k}y{j}" for j in range(18)]
    rows += [(100 + k, ["five spoken words are heard", "in every one of them"], many(k), "t") for k in range(3)]
    rows += [(110 + k, [f"speech {k} alone"], ["budget was agreed", "launch in spring", "hire two people", "ship the release"], "t") for k in range(2)]
    rows += [(120, None, ["word"], "t"), (121, None, ["word"], "u")]
    prints = duplicates.fingerprints(spark.createDataFrame(rows, RECORDING))
    text = {i: (" ".join(s for s in (segs or []) if s), " ".join(p for p in (pts or []) if p)) for i, segs, pts, _ in rows}
    full = _directed(text)
    first = {i: min(j for j in text if text[j] == text[i]) for i in text}
    pairs = duplicates.pair_scores(prints).cache()
    got = {(r.source, r.candidate): round(r.score, 6) for r in pairs.collect()}
    alike = lambda a, b: text[a][0] and text[a][0] == text[b][0]
    lead = {i: min(j for j in text if j == i or alike(i, j)) for i in text}
    want = {k: round(v, 6) for k, v in full.items() if v >= 0.85 and first[k[0]] == k[0] and first[k[1]] == k[1]}
    assert got == {k: v for k, v in want.items() if not alike(*k) or lead[k[0]] in k} and (101, 100) in got

    kept = []
    for i in sorted(text):
        if not any(full[i, k] >= 0.85 for k in kept):
            kept.append(i)
    out = {r.video_id: r.suppressed for r in duplicates.suppress_in_order(prints, pairs).collect()}
    assert out == {i: i not in kept for i in text}
    for policy in ("warn", "off"):
        assert not any(r.suppressed for r in duplicates.suppress_in_order(prints, pairs, policy).collect())

    best = {r.video_id: (round(r.score, 6), r.match_id) for r in duplicates.best_matches(prints, pairs=pairs).collect()}
    most = {i: max((round(full[i, j], 9), -j) for j in text if j != i) for i in text}
    assert best == {i: (round(s, 6), -j) for i, (s, j) in most.items() if s > 0}
    notes = duplicates.match_notes(duplicates.best_matches(prints, least=0.85, pairs=pairs))
    assert {r.video_id for r in notes.collect()} == {i for i, (s, _) in most.items() if s >= 0.85}
    assert duplicates.match_notes(duplicates.best_matches(prints, least=0.85, pairs=pairs), "off").count() == 0


def test_fingerprints_hold_topics_and_executive_summary(spark):
    kind = RECORDING + ", topics array<struct<topic string, summary string>>, executive_summary string"
    rows = [(1, ["R O C M is on"], ["p"], "t", [("Budget", "two years"), (None, None)], " all  agreed "), (2, None, None, "Only title", None, None)]
    got = {r.video_id: (r.spoken, r.points, r.text) for r in duplicates.fingerprints(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("ROCM is on", "p Budget two years all agreed", "ROCM is on p Budget two years all agreed"), 2: ("", "", "Only title")}


def test_empty_recordings(spark):
    prints = duplicates.fingerprints(spark.createDataFrame([], RECORDING))
    pairs = duplicates.pair_scores(prints)
    assert pairs.count() == 0 and duplicates.suppress_in_order(prints, pairs).count() == 0


def test_collapse_equals_plain_walk(spark):
    rng = random.Random(2)
    rows = [(q, rng.randrange(4), rng.choice(["transcript", "topic"]), rng.choice(["alpha beta gamma delta", "beta  alpha gamma delta delta", "one two"]) + " " * rng.randrange(3), None, "t", "", rng.randrange(3), round(rng.random() / 4, 3)) for q in range(6) for _ in range(12)]
    schema = "query_id long, video_id long, kind string, text string, timestamp double, title string, context string, created long, score double"
    df = spark.createDataFrame(sorted(set(rows), key=str), schema)
    got = sorted(tuple(r) for r in ranking.collapse(df).select("query_id", "kind", "score").collect())
    weight, want = {"transcript": 1.0, "topic": 0.92}, []
    for q in range(6):
        length = lambda r: len(" ".join(r[3].split()))
        mine = sorted((r for r in set(rows) if r[0] == q), key=lambda r: (-r[8], -weight[r[2]], -r[7], -length(r), r[1], r[3]))
        held = {}
        for r in mine:
            if len(set(r[3].split())) < 4:
                want.append((q, r[2], r[8]))
                continue
            key, old = r[2], held.get(r[2])
            if old is None or (round(abs(r[8] - old[8]), 9) <= 0.05 and (weight[r[2]], r[7], length(r)) > (weight[old[2]], old[7], length(old))):
                held[key] = r
        want += [(q, r[2], r[8]) for r in held.values()]
    assert got == sorted(want)


def test_grid_winner_depends_on_order(spark):
    rows = [("a", 0, "mean", 0.03, 0.05, 0.5, 0.6, 0.7), ("a", 1, "max", 0.05, 0.05, 0.5, 0.6, 0.7), ("b", 0, "mean", 0.03, 0.05, 0.0, 0.0, 0.0), ("b", 1, "max", 0.05, 0.05, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "key string, place int, aggregation string, absolute double, ratio double, metric double, precision double, recall double")
    rules = calibration.grid_winner(df)
    assert {r.key: r.aggregation for r in rules.collect()} == {"a": "max", "b": "mean"}
    chosen = spark.createDataFrame([("a", "p", 0.1)], "key string, prompt string, metric double")
    made = calibration.profile(chosen, chosen, rules, {"version": 2}, {"n": 1})
    assert made["version"] == 2 and made["primary_prompts"] == {"a": "p"} and made["supporting_prompts"] == {"a": ["p"]}
    assert made["supporting_rules"]["a"] == {"aggregation": "max", "absolute_min_score": 0.05, "relative_ratio": 0.05}


def test_keyframes(spark):
    flat, ramp, other = [10.0] * 72, [float(i % 9 * 9) for i in range(72)], [float(80 - i % 9 * 9) for i in range(72)]
    shots = [flat, flat, ramp, ramp, other, flat, other, other]
    df = spark.createDataFrame([(1, float(t), s) for t, s in enumerate(shots)] + [(2, 0.0, None)], "video_id long, timestamp double, signature array<double>")
    got = [(r.timestamp, r.reason) for r in frames.keyframes(df).orderBy("scene_idx").collect()]
    assert got == [(0.0, "initial"), (2.0, "change"), (6.0, "change")]
    assert frames.keyframes(df, most=2).count() == 2
    h = df.where("video_id = 1").select(frames.difference_hash(F.col("signature")).alias("h")).distinct().collect()
    bits = sorted(r.h for r in h)
    assert len(bits) == 2 and bits[0] == "0" * 64 and set(bits[1]) == {"1"}
    row = spark.createDataFrame([(bits[0], bits[1])], "a string, b string").select(frames.hash_distance(F.col("a"), F.col("b")).alias("d"), frames.hash_distance(F.col("a"), F.lit(None)).alias("n")).first()
    assert tuple(row) == (64, 999)


def test_repeated_heads(spark):
    rows = [(1, 0, "we start with the plan"), (1, 1, "the plan is short"), (1, 2, "is short"), (1, 3, "so we stop"), (2, 0, None)]
    got = folds.drop_repeated_heads(spark.createDataFrame(rows, "video_id long, piece_idx long, text string")).orderBy("video_id", "piece_idx").collect()
    assert [r.text for r in got] == ["we start with the plan", "is short", "", "so we stop", ""]


def test_throttle(spark):
    rows = [(1, "s", i, float(a), float(p)) for i, (a, p) in enumerate([(0, 0), (0.1, 0.5), (0.2, 1.0), (0.9, 1.5), (1.3, 1.6), (1.4, 100)])]
    got = folds.throttle(spark.createDataFrame(rows, "job_id long, step string, event_id long, at double, progress double")).orderBy("event_id").collect()
    assert [r.sent for r in got] == [True, False, True, False, True, True]


def test_joined_letters_and_records(spark):
    c = lambda s: T.joined_letters(F.lit(s))
    row = spark.range(1).select(c("R O C M is on"), c('a b cd "R" O. C, x1'), c(""), c(" a  b "), records.clean_tags(F.array(F.lit("  Alpha "), F.lit("alpha"), F.lit(""), F.lit("Beta"), F.lit(None))), records.clean_tags(F.array(F.lit(" ")))).first()
    assert tuple(row) == ("ROCM is on", "a b cd ROC x1", "", "a b", ["Alpha", "Beta"], None)
    made = spark.createDataFrame([("[1, 2]",), ("plain",), (None,), ('{"ocr_text": null, "bullets": null, "is_slide": false}',)], "a string").select(records.vision_answer(F.col("a")).alias("v")).collect()
    assert [(r.v.ocr_text, r.v.is_slide, r.v.key_points) for r in made] == [("", False, [])] * 4


def test_ids_lift_suppression(spark):
    rows = spark.createDataFrame([(1, "t", None, None, False, ["A"]), (2, "t", None, None, True, ["a"]), (3, None, None, None, False, None)], "video_id long, transcript string, summary string, slides string, suppressed boolean, tags array<string>")
    assert [r.video_id for r in views.search_candidates(rows).collect()] == [1]
    assert [r.video_id for r in views.search_candidates(rows, spark.createDataFrame([(2,)], "video_id long"), ["A"]).collect()] == [2]


def test_files_and_index(spark, tmp_path):
    for name, body in (("7", '{"segments": [{"start": 0, "end": 1, "text": "hi"}]}'), ("8", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "transcript.json").write_text(body)
    got = {r.video_id: r.segments for r in archive.step_files(spark, f"{tmp_path}/*/transcript.json", "segments " + archive.TRANSCRIPT[len("struct<segments: ") : -1]).collect()}
    assert got["7"][0].text == "hi" and got["8"] is None
    first = spark.createDataFrame([("m", 1, "a"), ("m", 2, "b"), ("n", 1, "c")], "namespace string, video_id long, text string")
    new = archive.replace_chunks(first, spark.createDataFrame([(1, "z")], "video_id long, text string"), "m")
    assert sorted(tuple(r) for r in new.select("namespace", "video_id", "text").collect()) == [("m", 1, "z"), ("m", 2, "b"), ("n", 1, "c")]


def test_manifest(spark):
    fixture = "label string, media_path string, audio_path string, video_path string, expected_primary_key string, expected_supporting_keys array<string>, use_for_calibration boolean"
    df = spark.createDataFrame([([("x", None, "/abs/a.wav", None, "k", [" b", "a ", ""], None), (None, "clips/talk.one.mp4", None, None, None, None, False)],)], f"fixtures array<struct<{fixture.replace(' ', ':').replace(',:', ', ')}>>")
    got = [tuple(r) for r in calibration.manifest_fixtures(df, "/data/").collect()]
    assert got == [("x", "/abs/a.wav", "k", ["a", "b"], True), ("talk.one", "/data/clips/talk.one.mp4", None, [], False)]


def test_answer_context(spark):
    cols = {"video_id": "long", "kind": "string", "title": "string", "timestamp": "double", "text": "string", "context": "string", "score": "double", "created": "long"}
    rows = [(1, 7, "transcript", "Plan", 65.0, "We ship.", "before / after", 0.99, 1), (1, 8, "summary", "Notes", None, "All agreed.", "", 0.5, None), (1, 9, "slide", None, 3.0, "Left out.", None, 0.1, 2)]
    found = spark.createDataFrame(rows, "query_id long, " + ", ".join(f"{k} {v}" for k, v in cols.items()))
    asked = spark.createDataFrame([(1,), (2,), (2,)], "query_id long")
    got = {r.query_id: r for r in ranking.answer_context(found, 2, asked).collect()}
    assert got[1].context == "Source 1: Plan @ 00:01:05\nWe ship.\nSupporting context: before / after\nSource 2: Notes\nAll agreed."
    assert got[1].confidence == 0.95 and got[1].answer is None
    assert got[2].context is None and got[2].confidence == 0.0 and got[2].answer == ranking.NO_ANSWER


def test_token_vectors(spark):
    texts = ["Budget review, budget!", "", None, "é !!", "a " * 300 + "b"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.token_vector(F.col("t")).alias("v")).collect():
        counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 64 for w in re.findall("[a-z0-9]+", (r.t or "").lower()))
        norm = sum(n * n for n in counts.values()) ** 0.5 or 1
        assert len(r.v) == 64 and all(abs(x - counts[k] / norm) < 1e-6 for k, x in enumerate(r.v))


def test_frames_without_speech_are_left_as_they_are(spark):
    seen = spark.createDataFrame([(1, 0, 0.0, "slack"), (1, 1, 5.0, "plan slack"), (2, 0, 0.0, "slack"), (3, 0, 0.0, None)], "video_id long, frame_id long, timestamp double, ocr_text string")
    segs = spark.createDataFrame([(1, 0.0, 4.0, "the plan"), (3, 0.0, 1.0, None)], "video_id long, start double, end double, text string")
    got = {(r.video_id, r.frame_id): (r.relevance_score, r.low_relevance) for r in frames.relevance(seen, segs).collect()}
    assert got == {(1, 0): (0.0, True), (1, 1): (0.5, False), (2, 0): (None, False), (3, 0): (0.0, False)}


def test_poor_keyframes_give_way_to_intervals(spark):
    still = [1.0] * 72
    pictures = spark.createDataFrame([(v, float(t), still) for v in (1, 2) for t in range(3)], "video_id long, timestamp double, signature array<double>")
    lengths = spark.createDataFrame([(1, 12.0), (2, 4.0), (3, 2.0)], "video_id long, duration double")
    found = lambda **k: sorted((r.video_id, r.timestamp, r.reason) for r in frames.keyframes_or_intervals(pictures, lengths, **k).collect())
    assert found() == [(1, 0.0, "interval"), (1, 4.0, "interval"), (1, 8.0, "interval"), (2, 0.0, "initial"), (3, 0.0, "interval")]
    assert found(most=2) == [(1, 0.0, "interval"), (1, 6.0, "interval"), (2, 0.0, "initial"), (3, 0.0, "interval")]


def test_retry_and_cancelled_batch(spark):
    rows = spark.createDataFrame([(1, 7, "b", "failed", 1, "boom", 2), (2, 7, "b", "failed", 0, "x", 1), (3, 8, "b", "failed", 0, "x", 1), (4, 8, "b", "queued", 0, None, 2)], "job_id long, video_id long, batch_id string, status string, retry_count int, error_message string, created_at long")
    assert [(r.job_id, r.status, r.retry_count, r.error_message) for r in jobs.to_retry(rows).collect()] == [(1, "queued", 2, None)]
    batches = spark.createDataFrame([("b", "processing"), ("c", "queued")], "batch_id string, status string")
    assert [tuple(r) for name in "bcx" for r in jobs.cancelled_batch(batches, rows, name).collect()] == [("b", "cancelled", 1), ("c", "cancelled", 0)]


def test_most_similar_equals_all_pairs(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(("hot1", "hot2", "hot3", f"word{rng.randrange(60)}", f"rare{rng.randrange(400)}")) for _ in range(rng.choice((1, 2, 5, 20, 60))))) for i in range(120)] + [(200, None), (201, "of a")]
    df = spark.createDataFrame(rows, "video_id long, text string")
    sets = {i: set(t.split()) for i, t in rows[:120]}
    want = set()
    for s, a in sets.items():
        found = sorted((-round(0.7 * len(a & b) / len(a) + 0.3 * len(a & b) / len(b), 6), v) for v, b in sets.items() if v != s and a & b)
        want |= {(s, v, -x, k + 1) for k, (x, v) in enumerate(found[:7])}
    for hot in (1, 9, 1000):
        got = {tuple(r) for r in ranking.most_similar(df, 7, hot=hot).select("source_id", "video_id", "lexical", "rank").collect()}
        assert {(s, v, k) for s, v, _, k in got} == {(s, v, k) for s, v, _, k in want} and all(abs(x - y) < 2e-6 for (*_, x, _), (*_, y, _) in zip(sorted(got), sorted(want)))
    some = spark.createDataFrame([(3,), (200,)], "video_id long")
    assert {tuple(r)[:2] for r in ranking.most_similar(df, 7, some, 9).collect()} == {w[:2] for w in want if w[0] == 3}


def test_similarity_text(spark):
    kind = "video_id long, title string, segments array<string>, key_points array<string>, executive_summary string"
    rows = [(1, "T", ["a", None, "b"], ["k", "", None], "long"), (2, "T", None, None, "long"), (3, None, [""], None, "long"), (4, "", None, ["k"], "long"), (5, None, None, None, None), (6, None, [f"s{i}" for i in range(30)], None, "x")]
    got = {r.video_id: r.text for r in ranking.similarity_text(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: "T a b k", 2: "T long", 3: "long", 4: "k long", 5: "", 6: " ".join(f"s{i}" for i in range(24))}


def test_audio_section(spark):
    P, S = "struct<label:string, confidence:string, score:double, hint:string>", "array<struct<label:string, key:string, hint:string>>"
    kind = f"n int, summary string, primary {P}, supporting {S}, hints array<string>, seen array<string>"
    rows = [
        (0, None, None, None, None, None), (1, " Loud. ", ("Demo", "high", 0.456, "h1"), [("", "music", "h2"), ("Clapping", "c", None), (None, None, None)], ["h1", " h3", "", None, "h2", "h3", "h4", "h5"], ["TV."]),
        (2, "", (None, None, None, None), [], [], []), (3, None, None, [("x", "y", "z")], ["z"], None),
    ]
    got = {r.n: r.s.split("\n")[1:] for r in spark.createDataFrame(rows, kind).select("n", prompts.audio_section(*[F.col(c) for c in ("summary", "primary", "supporting", "hints", "seen")]).alias("s")).collect()}
    assert got == {
        0: [], 2: ["- Primary classification: unknown audio context (unspecified confidence)."], 3: ["- Supporting classifier cues: x."],
        1: ["- Classifier summary: Loud.", "- Primary classification: Demo (high confidence, score 0.46).", "- Supporting classifier cues: music, Clapping, unknown cue.", "- Additional audio hint: h3", "- Additional audio hint: h4", "- Visual corroboration: TV."],
    }


@pytest.mark.parametrize(("crowd", "rounds"), [(0.0, 2), (3.0, 8), (1e9, 8)])
def test_leaders_suppress_what_arrival_order_does(spark, crowd, rounds):
    rng = random.Random(12)
    rows = _recordings(spark, rng, 30)
    rows += [(200 + k, ["of the", "and"], [f"note {k} about budget plans"], "t") for k in range(3)]  # equal speech without tokens
    near = [[f"line{i} token{i}x{j}" for j in range(12)] for i in range(4)]
    for k in range(30):  # one cluster, a word or two changed in each
        lines = [list(x) for x in near]
        for _ in range(rng.choice((1, 1, 2, 14))):
            rng.choice(lines)[rng.randrange(12)] = f"changed{rng.randrange(40)}"
        rows.append((300 + k, [" ".join(x) for x in lines], [], "t"))
    rng.shuffle(rows)
    text = {i: (" ".join(s for s in (segs or []) if s), " ".join(p for p in (pts or []) if p)) for i, segs, pts, _ in rows}
    kept = []
    for i in sorted(text):
        if all(_score(text[i], text[k]) < 0.85 for k in kept):
            kept.append(i)
    prints = duplicates.fingerprints(spark.createDataFrame(rows, RECORDING))
    got = {r.video_id: r.suppressed for r in duplicates.suppress_by_leaders(prints, crowd=crowd, rounds=rounds, few=0).collect()}
    assert got == {i: i not in kept for i in text} and 10 < len(kept) < len(text) - 20
    assert not any(r.suppressed for r in duplicates.suppress_by_leaders(prints, "warn").collect())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lexical_scores_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(blocks, "DENSE", 512)
    rng = random.Random(11)
    rows = [(i, " ".join(f"word{int(rng.random() ** 3 * 300)}" for _ in range(rng.choice((1, 8, 64, 200))))) for i in range(150)] + [(None, "word1"), (200, None), (201, "of a")]
    df = spark.createDataFrame(rows, "video_id long, text string").repartition(3)
    sets = {i: set(t.split()) for i, t in rows[:150]}
    half_up = lambda x: float(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    score = lambda a, b: half_up(0.7 * len(a & b) / len(a) + 0.3 * len(a & b) / len(b))
    want = {(s, v, score(a, b)) for s, a in sets.items() for v, b in sets.items() if s != v and a & b}
    got = ranking.lexical_similar(df, df.where("video_id % 10 = 0"))
    assert "Exchange hash" not in _plan(got) and "SortMergeJoin" not in _plan(got)
    assert {tuple(r) for r in got.collect()} == {w for w in want if w[0] % 10 == 0}
    assert {tuple(r) for r in ranking.lexical_similar(df).collect()} == want


def test_packed_blocks_hold_all_sets(spark):
    rows = [(i, list(range(i % 40))) for i in range(300)]
    sets = spark.createDataFrame(rows, "video_id long, t array<long>")
    for most in (1, 30, 10_000):
        tables = [blocks._read(bytes(r.block)) for r in blocks.packed(sets, most=most).collect()]
        assert sorted((i, t) for x in tables for i, t in zip(x["video_id"].to_pylist(), x["t"].to_pylist())) == rows
        assert all(len(x) == 1 or sum(len(t) + 1 for t in x["t"].to_pylist()) <= most for x in tables)


def test_similar_by_tokens_equals_similar(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(f"word{int(rng.random() ** 2 * 40)}" for _ in range(n))
    rows = [(i, text(rng.choice((1, 6, 30))) if i % 9 else None, rng.choice(("src one", "src two", "", None)), rng.choice(("english", "of", None))) for i in range(90)]
    rows += [(100 + i, *rows[1][1:]) for i in range(12)]
    docs = spark.createDataFrame(rows, "video_id long, spoken string, points string, title string").repartition(3).cache()
    lexical = ranking.lexical_similar(docs.withColumnRenamed("spoken", "text"), docs.where("video_id % 4 = 1"))
    semantic = lexical.where("video_id % 3 = 0").select("source_id", "video_id", F.round(F.col("lexical") * 0.8, 6).alias("semantic"))
    want = {tuple(r) for r in ranking.similar(semantic, lexical, docs).collect()}
    got = ranking.similar_by_tokens(docs, docs.where("video_id % 4 = 1"), lambda ids, x: np.where(ids % 3 == 0, blocks.rounded(x * 0.8), 0.0))
    assert "SortMergeJoin" not in _plan(got)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_matches_are_difflibs():
    rng = random.Random(13)
    for _ in range(400):
        letters = rng.choice(("ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz     eeeett", "日本語テキストabc", "x"))
        a = "".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 5, 40, 199, 200, 400))))
        b = list(a) if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.choice((0, 1, 40, 200, 300)))]
        for _ in range(rng.randrange(12) if b else 0):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randrange(4)] = [rng.choice(letters + "QZ") for _ in range(rng.randrange(4))]
        b = "".join(b)
        want, least = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()), rng.randrange(300)
        assert sequence.matches(a, b) == want and sequence.matches(a, b, least) == (want if want >= least else -1)


def test_cheap_terms_without_joins_of_sets(spark, monkeypatch):
    monkeypatch.setattr(alike, "CELLS", 64)
    monkeypatch.setattr(blocks, "BLOCK", 100)
    rng = random.Random(14)
    text = lambda: " ".join(f"tok{rng.randrange(24)}" for _ in range(rng.randrange(1, 26)))
    rows = [(i, text() if i % 5 else "", text()) for i in range(60)]  # what is said need not be part of the text
    f = duplicates.features(spark.createDataFrame(rows, "video_id long, spoken string, text string").withColumn("points", F.lit("")).repartition(3))
    found = duplicates.cheap_terms(f, 0.75)
    assert "SortMergeJoin" not in _plan(found)
    want = {}
    for a, sa, x in rows:
        for b, sb, y in rows:
            u, v, s, t = (set(z.split()) for z in (x, y, sa, sb))
            if a < b and u & v and not (sa and sa == sb):
                m, n = (set(zip(z.split(), z.split()[1:])) for z in (x, y))
                c, p, j = len(u & v) / min(len(u), len(v)), len(m & n) / len(m | n) if m | n else 0.0, len(u & v) / len(u | v)
                inside = len(s & t) / min(len(s), len(t)) if s and t else None
                la, lb = len(sa or x), len(sb or y)
                r = 2 * min(la, lb) / (la + lb)
                if 0.4 * c + 0.2 * p + 0.1 * j + 0.3 * r >= 0.75 - 1e-9 or (inside is not None and 0.55 * inside + 0.45 * r >= 0.75 - 1e-9):
                    want[a, b] = (c, p, j, inside)
    got = {(r.a, r.b): tuple(r)[2:] for r in found.collect()}
    assert got.keys() == want.keys() and len(want) > 20 and all(got[k] == pytest.approx(want[k]) for k in want)
