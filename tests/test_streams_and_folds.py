"""Streams give the batch jobs' rows; folds equal plain statements of their rules on random input."""

import random

import numpy as np
import pytest

from talkarchive.operators import calibration, folds, frames
from talkarchive.sources import archive
from talkarchive.streaming import live


def _run(query):
    query.processAllAvailable()
    query.stop()


def test_stateful_streams_equal_batch(spark, tmp_path):
    rows = spark.range(300).selectExpr("id % 3 AS identity", "id AS event_id", "timestamp_seconds(1000000 + id * id % 977) AS ts")
    rows = rows.orderBy("ts", "event_id")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    _run(live.rate_limit(stream, 2, 60).writeStream.format("memory").queryName("limits").outputMode("append").start())
    assert sorted(spark.sql("SELECT * FROM limits").collect()) == sorted(folds.rate_limit(rows, 2, 60).collect())
    said = rows.selectExpr("identity AS job_id", "'s' AS step", "event_id", "unix_seconds(ts) * 0.4D AS at", "event_id * 7 % 101 * 1.0D AS progress")
    live_said = stream.selectExpr("identity AS job_id", "'s' AS step", "event_id", "unix_seconds(ts) * 0.4D AS at", "event_id * 7 % 101 * 1.0D AS progress")
    _run(live.throttle(live_said, 3, 60).writeStream.format("memory").queryName("sends").outputMode("append").start())
    want = sorted(folds.throttle(said, 3, 60).collect())
    assert sorted(spark.sql("SELECT * FROM sends").collect()) == want and len({r.sent for r in want}) == 2
    steps = spark.createDataFrame([(1, 1, 100.0, 5), (1, 2, 50.0, 5), (1, 2, 70.0, 3), (2, 8, 100.0, 1)], "job_id long, step int, progress double, t long").selectExpr("job_id", "step", "progress", "timestamp_seconds(t) AS ts")
    assert {r.job_id: r.overall for r in live.overall_state(steps).collect()} == {1: 20.0, 2: 5.0}


def test_state_of_sent_messages_ends_and_survives_restarts(spark, tmp_path):
    kind, state = "job_id long, step string, event_id long, at double, progress double", []

    def send(*rows):
        spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = live.throttle(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), 5.0, 50.0, "10 seconds").writeStream
        query = query.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").start()
        query.processAllAvailable()
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        query.stop()

    (tmp_path / "in").mkdir()
    send((1, "a", 1, 100.0, 0.0), (1, "a", 2, 101.0, 10.0), (2, "a", 3, 100.0, 0.0))
    send((1, "a", 4, 102.0, 20.0), (1, "a", 5, 103.0, 51.0))  # restarted: 100.0 was the last one sent
    send((3, "a", 6, 500.0, 0.0))
    send((1, "a", 7, 110.0, 1.0), (3, "a", 8, 501.0, 1.0))  # the first is later than the watermark
    send((1, "a", 9, 502.0, 52.0))
    got = {r.event_id: r.sent for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 8: False, 9: True}
    assert state[0] == 2 and state[-1] <= 2


def test_step_files_as_a_stream(spark, tmp_path):
    def put(name, body):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "summary.json").write_text(body)

    def run():
        query = archive.step_files(spark, f"{tmp_path}/in/*/summary.json", "topic string, points array<string>", stream=True).writeStream
        query = query.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.video_id, r.topic) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put("7", '{"topic": "budget",\n "points": []}')
    put("8", "{broken")
    assert run() == [("7", "budget"), ("8", None)]
    put("9", '{"topic": "plan"}')
    assert run() == [("7", "budget"), ("8", None), ("9", "plan")]


def test_folds_equal_plain_rules(spark):
    rng = random.Random(6)
    words, said = [], []
    for v in range(6):
        t = 0.0
        for i in range(60):
            t += rng.choice((-0.4, 0.0, 0.04, 0.3, 0.5, 2.0))
            words.append((v, i, f" w{i}", round(t, 2), round(t + rng.choice((0.0, 0.2, 0.6, 3.0)), 2)))
        said += [(v, i, 4.0 * i, rng.choice(("Ann", None)), "x" * rng.choice((0, 3, 20, 45, 90))) for i in range(40)]
    want = set()
    for v in range(6):
        upto, segs = -1e9, []
        for _, _, w, s, e in [r for r in words if r[0] == v]:
            if s < upto - 0.05 and e <= upto + 0.05:
                continue
            upto = max(upto, e)
            if not segs or s - segs[-1][1] > 1.5 or e - segs[-1][0] > 15:
                segs.append([s, e, ""])
            segs[-1][1:] = [e, segs[-1][2] + w]
        want |= {(v, k, s, e, text.strip()) for k, (s, e, text) in enumerate(segs)}
    got = folds.words_to_segments(spark.createDataFrame(words, "video_id long, idx long, word string, start double, end double"))
    assert {tuple(r) for r in got.collect()} == want and len(want) < 250
    want = set()
    for v in range(6):
        held, n, at, done = [], 0, 0.0, 0
        for _, _, start, who, text in [r for r in said if r[0] == v]:
            at = start if n == 0 else at
            held, n = held + [f"{who}: {text}" if who else text], n + len(text)
            if n >= 100:
                want.add((v, done, at, who, " ".join(held)))
                keep = next(k for k in range(len(held) + 1) if sum(map(len, held[k:])) <= 50)
                held, done = held[keep:], done + 1
                n = sum(map(len, held))
        want |= {(v, done, at, None, " ".join(held))} if held else set()
    got = folds.chunk_transcript(spark.createDataFrame(said, "video_id long, seg_idx long, start double, speaker string, text string"), 100, 50)
    assert {tuple(r) for r in got.collect()} == want


def test_keyframes_equal_plain_rule(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for v in range(5):
        base, shots = rng.integers(0, 200, 72).astype(float), []
        for i in range(60):
            if rng.random() < 0.25:
                base = rng.integers(0, 200, 72).astype(float)
            shots.append(base + rng.normal(0, rng.choice((1.0, 9.0)), 72))
            rows.append((v, float(i), [float(x) for x in shots[-1]]))
        bits = [(s.reshape(8, 9)[:, 1:] > s.reshape(8, 9)[:, :-1]) for s in shots]
        gap = lambda a, b: np.abs(shots[a] - shots[b]).mean()  # noqa: E731, B023
        last, seen, open_, kept = 0, 0, None, [0]
        for i in range(1, 60):
            if open_ is not None and gap(i, open_) <= 6.0:
                if (bits[i] != bits[seen]).sum() >= 4:
                    kept.append(open_)
                    last, seen = open_, i
                open_ = None
            else:
                open_ = i if gap(i, last) >= 12.0 else None
        want += [(v, float(k)) for k in kept]
    got = [(r.video_id, r.timestamp) for r in frames.keyframes(spark.createDataFrame(rows, "video_id long, timestamp double, signature array<double>")).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_manifests_are_checked_and_defaults_chosen(spark):
    kind = "fixtures array<struct<label:string,media_path:string,audio_path:string,video_path:string,expected_primary_key:string,expected_supporting_keys:array<string>,use_for_calibration:boolean>>"
    for bad in ([], [("a", None, None, "", None, None, True)], [("a", "x.wav", None, None, None, None, False)]):
        with pytest.raises(ValueError):
            calibration.manifest_fixtures(spark.createDataFrame([(bad,)], kind), "/d")
    scores = spark.createDataFrame([("f", "k", p, 0.5, True) for p in ("b", "a")] + [("f", "z", p, 0.5, False) for p in ("b", "a")], "label string, key string, prompt string, score double, expected boolean")
    variants = spark.createDataFrame([("k", "b", 0, False), ("k", "a", 1, True), ("z", "a", 0, False), ("z", "b", 1, True)], "key string, prompt string, place int, is_default boolean")
    assert {r.key: r.prompt for r in calibration.primary_prompts(scores, variants).collect()} == {"k": "b", "z": "b"}
    assert {(r.key, r.prompt) for r in calibration.supporting_prompts(scores, variants=variants).collect()} == {("k", "b"), ("k", "a"), ("z", "b")}


def test_words_of_recordings_meet_without_a_shuffle(spark):
    rng = random.Random(8)
    rows = [(9, None), (10, []), (11, [(None, 1.0, 2.0), (" a", None, None), (" b ", 2.0, 60.0), ("c", 3.0, 3.5)]), (None, [(" d", 0.0, 1.0)])]
    for v in range(8):
        t, words = 0.0, []
        for i in range(300):
            t += rng.choice((0.3, 0.4, 0.5) if v % 2 else (-0.4, 0.0, 0.3, 0.5, 2.0))
            words.append((f" w{i} " if i % 7 == 0 else f" w{i}", round(t, 2), round(t + rng.choice((0.2, 0.3) if v % 2 else (0.0, 0.2, 3.0)), 2)))
        rows.append((v, words))
    recordings = spark.createDataFrame(rows, "video_id long, words array<struct<word string, start double, end double>>")
    flat = recordings.selectExpr("video_id", "posexplode(words) AS (idx, w)").selectExpr("video_id", "CAST(idx AS long) AS idx", "w.*")
    got = folds.recordings_to_segments(recordings)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    made = {tuple(r) for r in got.collect()}
    assert made == {tuple(r) for r in folds.words_to_segments(flat).collect()} and {r[0] for r in made} == {*range(8), 11}
    assert {r for r in made if r[0] == 11} == {(11, 0, 1.0, 2.0, ""), (11, 1, 2.0, 60.0, "b")}
