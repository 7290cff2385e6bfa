from talkarchive.operators import search as S

SEGMENT = "video_id long, seg_idx long, text string, start double, speaker string"


def _pieces(spark, segments, summaries=(), slides=()):
    ids = sorted({r[0] for r in [*segments, *summaries, *slides]})
    named = spark.createDataFrame([(i, f"talk {i}", "f.mp4") for i in ids], "video_id long, title string, filename string")
    summary = "video_id long, executive_summary string, key_points array<string>, topics array<struct<timestamp string, topic string, summary string>>"
    return S.pieces(named, spark.createDataFrame(list(segments), SEGMENT), spark.createDataFrame(list(summaries), summary), spark.createDataFrame(list(slides), "video_id long, slide_idx long, timestamp double, title string, content string"))


def test_lexical_finds_queries_inside_segments_without_a_common_token(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 2)
    monkeypatch.setattr(S, "PASS", 2)
    texts = ["We use AI daily", "planning the week", "会議の計画です", "of the and with", "nothing", None, "a plan, again"]
    pieces = _pieces(spark, [(1, k, t, 4.0 * k, None) for k, t in enumerate(texts)])
    queries = spark.createDataFrame([(1, "AI"), (2, "plan"), (3, "計画"), (4, "of"), (5, ""), (6, None), (7, "a plan, again"), (8, "zzz")], "query_id long, text string")
    got = {(r.query_id, r.piece_idx): r.score for r in S.lexical(queries, pieces).collect()}
    assert {k for k in got if k[0] != 7} == {(1, 0), (1, 6), (2, 1), (2, 6), (3, 2), (4, 3)}
    assert (got[1, 0], got[2, 1], got[3, 2], got[4, 3]) == (2.4, 2.4, 2.4, 2.4)
    assert got[2, 6] == 3.9 and got[7, 6] == 4.4


def test_queries_across_words(spark):
    pieces = _pieces(spark, [(1, k, t, 0.0, None) for k, t in enumerate(("we talk about ai here", "railroad maple trees", "the roadmap is ready"))])
    queries = spark.createDataFrame([(1, "AI"), (2, "road map"), (3, "road")], "query_id long, text string")
    got = {(r.query_id, r.piece_idx): r.score for r in S.lexical(queries, pieces).collect()}
    assert got == {(1, 0): 2.4, (1, 1): 2.4, (2, 1): 2.4, (3, 1): 2.4, (3, 2): 2.4}


def test_places_speaker_order_and_limit(spark):
    segments = [(1, 0, "budget plan", 5.0, "Ann"), (1, 1, "budget plan", 1.0, "Bob"), (2, 0, "budget plan", 1.0, "Ann")]
    summaries = [(1, " budget plan ", ["budget plan", ""], [("01:02", "budget", "plan")]), (2, None, None, None)]
    pieces = _pieces(spark, segments, summaries, [(2, 0, 7.0, "budget", "plan")])
    queries = spark.createDataFrame([(1, " Budget plan ")], "query_id long, text string")
    got = [(r.video_id, r.place, r.piece_idx, r.score, r.timestamp, r["rank"]) for r in S.lexical(queries, pieces).orderBy("rank").collect()]
    assert got == [
        (2, "segment", 0, 4.4, 1.0, 1), (1, "segment", 1, 4.4, 1.0, 2), (1, "segment", 0, 4.4, 5.0, 3), (1, "executive", 0, 4.2, None, 4),
        (1, "key_point", 0, 4.1, None, 5), (1, "topic", 0, 4.1, 62.0, 6), (2, "slide", 0, 4.0, 7.0, 7),
    ]
    ann = S.lexical(queries, pieces, 3, speaker="Ann").orderBy("rank").collect()
    assert [(r.video_id, r.place, r.piece_idx) for r in ann] == [(2, "segment", 0), (1, "segment", 0), (1, "executive", 0)]
    capped = S.cap_per_recording(S.lexical(queries, pieces), 2, 3).orderBy("rank").collect()
    assert [(r.video_id, r["rank"]) for r in capped] == [(2, 1), (1, 2), (1, 3)]
    assert S.lexical(queries.limit(0), pieces).count() == 0 and S.lexical(queries, pieces.limit(0)).count() == 0
