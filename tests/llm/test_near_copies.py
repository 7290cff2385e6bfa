import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from talkarchive.llm import near_copies

from .data import documents, frame
from .test_text_dedup import words


def shingles(t):
    ws = ["".join(c.lower() if c.isascii() else c for c in w) for w in words(t or "")]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and bool(sets[a]) == bool(sets[b]) and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in root}


@pytest.mark.parametrize("block_words", [near_copies.BLOCK_WORDS, 150])
def test_near_copies_equal_brute_force(spark, block_words):
    rows = documents(13)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, rows), block_words).collect()}
    assert got == brute(rows)
    assert near_copies.near_copies(frame(spark, [])).count() == 0


def test_stage_drops_planted_copies_and_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(2000)]
    clean = [[rng.choice(vocab) for _ in range(rng.randrange(80, 400))] for _ in range(150)]
    for w in clean[100:]:
        w[:20] = clean[100][:20]  # a passage in common makes no copy
    rows, copies = [(i, " ".join(w), "en", "a", 1) for i, w in enumerate(clean)], 0
    for i, w in enumerate(clean):
        for share in (0.005, 0.01, 0.02):
            edited = " ".join(rng.choice(vocab) if rng.random() < share else x for x in w)
            if jaccard(shingles(" ".join(w)), shingles(edited)) >= 0.8:
                rows.append((1000 + len(rows), edited, "en", "a", 1))
                copies += 1
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, frame(spark, rows, extra=False), str(tmp_path)).select(F.col("doc_id")).collect()}
    assert copies > 300 and kept == set(range(150))


def test_stage_keeps_different_texts_of_one_id(spark, tmp_path):
    a, b, c = ("".join(f"{p}{i} " for i in range(60)) for p in "abc")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a, "en", "s", 1), (2, a + " more", "en", "s", 1), (None, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "fr", "s", 1), (3, None, "en", "s", 0), (4, "", "en", None, 0)]
    out = P.drop_near_duplicates(spark, frame(spark, rows, extra=False), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in out) == [(0, "c0 "), (1, "a0 "), (1, "b0 "), (3, "")]
    assert P.drop_near_duplicates(spark, frame(spark, [], extra=False), str(tmp_path)).count() == 0


@pytest.mark.parametrize("empty", ["documents", "benchmark", "labels"])
def test_pipeline_on_empty_tables_and_odd_ids(spark, tmp_path, empty):
    text = lambda p: "".join(f"{p}word{i} " for i in range(40))
    rows = {"documents": [(1, text("a"), "en", "s", 1), (1, text("b"), "en", "s", 1), (None, text("c"), None, None, 1), (None, None, None, None, None)], "benchmark": [(1, text("b"))], "labels": [(1, 1, 0), (None, None, None)]}
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int"}
    for name, kind in kinds.items():
        spark.createDataFrame([] if name == empty else rows[name], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    assert len(out) == (0 if empty == "documents" else 3)


def test_columns_of_any_name_are_kept(spark):
    rows = [(i, "same words in all of these texts here", "x", f"h{i % 2}", None, 1) for i in (3, 1, 2)] + [(1, "same words in all of these texts here", "x", "h1", None, 1), (9, None, "t", "u", "v", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string, _h string, _row string, root int")
    out = near_copies.first_of_copies(df)
    assert out.columns == df.columns and sorted((tuple(r) for r in out.collect()), key=str) == sorted([rows[1], rows[4]], key=str)
