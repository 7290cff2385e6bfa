import re

import numpy as np
from hypothesis import given, settings, strategies as st

from talkarchive.llm import decontamination as D

from .data import documents, frame


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, width):
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        q = words(t)
        for k in range(max(1, len(q) - width + 1) if q else 0):
            w = q[k : k + width]
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    found.add("null" if item is None else str(item))
    return len(ws), hit, sorted(found)


def test_equals_brute_force(spark):
    rows = documents(5)
    long = next(r[1] for r in rows if r[1] and len(words(r[1])) > 100)
    items = [(1, " ".join(words(long)[20:45])), (10, "W1 w2"), (2, " ".join(words(long)[30:39])), (3, ""), (4, None), (None, "日本"), (10, "w3 the"), (5, "no such words here")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for shard, block in ((4 << 20, 16 << 20), (2000, 50)):
        got = D.find_contamination(frame(spark, rows), bench, shard_bytes=shard, block_bytes=block).collect()
        want = {r[0]: brute(r[1], items, 10) for r in rows}
        assert len(got) == len(rows) and sum(bool(r.spans) for r in got) > 5
        for r in got:
            assert (r.n_words, {i for s in r.spans for i in range(s.start, s.end)}, r.item_ids) == want[r.doc_id]
    cut = D.find_contamination(frame(spark, rows), bench, cut=True).collect()
    texts = {r[0]: r[1] for r in rows}
    for r in cut:
        n, hit, _ = want[r.doc_id]
        assert words(r.text) == [w for i, w in enumerate(words(texts[r.doc_id])) if i not in hit]
        assert hit or r.text == texts[r.doc_id]


def test_cases(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [list(r) for r in D.find_contamination(frame(spark, [(1, "a b", None, None, None)]), empty).select("n_words", "spans", "item_ids").collect()] == [[2, [], []]]
    assert D.find_contamination(frame(spark, []), empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 4))
def test_index_finds_all(seq, k):
    seq = np.array(seq, np.int64)
    assert D.suffix_array(seq).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
    index = D.FMIndex(seq, 4)
    windows = np.array([[a, *[b] * (k - 1)] for a in range(4) for b in range(4)], np.int64)
    hit, low, high = index.search(windows)
    got = {(int(w), int(p)) for w, a, b in zip(hit, low, high) for p in index.locate(np.arange(a, b))}
    want = {(w, p) for w in range(len(windows)) for p in range(len(seq) - k + 1) if seq[p : p + k].tolist() == windows[w].tolist()}
    assert got == want
