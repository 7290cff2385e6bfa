import hashlib
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from talkarchive.llm import lm_scoring, simhash, substring_dedup, suffix_dedup
from talkarchive.llm._chunks import chunked, placed

from .data import documents, frame


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_windows(rows, width):
    seen, out = set(), {}
    for doc, t in sorted(rows):
        ws = words(t)
        gone = set()
        for i in range(len(ws) - width + 1):
            w = tuple(ws[i : i + width])
            if w in seen:
                gone |= set(range(i, i + width))
            seen.add(w)
        out[doc] = (len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone), gone)
    return out


def test_substring_dedup_equals_brute_force(spark):
    for seed, chunk in ((0, 4000), (1, 1 << 24)):
        rows = documents(seed)
        want = brute_windows([(r[0], r[1]) for r in rows], 20)
        got = substring_dedup.remove_repeated_windows(frame(spark, rows), chunk_bytes=chunk).collect()
        assert len(got) == len(rows)
        assert sum(r.n_removed for r in got) > 100
        for r in got:
            n, m, kept, gone = want[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_text) == (n, m, kept)
            assert {i for s in r.intervals for i in range(s.start, s.end)} == gone
            assert all(a.end < b.start for a, b in zip(r.intervals, r.intervals[1:]))


def test_substring_dedup_cases(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(None, text, None, None, None), (1, text, None, None, None), (1, text, None, None, None), (2, None, None, None, None)]
    got = sorted(substring_dedup.remove_repeated_windows(frame(spark, rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_removed))
    assert [(r.doc_id, r.n_removed) for r in got] == [(1, 0), (1, 25), (2, 0), (None, 25)]
    assert substring_dedup.remove_repeated_windows(frame(spark, [])).count() == 0


def in_place(rows):
    """(id, text) in the operator's order: null ids last, rows of one id by the hash of their text."""
    signed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + 2**63) % 2**64 if t is not None else 42 + 2**63
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1]), r[1] or ""))


def test_hot_and_missing_ids_are_split(spark):
    rng = random.Random(8)
    passages = [" ".join(f"p{k}x{rng.randrange(99)}" for _ in range(30)) for k in range(6)]
    texts = [f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(40))} {rng.choice(passages)} end{i}" for i in range(240)]
    rows = [((None, 7, i)[i % 3], t) for i, t in enumerate(texts)] + [(None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts, _ = chunked(df, 4000)
    sizes = {r.chunk: r.n for r in parts.groupBy("chunk").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert len(sizes) > 20 and max(sizes.values()) < 16000
    seen, want = set(), []
    for doc, t in in_place(rows):
        ws, gone = words(t), set()
        for i in range(len(ws) - 19):
            gone |= set(range(i, i + 20)) if tuple(ws[i : i + 20]) in seen else set()
            seen.add(tuple(ws[i : i + 20]))
        want.append((doc is None, doc or 0, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeated_windows(df, chunk_bytes=4000).collect()]
    assert sorted(got) == sorted(want) and sum(w[3] for w in want) > 3000
    # bytes: rows of one id, or of none, never remove bytes of each other
    old, cut = {}, []
    for doc, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            k = b[i : i + 50]
            old[k] = min(old.get(k, 2**63), 2**63 - 1 if doc is None else doc)
    for doc, t in rows:
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - 49):
            gone |= set(range(i, i + 50)) if old[b[i : i + 50]] < (2**63 - 1 if doc is None else doc) else set()
        cut.append((doc is None, doc or 0, len(b), len(gone)))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeated_bytes(df, chunk_bytes=4000).collect()]
    assert sorted(got) == sorted(cut) and sum(c[3] for c in cut) > 3000
    target = spark.createDataFrame([(7,), (3,)], "doc_id long")
    few, one = (sorted((r.doc_id or -1, r.n_tokens, round(r.score or 0, 9)) for r in lm_scoring.cross_entropy_difference(df, target, n).collect()) for n in (4000, 1 << 24))
    assert few == one


def fingerprint(t):
    ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius=2):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    rows = documents(3)
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    comp = brute_components(prints)
    for shard in (20_000, 8):
        got = simhash.near_duplicates(frame(spark, rows), shard=shard).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], comp[r.doc_id])
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_trees_lose_no_link():
    import random

    import numpy as np

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(700)]
    points = base + [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base for _ in range(2)]
    dense = [base[0] ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]
    p = np.unique(np.array(points + dense, np.uint64))
    brute = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if int(p[i] ^ p[j]).bit_count() <= 2}
    a, b = simhash.links(p, 2, leaf=32)
    assert {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist()) if i != j} <= brute
    # links may stand for pairs by chains: the components agree
    label = simhash.least_labels(len(p), a, b)
    x, y = np.array(sorted(brute)).T
    assert (label == simhash.least_labels(len(p), x, y)).all()
    tree = simhash.grow(p, 5, 2, rng)
    out = []
    simhash._deal(p, np.arange(len(p)), tree, 2, 0, out)
    assert len(out) == simhash.leaves(tree) > 8
    together = {(i, j) for _, at in out for s in [set(at.tolist())] for i, j in brute if i in s and j in s}
    assert together == brute


def test_digest_is_of_kept_text(spark):
    got = substring_dedup.remove_repeated_windows(frame(spark, [(1, "a  b\tc", None, None, None)])).first()
    assert hashlib.sha256(got.kept_text.encode()).hexdigest() == hashlib.sha256(b"a b c").hexdigest()


def test_chunks_follow_ids_and_weigh_texts(spark):
    """Chunks rise with ids, split where texts are long or ids are apart, and take null ids last."""
    rows = [(k, "x" * 10) for k in range(3000)] + [(10**12 + k, "y" * 5000) for k in range(400)] + [(-5, None), (None, "z" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    add, size = placed(docs, 100_000)
    out = sorted(add(docs, "doc_id").select("doc_id", "chunk", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    chunks = [r.chunk for r in out]
    assert size == sum(len(t or "") for _, t in rows) and chunks == sorted(chunks)
    assert out[-1].chunk >= out[-2].chunk and out[0].doc_id == -5
    sizes = Counter()
    for r in out:
        sizes[r.chunk] += len(r.text or "") + 16
    assert max(sizes.values()) < 150_000 and len(sizes) >= 20
    again = add(docs.select(F.col("doc_id").alias("_id")), "_id", texts=False).select("_id", "chunk")
    assert {(r._id, r.chunk) for r in again.collect()} >= {(r.doc_id, r.chunk) for r in out}


def test_chunks_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    add, size = placed(none)
    assert size == 0 and add(none, "doc_id").count() == 0
