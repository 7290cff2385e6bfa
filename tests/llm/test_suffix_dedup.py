import random

from talkarchive.llm import suffix_dedup as S

from .data import documents, frame


def brute(rows, length):
    first, out = {}, []
    null = lambda d: 2**63 if d is None else d
    for doc, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(null(doc), first.get(b[i : i + length], 2**64))
    for doc, t in rows:
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < null(doc):
                gone |= set(range(i, i + length))
        out.append((doc, len(b), bytes(x for i, x in enumerate(b) if i not in gone), gone))
    return out


def check(spark, rows, chunk, length=50, gram=24, hot=S.HOT):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = sorted(brute([(r[0], r[1]) for r in rows], length), key=key)
    got = sorted(((r.doc_id, r.n_bytes, bytes(r.kept), {i for s in r.spans for i in range(s.start, s.end)}, r.n_removed) for r in S.remove_repeated_bytes(frame(spark, rows), length, gram, chunk, hot).collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w and g[4] == len(w[3])
    return sum(g[4] for g in got)


def test_equals_brute_force(spark):
    assert check(spark, documents(7), 3000) > 1000
    assert check(spark, documents(8), 1 << 23) > 1000


def test_low_entropy_repeated_and_null_ids(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") * rng.randint(1, 40) for _ in range(12)), None, None, None) for i in range(40)]
    rows += [(3, rows[5][1], None, None, None), (None, rows[7][1], None, None, None), (None, rows[7][1] * 2, None, None, None), (50, "é" * 200, None, None, None), (51, "x" + "é" * 90, None, None, None)]
    check(spark, rows, 600)
    check(spark, rows, 1 << 23, length=20, gram=8)
    assert S.remove_repeated_bytes(frame(spark, [])).count() == 0


def test_spark_ranks_hot_names(spark):
    assert check(spark, documents(7), 3000, hot=0) > 1000  # every name with another document
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    phrase = "a phrase that very many of these texts hold, as they stand beside it; "
    rows = [(i, f"{word()} {word()} " + (phrase if i % 3 else phrase[:45]) + " ".join(word() for _ in range(8)), None, None, None) for i in range(300)]
    rows += [(None, rows[4][1], None, None, None), (7, rows[8][1] * 2, None, None, None), (400, "", None, None, None), (401, None, None, None, None), (402, phrase * 60, None, None, None)]
    assert check(spark, rows, 4000, hot=40) > 5000
    assert check(spark, rows, 1 << 23, length=20, gram=8, hot=40) > 5000
