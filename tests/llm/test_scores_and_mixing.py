import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from talkarchive.llm import lm_scoring, preference_format, quality_rules, source_mixing, toxicity
from talkarchive.llm import _bytes as B

from .data import documents, frame


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_lm_scores_equal_brute_force(spark):
    rows = documents(11)
    target = {r[0] for r in rows if r[0] % 2}
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)]
    from collections import Counter

    uni, pair = [Counter(), Counter()], [Counter(), Counter()]
    for doc, t, *_ in rows:
        ws = low(t)
        for k in range(2):
            if k == 1 or doc in target:
                uni[k].update(ws)
                pair[k].update(zip(ws, ws[1:]))
    known = {w for w, c in uni[1].items() if c > 1}
    ids = spark.createDataFrame([(d,) for d in target] + [(None,)], "doc_id long")
    for chunk in (3000, 1 << 23):
        got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(frame(spark, rows), ids, chunk).collect()}
        assert len(got) == len(rows)
        for doc, t, *_ in rows:
            ws, r = low(t), got[doc]
            assert r.n_tokens == len(ws)
            if not ws:
                assert r.score is None
                continue
            for k, loss in ((0, r.loss_target), (1, r.loss_background)):
                total = 0.0
                for i, w in enumerate(ws):
                    c = uni[k][w] if w in known else sum(n for x, n in uni[k].items() if x not in known)
                    p = (c + 0.1) / (sum(uni[k].values()) + 0.1 * (len(known) + 1))
                    before = uni[k][ws[i - 1]] if i and ws[i - 1] in known else 0
                    if before:
                        p = 0.4 * p + 0.6 * (pair[k][ws[i - 1], w] if pair[1][ws[i - 1], w] > 1 else 0) / before
                    total -= math.log(p)
                assert abs(loss - total / len(ws)) < 1e-9
    assert lm_scoring.cross_entropy_difference(frame(spark, []), ids).count() == 0


def test_nearest_examples_are_exact_and_toxicity_is_learned(spark):
    rng = random.Random(4)
    make = lambda bad: " ".join(rng.choice(["nasty", "vilely", "vilest"]) if bad and rng.random() < 0.2 else f"w{rng.randrange(200)}" for _ in range(40))
    label = {i: int(rng.random() < 0.3) for i in range(600)}
    rows = [(i, make(label[i]), "en", "s", 1) for i in label] + [(900, None, None, None, None), (901, "", None, None, None)]
    labels = spark.createDataFrame([(i, 1, y) for i, y in label.items() if i % 5] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark, rows), labels, per_class=150)
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in label if i % 5 == 0]
    assert np.mean([got[i].predicted == label[i] for i in held]) > 0.97
    assert got[900].predicted == got[901].predicted == 0 and got[900].evidence == []
    vectors = model.split(model.vectors(*B.text_bytes(pa.array([r[1] for r in rows[:40]]))), 40)
    examples = {r[0]: r[1] for r in rows}
    dense = np.zeros((len(model.ids), len(model.terms)))
    for k, (t, w) in enumerate(model.split(model.vectors(*B.text_bytes(pa.array([examples[int(i)] for i in model.ids]))), len(model.ids))):
        dense[k, t] = w
    for t, w in vectors:
        cos = np.round(dense[:, t] @ w, 9) if len(t) else np.zeros(len(dense))
        best = [k for k in np.lexsort((model.ids, -cos))[: model.k] if cos[k] > 0]
        who, near = model.nearest(t, w)
        assert np.allclose(near, cos[best], atol=1e-8) and sorted(near.tolist(), reverse=True) == near.tolist()
    none = toxicity.fit(frame(spark, rows), labels.where("false"))
    assert {r.predicted for r in toxicity.score(frame(spark, rows), none).collect()} == {0}
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_preferences(spark):
    rows = [
        (1, "chosen", 0, "user", "hi", 5), (1, "chosen", 1, "assistant", "good", 5), (1, "rejected", 0, "user", "hi", 5), (1, "rejected", 1, "assistant", "bad one", 5),
        (2, "chosen", 0, None, None, 5), (2, "rejected", 0, None, None, 5), (3, "chosen", 0, "user", "alone", 5), (4, "other", 0, "user", "x", 5), (None, "chosen", 0, "user", "x", 5),
        (5, "chosen", 0, "user", "a", 5), (5, "rejected", 0, "user", "b", 5), (5, "rejected", 1, "assistant", "c", 5),
    ]
    turns = spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string, prompt int")
    got = {r.pair_id: r for r in preference_format.format_preferences(turns).collect()}
    assert set(got) == {1, 2, 3, 5}
    one = got[1]
    assert (one.prompt_turns, one.prompt) == (1, "<|user|>\nhi<|end|>\n")
    for side, text in (("chosen", "good"), ("rejected", "bad one")):
        (span,) = one[f"{side}_mask"]
        assert one[side][span.start : span.end] == f"{text}<|end|>\n" and one[side] == f"<|assistant|>\n{text}<|end|>\n"
    assert (got[2].prompt_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    assert (got[3].prompt, got[3].chosen_turns, got[3].rejected_turns) == ("", 1, 0)
    assert (got[5].prompt_turns, got[5].rejected_turns, len(got[5].rejected_mask), got[5].chosen_mask) == (0, 2, 1, [])
    assert preference_format.format_preferences(turns.where("false")).count() == 0


def test_quality_counts_equal_brute_force(spark):
    rows = documents(21) + [(2000, "a b c a b c a b c\nx\nx\n\n \nx", None, None, None), (2001, "!# " * 60, None, None, None)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for doc, t, *_ in rows:
        ws, r = words(t), got[doc]
        grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws)) and not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            free.remove(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def test_mixing_meets_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(40)), "en", rng.choice(["a", "a", "a", "b", "c", "ä", None]), 1) for i in range(900)]
    rows += [(5000, "w " * 9, "en", "tiny", 1), (5001, None, "en", "empty", 1), (None, "w w", "en", "b", 1), (3, "w", "en", "b", 1)]
    quality = spark.createDataFrame([(i, 1.0 if i % 2 else 0.2) for i in range(900)] + [(901, None)], "doc_id long, quality double")
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    for ranges in (2000, 20):
        got = source_mixing.mix_sources(frame(spark, rows), quality, ranges).collect()
        assert len(got) == len(rows)
        for s in sizes:
            mine = [r for r in got if r.source == s]
            assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and r.taken <= 3 * r.size for r in mine)
            assert abs(sum(r.taken for r in mine) - want[s]) <= 20
        again = source_mixing.mix_sources(frame(spark, rows[::-1]), quality, 50).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again))
    heavy = [r.taken / r.size for r in got if r.source == "a" and r.size and r.doc_id % 2 == 0]
    light = [r.taken / r.size for r in got if r.source == "a" and r.size and r.doc_id % 2]
    assert np.mean(light) > np.mean(heavy)
    assert source_mixing.mix_sources(frame(spark, [])).count() == 0


def test_ranges_of_keys_hold_alike_many_rows(spark):
    """Whatever the weights: a third of the rows weigh 0.02, others 1 and 7."""
    rng = random.Random(2)
    rows = [("s", rng.expovariate(1) / q, q) for q in (0.02, 1.0, 7.0) for _ in range(4000)] + [("one", 1.0, 0.3)]
    plan = spark.createDataFrame([("s", 12000, 24), ("one", 1, 1)], "source string, n long, ranges long")
    got = {(r.source, r.range): r["count"] for r in source_mixing._ranges(spark.createDataFrame(rows, "source string, key double, q double"), plan).groupBy("source", "range").count().collect()}
    assert got.pop(("one", 0)) == 1 and len(got) == 24 and max(got.values()) < 700 and min(got.values()) > 300


def test_rows_without_ids_and_copies_are_mixed_to_the_target(spark):
    rows = [(None, f"text {i} " + "w " * (i % 5), "en", "a" if i % 3 else "b", 1) for i in range(300)] + [(None, "the same words", "en", "a", 1)] * 200 + [(i, "x y", "fr", "c", 1) for i in range(40)]
    quality = spark.createDataFrame([(i, 0.01) for i in range(20)], "doc_id long, quality double")
    out = source_mixing.mix_sources(frame(spark, rows), quality, 10).collect()
    assert len(out) == len(rows)
    for source in "abc":
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) and all(r.taken <= 3 * r.size for r in mine)


def test_toxicity_equals_a_plain_statement_of_the_rule(spark):
    """Terms, z scores, TF-IDF cosines, votes and the calibrated curve with dictionaries, all pairs compared."""
    rng = random.Random(11)
    word = lambda tox: rng.choice(["vilething", "vilest", "nasty", "nastier"] if tox and rng.random() < 0.5 else [f"plain{i}" for i in range(30)] + ["of", "the", "é"])
    rows = [(i, " ".join(word(i % 4 == 0) for _ in range(rng.choice([3, 8, 30]))), int(i % 4 == 0)) for i in range(240)]
    rows += [(500 + i, t, None) for i, t in enumerate(["", "of the", "vilethings plain1", "NASTY nastiest " * 9, "plain2 plain3"])]

    def terms(t):
        words = re.findall("[0-9a-zé]+", t.lower())
        return words and Counter([("w", w) for w in words] + [(n, w.encode()[:n]) for w in words for n in toxicity.PREFIXES if len(w.encode()) > n]) or Counter()

    known = [(i, terms(t), y) for i, t, y in sorted({t: (i, t, y) for i, t, y in rows[::-1] if y is not None}.values())]
    n1, n = sum(y for *_, y in known), len(known)
    seen, tox = Counter(t for _, c, _ in known for t in c), Counter(t for _, c, y in known if y for t in c)
    z = lambda t: (tox[t] / n1 - (seen[t] - tox[t]) / (n - n1)) / math.sqrt(seen[t] / n * (1 - seen[t] / n) * (1 / n1 + 1 / (n - n1)) + 1e-12)
    df = Counter(t for _, text, _ in rows for t in terms(text))
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in seen if abs(z(t)) >= toxicity.LEAST_Z and seen[t] >= toxicity.LEAST_SEEN}

    def vector(c):
        v = {t: (1 + math.log(k)) * idf[t] for t, k in c.items() if t in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = {i: vector(c) for i, c, _ in known}
    label, rate = {i: y for i, _, y in known}, sum(y for *_, y in rows[:240]) / 240

    def vote(v, leave=None):
        near = sorted((-round(sum(x * w[t] for t, x in v.items() if t in w), 9), i) for i, w in vectors.items() if i != leave)
        near = [(-c, i) for c, i in near if c < 0][: toxicity.NEIGHBOURS]
        return (sum(c * c * label[i] for c, i in near) + toxicity.SHRINK * rate) / (sum(c * c for c, _ in near) + toxicity.SHRINK)

    clip = lambda p: min(1 - 1e-4, max(1e-4, p))
    logit = lambda p: math.log(clip(p) / (1 - clip(p)))
    data = [(logit(vote(vectors[i], i)), y, (rate / n1 if y else (1 - rate) / (n - n1)) * n) for i, _, y in known]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, y int"), spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int"))
    assert sorted(model.ids.tolist()) == sorted(label) and len(model.terms) == len(idf) > 3
    # the curve: no gradient is left of the weighted loss and the penalty on leaving slope 1 and shift 0
    p = [1 / (1 + math.exp(-(model.slope * x + model.shift))) for x, *_ in data]
    assert abs(sum(w * (q - y) * x for q, (x, y, w) in zip(p, data)) + model.slope - 1) < 1e-3 and abs(sum(w * (q - y) for q, (_, y, w) in zip(p, data)) + model.shift) < 1e-3
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, y int"), model).collect()}
    for i, text, _ in rows:
        want = 1 / (1 + math.exp(-(model.slope * logit(vote(vector(terms(text)))) + model.shift)))
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(want >= 0.5), i
