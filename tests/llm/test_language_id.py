import math
import random
from collections import Counter

import numpy as np

from talkarchive.llm import language_id as L

from .data import frame

PARTS = {"en": "the ing tion and er wh".split(), "de": "sch ung ein keit und ö".split(), "fr": "eau oi le que é ment".split(), "es": "ción ra os el ñ ando".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_cases(spark):
    rng = random.Random(0)
    rows = [(i, text(rng, lang, rng.choice([3, 30, 300])), lang, "s", 1) for i in range(400) for lang in [rng.choice(list(PARTS))]]
    rows += [(900, None, "en", None, None), (901, "", "en", None, None), (902, "12 ... !", "en", None, None), (903, "日本", None, None, None), (904, "×÷", "fr", None, None)]
    docs = frame(spark, rows)
    model = L.fit(docs.where(~L.held_out(3, 1)), per_language=50)
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert len(got) == len(rows)
    right = [got[r[0]].lang_pred == r[2] for r in rows[:400]]
    assert np.mean(right) > 0.97
    assert [got[k].lang_pred for k in (900, 901, 902, 904)] == ["und"] * 4 and got[903].lang_pred in PARTS
    assert all(0 <= r.score <= 1 for r in got.values())
    none = L.fit(docs.where("false"))
    assert {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(frame(spark, []), model).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 20):
        code = L.codewords(n)
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= (1 if n == 2 else 2)


def test_decoding_equals_a_plain_statement_of_the_rule(spark):
    """Trigram counts, log odds a bit, losses and shares written out with dictionaries, each text alone."""
    rng = random.Random(4)
    known = [(text(rng, lang, rng.choice([1, 5, 40])), lang) for lang in PARTS for _ in range(25)]
    asked = [text(rng, lang, n) for lang in PARTS for n in (1, 2, 9)] + ["a", "ñ", "É 1", "x.y", "", "..", "日本 the"]

    def grams(t):
        fold = [0 if b < 128 and not chr(b).isalpha() else (b & 31) if b < 128 else 27 + (b - 128) % 37 for b in t.encode()]
        flat = [0, *fold, 0]
        return [g for g in zip(flat, flat[1:], flat[2:]) if g != (0, 0, 0)][: len(fold)]

    langs = sorted(PARTS)
    share = {}
    for lang in langs:
        c = Counter(g for t, k in known if k == lang for g in grams(t))
        share[lang] = {g: n / sum(c.values()) * 1e6 for g, n in c.items()}
    code = L.codewords(4)

    def decided(t):
        outputs = []
        for b in range(code.shape[1]):
            sides = [[share[lang] for i, lang in enumerate(langs) if code[i, b] * s > 0] for s in (1, -1)]
            total = [sum(sum(c.values()) for c in side) + L.SMOOTH * L.SIZE for side in sides]
            p = lambda g, k: math.log((sum(c.get(g, 0) for c in sides[k]) + L.SMOOTH) / total[k])  # noqa: E731, B023
            outputs.append(sum(p(g, 0) - p(g, 1) for g in grams(t)) / math.sqrt(max(1, len(t.encode()))))
        losses = [sum(math.log1p(math.exp(-o * w)) for o, w in zip(outputs, code[i])) for i in range(4)]
        weight = [math.exp(min(losses) - x) for x in losses]
        return langs[losses.index(min(losses))], max(weight) / sum(weight), sorted(losses)[1] - min(losses) < L.MARGIN

    model = L.Model([(lang, t) for t, lang in known])
    # in one batch, in another order, and one by one: neighbours change nothing
    for rows in (list(enumerate(asked)), list(enumerate(asked))[::-1], *[[r] for r in list(enumerate(asked))[:3]]):
        for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect():
            lang, score, close = decided(asked[r.doc_id])
            if not any(c.isalpha() for c in asked[r.doc_id]):
                assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
            else:
                assert (r.lang_pred, r.ambiguous) == (lang, close) and abs(r.score - score) < 1e-4
