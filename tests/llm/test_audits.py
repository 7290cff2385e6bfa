"""URL filters, the filter interaction audit and the source divergence audit against plain statements of their rules."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from talkarchive.llm import filter_audit as A, source_divergence as D, url_filters as U

from .data import documents, frame

PAGES = "page_id long, url string, host int, score string, fit string, rule string"
URLS = [
    None, "", "no scheme", "http://", "http://com/", "http://A.COM/x?y", "http://a.com", "http://a.com?x/", "https://www.Example.com/en/1", "https://m.example.com/en/", "https://example.com/en", "https://notexample.com/en/2",
    "https://x.net/es/", "https://x.net/ES/", "https://net/fr/9#a://b", "ftp://x.org/a b?c", "http://é.net/fr/ü", "x://y://z/com/", "https://casino-bets.example/slots", "https://quiet-garden.example/roses", "http://a.com/" + "long/" * 4000, "http://b.net:80/es/",
]


def verdict_by_rules(host, path, rules):
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), verdict, rule))
    return max(fits, default=None)


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    lower = {c: c + 32 for c in range(65, 91)}
    return (m[1].translate(lower), m[2]) if m else ("", "")


@pytest.fixture(scope="module")
def model(spark):
    return U.fit(U.labelled_urls(spark), n=512)


def test_urls_meet_rules_and_model(spark, model):
    rows = [(i % 19, u, 1, "s", "f", "r") for i, u in enumerate(URLS + URLS[3:9])]
    pages = spark.createDataFrame(rows, PAGES)
    got = Counter(tuple(r)[:5] for r in U.judge_urls(pages, U.RULES, model).collect())
    joined = Counter(tuple(r)[:5] for r in U.judge_urls(pages, spark.createDataFrame(U.RULES, "verdict string, rule string"), model).collect())
    many = U.RULES + [("block", f"z{i}.org/q") for i in range(U.COMPILED)]
    assert got == joined == Counter(tuple(r)[:5] for r in U.judge_urls(pages, many, model).collect())
    scored = {r.page_id: r.verdict for r in U.judge_urls(pages, [], model).collect()}
    want = Counter()
    for page, url, *_ in rows:
        host, path = parts(url)
        best = verdict_by_rules(host, path, U.RULES)
        if best is None:
            found = [v for (p, h, q, rule, v), _ in got.items() if (p, h, q, rule) == (page, host, path, None)]
            assert found
            want[page, host, path, None, found[0]] += 1
        else:
            want[page, host, path, best[3], best[2]] += 1
    assert got == want and set(scored.values()) == {"allow", "block"}
    assert U.judge_urls(pages.limit(0), U.RULES, model).count() == 0


def test_weights_are_the_penalised_optimum(spark, model):
    """The gradient of the mean loss and the penalty is zero at the weights, features counted here from the text."""
    import hashlib

    def features(url):
        grams = [mark + t[i : i + k] for mark, s in zip("hp", parts(url)) if s for t in [f"^{s}$"] for k in U.SIZES for i in range(len(t) - k + 1)]
        b = {int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 512 for g in grams}
        return [1 / math.sqrt(len(b)) if k in b else 0.0 for k in range(512)]

    rows = [(u, y) for y, urls in ((1, U.BLOCKED), (0, U.ALLOWED)) for u in urls.split()]
    x, y = np.array([features(u) for u, _ in rows]), np.array([y for _, y in rows])
    intercept, weights = model
    off = 1 / (1 + np.exp(-(x @ weights + intercept))) - y
    assert abs(off.mean()) < 1e-4 and np.abs(x.T @ off / len(y) + U.PENALTY * np.array(weights)).max() < 1e-4
    unseen = [("http://m.casino-win.example.com/a", 1), ("http://www.cheap-pills.example.com/b", 1), ("http://free-bets.example.org/", 1), ("http://adult-x.example.net/q", 1), ("https://blog.thertion.example.org/es/9", 0), ("https://www.cityplanners.example/minutes", 0)]
    got = {r.page_id: r.verdict for r in U.judge_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(unseen)], "page_id long, url string"), [], model).collect()}
    assert [got[i] == "block" for i in range(len(unseen))] == [bool(v) for _, v in unseen]
    nothing = U.judge_urls(spark.createDataFrame([(2, None)], "page_id long, url string"), [], model).first()
    assert nothing.score == pytest.approx(1 / (1 + math.exp(-intercept)))


def test_too_few_labels_give_a_share(spark):
    table = U.labelled_urls(spark)
    assert U.fit(table.limit(0), n=8) == (0.0, [0.0] * 8)
    assert U.fit(table.where("label = 1"), n=8)[0] == pytest.approx(math.log(len(U.BLOCKED.split()) + 1))


def audited(rows, labels):
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    key = lambda d: (d is None, d or 0)
    least, cells = {}, defaultdict(Counter)
    for d, text, *_ in rows:
        least[text or ""] = min(least.get(text or "", (True, math.inf)), key(d))
    for d, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), key(d) > least[text])
        cells[lang or ""][fails, d in good, d in toxic] += 1
    out, shapley = {}, Counter()
    for part, docs in cells.items():
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                c = Counter()
                for (fails, g, t), n in docs.items():
                    failed = {x for x, y in zip("ABCDE", fails) if y}
                    gone, hit = bool(failed & set(order[:k])), f in failed
                    c["kept"] += n * (not gone and not hit)
                    c["removed"] += n * (not gone and hit)
                    c["redundant"] += n * (gone and hit)
                    c["unique_fails"] += n * (failed == {f})
                    c["good_lost"] += n * (not gone and hit and g)
                    c["toxic_lost"] += n * (not gone and hit and t)
                out[part, "".join(order), k + 1] = c
                shapley[part, f] += c["removed"]
    return {k: (*[c[m] for m in A.MEASURES], shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_of_all_orders(spark, seed):
    rng = random.Random(seed)
    rows = documents(seed) + [(i % 40, " ".join(rng.choice(["Aa", "BB", "c", "D", "e#", *"fghijkl", *map(str, range(200))]) for _ in range(rng.choice([50, 120, 300]))), "en", None, 1) for i in range(60)]
    rows += [(rng.choice([None, 3, 5000 + i]), t, rng.choice(["fr", None, ""]), "s", 1) for i, (_, t, *_) in enumerate(rng.sample(rows, 50))] + [(7, "same", "en", "s", 1)] * 3 + [(None, "lost", None, "s", 1)] * 2
    labels = [(rng.choice([*range(200), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    got = A.audit(frame(spark, rows), spark.createDataFrame([(*x, "en") for x in labels], "doc_id long, quality int, toxic int, part string"))
    assert got.columns == ["part", "filter_order", "step", *A.MEASURES, "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == audited(rows, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(frame(spark, []), labels).count() == 0
    assert {r.kept + r.removed for r in A.audit(frame(spark, [(1, None, None, None, 0)]), labels).where("step = 1").collect()} == {1}


def diverged(rows, least, most):
    docs = [(lang or "", source or "", Counter(t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df, groups = Counter(), defaultdict(Counter)
        for x, source, terms in docs:
            if x == lang:
                df.update(terms.keys())
                groups[source].update(terms)
        kept = [t for t, n in df.items() if n >= least]
        p = {}
        for name, c in [*groups.items(), (None, sum(groups.values(), Counter()))]:
            total = sum(c[t] for t in kept)
            p[name] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for source, c in groups.items():
            pairs = [(-sum(abs(p[source][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != source]
            terms = [(p[None][t] - p[source][t], t.encode(), t) for t in kept if c[t] and p[source][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out |= {(lang, source, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("cells", [D.CELLS, 40])
def test_divergence_of_sources(spark, cells, monkeypatch):
    monkeypatch.setattr(D, "PER_PAIR", 0 if cells < D.CELLS else D.PER_PAIR)
    rng = random.Random(cells)
    terms = ["a", "Ab", "abc", "ABCD", "éé", "word", "eightish", "ninechars", "exactlysixteenby", "seventeenbytesxx", "x" * 17, "y" * 17, "日本語日本語", "日本語日本語ü", "z" * 400]
    rows = documents(4) + [(i, " ".join(rng.choices(terms, range(1, 16), k=rng.choice([0, 5, 40]))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ç", "zz", None]), 1) for i in range(150)]
    rows += [(900, "", "xx", "only", 1), (901, None, "yy", "a", 1), (901, "12 !!", "yy", "b", 1)] + [(5, "twice the same", "en", "a", 1)] * 6
    got = {tuple(r) for r in D.divergence(frame(spark, rows), 5, 7, cells).collect()}
    assert got == diverged(rows, 5, 7)
    assert D.divergence(frame(spark, [])).count() == 0


def test_runs_of_terms_over_slices():
    rng = random.Random(0)
    texts = [" ".join("".join(rng.choice("aAbé") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 30]))) for _ in range(40)) for _ in range(30)] + [""]
    raw = [t.encode() for t in texts]
    off, group = np.concatenate([[0], np.cumsum([len(t) for t in raw])]), np.array([rng.randrange(3) for _ in raw])
    n, docs = Counter(), Counter()
    for g, t in zip(group, texts):
        words = [re.sub("A", "a", w) for w in t.split()]
        n.update((int(g), w) for w in words)
        docs.update((int(g), w) for w in set(words))
    for g, body, at, count, seen in D.term_runs(np.frombuffer(b"".join(raw), np.uint8), off, group):
        for k in range(len(g)):
            key = int(g[k]), body[at[k] : at[k + 1]].tobytes().decode()
            assert (n.pop(key), docs.pop(key)) == (count[k], seen[k])
    assert not n and not docs
