"""What the pipeline's stages leave on the driver: rounds of jobs, plans that repeat themselves, a model's arrays."""

import random
import tracemalloc

import pytest

from talkarchive.llm import language_id, simhash, source_mixing

from .data import documents, frame


def brute_roots(links):
    root = {n: n for link in links for n in link if link[0] != link[1]}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {(n, find(n)) for n in root if find(n) != n}


def random_links(seed):
    rng = random.Random(seed)
    return [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(rng.choice([20, 60, 200]))]


@pytest.mark.parametrize("links, rounds", [
    ([], 0), ([(3, 3)], 0), ([(5, 1), (1, 6), (7, 1), (5, 1), (9, 8)], 0), ([(2, 1), (3, 1), (3, 2)], 1), ([(i, i + 1) for i in range(50)], None),
    ([(-1, 5), (5, 9), (-2, 9)], None), (random_links(1), None), (random_links(2), None), (random_links(3), None),
])
def test_components_take_no_round_for_stars(spark, monkeypatch, links, rounds):
    cuts, cut = [], simhash.cut_lineage
    monkeypatch.setattr(simhash, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    got = [(r.node, r.root) for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_roots(links)
    assert rounds is None or len(cuts) == rounds + 1


def test_plan_of_the_mix_holds_each_window_once(spark):
    """Targets of sources and sums of ranges stand in the plan as rows, not as the work that made them."""
    out = source_mixing.mix_sources(frame(spark, documents(7)), spark.createDataFrame([(3, 1.0)], "doc_id long, quality double"), 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 1 and plan.count("Join") == 0


def test_language_model_is_fitted_in_slices():
    rng = random.Random(5)
    texts = [(lang, " ".join(rng.choice(("the", "wort", "señal", "x1")) for _ in range(2500))) for lang in ("a", "b") for _ in range(200)]
    size = sum(len(t) for _, t in texts)
    assert size > 3 << 20
    tracemalloc.start()
    language_id.Model(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * size
