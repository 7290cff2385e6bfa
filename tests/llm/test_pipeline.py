import re

import corpus_pipeline as P

from .data import documents, frame
from .test_decontamination import brute, words as alnum
from .test_near_copies import brute as brute_copies
from .test_text_dedup import brute_windows, words


def test_each_stage_equals_brute_force(spark, tmp_path):
    rows = [(i, t, lang or "en", source, n) for i, t, lang, source, n in documents(13)]
    source = next(r[1] for r in rows if r[1] and len(alnum(r[1])) > 120)
    bench = [(1, " ".join(alnum(source)[5:30])), (2, "nothing like this"), (3, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[::3]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert set(docs.columns) == set(P.COLUMNS)
        seen[k] = {r.doc_id: r for r in docs.collect()}
        assert len(seen[k]) == docs.count()
    # language ID: only texts with a letter stay
    assert set(seen[0]) == {r[0] for r in rows if re.search(r"[^\W\d_]", r[1] or "")}
    comp = brute_copies([(d, r.text) for d, r in seen[0].items()])
    assert set(seen[1]) == set(comp.values()) and len(seen[1]) < len(seen[0])
    want = brute_windows([(d, r.text) for d, r in seen[1].items()], 20)
    assert set(seen[2]) == set(seen[1]) and any(w[1] for w in want.values())
    for d, r in seen[2].items():
        n, m, kept, _ = want[d]
        assert r.text == (kept if m else seen[1][d].text) and r.n_chars == len(r.text)
    hits = 0
    for d, r in seen[3].items():
        before = seen[2][d].text
        _, hit, _ = brute(before, bench, 10)
        hits += bool(hit)
        assert alnum(r.text) == [w for i, w in enumerate(alnum(before)) if i not in hit]
        assert hit or r.text == before
    assert hits and set(seen[3]) == set(seen[2])
    assert set(seen[4]) == set(seen[3])
    assert all(r.size == len(words(seen[3][d].text)) for d, r in seen[4].items())
    assert sum(r.taken for r in seen[4].values()) > 0
    ran = P.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, ran)) == sorted(map(repr, seen[4].values()))
