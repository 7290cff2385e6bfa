"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, size string, fp string, n_words string"
BARE = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=0, n=60):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "é", "Ünder", "A", "z9", "|", "foo,", "word.", "日本"] + [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    texts = [None, "", " \t\n\u000b ", "one", "one two", "!!", "a b c d", "é", "x" * 3000, "ab " * 900, "12 34"]
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 19, 20, 21, 60, 200]))]
        if rng.random() < 0.4:
            k = rng.randrange(len(words))
            words[k:k] = passage.split()
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += [rng.choice(texts[11:]) for _ in range(n // 3)]
    near = texts[-1].split(" ")
    near[0] = "changed"
    texts.append(" ".join(near))
    rng.shuffle(texts)
    rows = [(i * 3 % 1009, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), 1) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows, extra=True):
    if extra:
        rows = [(*r, 7, "x", "y", "z") for r in rows]
        return spark.createDataFrame(rows, SCHEMA)
    return spark.createDataFrame(rows, BARE)
