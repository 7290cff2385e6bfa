"""Language ID by error-correcting output codes over byte trigrams.

Every language has a codeword. One binary classifier a bit, a naive Bayes log-odds table over hashed trigrams of case-
folded bytes, is fitted on a bounded sample of labelled rows. A text's trigrams are summed through all tables at once,
and loss-weighted decoding picks the language whose codeword has the least logistic loss. Texts whose two best
codewords are close are flagged as ambiguous.

The only bound: PER_LANGUAGE labelled texts a language (about; chosen by a hash of the id) are fitted on.

Cases: null texts and texts without a letter are `und` with score 0; without any learned language all are `und`; with
one, all others have it; very long texts count whole; repeated rows are judged alike; an empty table gives an empty
result; other columns are not read for a prediction.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B

PER_LANGUAGE, MARGIN, SMOOTH = 1000, 0.1, 0.5
#: Bytes of text that the driver counts at once while it fits.
FIT_BYTES = 128 << 10
SIZE = 1 << 18
#: Bytes in 64 classes: 0 for ASCII that is no letter, 1-26 for letters, 27-63 for the others.
FOLD = np.zeros(256, np.uint32)
FOLD[65:91] = FOLD[97:123] = np.arange(1, 27)
FOLD[128:] = 27 + np.arange(128) % 37


def codewords(n: int) -> np.ndarray:
    """n rows of +-1: the exhaustive code up to 5 languages, beyond that the best of some seeded random codes."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1)][1:]
        return np.array(columns, np.float32).T
    rng, best = random.Random(n), None
    bits = 15 * (n - 1).bit_length()
    for _ in range(50):
        code = np.array([[rng.choice((-1, 1)) for _ in range(bits)] for _ in range(n)], np.float32)
        least = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if (best is None or least > best[0]) and (abs(code.sum(0)) < n).all():
            best = least, code
    return best[1]


def _grams(data: np.ndarray, off: np.ndarray):
    """(trigram numbers, flat bytes): each text between two blanks, whose trigrams are as many as its bytes; what would
    begin after them, and cross into the next text, is number 0, which counts for nothing."""
    n = len(off) - 1
    flat = np.zeros(len(data) + 2 * n, np.uint32)
    flat[np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(off)) + 1] = FOLD[data]
    grams = (flat[:-2] << 12) | (flat[1:-1] << 6) | flat[2:] if len(flat) > 2 else np.empty(0, np.uint32)
    past = off[1:] + 2 * np.arange(n)
    past = np.concatenate([past, past + 1])
    grams[past[past < len(grams)]] = 0
    return grams, flat


def _has_letter(data, off) -> np.ndarray:
    letter = np.concatenate([[0], np.cumsum((FOLD[data] > 0) & (FOLD[data] < 27))])[off]
    out = np.diff(letter) > 0
    high = np.concatenate([[0], np.cumsum(data >= 128)])[off]
    for d in np.flatnonzero(~out & (np.diff(high) > 0)):
        out[d] = any(c.isalpha() for c in data[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


class Model:
    def __init__(self, texts: list[tuple[str, str]], smooth: float = SMOOTH):
        self.langs = sorted({lang for lang, _ in texts})
        counts = np.zeros((len(self.langs), SIZE))
        for k, lang in enumerate(self.langs):
            known = [t for g, t in texts if g == lang]
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(known))), pa.array(known, pa.string())], ["doc_id", "text"])
            share = np.zeros(SIZE, np.int64)
            for _, data, off in B.slices([batch], FIT_BYTES):
                share += np.bincount(_grams(data, off)[0], minlength=SIZE)
            share[0] = 0
            counts[k] = share / max(1, share.sum()) * 1e6  # languages weigh alike
        self.code = codewords(len(self.langs))
        bits = self.code.shape[1]
        table = np.zeros((SIZE, bits), np.float32)
        for b in range(bits):
            yes, no = counts[self.code[:, b] > 0].sum(0) + smooth, counts[self.code[:, b] < 0].sum(0) + smooth
            table[:, b] = np.log(yes / yes.sum()) - np.log(no / no.sum())
        table[0] = 0
        self.table = table

    def decide(self, data: np.ndarray, off: np.ndarray, margin: float):
        """(language number or -1, score, ambiguous) of each text."""
        n = len(off) - 1
        if not len(self.langs):
            return np.full(n, -1), np.zeros(n), np.zeros(n, bool)
        sums = np.zeros((n, self.code.shape[1]), np.float64)
        full = np.flatnonzero(np.diff(off))
        if len(full):
            grams, _ = _grams(data, off)
            values = self.table[grams]
            sums[full] = np.add.reduceat(values, (off[:-1] + 2 * np.arange(n))[full], axis=0, dtype=np.float64)
        outputs = sums / np.sqrt(np.maximum(1, np.diff(off)))[:, None]
        loss = np.logaddexp(0, -outputs[:, None, :] * self.code[None]).sum(2)
        weight = np.exp(loss.min(1, keepdims=True) - loss)
        share = weight / weight.sum(1, keepdims=True)
        best = loss.argmin(1)
        ranked = np.sort(loss, 1)
        close = (ranked[:, 1] - ranked[:, 0] < margin) if len(self.langs) > 1 else np.zeros(n, bool)
        ok = _has_letter(data, off)
        return np.where(ok, best, -1), np.where(ok, share[np.arange(n), best], 0.0), close | ~ok


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of about per_language rows of each language of (doc_id, text, lang); the driver gets only those."""
    rows = labelled.select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text rlike '\\\\p{L}'")
    counts = {r.lang: r["count"] for r in labelled.where("lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        limit = int(min(1.0, per_language / n) * 2**63) * 2 - 2**63 - 1 if n > per_language else 2**63 - 1
        chosen = chosen | ((F.col("lang") == lang) & (F.col("h") <= limit))
    model = Model(sorted((r.lang, r.text) for r in rows.where(chosen).select("lang", "text").collect()))
    B.tidy()  # the driver's Python lives as long as the session
    return model


def identify(docs: DataFrame, model: Model, margin: float = MARGIN, carry: str | None = None) -> DataFrame:
    """doc_id, lang_pred, score (the share of the best codeword), ambiguous; with carry, also text and that column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([carry] if carry else []))

    def run(batches):
        for batch in batches:
            at = 0
            for ids, data, off in B.slices([batch], 1 << 20):
                model = shared.value
                best, score, close = model.decide(data, off, margin)
                names = np.array([*model.langs, "und"], object)[best]
                part = batch.slice(at, len(ids))
                at += len(ids)
                kept = [part[c] for c in ("text", carry)] if carry else []
                yield pa.RecordBatch.from_arrays([ids, *kept, pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(close)], ["doc_id", *(("text", carry) if carry else ()), "lang_pred", "score", "ambiguous"])

    found = "lang_pred string, score double, ambiguous boolean"
    return rows.mapInArrow(run, f"doc_id long, text string, {carry} {rows.schema[carry].dataType.simpleString()}, {found}" if carry else f"doc_id long, {found}")


def held_out(modulus: int, rest: int):
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus) == rest
