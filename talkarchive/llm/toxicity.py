"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Examples are a bounded sample of labelled documents. Terms are whole words and their first 4 to 6 characters' bytes
(as "4:idio"); all that go with the label beyond chance in the sample (|z| >= LEAST_Z, in LEAST_SEEN examples or more) span
the vectors, whatever their number, and weigh by their document frequency in the whole corpus, which Spark counts. Every
task holds the index: postings in blocks of examples, and the greatest weight of a term in a block. A document's blocks are
taken by falling upper bound and the search stops when no block left can beat the k-th best cosine, so the k neighbours are
exact. Their squared cosines weigh their labels, shrunk towards the base rate; a logistic curve fitted on the examples
themselves, each left out in turn, makes the vote a probability. The neighbours are the evidence.

The only bound: PER_CLASS examples a label. All documents are scored on their whole text. Cosines over the examples' whole
vocabulary (125,938 words at sf0.1) are those of the topic: 38 of 97 held-out toxic documents found there, hence the test.

Cases: null, empty and unknown texts have no neighbour and score as the examples without terms do; ties in cosine go
to the smaller example id; repeated labels of a document count as the highest; without examples, or with one label
only, all documents score the base rate; repeated rows score alike; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B

PER_CLASS, NEIGHBOURS, BLOCK = 2000, 15, 64
LEAST_Z, LEAST_SEEN, SHRINK, PREFIXES = 5.0, 3, 0.05, (4, 5, 6)


def _terms(data: np.ndarray, off: np.ndarray):
    """(document, term hash) of every word and word prefix."""
    low = B.LOWER[data]
    starts, ends, word_off = B.word_bounds(low, off, B.NOT_ALNUM)
    doc, view = np.repeat(np.arange(len(off) - 1), np.diff(word_off)), B.lanes(low)
    docs, terms = [doc], [B.hash_spans(view, starts, ends)]
    for n in PREFIXES:
        some = ends - starts > n
        docs.append(doc[some])
        terms.append(B.mix((view[starts[some]] & B._MASKS[n]) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(terms)


class Model:
    def __init__(self, examples: list[tuple[int, str, int]], rate: float, frequencies=None):
        """examples: (doc_id, text, label), with labels at the share `rate` among all that were not held out.

        frequencies(terms) gives how many documents have each term, and how many there are; without it the examples count.
        """
        self.rate, self.k = rate, NEIGHBOURS
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.label = np.array([e[2] for e in examples], np.int64)
        self.terms = np.empty(0, np.uint64)
        self.slope, self.shift = 0.0, _logit(rate)
        n1 = int(self.label.sum())
        if not 0 < n1 < len(examples):
            self.index(np.empty((0, 3)))
            return
        n0 = len(examples) - n1
        data, off = B.text_bytes(pa.array([e[1] for e in examples], pa.string()))
        doc, term = _terms(data, off)
        pair = np.unique(np.rec.fromarrays([term, doc]))
        terms, first, seen = np.unique(pair.f0, return_index=True, return_counts=True)
        toxic = np.add.reduceat(self.label[pair.f1], first)
        share = seen / len(examples)
        z = (toxic / n1 - (seen - toxic) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
        good = np.flatnonzero((np.abs(z) >= LEAST_Z) & (seen >= LEAST_SEEN))
        self.terms = terms[good]
        df, n = frequencies(self.terms) if frequencies else (seen[good], len(examples))
        self.idf = np.log((1 + n) / (1 + df)) + 1
        rows = self.vectors(data, off)
        self.index(rows)
        # leave-one-out votes, then the curve, weighted back to the base rate
        votes = np.array([self.vote(q, w, leave=d)[0] for d, (q, w) in enumerate(self.split(rows, len(examples)))])
        weight = np.where(self.label == 1, rate / n1, (1 - rate) / n0)
        self.slope, self.shift = _logistic(votes, self.label, weight / weight.sum() * len(votes), rate)

    def vectors(self, data, off) -> np.ndarray:
        """Rows (document, term number, weight), unit length a document, in order."""
        doc, term = _terms(data, off)
        at = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
        hit = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        key, count = np.unique(doc[hit] * max(1, len(self.terms)) + at[hit], return_counts=True)
        if not len(key):
            return np.empty((0, 3))
        doc, term = key // len(self.terms), key % len(self.terms)
        w = (1 + np.log(count)) * self.idf[term]
        length = np.sqrt(np.bincount(doc, w * w))
        return np.column_stack([doc, term, w / length[doc]])

    @staticmethod
    def split(rows: np.ndarray, n: int):
        cut = np.searchsorted(rows[:, 0], np.arange(n + 1))
        return [(rows[a:b, 1].astype(np.int64), rows[a:b, 2]) for a, b in zip(cut, cut[1:])]

    def index(self, rows: np.ndarray) -> None:
        """Postings by term and block; examples are renumbered by label and heaviest term, so that blocks are alike."""
        n = len(self.ids)
        heavy = np.full(n, -1)
        for d, (t, w) in enumerate(self.split(rows, n)):
            if len(t):
                heavy[d] = t[w.argmax()]
        self.order = np.lexsort((self.ids, heavy, self.label))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.blocks = -(-n // BLOCK)
        example, term = place[rows[:, 0].astype(np.int64)], rows[:, 1].astype(np.int64)
        by = np.lexsort((example, term))
        self.example, self.weight = example[by], rows[by, 2]
        cell = term[by] * max(1, self.blocks) + self.example // BLOCK
        self.cut = np.searchsorted(cell, np.arange(len(self.terms) * self.blocks + 1)).reshape(-1)
        self.most = np.zeros(len(self.terms) * self.blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(len(self.terms), self.blocks) if self.blocks else self.most

    def nearest(self, terms: np.ndarray, weights: np.ndarray, leave: int = -1):
        """The k examples of greatest positive cosine: (numbers, cosines), best first; leave: an example to leave out."""
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        bound = weights @ self.most[terms]
        found, cosines, least = np.empty(0, np.int64), np.empty(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or bound[b] < least - 1e-9:
                break
            sums = np.zeros(BLOCK)
            for t, w in zip(terms, weights):
                a, e = self.cut[t * self.blocks + b], self.cut[t * self.blocks + b + 1]
                if a < e:
                    sums[self.example[a:e] - b * BLOCK] += w * self.weight[a:e]
            at = np.flatnonzero(sums > 0)
            who = self.order[at + b * BLOCK]
            at, who = at[who != leave], who[who != leave]
            found, cosines = np.concatenate([found, who]), np.concatenate([cosines, np.round(sums[at], 9)])
            if len(found) > self.k:
                best = np.lexsort((self.ids[found], -cosines))[: self.k]
                found, cosines = found[best], cosines[best]
                least = cosines[-1]
        best = np.lexsort((self.ids[found], -cosines))
        return found[best], cosines[best]

    def vote(self, terms, weights, leave: int = -1):
        who, cosines = self.nearest(terms, weights, leave)
        w = cosines**2
        return ((w * self.label[who]).sum() + SHRINK * self.rate) / (w.sum() + SHRINK), who, cosines

    def calibrated(self, vote: float) -> float:
        return float(1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * _logit(vote) + self.shift)))))


def _logit(p: float) -> float:
    p = min(1 - 1e-4, max(1e-4, p))
    return math.log(p / (1 - p))


def _logistic(votes, label, weight, rate) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the logit of the votes, with a small penalty on leaving (1, 0)."""
    x = np.column_stack([np.log(v / (1 - v)) for v in [np.clip(votes, 1e-4, 1 - 1e-4)]] + [np.ones(len(votes))])
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (weight * (p - label)) + (theta - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(h, g)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def counted(docs: DataFrame):
    """frequencies(terms) over all documents: one pass, summed a task before the shuffle; the driver gets a row a term."""
    texts = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def frequencies(terms: np.ndarray):
        shared = docs.sparkSession.sparkContext.broadcast(terms)

        def run(batches):
            known, total, n = shared.value, np.zeros(len(shared.value), np.int64), 0
            for ids, data, off in B.slices(batches, 2 << 20):
                n += len(ids)
                doc, term = _terms(data, off)
                at = np.minimum(np.searchsorted(known, term), max(0, len(known) - 1))
                hit = known[at] == term if len(known) else np.zeros(len(term), bool)
                total += np.bincount(np.unique(doc[hit] * len(known) + at[hit]) % max(1, len(known)), minlength=len(known)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known) + 1), pa.int64()), pa.array(np.append(total, n), pa.int64())], ["term", "n"])

        rows = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        got = np.zeros(len(terms) + 1, np.int64)
        for r in rows:
            got[r.term] = r.n
        return got[:-1], int(got[-1])

    return frequencies


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of at most per_class documents of each label of labels (doc_id, toxic), the first by a hash of the id."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label"))
    counts = {r._label: r["count"] for r in known.groupBy("_label").count().collect()}
    chosen = None
    for k in counts:
        some = known.where(F.col("_label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return Model([], 0.0)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text")).collect()  # 2 * per_class ids, a text each
    # copies of one text count once, or their words would all seem to go with its label
    one = {(r.text or "", r._label): (r.doc_id, r.text or "", r._label) for r in sorted(rows, key=lambda r: -r.doc_id)}
    return Model(list(one.values()), counts.get(1, 0) / sum(counts.values()), counted(docs))


_OUT = "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,toxic:int,cosine:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted (score >= 0.5), evidence: the nearest examples with their labels and cosines."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        model, seen = shared.value, {}
        for ids, data, off in B.slices(batches, 2 << 20):
            scores, why = [], []
            for terms, weights in model.split(model.vectors(data, off), len(ids)):
                key = (terms.tobytes(), weights.tobytes())
                if key not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    vote, who, cosines = model.vote(terms, weights)
                    seen[key] = model.calibrated(vote), [{"doc_id": int(model.ids[w]), "toxic": int(model.label[w]), "cosine": float(c)} for w, c in zip(who, cosines)]
                s, e = seen[key]
                scores.append(s)
                why.append(e)
            s = np.array(scores)
            yield pa.RecordBatch.from_arrays([B.one_array(ids), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(why, evidence)], ["doc_id", "score", "predicted", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)
