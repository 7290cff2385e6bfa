"""LM scoring by cross-entropy difference between a target and a background bigram model.

Both models count the same words and word pairs, over the target documents and over all documents, and smooth alike:
p(w | v) = 0.4 p(w) + 0.6 c(v w) / c(v) where v was seen, else p(w); p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). The shared
vocabulary is every word that occurs twice or more in all documents; all others are one unknown word, and pairs that
occur once in all documents have no count of their own. A document's score is its mean loss a token under the target
model less that under the background model: the lower, the closer to the target.

Counts grow with the corpus and never meet in one place: a chunk sends its own counts once a pair, a bucket sums them
and answers each chunk with the sums for the pairs it has. A chunk sends to the buckets that it has keys of only, so the
rows are never more than its keys, however many buckets there are. The five totals of the word model are summed over the
buckets, from the same exchange, and go along with the answers.

Cases: null and empty texts have 0 tokens and null losses; null and repeated labels: a document is in the target if any
row says so; null ids are in no target; repeated rows count each; empty target or empty table: losses by smoothing
alone, or an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B
from ._chunks import CHUNK_BYTES, bucket_bits, chunked, in_order
from .suffix_dedup import full_buckets

WEIGHT, ALPHA = 0.6, 0.1
_KINDS = ("w", "p")  # words, pairs
_SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int32()), *[(k + n, pa.binary()) for k in _KINDS for n in ("key", "all", "target")]])
_BACK = pa.schema([("chunk", pa.int32()), ("bucket", pa.int64()), *[(k + n, pa.binary()) for k in _KINDS for n in ("known", "all", "target")]])
_TOTALS = ("v", "all", "target", "unknown_all", "unknown_target")
_OUT = "doc_id long, n_tokens long, loss_target double, loss_background double"
_PAIR = np.uint64(0xA24BAED4963EE407)


def _spans(hashes: np.ndarray, bits: int) -> dict[int, tuple[int, int]]:
    """Where the sorted hashes of each bucket of leading bits begin and end; buckets without any are left out."""
    return {b: (i, j) for b, i, j in full_buckets(hashes, bits)}


def _ddl(schema):
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def pack(counts: np.ndarray) -> bytes:
    """Counts in the least of 1, 2, 4 or 8 bytes each; first byte: which."""
    top = int(counts.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", -1, 1).astype(np.int64)


def _tokens(table):
    data, off = B.text_bytes(table["text"])
    low = B.LOWER[data]
    starts, ends, word_off = B.word_bounds(low, off)
    words = B.hash_spans(B.lanes(low), starts, ends)
    inner = np.ones(len(words), bool)  # words with another before them
    inner[word_off[:-1][np.diff(word_off) > 0]] = False
    at = np.flatnonzero(inner)
    return words, word_off, at, B.mix(words[at - 1] * _PAIR + words[at])


def _counted(keys, weight):
    """(different keys in order, counts, counts of those with weight)."""
    ranked, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return ranked, counts, np.bincount(inverse, weight, len(ranked)).astype(np.int64)


def send_counts(bits):
    def run(key, table, target):
        if not table.num_rows:
            return _SENT.empty_table()
        table = in_order(table)
        words, word_off, at, pairs = _tokens(table)
        chosen = np.isin(B.one_array(table["doc_id"]).fill_null(-(2**63)).to_numpy(), B.one_array(target["_id"]).to_numpy())
        weight = np.repeat(chosen, np.diff(word_off)).astype(float)
        counted = {kind: _counted(keys, wt) for kind, keys, wt in (("w", words, weight), ("p", pairs, weight[at]))}
        spans = {kind: _spans(c[0], bits) for kind, c in counted.items()}
        buckets = sorted({*spans["w"], *spans["p"]})
        rows = {"bucket": buckets, "chunk": [key[0].as_py()] * len(buckets)}
        for kind, values in counted.items():
            for name, put, value in zip(("key", "all", "target"), (B.pack_sorted, pack, pack), values):
                rows[kind + name] = [put(value[slice(*spans[kind].get(b, (0, 0)))]) for b in buckets]
        return pa.table(rows, schema=_SENT)

    return run


def _summed(table, kind):
    """(places of each row's keys among all different ones, their counts everywhere, their counts in the target)."""
    keys = [B.unpack_sorted(x) for x in table[kind + "key"].to_pylist()]
    ranked, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total, inside = (np.bincount(inverse, np.concatenate([unpack(x) for x in table[kind + n].to_pylist()]), len(ranked)).astype(np.int64) for n in ("all", "target"))
    return np.split(inverse, np.cumsum([len(k) for k in keys])[:-1]), total, inside


def word_totals(key, table):
    """Of a bucket's words: how many occur twice or more anywhere, all tokens, the target's, and those of other words."""
    _, total, inside = _summed(table, "w")
    once = total < 2
    return pa.table([[int(x)] for x in ((~once).sum(), total.sum(), inside.sum(), total[once].sum(), inside[once].sum())], names=list(_TOTALS))


def sum_counts(key, table):
    """For each chunk: which of its keys occur twice or more anywhere, and their sums."""
    B.tidy()
    rows = {"chunk": table["chunk"].combine_chunks(), "bucket": pa.array([key[0].as_py()] * table.num_rows, pa.int64())}
    for kind in _KINDS:
        places, total, inside = _summed(table, kind)
        known = total > 1
        rows[kind + "known"] = pa.array([np.packbits(known[p]).tobytes() for p in places], pa.binary())
        for name, values in (("all", total), ("target", inside)):
            rows[kind + name] = pa.array([pack(values[p[known[p]]]) for p in places], pa.binary())
    return pa.table(rows, schema=_BACK)


def score(bits):
    def run(key, table, back):
        table = in_order(table)
        words, word_off, at, pairs = _tokens(table)
        of = {}
        answers = back.to_pylist()
        for kind, keys in (("w", words), ("p", pairs)):
            ranked, inverse = np.unique(keys, return_inverse=True)
            spans = _spans(ranked, bits)
            known, sums = np.zeros(len(ranked), bool), np.zeros((2, len(ranked)), np.int64)
            for r in answers:
                a, b = spans.get(r["bucket"], (0, 0))
                got = np.unpackbits(np.frombuffer(r[kind + "known"], np.uint8), count=int(b - a)).astype(bool)
                known[a:b] = got
                for k, name in enumerate(("target", "all")):
                    sums[k, a:b][got] = unpack(r[kind + name])
            of[kind] = known[inverse], sums[:, inverse]
        v, n_all, n_target, unknown_all, unknown_target = answers[0]["totals"] if answers else (0,) * 5
        losses = []
        for k, (n, unknown) in enumerate(((n_target, unknown_target), (n_all, unknown_all))):
            known, sums = of["w"]
            p = (np.where(known, sums[k], unknown) + ALPHA) / (n + ALPHA * (v + 1))
            before = np.where(known[at - 1], sums[k][at - 1], 0)
            seen = before > 0
            p[at] = np.where(seen, (1 - WEIGHT) * p[at] + WEIGHT * of["p"][1][k] / np.maximum(1, before), p[at])
            upto = np.concatenate([[0.0], np.cumsum(-np.log(p))])[word_off]
            losses.append(np.diff(upto) / np.maximum(1, np.diff(word_off)))
        none = np.diff(word_off) == 0
        return pa.table({"doc_id": table["doc_id"], "n_tokens": pa.array(np.diff(word_off), pa.int64()), "loss_target": pa.array(losses[0], mask=none), "loss_background": pa.array(losses[1], mask=none)})

    return run


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score; target_ids holds the doc_id of target documents."""
    parts, size, add_chunk = chunked(docs, chunk_bytes, with_places=True)
    bits = bucket_bits(size / 6)
    ids = add_chunk(target_ids.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null"), "_id", texts=False)
    sent = parts.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(send_counts(bits), _ddl(_SENT))
    totals = sent.groupBy("bucket").applyInArrow(word_totals, ", ".join(f"{c} long" for c in _TOTALS)).agg(F.array(*[F.sum(c) for c in _TOTALS]).alias("totals"))
    back = sent.groupBy("bucket").applyInArrow(sum_counts, _ddl(_BACK)).withColumn("totals", totals.scalar())
    out = parts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score(bits), _OUT)
    return out.withColumn("score", F.col("loss_target") - F.col("loss_background"))
