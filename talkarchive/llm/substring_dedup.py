"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A word goes if a window over it has a word sequence that starts earlier too: in a document with a smaller doc_id, or
earlier in the same document. Windows are judged on the input. Words are runs of bytes outside space and \\t-\\r.

Two counts by Spark decide. Every window is named by the least Rabin-Karp hash of the GRAM-word strings inside it; equal
windows have equal names, neighbouring windows mostly share one, and a name that one chunk alone has ends there. Then the
hashes of all windows of the other names, each once a chunk, are counted: a hash with a smaller chunk is repeated, and
repeats inside a chunk are found where it is hashed. Rows are a hash and a chunk number, so nothing grows with a hot
passage but the number of chunks that have it.

Cases: null and empty texts have no words and stay empty; texts shorter than a window lose nothing; rows that repeat a
doc_id count as further documents in the order of a hash of their texts; null ids count as the largest, in that order; an
empty table gives an empty result; columns other than doc_id and text are not read. Equal hashes inside a chunk are
compared word by word (as 64-bit word hashes); between chunks two window hashes are taken to be equal sequences: with 64
mixed bits a false match is expected once in about 2**65 / n**2 runs of n windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import _bytes as B
from ._chunks import CHUNK_BYTES, chunked, in_order

WINDOW, GRAM = 20, 8
_SENT = pa.schema([("hash", pa.int64()), ("chunk", pa.int32())])
_OUT = "doc_id long, n_words long, n_removed long, kept_text string, intervals array<struct<start:long,end:long>>"


class _Chunk:
    """The windows of a chunk: where each begins, its hash, and those equal to an earlier one here."""

    def __init__(self, table: pa.Table, window: int):
        self.data, off = B.text_bytes(table["text"])
        self.starts, self.ends, self.word_off = B.word_bounds(self.data, off)
        self.words = B.hash_spans(B.lanes(self.data), self.starts, self.ends)
        self.window = window
        self.first, self.hash = B.rolling(self.words, self.word_off, window)

    def names(self, gram: int) -> np.ndarray:
        """The name of every window."""
        _, h = B.rolling(self.words, np.array([0, len(self.words)]), gram)
        span, width = 1, self.window - gram + 1
        while 2 * span <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < width:
            h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
        return h[self.first]

    def repeated(self) -> np.ndarray:
        """Which windows have an equal one earlier in this chunk."""
        order = np.argsort(self.hash, kind="stable")
        ranked, at = self.hash[order], self.first[order]
        same = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
        for k in range(self.window):
            same = same[self.words[at[same] + k] == self.words[at[same - 1] + k]]
        out = np.zeros(len(order), bool)
        out[order[same]] = True
        return out


def _rows(hashes: np.ndarray, chunk) -> pa.Table:
    return pa.table([pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), chunk, np.int32))], schema=_SENT)


def send_names(window: int, gram: int):
    def run(key, table):
        return _rows(np.unique(_Chunk(in_order(table), window).names(gram)), key[0].as_py())

    return run


def send_windows(window: int, gram: int):
    """The window hashes of a chunk's names that other chunks have too, each once."""

    def run(key, table, back):
        c = _Chunk(in_order(table), window)
        return _rows(np.unique(c.hash[_among(c.names(gram), back)]), key[0].as_py())

    return run


def _among(hashes: np.ndarray, back: pa.Table) -> np.ndarray:
    known = np.sort(B.one_array(back["hash"]).to_numpy().view(np.uint64))
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    return known[at] == hashes if len(known) else np.zeros(len(hashes), bool)


def _kept_bytes(data, starts, ends, word_off, gone) -> list[bytes]:
    """Each document's kept words, joined by one space."""
    keep = ~gone
    length = np.where(keep, ends - starts + 1, 0)
    take = B.ranges(starts, length)
    out = np.concatenate([data, [np.uint8(0x20)]])[np.minimum(take, len(data))]
    upto = np.concatenate([[0], np.cumsum(length)])
    out[upto[1:][keep] - 1] = 0x20
    whole, bounds = out.tobytes(), upto[word_off].tolist()
    return [whole[a : max(a, b - 1)] for a, b in zip(bounds, bounds[1:])]


def apply(window: int):
    def run(key, table, back):
        table = in_order(table)
        c = _Chunk(table, window)
        gone = B.cover(c.first[c.repeated() | _among(c.hash, back)], window, len(c.starts))
        return _full(table, c.data, c.starts, c.ends, c.word_off, gone)

    return run


def _full(table, data, starts, ends, word_off, gone):
    n = len(gone)
    edge = np.zeros(n + 1, bool)
    edge[word_off] = True
    run_start = np.flatnonzero(gone & (edge[:n] | ~np.concatenate([[False], gone[:-1]]))) if n else np.empty(0, np.int64)
    run_end = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1 if n else np.empty(0, np.int64)
    runs = np.searchsorted(run_start, word_off)
    base = np.repeat(word_off[:-1], np.diff(runs))
    spans = pa.StructArray.from_arrays([pa.array(run_start - base, pa.int64()), pa.array(run_end - base, pa.int64())], ["start", "end"])
    n_gone = np.concatenate([[0], np.cumsum(gone)])[word_off]
    more = {c: table[c] for c in table.column_names if c not in ("chunk", "doc_id", "text")}
    return pa.table({
        "doc_id": table["doc_id"], "n_words": pa.array(np.diff(word_off), pa.int64()), "n_removed": pa.array(np.diff(n_gone), pa.int64()),
        "kept_text": pa.array(_kept_bytes(data, starts, ends, word_off, gone), pa.binary()).cast(pa.string()),
        "intervals": pa.ListArray.from_arrays(pa.array(runs, pa.int32()), spans), **({"text": table["text"]} if more else {}), **more,
    })


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, carry: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, and the removed word intervals [start, end), maximal and in order.

    With carry, the result also has text and that column.
    """
    parts, _ = chunked(docs, chunk_bytes, carry=carry)
    out = f"{_OUT}, text string, {carry} {parts.schema[carry].dataType.simpleString()}" if carry else _OUT
    by_chunk, same = parts.groupBy("chunk"), Window.partitionBy("hash")
    rows = "hash long, chunk int"
    names = by_chunk.applyInArrow(send_names(window, gram), rows)
    shared = names.withColumn("n", F.count("*").over(same)).where("n > 1").drop("n")
    sent = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(send_windows(window, gram), rows)
    counted = sent.withColumn("n", F.count("*").over(same)).withColumn("least", F.min("chunk").over(same))
    back = counted.where("n > 1 and chunk > least").select("hash", "chunk")
    return parts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(apply(window), out)
