"""Benchmark decontamination with an FM-index a training shard.

A shard is a few MB of neighbouring rows. Its words become numbers of the benchmark's vocabulary; stretches without
room for a whole window of benchmark words cannot hold an occurrence and stay out of the index. The rest is one
sequence with a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and every eighth suffix position.
Windows are searched backward through wavelet ranks, all windows of a length at once; the rows found walk back to the
next sampled position, and the spans of words they cover are merged.

Texts are lower-cased in A-Z; words are runs of digits, ASCII letters and non-ASCII bytes. A window is `width`
consecutive item words; an item of fewer words is one window. The benchmark is the query set: it is sent to the tasks
in blocks of at most BLOCK_BYTES of text, and each block goes over all rows in one narrow pass, without a shuffle.

Cases: null and empty texts have no words and no hits; items without words are never found; item ids are compared as
strings, a null id as "null", repeated ids count once; repeated documents are judged alike; an empty benchmark or an
empty table gives no hits or no rows; columns other than doc_id and text, item_id and text are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B

WIDTH, SHARD_BYTES, BLOCK_BYTES, SAMPLE_STEP = 10, 4 << 20, 16 << 20, 8
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("item_ids", pa.list_(pa.string()))])
_DDL = "doc_id long, text string, n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"


class Windows:
    """The windows of one block of items, as numbers over the block's vocabulary (1, 2, ..; 0 is any other word)."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        words = [(i, _WORD.findall(t.encode().lower())) for i, t in items]  # bytes.lower() changes A-Z only
        vocab = sorted({w for _, ws in words for w in ws})
        flat = np.frombuffer(b"".join(vocab), np.uint8)
        ends = np.cumsum([len(w) for w in vocab], dtype=np.int64) if vocab else np.empty(0, np.int64)
        starts = ends - np.array([len(w) for w in vocab], np.int64)
        hashes = B.hash_spans(B.lanes(flat), starts, ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = np.empty(len(vocab), np.int64)
        number[order] = np.arange(1, len(vocab) + 1)
        of = dict(zip(vocab, number.tolist()))
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, ws in words:
            ids = [of[w] for w in ws]
            for k in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + width]), set()).add(item)
        self.size = len(vocab) + 1
        self.items = sorted({i for s in owners.values() for i in s})
        place = {i: k for k, i in enumerate(self.items)}
        self.groups = []  # (windows of one length, their first number, owners as a ragged list)
        for length in sorted({len(w) for w in owners}):
            some = [w for w in owners if len(w) == length]
            lists = [[place[i] for i in owners[w]] for w in some]
            self.groups.append((np.array(some, np.int64), np.cumsum([0] + [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)))
        self.shortest = min((g[0].shape[1] for g in self.groups), default=0)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of seq in order, by prefix doubling over the positions that are still tied."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    rank = np.empty(n, np.int64)
    ranked = seq[order]
    head = np.ones(n, bool)
    head[1:] = ranked[1:] != ranked[:-1]
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # a tied group has the place of its first
    step = 1
    while True:
        last = np.ones(n, bool)
        last[:-1] = head[1:]
        tied = np.flatnonzero(~(head & last))  # places in groups of two or more
        if not len(tied):
            return order
        at = order[tied]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        inner = np.lexsort((after, rank[at]))
        at, after = at[inner], after[inner]
        order[tied] = at
        group = rank[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        head[tied] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        step *= 2


class FMIndex:
    def __init__(self, seq: np.ndarray, size: int):
        """seq: numbers below size. A sentinel below all of them ends the text."""
        text = np.append(seq + 1, 0)
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.n, self.levels = len(text), max(1, int(size).bit_length())
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size + 2))])
        self.ones, self.zeros, row = [], [], self.bwt
        for level in range(self.levels - 1, -1, -1):  # the wavelet matrix: zeros of a level go before its ones
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        marked = sa % SAMPLE_STEP == 0
        self.marked, self.before = marked, np.cumsum(marked) - marked
        self.sampled = sa[marked]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first upto places of the transform."""
        start, at = np.zeros(len(symbol), np.int64), upto
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            up = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[k][start], self.ones[k][at]
            start, at = np.where(up, self.zeros[k] + a, start - a), np.where(up, self.zeros[k] + b, at - b)
        return at - start

    def search(self, windows: np.ndarray):
        """(window, low, high) for the windows that occur: rows low..high of the index start with them."""
        live = np.arange(len(windows))
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for k in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[live, k] + 1
            low, high = self.less[symbol] + self.rank(symbol, low), self.less[symbol] + self.rank(symbol, high)
            some = low < high
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the transform until a sampled position."""
        out, steps, live = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(live):
            done = self.marked[rows]
            out[live[done]] = self.sampled[self.before[rows[done]]] + steps
            live, rows = live[~done], rows[~done]
            symbol = self.bwt[rows]
            rows = self.less[symbol] + self.rank(symbol, rows)
            steps += 1
        return out


def occurrences(windows: Windows, words: np.ndarray, word_off: np.ndarray):
    """(first word, words, item number) of every occurrence; words are hashes, documents word_off[d]:word_off[d+1]."""
    at = np.minimum(np.searchsorted(windows.hashes, words), max(0, len(windows.hashes) - 1))
    known = windows.hashes[at] == words if len(windows.hashes) else np.zeros(len(words), bool)
    edge = np.zeros(len(words) + 1, bool)
    edge[word_off] = True
    starts = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    room = ends - starts >= max(1, windows.shortest)
    starts, length = starts[room], (ends - starts)[room]
    if not len(starts):
        return (np.empty(0, np.int64),) * 3
    place = B.ranges(starts, length + 1)  # one place more a stretch, for the separator 0
    seq = np.where(np.isin(np.arange(len(place)), np.cumsum(length + 1) - 1), 0, at[np.minimum(place, len(at) - 1)] + 1)
    index = FMIndex(seq, windows.size)
    found = []
    for group, bounds, owners in windows.groups:
        hit, low, high = index.search(group)
        if not len(hit):
            continue
        which = np.repeat(hit, high - low)
        first = place[index.locate(B.ranges(low, high - low))]
        n = np.diff(bounds)[which]
        found.append((np.repeat(first, n), np.full(int(n.sum()), group.shape[1]), owners[B.ranges(bounds[which], n)]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def _shards(batches, size):
    """Tables of about `size` bytes of text; whole rows, so one text may be larger."""
    held, bytes_held = [], 0
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(size, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            held.append(part)
            bytes_held += part.nbytes
            if bytes_held >= size:
                yield pa.Table.from_batches(held)
                held, bytes_held = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _without(text, data, off, starts, word_off, run_start, run_end) -> pa.Array:
    """The texts without the bytes of word runs, each up to the next word that stays or the end of its text."""
    doc = np.searchsorted(word_off, run_start, "right") - 1
    to = np.where(run_end < word_off[doc + 1], np.append(starts, 0)[np.minimum(run_end, len(starts))], off[doc + 1]) if len(doc) else run_end
    stay = ~B.cover_spans(starts[run_start], to, len(data))
    upto = np.concatenate([[0], np.cumsum(stay)])[off].astype(np.int64)
    null = text.is_null()
    bytes_left = pa.Array.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(upto), pa.py_buffer(data[stay])])
    return pc.if_else(null, pa.scalar(None, pa.string()), bytes_left.cast(pa.large_string()).cast(pa.string()))


def _scan(windows, keep_text: bool, shard_bytes: int, carry: str | None, cut: bool):
    def run(batches):
        for table in _shards(batches, shard_bytes):
            B.tidy()
            data, off = B.text_bytes(table["text"])
            low = B.LOWER[data]
            starts, ends, word_off = B.word_bounds(low, off, B.NOT_ALNUM)
            block = windows.value
            first, length, item = occurrences(block, B.hash_spans(B.lanes(low), starts, ends), word_off)
            n = len(starts)
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, first, 1)
            np.add.at(step, first + length, -1)
            hit = np.cumsum(step[:n]) > 0
            names = np.array(block.items, object)
            doc = np.searchsorted(word_off, first, "right") - 1
            pair = np.unique(doc * len(names) + item) if len(first) else np.empty(0, np.int64)
            owner, items = (pair // len(names), names[pair % len(names)]) if len(pair) else (pair, names[:0])
            lists = np.searchsorted(owner, np.arange(table.num_rows + 1))
            if "spans" in table.column_names:  # what earlier blocks found
                old = B.one_array(table["spans"])
                spans = old.flatten()
                base = np.repeat(word_off[:-1], np.diff(old.offsets.to_numpy()))
                for s, e in zip(spans.field("start").to_numpy() + base, spans.field("end").to_numpy() + base):
                    hit[s:e] = True
                before = table["item_ids"].to_pylist()
                items_out = pa.array([sorted({*b, *items[x:y].tolist()}) for b, x, y in zip(before, lists, lists[1:])], pa.list_(pa.string()))
            else:
                items_out = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(items.tolist(), pa.string()))
            edge = np.zeros(n + 1, bool)
            edge[word_off] = True
            run_start = np.flatnonzero(hit & (edge[:n] | ~np.concatenate([[False], hit[:-1]]))) if n else np.empty(0, np.int64)
            run_end = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1 if n else np.empty(0, np.int64)
            runs = np.searchsorted(run_start, word_off)
            base = np.repeat(word_off[:-1], np.diff(runs))
            spans = pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pa.StructArray.from_arrays([pa.array(run_start - base, pa.int64()), pa.array(run_end - base, pa.int64())], ["start", "end"]))
            text = B.one_array(table["text"]).cast(pa.string()) if keep_text else pa.nulls(table.num_rows, pa.string())
            if cut:
                text = _without(text, data, off, starts, word_off, run_start, run_end)
            ids = B.one_array(table["doc_id"])
            out = pa.Table.from_arrays([ids, text, pa.array(np.diff(word_off), pa.int64()), spans, items_out], schema=_OUT)
            if carry:
                out = out.append_column(carry, table[carry])
            yield from out.to_batches()

    return run


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items, in blocks of at most block_bytes of text (or one item), read partition by partition."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("string").alias("t")).where("t is not null and t <> ''")
    for r in rows.toLocalIterator():
        if held and size + len(r.t) > block_bytes:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += len(r.t.encode())
    yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, with_text: bool = False, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, carry: str | None = None, cut: bool = False) -> DataFrame:
    """doc_id, text (null unless with_text), n_words, the merged hit spans [start, end) in words, sorted item_ids.

    carry: a column to keep. cut: text is given, without the hit spans, each up to the next word that stays.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([carry] if carry else []))
    ddl = f"{_DDL}, {carry} {out.schema[carry].dataType.simpleString()}" if carry else _DDL
    parts = list(blocks(benchmark, block_bytes))
    for k, items in enumerate(parts):
        windows = docs.sparkSession.sparkContext.broadcast(Windows(items, width))
        out = out.mapInArrow(_scan(windows, with_text or cut or k + 1 < len(parts), shard_bytes, carry, cut and k + 1 == len(parts)), ddl)
    return out
