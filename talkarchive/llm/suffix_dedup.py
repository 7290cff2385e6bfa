"""Suffix-array dedup: bytes of repeated strings go, found by prefix doubling over suffix positions.

A byte goes if a `length`-byte string over it also starts in a document with a smaller doc_id. Two suffixes share such
a string if they tie in the order of their first `length` bytes, which prefix doubling decides: positions are sorted by
pairs of ranks, their own and the one 8, 16, 32, .. bytes on, and ranked anew, until they are unique or the threshold is
reached. To sort all positions of a corpus in Spark would move many times its size, so positions are dealt first:
the least hash of the `gram`-byte strings inside a position's `length` bytes names its group, equal strings have equal
names, and neighbouring positions mostly share one and travel as one stretch of text. Names that one document alone
has are unique already and go no further. A name of at most `hot` different stretches meets in one task, which ranks
its positions by doubling. Positions of names beyond that, such as a phrase that a third of all documents hold between
different neighbours, are rows that Spark ranks: it pairs the rank at a position with the one 8, 16, .. bytes on, sorts
and merges by pairs, names a pair by its least position, and drops pairs that one document alone has.

Cases: null texts count as empty; texts shorter than `length` lose nothing; null ids count as the largest, and rows of
equal id, as of null id, never remove bytes of each other; texts of one repeated byte are one stretch; an empty table gives
an empty result; other columns are not read. Stretches are compared byte by byte, names are 64-bit hashes that only
group. Within a chunk, stretches count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B
from ._chunks import CHUNK_BYTES, bucket_bits, chunked, in_order

LENGTH, GRAM, SEGMENT, PART_BYTES = 50, 24, 1 << 16, 1 << 19
#: Different stretches of a name that one task may rank, about 5 MB of text. A chunk states how many it has of a name
#: beyond FEW; else they count as half of FEW.
HOT, FEW, PIECE_BYTES = 1 << 16, 8, 1 << 18
_NAMES = pa.schema([("bucket", pa.int64()), ("chunk", pa.int32()), ("payload", pa.binary()), ("many", pa.binary())])
_FLAGS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int64()), ("flags", pa.binary()), ("hot", pa.binary())])
_SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int32()), ("name", pa.binary()), ("doc", pa.binary()), ("start", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary())])
_BACK = pa.schema([("chunk", pa.int32()), ("start", pa.binary()), ("size", pa.binary()), ("flags", pa.binary())])
_OUT = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,end:long>>"
_LAST = np.iinfo(np.int64).max


def full_buckets(hashes: np.ndarray, bits: int):
    """[(bucket, first, end)]: sorted hashes[first:end] have the leading bits bucket; buckets without any are left out."""
    lead = hashes >> np.uint64(64 - bits)
    head = np.flatnonzero(np.append(True, lead[1:] != lead[:-1])) if len(lead) else np.empty(0, np.int64)
    return list(zip(lead[head].tolist(), head.tolist(), [*head[1:].tolist(), len(lead)]))


def flagged(hashes: np.ndarray, bits: int, back: pa.Table, column: str) -> np.ndarray:
    """The flags that the buckets answered, in the order of the sorted hashes; an empty answer sets none."""
    got, out = dict(zip(back["bucket"].to_pylist(), back[column].to_pylist())), np.zeros(len(hashes), bool)
    for b, i, j in full_buckets(hashes, bits):
        if got[b]:
            out[i:j] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=j - i)
    return out


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _name_segment(view: np.ndarray, a: int, b: int, length: int, gram: int) -> np.ndarray:
    """Names of the positions a..b: least hash of the grams inside their length bytes."""
    width = length - gram + 1
    n = b - a + width - 1
    h = view[a : a + n].copy()
    for k in range(8, gram, 8):
        at = min(k, gram - 8)
        h = B.mix(h) + view[a + at : a + at + n]
    h = B.mix(h)
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < width:
        h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
    return h[: b - a]


def stretches(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(start, positions, name): maximal runs of neighbouring positions of one document with one name."""
    view, found = B.lanes(data), []
    last = len(data) - length + 1
    ok = np.zeros(max(0, last), bool)
    for a, b in zip(off[:-1], off[1:] - length + 1):
        ok[a : max(a, b)] = True
    for a in range(0, max(0, last), SEGMENT):
        b = min(last, a + SEGMENT)
        names, valid = _name_segment(view, a, b, length, gram), ok[a:b]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (names[1:] != names[:-1])
        start = np.flatnonzero(new)
        upto = np.concatenate([[0], np.cumsum(valid)])
        sizes = np.diff(np.append(upto[start], upto[-1]))
        found.append((start + a, sizes, names[start]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    start, size, name = (np.concatenate(x) for x in zip(*found))
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + size[:-1]) | (name[1:] != name[:-1])
    head = np.flatnonzero(new)
    return start[head], np.add.reduceat(size, head) if len(head) else size, name[head]


class _Chunk:
    def __init__(self, table: pa.Table, length: int, gram: int):
        self.table = in_order(table)
        self.data, self.off = B.text_bytes(self.table["text"])
        self.start, self.size, self.name = stretches(self.data, self.off, length, gram)
        self.row = np.searchsorted(self.off, self.start, "right") - 1
        self.ids = B.one_array(self.table["doc_id"]).fill_null(_LAST).to_numpy()
        self.length = length

    def covered(self, which: np.ndarray):
        """(starts, ends) of the maximal spans of these stretches, inside documents."""
        n = len(self.data)
        inside = B.cover_spans(self.start[which], self.start[which] + self.size[which] + self.length - 1, n)
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        start = np.flatnonzero(inside & (edge[:n] | ~np.append(False, inside[:-1])))
        end = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
        return start, end

    def hashes(self, which: np.ndarray) -> np.ndarray:
        return B.hash_spans(B.lanes(self.data), self.start[which], self.start[which] + self.size[which] + self.length - 1)


def kinds_of_names(c: _Chunk, inverse: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many different stretches each name of the chunk has; 0 for names that occur FEW times or less."""
    some = np.flatnonzero((count > FEW)[inverse])
    h, of = c.hashes(some), inverse[some]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return np.bincount(of[new], minlength=len(count))


def send_names(length, gram, bits):
    def run(key, table):
        c = _Chunk(table, length, gram)
        names, inverse, count = np.unique(c.name, return_inverse=True, return_counts=True)
        kinds = kinds_of_names(c, inverse, count)
        full, many = full_buckets(names, bits), []
        for _, i, j in full:
            at = np.flatnonzero(kinds[i:j] > FEW)
            many.append(np.concatenate([at, kinds[i + at]]).astype(np.uint32).tobytes())
        return pa.table([[b for b, _, _ in full], [key[0].as_py()] * len(full), [B.pack_sorted(names[i:j]) for _, i, j in full], many], schema=_NAMES)

    return run


def shared_names(hot):
    """Two flags for each name a chunk sent: does another chunk have it, and has it too many stretches for a task?"""

    def run(key, table):
        B.tidy()
        parts = [B.unpack_sorted(x) for x in table["payload"].to_pylist()]
        weights = [np.full(len(p), FEW // 2, np.int64) for p in parts]
        for w, x in zip(weights, table["many"].to_pylist()):
            at, kinds = np.frombuffer(x, np.uint32).reshape(2, -1)
            w[at] = kinds
        names = np.concatenate(parts)
        order = np.argsort(names, kind="stable")
        new = np.append(True, names[order][1:] != names[order][:-1])
        group = np.cumsum(new) - 1
        shared, heavy = np.zeros(len(names), bool), np.zeros(len(names), bool)
        shared[order] = (np.bincount(group) > 1)[group]
        heavy[order] = (np.add.reduceat(np.concatenate(weights)[order], np.flatnonzero(new)) > hot)[group]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        flags = [np.packbits(x).tobytes() for x in np.split(shared, cuts)]
        over = [np.packbits(x).tobytes() if x.any() else b"" for x in np.split(heavy, cuts)]
        return pa.table([table["chunk"].combine_chunks(), pa.array([key[0].as_py()] * len(flags), pa.int64()), pa.array(flags, pa.binary()), pa.array(over, pa.binary())], schema=_FLAGS)

    return run


def send_stretches(length, gram, bits):
    """The stretches whose name another document has too, each different one once, with its first document.

    Those of hot names go as the texts they cover, in buckets below 0. Their places are in the chunk's text with a gap of
    `length` after each document, so that no pair of positions crosses into the next.
    """

    def run(key, table, back):
        c = _Chunk(table, length, gram)
        names, inverse = np.unique(c.name, return_inverse=True)
        shared, hot = flagged(names, bits, back, "flags"), flagged(names, bits, back, "hot")
        doc = c.ids[c.row]
        low, high = np.full(len(names), _LAST), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        several = shared | (low < high)
        which = np.flatnonzero((several & ~hot)[inverse])
        which = np.sort(which[np.unique(c.hashes(which), return_index=True)[1]])
        which = which[np.argsort(c.name[which], kind="stable")]
        rows = [[] for _ in _SENT]
        for b, i, j in full_buckets(c.name[which], bits):
            some = which[i:j]
            text = c.data[B.ranges(c.start[some], c.size[some] + length - 1)]
            for column, value in zip(rows, (b, key[0].as_py(), c.name[some].tobytes(), doc[some].tobytes(), c.start[some].astype(np.uint32).tobytes(), c.size[some].astype(np.uint32).tobytes(), text.tobytes())):
                column.append(value)
        heavy = np.flatnonzero((several & hot)[inverse])
        if len(heavy):
            start, end = c.covered(heavy)
            piece = np.cumsum(end - start) // PIECE_BYTES
            for k, some in enumerate(np.split(np.arange(len(start)), np.flatnonzero(np.diff(piece)) + 1)):
                at = B.ranges(start[some], end[some] - start[some])
                row = np.searchsorted(c.off, start[some], "right") - 1
                sizes = (end[some] - start[some]).astype(np.uint32)
                value = (-1 - (key[0].as_py() << 24) - k, key[0].as_py(), b"", c.ids[row].tobytes(), (start[some] + row * length).tobytes(), sizes.tobytes(), c.data[at].tobytes())
                for column, x in zip(rows, value):
                    column.append(x)
        return pa.table(rows, schema=_SENT)

    return run


_POSITIONS = pa.schema([("at", pa.int64()), ("doc", pa.int64()), ("rank", pa.int64())])


def positions(key, table):
    """The texts of hot names as positions (at, doc, rank): chunk and place, document, and the first 8 bytes."""
    out = [pa.table([[], [], []], schema=_POSITIONS)]
    if key[0].as_py() < 0:
        for chunk, doc, start, size, data in zip(*(table[k].to_pylist() for k in ("chunk", "doc", "start", "size", "bytes"))):
            data, size = np.frombuffer(data, np.uint8), np.frombuffer(size, np.uint32).astype(np.int64)
            at = B.ranges(np.frombuffer(start, np.int64), size - 7) + (chunk << 32)
            rank = B.lanes(data)[B.ranges(np.cumsum(size) - size, size - 7)].view(np.int64)
            out.append(pa.table([at, np.repeat(np.frombuffer(doc, np.int64), size - 7), rank], schema=_POSITIONS))
    return pa.concat_tables(out)


def doubled_by_spark(rows: DataFrame, length: int) -> DataFrame:
    """Of the positions (at, doc, rank) those (at) whose `length` bytes, over 8, an earlier document has too.

    A round pairs each rank with the one `step` on, sorts and groups by pairs, and keeps the pairs of several documents
    with their least position as the new rank. Groups are combined before the shuffle, and AQE splits a hot pair's rows
    in the join. Both uses of the pairs read all their columns, so that they share one exchange.
    """
    none, span = F.lit(None).cast("long"), 8
    while span < length:
        step = min(span, length - span)
        own = F.struct("at", "doc", F.col("rank").alias("first"), none.alias("after"))
        ahead = F.struct((F.col("at") - step).alias("at"), none.alias("doc"), none.alias("first"), F.col("rank").alias("after"))
        pairs = rows.select(F.inline(F.array(own, ahead))).groupBy("at").agg(*[F.max(c).alias(c) for c in ("doc", "first", "after")]).where("first is not null and after is not null")
        tied = pairs.groupBy(F.col("first").alias("_f"), F.col("after").alias("_a")).agg(F.min("at").alias("rank"), F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
        rows = pairs.join(tied, (F.col("first") == F.col("_f")) & (F.col("after") == F.col("_a"))).select("at", "doc", "rank", "low")
        span += step
    return rows.where("doc > low").select("at")


def rank_pairs(first: np.ndarray, second: np.ndarray):
    """Ranks of the pairs in order, from 0; -1 for a pair that is unique."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    alone = new & np.append(new[1:], True)
    out = np.empty(len(a), np.int64)
    out[order] = np.where(alone, -1, np.cumsum(new) - 1)
    return out


def doubled(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the positions `starts` of data by their first `length` bytes; -1 for unique ones."""
    n = len(data)
    rank = B.lanes(data)[:n].byteswap().view(np.uint64)  # big-endian: the order of the first 8 bytes
    live, span = np.arange(n), 8
    while span < length:
        step = min(span, length - span)
        if span + step == length:  # the last pairs are needed at the starts only
            live = np.intersect1d(live, starts)
        live = live[live + step < n]
        if span > 8:
            live = live[(rank[live] >= 0) & (rank[live + step] >= 0)]
        after = np.full(n, -1, np.int64)
        after[live] = rank_pairs(rank[live], rank[live + step])
        rank, span = after, span + step
    return rank[starts]


def _older(data, size, doc, name, length) -> np.ndarray:
    """For each position of these stretches, in order: has a document before the stretch's own its string too?"""
    off = np.concatenate([[0], np.cumsum(size + length - 1)])
    texts = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
    code = texts.dictionary_encode().indices.to_numpy()
    kinds = int(code.max()) + 1
    least = np.full(kinds, _LAST)
    np.minimum.at(least, code, doc)
    one = np.empty(kinds, np.int64)
    one[code[::-1]] = np.arange(len(code))[::-1]  # a stretch of each kind
    # names with one kind of stretch need no ranks: all its positions tie with their own copies only
    order = np.argsort(name[one], kind="stable")
    same = name[one][order][1:] == name[one][order][:-1]
    many = np.zeros(kinds, bool)
    many[order[1:]] |= same
    many[order[:-1]] |= same
    win = np.concatenate([[0], np.cumsum(size[one])])  # positions of kind k: win[k]:win[k + 1]
    first = np.repeat(least, size[one])
    mixed = np.flatnonzero(many)
    if len(mixed):
        bytes_of = size[one][mixed] + length - 1
        ranks = doubled(data[B.ranges(off[one[mixed]], bytes_of)], B.ranges(np.cumsum(bytes_of) - bytes_of, size[one][mixed]), length)
        at, tied = B.ranges(win[mixed], size[one][mixed]), ranks >= 0
        low = np.full(int(ranks.max(initial=0)) + 1, _LAST)
        np.minimum.at(low, ranks[tied], first[at[tied]])
        first[at[tied]] = low[ranks[tied]]
    return first[B.ranges(win[code], size)] < np.repeat(doc, size)


def rank_stretches(length):
    """Answers a bucket's stretches, whole names at a time in parts of about PART_BYTES; not those of hot names."""

    def run(key, table):
        B.tidy()
        if key[0].as_py() < 0:
            return pa.table([[]] * len(_BACK), schema=_BACK)
        get = lambda name, kind: [np.frombuffer(x, kind) for x in table[name].to_pylist()]
        name, doc, size, data = (np.concatenate(get(*x)) for x in (("name", np.uint64), ("doc", np.int64), ("size", np.uint32), ("bytes", np.uint8)))
        size = size.astype(np.int64)
        full = size + length - 1
        off, win = np.cumsum(full) - full, np.cumsum(size) - size
        gone = np.zeros(int(size.sum()), bool)
        order = np.argsort(name, kind="stable")
        part = (np.cumsum(full[order]) - 1) // PART_BYTES
        head = np.ones(len(order), bool)
        head[1:] = name[order][1:] != name[order][:-1]
        part = np.maximum.accumulate(np.where(head, part, 0))  # a name stays in the part of its first stretch
        for some in np.split(order, np.flatnonzero(np.diff(part)) + 1):
            gone[B.ranges(win[some], size[some])] = _older(data[B.ranges(off[some], full[some])], size[some], doc[some], name[some], length)
        ends = np.cumsum([0, *[int(x.sum()) for x in get("size", np.uint32)]])
        flags = [np.packbits(gone[a:b]).tobytes() for a, b in zip(ends, ends[1:])]
        return pa.table([table["chunk"].combine_chunks(), table["start"].combine_chunks(), table["size"].combine_chunks(), pa.array(flags, pa.binary())], schema=_BACK)

    return run


def apply_flags(length, gram):
    def run(key, table, back):
        c = _Chunk(table, length, gram)
        place = np.array([x for some in back["gone"].to_pylist() if some for x in some], np.int64)
        hot = place - (np.searchsorted(c.off[:-1] + np.arange(len(c.off) - 1) * length, place, "right") - 1) * length
        back = back.filter(pc.is_valid(back["start"]))
        sent = [np.frombuffer(x, np.uint32) for x in back["start"].to_pylist()]
        starts = np.concatenate(sent).astype(np.int64) if sent else np.empty(0, np.int64)
        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=int(np.frombuffer(s, np.uint32).sum())) for f, s in zip(back["flags"].to_pylist(), back["size"].to_pylist())]
        flags = np.concatenate(flags).astype(bool) if flags else np.empty(0, bool)
        own = np.searchsorted(c.start, starts)  # the stretches that were sent, in the order of their flags
        size = c.size[own]
        windows = B.ranges(starts, size)[flags]
        copies = np.flatnonzero(np.isin(c.name, c.name[own]))
        h, sent_h = c.hashes(copies), c.hashes(own)
        order = np.argsort(sent_h)
        mate = order[np.minimum(np.searchsorted(sent_h[order], h), max(0, len(order) - 1))] if len(order) else np.empty(0, np.int64)
        later = c.ids[c.row[copies]] > c.ids[c.row[own[mate]]] if len(order) else np.empty(0, bool)
        spans_a, spans_b = [windows, hot, c.start[copies[later]]], [windows + length, hot + length, c.start[copies[later]] + c.size[copies[later]] + length - 1]
        # further copies in the document that was first, or in another of its id, fare like the one that was sent
        twin = np.flatnonzero(~later & (copies != own[mate])) if len(order) else []
        base = np.cumsum(size) - size
        for k in twin:
            m = mate[k]
            w = c.start[copies[k]] + np.flatnonzero(flags[base[m] : base[m] + size[m]])
            spans_a.append(w)
            spans_b.append(w + length)
        n = len(c.data)
        gone = B.cover_spans(np.concatenate(spans_a), np.concatenate(spans_b), n)
        edge = np.zeros(n + 1, bool)
        edge[c.off] = True
        run_start = np.flatnonzero(gone & (edge[:n] | ~np.concatenate([[False], gone[:-1]]))) if n else np.empty(0, np.int64)
        run_end = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1 if n else np.empty(0, np.int64)
        runs = np.searchsorted(run_start, c.off)
        shift = np.repeat(c.off[:-1], np.diff(runs))
        spans = pa.StructArray.from_arrays([pa.array(run_start - shift, pa.int64()), pa.array(run_end - shift, pa.int64())], ["start", "end"])
        removed = np.concatenate([[0], np.cumsum(gone)])[c.off]
        kept = c.data[~gone].tobytes()
        at = (c.off - removed).tolist()
        return pa.table({
            "doc_id": c.table["doc_id"], "n_bytes": pa.array(np.diff(c.off), pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()),
            "kept": pa.array([kept[a:b] for a, b in zip(at, at[1:])], pa.binary()), "spans": pa.ListArray.from_arrays(pa.array(runs, pa.int32()), spans),
        })

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, the kept bytes, and the maximal removed spans [start, end); 8 <= gram <= length, 8 < length.

    hot: how many different stretches of a name one task may rank.
    """
    parts, size = chunked(docs, chunk_bytes)
    bits = bucket_bits(size / 4, 1 << 19)
    by_chunk = parts.groupBy("chunk")
    names = by_chunk.applyInArrow(send_names(length, gram, bits), _ddl(_NAMES))
    shared = names.groupBy("bucket").applyInArrow(shared_names(hot), _ddl(_FLAGS))
    sent = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(send_stretches(length, gram, bits), _ddl(_SENT))
    by_bucket = sent.groupBy("bucket")
    back = by_bucket.applyInArrow(rank_stretches(length), _ddl(_BACK))
    found = doubled_by_spark(by_bucket.applyInArrow(positions, "at long, doc long, rank long"), length)
    gone = found.groupBy(F.shiftright("at", 32).cast("int").alias("chunk")).agg(F.collect_list(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))).alias("gone"))
    ranked = back.unionByName(gone, allowMissingColumns=True)
    return parts.groupBy("chunk").cogroup(ranked.groupBy("chunk")).applyInArrow(apply_flags(length, gram), _OUT)
