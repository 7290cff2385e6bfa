"""Near copies: documents linked by an exact Jaccard similarity of their word shingles, for the pipeline's near-dedup.

SimHash fingerprints of five words, linked by the vantage-point trees of simhash, give the first candidates. A pair of
0.8 differs in up to 13 of 64 bits, though, where such a tree parts nothing (each half of a split keeps 93 % of the
points), so pairs beyond its radius are found by min-hashes: BANDS times ROWS of them, of which a pair at the threshold
shares a band with a chance of 0.99994. Texts of equal shingle sets are one point. Points that meet in a fingerprint
component or a band, however indirectly, form a group; each group's texts travel once, and all its pairs are compared by
their sets of shingle hashes. Texts of one 64-bit hash, and shingle sets of one, are taken to be the same. Groups above BLOCK_WORDS are cut into blocks by a hash, and every two
blocks meet in a task of their own.

Cases: texts shorter than a shingle are one shingle; null texts and those without words link to each other only; a null
doc_id has the component of its text and is never its name unless all ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B
from ._chunks import cut_lineage
from .simhash import components, least_labels, vantage_links

#: The rule is five words and a similarity of NUMERATOR / DENOMINATOR or more.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
BANDS, ROWS = 32, 6
#: Words that meet in one task, from each of two blocks.
BLOCK_WORDS = 1_000_000

_FACTORS = B.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(-1, 2) | np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray, width: int = SHINGLE):
    """(hashes, bounds): the distinct shingle hashes of document d, sorted, are hashes[bounds[d]:bounds[d + 1]]."""
    data = B.LOWER[data]
    starts, ends, word_off = B.word_bounds(data, off)
    word = B.hash_spans(B.lanes(data), starts, ends)
    size = np.diff(word_off)
    n = np.where(size > 0, np.maximum(size - width + 1, 1), 0)
    first, last = B.ranges(word_off[:-1], n), np.repeat(word_off[1:], n)
    h = np.zeros(len(first), np.uint64)
    for k in range(width):
        live = np.flatnonzero(first + k < last)
        h[live] = B.mix(h[live] ^ word[first[live] + k])
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def prints(batches):
    """(t, fp, n, sim, bands): the hash of the shingle set, its size, its SimHash, and the band keys, none without words."""
    for ids, data, off in B.slices(batches, 2 << 20):
        h, bounds = shingles(data, off)
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        fp, sim, keys = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.empty((len(full), BANDS), np.uint64)
        if len(full):
            at = bounds[full]
            fp[full] = B.mix(np.add.reduceat(B.mix(h), at) ^ n[full].astype(np.uint64))
            ones = np.add.reduceat(np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), at, axis=0, dtype=np.int64)
            sim[full] = np.packbits(2 * ones > n[full, None], axis=1).view(">u8")[:, 0]
            for b in range(BANDS):
                key = np.full(len(full), b, np.uint64)
                for x, y in _FACTORS[b * ROWS : (b + 1) * ROWS]:
                    key = B.mix(key ^ np.minimum.reduceat((h ^ x) * y, at))
                keys[:, b] = key
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * BANDS)]), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([B.one_array(ids), pa.array(fp.view(np.int64)), pa.array(n, pa.int64()), pa.array(sim.view(np.int64)), lists], ["t", "fp", "n", "sim", "bands"])


def alike(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of sets at the threshold or above."""
    n = np.diff(bounds)
    if len(n) < 2:
        return (np.empty(0, np.int64),) * 2
    _, place, df = np.unique(h, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(n)), n)
    shared = df[place] > 1
    column = (np.cumsum(df > 1) - 1)[place[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width, found = int(column[-1]) + 1 if len(column) else 0, []
    for low in range(0, len(n), 1024):
        high = min(low + 1024, len(n))
        common = np.zeros((high - low, len(n)), np.float32)
        for k in range(0, width, 1024):
            a, b = np.searchsorted(column, [k, k + 1024])
            there = np.zeros((len(n), min(1024, width - k)), np.float32)
            there[owner[a:b], column[a:b] - k] = 1
            common += there[low:high] @ there.T
        i, j = np.nonzero((NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (n[low:high, None] + n[None, :]) - 0.5)
        up = i + low < j
        found.append((i[up] + low, j[up]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def compared(key, table):
    """(a, b): each point with the least of its component inside one meeting of a group's blocks, over a task's meetings."""
    fp, root, meeting = (table[c].to_numpy() for c in ("fp", "root", "meeting"))
    data, off = B.text_bytes(table["text"])
    h, bounds = shingles(data, off)
    order = np.lexsort((fp, meeting, root))
    root_, meeting_ = root[order], meeting[order]
    cuts = np.flatnonzero((root_[1:] != root_[:-1]) | (meeting_[1:] != meeting_[:-1])) + 1
    out = []
    for at in np.split(order, cuts):
        n = bounds[at + 1] - bounds[at]
        i, j = alike(h[B.ranges(bounds[at], n)], np.concatenate([[0], np.cumsum(n)]))
        label = least_labels(len(at), i, j)
        low = label != np.arange(len(at))
        out.append((fp[at[low]], fp[at[label[low]]]))
    B.tidy()
    return pa.table([np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def text_groups(texts: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(t, root): texts (t = xxhash64(text), text) of one root are linked by pairs of 5-word Jaccard similarity 0.8 or more."""
    found = texts.mapInArrow(_named(prints), "t long, fp long, n long, sim long, bands array<long>").groupBy("t").agg(*[F.first(c).alias(c) for c in ("fp", "n", "sim", "bands")])
    found = cut_lineage(found)
    points = found.groupBy("fp").agg(F.min("t").alias("t"), F.first("n").alias("n"))
    # one SimHash is one node: its texts share a key, and links name it by its least point
    nodes = cut_lineage(found.where("n > 0").groupBy("sim").agg(F.min("fp").alias("least")))
    end = lambda c: nodes.select(F.col("sim").alias(c), F.col("least").alias(f"{c}_fp"))
    close = vantage_links(nodes.select(F.col("sim").alias("fp"))).join(end("a"), "a").join(end("b"), "b").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    keys = found.where("n > 0").select("fp", F.explode(F.concat("bands", F.array(F.xxhash64(F.lit("simhash"), "sim")))).alias("key"))
    met = keys.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("_top")).where("b <> _top").select("key", "b")
    groups = components(keys.join(met, "key").where("fp <> b").select(F.col("fp").alias("a"), "b").unionByName(close))
    # a component names only the nodes above its least one
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root")).distinct()
    members = cut_lineage(members.join(points.select(F.col("fp").alias("node"), "t", "n"), "node"))
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / block_words).cast("int").alias("blocks"), F.sum("n").alias("words"))
    tasks = F.greatest(F.lit(1), F.ceil(F.sum(F.col("words") * F.col("blocks")) / block_words)).cast("int")
    n_tasks = int(blocks.agg(tasks.alias("n")).first().n or 1)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sent = members.join(blocks.select("root", "blocks"), "root").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.withColumn("meeting", F.least(own, "other") * F.col("blocks").cast("long") + F.greatest(own, "other"))
    # one text of each point; its copies are the same bytes
    chosen = texts.select("t", "text").join(members.select("t").distinct(), "t").groupBy("t").agg(F.first("text").alias("text"))
    rows = sent.join(chosen, "t").select(F.col("node").alias("fp"), "root", "meeting", "text", F.pmod(F.xxhash64("root", "meeting"), F.lit(n_tasks)).alias("task"))
    roots = components(rows.groupBy("task").applyInArrow(compared, "a long, b long"))
    return found.select("t", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("t", F.coalesce("root", "fp").alias("root"))


def _named(of):
    """prints over rows (t, text), whose first column it calls doc_id."""

    def run(batches):
        yield from of(pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["doc_id", "text"]) for b in batches)

    return run


def hashed(docs: DataFrame) -> DataFrame:
    """docs with t, the hash that stands for its text."""
    return docs.withColumn("t", F.xxhash64(F.col("text").cast("string")))


def near_copies(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, component_id (least doc_id reachable over pairs of 5-word Jaccard similarity 0.8 or more)."""
    texts = hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = texts.select("doc_id", "t").join(text_groups(texts.select("t", "text"), block_words), "t")
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def first_of_copies(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row of each group of near copies, as it is: the least doc_id (null last), then the least hashes of text and row.

    Rows are told apart by all their columns, so different texts under one id, or under none, are judged by their texts
    alone. Only narrow rows are grouped, a group's partial minima before the shuffle; texts meet the rows that stay.
    """
    texts = hashed(docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_row")))
    found = cut_lineage(text_groups(texts.select("t", F.col("text").cast("string").alias("text")), block_words))
    whole = texts.withColumn("_h", F.xxhash64("_row"))
    order = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "t", "_h")
    kept = whole.select("doc_id", "t", "_h").join(found, "t").groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.t").alias("t"), F.col("k._h").alias("_h"))
    # a row of equal hash, text and all columns, that occurs more than once stays once
    many = whole.groupBy("t", "_h").agg(F.count("*").alias("_n")).where("_n > 1").select("t", "_h").join(kept, ["t", "_h"], "left_semi")
    one = whole.join(kept, ["t", "_h"], "left_semi")
    once = one.join(many, ["t", "_h"], "left_anti").select("_row")
    return once.unionByName(one.join(many, ["t", "_h"], "left_semi").select("_row").dropDuplicates()).select("_row.*")
