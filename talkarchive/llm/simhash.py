"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming distance by vantage-point trees.

Texts are read once; equal fingerprints are one point from there on. The driver builds the top of one tree from a
sample of points, a fixed number for each shard. A node splits by the distance to its vantage point: points at most m from it go inside,
others outside, and those outside at most m + radius from it go inside as well, since by the triangle inequality
nothing farther out has a partner inside. So two points within the radius always share a shard. A task continues the
same splits in its shard down to small leaves and compares leaf members pair by pair. It returns links to the least
member of each group found, not all pairs. Groups that span shards are joined by rounds of min-label stars in Spark.

Cases: null and texts without words have fingerprint 0 and link like any other; texts shorter than a shingle are one
shingle; repeated rows share a fingerprint; a null doc_id has the component of its fingerprint and is never its name
unless all ids are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B
from ._chunks import cut_lineage

SHINGLE, RADIUS, SEED = 3, 2, 42
SHARD, LEAF = 20_000, 256
#: Points sampled for the top of the tree, and for each shard that it is to have: 256 bytes a shard of 20,000 points reach
#: the driver, so that shards keep their size however many points there are.
SAMPLE, SAMPLE_A_SHARD = 20_000, 32


def fingerprints(shingle: int):
    def run(batches):
        for ids, data, off in B.slices(batches, 4 << 20):
            data = B.LOWER[data]
            starts, ends, word_off = B.word_bounds(data, off)
            # words joined by single spaces; a shingle is then one slice
            length = ends - starts + 1
            flat = np.concatenate([data, [np.uint8(32)]])[B.ranges(starts, length)]
            upto = np.concatenate([[0], np.cumsum(length)])
            flat[upto[1:] - 1] = 32
            joined = flat.tobytes()
            out = np.zeros(len(ids), np.uint64)
            digest = xxhash.xxh64_intdigest
            bounds, words = upto.tolist(), word_off.tolist()
            for d, (a, b) in enumerate(zip(words, words[1:])):
                if a == b:
                    continue
                last = max(b - shingle, a)
                n = last - a + 1
                h = np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(bounds[a : last + 1], bounds[min(a + shingle, b) : b + 1])), np.uint64, n)
                bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(n, 8), axis=1).sum(0, dtype=np.int64) * 2 > n
                out[d] = np.packbits(bits).view(">u8")[0]
            yield pa.RecordBatch.from_arrays([B.one_array(ids), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def grow(points: np.ndarray, depth: int, radius: int, rng: random.Random):
    """A tree of (vantage point, bound, inside, outside); a leaf is None. Bounds halve what reaches the node."""
    if depth == 0 or len(points) < 16:
        return None
    best = None
    for p in rng.sample(range(len(points)), min(4, len(points))):
        d = _bits(points ^ points[p])
        m = int(np.median(d)) - radius // 2
        inside, outside = int((d <= m + radius).sum()), int((d > m).sum())
        if best is None or max(inside, outside) < best[0]:
            best = max(inside, outside), p, m, d
    worst, p, m, d = best
    if worst >= len(points) * 0.95:
        return None
    return points[p], m, grow(points[d <= m + radius], depth - 1, radius, rng), grow(points[d > m], depth - 1, radius, rng)


def leaves(tree) -> int:
    return 1 if tree is None else leaves(tree[2]) + leaves(tree[3])


def _deal(points: np.ndarray, at: np.ndarray, tree, radius: int, first: int, out: list) -> int:
    """Appends (leaf number, places) for every leaf under tree."""
    if tree is None:
        out.append((first, at))
        return first + 1
    d = _bits(points[at] ^ tree[0])
    first = _deal(points, at[d <= tree[1] + radius], tree[2], radius, first, out)
    return _deal(points, at[d > tree[1]], tree[3], radius, first, out)


def dealt(tree, radius: int):
    """Each point to the shards that its ball reaches."""

    def run(batches):
        for batch in batches:
            points, out = batch["fp"].to_numpy().view(np.uint64), []
            _deal(points, np.arange(len(points)), tree, radius, 0, out)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([k for k, _ in out], [len(x) for _, x in out]), pa.int32()), pa.array(points[np.concatenate([x for _, x in out])].view(np.int64))], ["shard", "fp"])

    return run


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's connected component, for links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        live = label[a] != label[b]
        a, b = a[live], b[live]
        if np.array_equal(before, label) and not len(a):
            break
    return label


def _one_flip(points: np.ndarray, at: np.ndarray):
    """Links among points too close for a tree to part: points that meet after flipping at most one bit each.

    Exact for a radius of 2 and linear in the points: each gives 65 keys, and equal keys are within two bits.
    """
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    keys = (points[at][:, None] ^ flips[None, :]).reshape(-1)
    owner = np.repeat(at, 65)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    same = keys[1:] == keys[:-1]
    return owner[:-1][same], owner[1:][same]


def _pairs(points: np.ndarray, at: np.ndarray, radius: int):
    found = []
    for k in range(0, len(at), 1024):
        block = at[k : k + 1024]
        i, j = np.nonzero(_bits(points[block][:, None] ^ points[at][None, k:]) <= radius)
        found.append((block[i], at[k:][j]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def links(points: np.ndarray, radius: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """All links within the radius, as places (i, j), some of them twice."""
    rng, todo, found = random.Random(7), [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            found.append(_pairs(points, at, radius))
            continue
        best = None
        for _ in range(3):
            d = _bits(points[at] ^ points[at[rng.randrange(len(at))]])
            m = int(np.median(d)) - radius // 2
            sizes = int((d <= m + radius).sum()), int((d > m).sum())
            if best is None or max(sizes) < max(best[1]):
                best = m, sizes, d
        m, sizes, d = best
        if max(sizes) < 0.95 * len(at):
            todo += [at[d <= m + radius], at[d > m]]
        elif radius == 2:
            found.append(_one_flip(points, at))
        else:
            found.append(_pairs(points, at, radius))
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.empty(0, np.int64),) * 2


def linked(radius: int):
    """(fp, least fp of its group in this shard) for groups of two or more."""

    def run(key, table):
        points = np.unique(table["fp"].to_numpy())
        a, b = links(points.view(np.uint64), radius)
        label = least_labels(len(points), a, b)
        low = label != np.arange(len(points))
        return pa.table([points[low], points[label[low]]], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def are_stars(edges: DataFrame) -> bool:
    """Whether every node of the links (a, b), b < a, has either one link down and none up, or none down: its b is the root."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.lit(c == "a").cast("int").alias("down"), F.lit(c == "b").cast("int").alias("up")) for c in "ab"])))
    sums = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    return sums.agg(F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).alias("n")).first().n == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of the links (a, b), b < a, over the nodes they name.

    Alternates two steps until all links are stars: every larger neighbour of a node links to the node's least neighbour,
    then every smaller one does. Stars shrink components by at least half a round, and rows never outgrow the links.
    Stars are told by one count, so links that are stars take no round, and no round is spent on finding no change.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not are_stars(edges):
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"))
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large.a == low.u)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        edges = cut_lineage(small)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def vantage_links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links of different fingerprints (fp, each once) within the radius, each shard's as stars to the least of a
    group, found through one vantage-point tree."""
    n = points.count()
    wanted = max(SAMPLE, SAMPLE_A_SHARD * math.ceil(n / shard))
    sample = [r.fp for r in points.sample(min(1.0, wanted / max(1, n)), 11).select("fp").limit(2 * wanted).collect()]
    depth = max(0, math.ceil(math.log2(max(1, n) / shard) * 1.3))
    tree = grow(np.array(sorted(sample), np.int64).view(np.uint64), depth, radius, random.Random(5))
    return points.select("fp").mapInArrow(dealt(tree, radius), "shard int, fp long").groupBy("shard").applyInArrow(linked(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = cut_lineage(rows.mapInArrow(fingerprints(shingle), "doc_id long, fp long"))
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(vantage_links(points, radius, shard))
    named = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    place = named.join(names, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(place, prints.fp == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
