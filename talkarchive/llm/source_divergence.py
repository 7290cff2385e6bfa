"""Source divergence audit: how far the sources of a language differ in their words, pair by pair and term by term.

Terms are counted in tasks by length-bucketed packing. A term of up to 16 bytes becomes one or two 64-bit words; terms
that fill the same number of 16-bit digits are a bucket, sorted by least-significant-digit radix passes (numpy's sort of
16-bit keys is a radix sort) and counted by runs. Longer terms have a bucket for each length, sorted as bytes. Documents
are visited by group, so one stable sort also brings the occurrences of a group and of a document together: a run gives
the number of occurrences and of documents of a term in a group.

Spark sums the runs by (language, term), keeps the terms in enough documents, and computes shares in whole numbers.
Distances of all pairs of sources are summed over blocks of terms: a block is a matrix of terms by sources of about CELLS
numbers, more where there are so many sources that their pairs, one number each, would outgrow it.

Cases: null text, lang and source are ''; a group without terms has a row for each other source of its language; a
language without kept terms has distances 0 and no term rows; ties go to the lesser item in UTF-8; very long texts and
terms count whole; repeated rows count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _bytes as B
from ._chunks import cut_lineage

LEAST_DOCS, SMOOTH, UNIT, MOST_TERMS = 30, 5, 1_000_000_000, 50
SLICE_BYTES, CELLS = 1 << 24, 1 << 15
#: Numbers of a block for each pair of sources that it gives, at least.
PER_PAIR = 8
#: Bytes outside `[^\x00-\x40\x5B-\x60\x7B-\x7F]`: all but ASCII letters and non-ASCII.
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SHORT = 16


def radix_order(digits: list[np.ndarray], n: int) -> np.ndarray:
    """The stable order of n keys by their 16-bit digits, least significant first."""
    order = np.arange(n)
    for digit in digits:
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def _words(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The bytes of short terms as one or two 64-bit words, zeros beyond the end."""
    words = [view[starts] & B._MASKS[np.minimum(lengths, 8)]]
    if len(lengths) and lengths.max() > 8:
        words.append(view[np.minimum(starts + 8, len(view) - 1)] & B._MASKS[np.maximum(lengths - 8, 0)])
    return words


def _buckets(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(chosen, order, differs) of each bucket: which terms, their order, and where a term differs from the one before."""
    view = B.lanes(data)
    size = np.where(lengths <= SHORT, (lengths + 1) // 2, 0)
    for digits in range(1, SHORT // 2 + 1):
        chosen = np.flatnonzero(size == digits)
        if not len(chosen):
            continue
        words = _words(view, starts[chosen], lengths[chosen])
        parts = [(words[k // 4] >> np.uint64(16 * (k % 4))).astype(np.uint16) for k in range(digits)]
        order = radix_order(parts, len(chosen))
        differs = np.zeros(len(chosen), bool)
        for w in words:
            w = w[order]
            differs[1:] |= w[1:] != w[:-1]
        yield chosen, order, differs
    long = np.flatnonzero(lengths > SHORT)
    by_length = long[np.argsort(lengths[long], kind="stable")]
    for chosen in np.split(by_length, np.flatnonzero(np.diff(lengths[by_length])) + 1) if len(by_length) else []:
        n = int(lengths[chosen[0]])
        keys = data[B.ranges(starts[chosen], lengths[chosen])].view(f"S{n}")
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        yield chosen, order, np.concatenate([[False], keys[1:] != keys[:-1]])


def term_runs(data: np.ndarray, off: np.ndarray, group: np.ndarray):
    """(group number, bytes, offsets of terms, occurrences, documents) of every term in every group of these texts."""
    data = B.LOWER[data]
    starts, ends, word_off = B.word_bounds(data, off, NOT_TERM)
    by_group = np.argsort(group, kind="stable")
    counts = np.diff(word_off)
    at = B.ranges(word_off[:-1][by_group], counts[by_group])
    doc = np.repeat(by_group, counts[by_group])
    starts, lengths = starts[at], (ends - starts)[at]
    for chosen, order, differs in _buckets(data, starts, lengths):
        chosen = chosen[order]
        d = doc[chosen]
        other = np.concatenate([[True], d[1:] != d[:-1]]) | differs
        g = group[d]
        new = np.concatenate([[True], g[1:] != g[:-1]]) | differs
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(chosen)))
        docs = np.add.reduceat(other.astype(np.int64), first)
        a, size = starts[chosen[first]], lengths[chosen[first]]
        yield g[first], data[B.ranges(a, size)], np.concatenate([[0], np.cumsum(size)]), n, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): runs of each slice of a task; a term of a group has a row for each slice it is in."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(F.lit(0).alias("doc_id"), text("text"), text("lang"), text("source"))

    def run(batches):
        for batch in batches:
            langs, sources = (batch[c].dictionary_encode() for c in ("lang", "source"))
            codes = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            at = 0
            for ids, data, off in B.slices([batch], SLICE_BYTES):
                names, group = np.unique(codes[at : at + len(ids)], return_inverse=True)
                at += len(ids)
                for g, body, offsets, n, d in term_runs(data, off, group):
                    lang, source = np.divmod(names[g], len(sources.dictionary))
                    terms = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), terms, pa.array(n), pa.array(d)], ["lang", "source", "term", "n", "docs"])

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, total): occurrences of the terms in at least least_docs documents of their language.

    One exchange by (lang, term) serves the sums of a group, of the language, and the choice.
    """
    rows = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term")
    rows = rows.withColumn("total", F.sum("n").over(own)).withColumn("_d", F.sum("docs").over(own))
    return rows.where(F.col("_d") >= least_docs).drop("_d", "docs")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), in whole numbers of 38 digits."""
    wide = "cast({} as decimal(27, 0))"
    return F.expr(f"1 + (cast({UNIT} as decimal(11, 0)) * ({wide.format(count)} + {SMOOTH})) div ({wide.format(total)} + {SMOOTH} * {wide.format(terms)})").cast("long")


def _pair_sums(key, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over a block's terms of the differences of every two sources' shares."""
    names = groups["source"].combine_chunks()
    rest = groups["rest"].to_numpy()
    term = rows["term"].combine_chunks().dictionary_encode() if len(rows) else None
    matrix = np.tile(rest, (len(term.dictionary) if term is not None else 0, 1))
    if term is not None:
        where = pa.compute.index_in(rows["source"].combine_chunks(), names)
        matrix[term.indices.to_numpy(), where.to_numpy()] = rows["p"].to_numpy()
    n = len(names)
    sums = np.array([np.abs(matrix - matrix[:, [k]]).sum(0) for k in range(n)], np.int64).reshape(n, n)
    i, k = np.nonzero(~np.eye(n, dtype=bool))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(i), pa.string()), "source": names.take(pa.array(i)), "item": names.take(pa.array(k)), "value": pa.array(sums[i, k], pa.int64())})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank, for docs of text, lang, source.

    Part `pair`: the distance to each other source of the language. Part `term`: the terms that the source has more of
    than its language has, the first most_terms of them.
    """
    kept = cut_lineage(kept_terms(docs, least_docs))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    every = docs.select(name("lang"), name("source")).distinct()
    whole = kept.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    langs = every.groupBy("lang").agg(F.count("*").alias("sources")).join(whole, "lang", "left").select("lang", "sources", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all_n", F.lit(0)).alias("all_n"))
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("sources") / F.greatest(F.lit(cells), PER_PAIR * F.col("sources") * F.col("sources")))).cast("int"))
    groups = every.join(sums, ["lang", "source"], "left").join(langs, "lang").withColumn("own_n", F.coalesce("own_n", F.lit(0)))
    groups = cut_lineage(groups.withColumn("rest", F.when(F.col("v") > 0, share("0", "own_n", "v")).otherwise(0)))
    rows = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "own_n", "v"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    left = rows.select("lang", block.alias("block"), "source", "term", "p").groupBy("lang", "block")
    right = groups.select("lang", "source", "rest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).groupBy("lang", "block")
    pairs = left.cogroup(right).applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    more = F.col("p") - share("total", "all_n", "v")
    terms = rows.withColumn("value", more).where("n > 0 and value > 0").select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", rank).select(*out).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= most_terms).select(*out))
