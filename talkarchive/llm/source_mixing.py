"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document draws an exponential key, -ln(u) / quality, from a hash of its id. A source whose target is e full passes
and a rest takes each document e times, and once more the documents with the least keys whose words fill the rest.
The prefix sums are made in two steps so that no source is sorted in one task: keys fall in as many ranges a source as
it has thousands of rows, a running sum over range totals finds the range where the rest ends, and only rows of that
range are summed one by one. A key's range is its share of the source's keys by the exponential distributions of the
source's weights (by octave), so ranges hold alike many rows whatever the weights are. Rows that draw alike in all their
columns are one row with a count.

Cases: a null text has size 0; a null source is a source of its own, last in order; a null doc_id draws the key of its
text, ties are broken by size; sources without words have target 0; a null, zero or negative quality counts
as the least, 0.01; repeated rows draw alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ._chunks import cut_lineage

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
ROWS_A_RANGE = 2000
#: Quality weights of the labels 1 and 0, and of documents without a label.
QUALITY = {1: 1.0, 0: 0.5, None: 0.75}
LEAST = 0.01


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labelled documents; the highest label of a document counts."""
    best = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_label"))
    return best.select("doc_id", F.when(F.col("_label") == 1, QUALITY[1]).otherwise(QUALITY[0]).alias("quality"))


def _targets(sources: DataFrame) -> DataFrame:
    """Adds target to (source, source_size, n): shares by weight, capped at MOST_TIMES the size, excess reshared.

    Capped sources are those with the least size a weight, so one running sum over sources in that order finds them.
    One row a source meets in one task here, never a document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("long"))
    ranked = ranked.withColumn("cap", MOST_TIMES * F.col("source_size"))
    everything = Window.partitionBy()
    upward = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    ranked = ranked.withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("_full", F.col("cap") * F.col("_weights") > F.col("weight") * F.col("_left"))
    ranked = ranked.withColumn("_row", F.row_number().over(upward))
    ranked = ranked.withColumn("_at", F.min(F.when(F.col("_full"), F.struct("_row", F.col("_left").alias("l"), F.col("_weights").alias("w")))).over(everything))
    share = F.col("_at.l") * F.col("weight") / F.col("_at.w")
    return ranked.select("source", "source_size", "n", F.coalesce(F.least(share, F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def _ranges(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, key, q, ...) with the plan (source, n, ranges, ...) of their source and their range of keys."""
    # how many of a source's rows have a weight in each octave, and their mean
    octaves = rows.groupBy(F.col("source").alias("_o"), F.floor(F.log2("q")).alias("octave")).agg(F.count("*").alias("m"), F.avg("q").alias("q"))
    octaves = octaves.groupBy("_o").agg(F.collect_list(F.struct("m", "q")).alias("weights"))
    # a row a source, cut: it stands in every later plan, and its windows would be planned again in each
    plan = cut_lineage(plan.join(octaves, F.col("source").eqNullSafe(F.col("_o"))).drop("_o"))
    rows = rows.drop("q").join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    below = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w["m"] * (1 - F.exp(-w["q"] * F.col("key"))))
    rows = rows.withColumn("range", F.floor(below / F.col("n") * F.col("ranges"))).drop("weights", "n")
    return rows


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, for docs of doc_id, text, source.

    quality gives (doc_id, quality) of some documents, one row each; it meets the sizes, so that no text is shuffled.
    """
    text = F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(" \t\n\u000b\f\r"))
    size = F.when(text == "", 0).otherwise(F.size(F.split(text, "[\\x20\\x09-\\x0D]+"))).cast("long")
    # u from 52 bits of an MD5, never 0: the same in any engine.
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))), 1, 13), 16, 10).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), (-F.log((bits + 0.5) / float(1 << 52))).alias("key"))
    rows = rows.withColumn("q", F.lit(1.0))
    if quality is not None:
        weights = quality.select(F.col("doc_id").alias("_id"), F.greatest(F.coalesce(F.col("quality").cast("double"), F.lit(LEAST)), F.lit(LEAST)).alias("_q"))
        rows = rows.join(weights, F.col("doc_id") == F.col("_id"), "left").withColumn("q", F.coalesce("_q", F.lit(QUALITY[None]))).withColumn("key", F.col("key") / F.col("q")).drop("_id", "_q")
    rows = cut_lineage(rows)  # the texts are read once; what follows joins these narrow rows twice
    per_source = _targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    plan = per_source.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("ranges", F.ceil(F.col("n") / rows_a_range))
    rows = _ranges(rows, plan)
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("in_range"), F.first("rest").alias("_rest"))
    ahead = F.coalesce(F.sum("in_range").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("ahead", ahead)
    # whole ranges before the one where the rest ends are taken, those after it are not
    state = F.when(F.col("ahead") + F.col("in_range") <= F.col("_rest"), 1).when(F.col("ahead") < F.col("_rest"), 0).otherwise(-1)
    sums = sums.select(F.col("source").alias("_s"), F.col("range").alias("_r"), "ahead", state.alias("state"))
    rows = cut_lineage(rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r"))).drop("_s", "_r"))
    out = ["doc_id", "source", "size", "source_size", "target", "taken"]
    whole = rows.where("state <> 0").withColumn("taken", F.col("size") * (F.col("passes") + F.when(F.col("state") == 1, 1).otherwise(0)))
    edge = rows.where("state = 0")
    edge = edge.groupBy(*edge.columns).agg(F.count("*").alias("copies"))
    inner = Window.partitionBy("source", "range").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inner), F.lit(0)))
    edge = edge.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    upto = F.col("ahead") + F.col("before") + F.col("copy") * F.col("size") + F.col("size") / 2
    edge = edge.withColumn("taken", F.col("size") * (F.col("passes") + F.when(upto <= F.col("rest"), 1).otherwise(0)))
    return whole.select(*out).unionByName(edge.select(*out)).withColumn("taken", F.col("taken").cast("long"))
