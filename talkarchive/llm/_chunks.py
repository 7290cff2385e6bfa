"""Documents in chunks of neighbouring doc_ids: the frame of the operators that compare all texts.

A chunk is a range of doc_ids with about `chunk_bytes` of text. A task hashes one chunk, keeps each distinct hash once
(so a passage shared by a third of all documents is sent once a chunk, not once a document), and sends the hashes on:
as rows that Spark counts (op4), or packed, one row for a bucket of leading bits (op2, op8). The answers meet the same
chunk again in a cogroup. Ranges make "a smaller doc_id" a matter of chunk numbers, so no position travels. All passes
read one exchange of the texts, which Spark reuses.
"""

from __future__ import annotations

import itertools
import math
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from ._bytes import tidy

CHUNK_BYTES = 8 << 20
#: Ranges of equally many ids that the driver sees, at every size, and what a row weighs beside its text.
PROBES, ROW_BYTES = 1000, 16


def _numbers(values) -> Column:
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in values)})")


def placed(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES):
    """(add, bytes of text): add(df, id_column) gives df the column chunk, whose order is the order of ids.

    PROBES ranges of equally many ids are weighed by the bytes of their texts. An id's place in the corpus is what the
    ranges before its own weigh and its share of its own, by its distance from the least id there; the place names the
    chunk. So long texts get narrower ranges of ids, and the driver holds PROBES numbers however many chunks there are.
    Null ids come after all others. Rows that share one id, or none, are dealt within it by a hash of their text, if
    there are enough to make a range of their own: then no chunk grows with them. Rows of df without a text (add of bare
    ids, texts=False) go to every chunk that their id has.
    """
    at = F.col("doc_id").cast("double")
    q = docs.agg(F.percentile_approx(at, [i / PROBES for i in range(1, PROBES)], 100 * PROBES).alias("q")).first().q or []
    often = {a for a, b in zip(q, q[1:]) if a == b}
    splits = sorted({*q, *(math.nextafter(a, math.inf) for a in often)})
    bucketizer = Bucketizer(splits=[-math.inf, *(splits or [0.0]), math.inf], inputCol="_at", outputCol="_range")
    n = len(bucketizer.getSplits()) - 1  # ranges; null ids are range n

    def ranged(df: DataFrame, id_column: str) -> DataFrame:
        known = F.col(id_column).isNotNull()
        out = bucketizer.transform(df.withColumn("_at", F.coalesce(F.col(id_column).cast("double"), F.lit(0.0))))
        return out.withColumn("_range", F.when(known, F.col("_range").cast("int")).otherwise(n))

    size = F.coalesce(F.octet_length("text"), F.lit(0))
    seen = ranged(docs.select("doc_id", "text"), "doc_id").groupBy("_range").agg(F.sum(size).alias("text"), F.sum(size + ROW_BYTES).alias("b"), F.min("_at").alias("low"), F.max("_at").alias("high"), (F.min("doc_id") == F.max("doc_id")).alias("one")).collect()
    weights, lows, widths, one = ([0.0] * (n + 1) for _ in range(4))
    for r in seen:
        weights[r._range], lows[r._range], widths[r._range], one[r._range] = float(r.b), r.low, r.high - r.low + 1, float(r.one is not False)
    before = [0.0, *itertools.accumulate(weights)]
    last = int(before[-1] // chunk_bytes)
    before, weights, lows, widths, one = (_numbers(x) for x in (before, weights, lows, [max(1.0, x) for x in widths], one))
    of = lambda numbers: F.element_at(numbers, F.col("_range") + 1)
    chunk = lambda share: F.least(F.floor((of(before) + share) / chunk_bytes), F.lit(last)).cast("int")

    def add(df: DataFrame, id_column: str, texts: bool = True) -> DataFrame:
        share = F.greatest(F.lit(0.0), F.least(of(weights), of(weights) * (F.col("_at") - of(lows)) / of(widths)))
        rows = ranged(df, id_column)
        if texts:
            rows = rows.withColumn("chunk", chunk(F.when(of(one) > 0, of(weights) * (F.xxhash64("text").cast("double") / 2.0**64 + 0.5)).otherwise(share)))
        else:
            every = F.sequence(chunk(F.lit(0.0)), chunk(of(weights)))
            rows = rows.withColumn("chunk", F.explode(F.when(of(one) > 0, every).otherwise(F.array(chunk(share)))))
        return rows.drop("_at", "_range")

    return add, sum(r.text for r in seen)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_places: bool = False, carry: str | None = None):
    """((chunk, doc_id, text, _u), bytes of text), and the function that places other ids alike if asked for.

    _u is a hash of the text, the order of rows of one id. carry: a column that travels with the texts.
    """
    more = [carry] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    add, size = placed(docs, chunk_bytes)
    parts = add(docs.withColumn("_u", F.xxhash64("text")), "doc_id").select("chunk", "doc_id", "text", "_u", *more)
    return (parts, size, add) if with_places else (parts, size)


def in_order(table: pa.Table) -> pa.Table:
    """Rows by doc_id (null last), then the hash of the text, then the text: the same in every pass and every rerun."""
    tidy()
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("_u", "ascending"), ("text", "ascending")])).drop_columns("_u")


def bucket_bits(items: float, per_bucket: int = 1 << 21) -> int:
    """How many leading hash bits name a bucket, for about per_bucket items each."""
    return max(3, math.ceil(math.log2(max(1.0, items / per_bucket))))


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, as in tests, may do without: it has a temporary one."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def remove(spark, path: str) -> None:
    """Deletes a folder of the shared ones, by Spark's own file system client."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
