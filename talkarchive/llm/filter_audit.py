"""Filter interaction audit: what each filter removes, and takes from the others, in every order of the filters.

A document is a mask of the filters it fails. Masks are counted by part, so a few cells a part (32 for five filters)
stand for all documents. Each cell folds across the array of all orders, which is one literal of the plan and so goes to
every task: `aggregate` walks an order and carries whether the document is still there, `transform` does so for all 120
orders, and the 600 structs, weighted by the cell's counts, are summed place by place.

"Identical to a smaller doc_id's text" needs the whole table: only a SHA-256 of each text is shuffled. Rows of equal
text, part and labels are summed before they meet, with the least id and its number of rows, so a text that a third of
all documents share is a few rows.

Cases: a null text is empty; a null lang is the part ''; a null doc_id comes after all others, and rows of one id are not
duplicates of each other; a document with several labels counts by the greatest of each; repeated rows count each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> list[Column]:
    """The failure conditions of the filters A to D, which read one text each."""
    body = F.btrim(text, F.lit(" \t\n\u000b\f\r"))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[\\x20\\x09-\\x0D]+"))
    n, capitals = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, bit k for the k-th of FILTERS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures(F.col("text")))), F.lit(0))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("h"), bits.alias("mask"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    seen = rows.where("doc_id is not null").join(known, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "part", "h", "mask", flag("good"), flag("toxic"))
    # rows without an id have no labels and meet no join
    seen = seen.unionByName(rows.where("doc_id is null").select("doc_id", "part", "h", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    kind = ["part", "mask", "good", "toxic"]
    same = seen.groupBy("doc_id", "h", *kind).agg(F.count("*").alias("n"))
    # the rows of the least id of a text fail E only if another id is less; a null id is the greatest
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n"))
    groups = same.groupBy("h", *kind).agg(F.sum("n").alias("n"), first.alias("first"))
    least = F.min(F.struct("first.last", "first.doc_id")).over(Window.partitionBy("h"))
    free = F.when(F.struct("first.last", "first.doc_id") == least, F.col("first.n")).otherwise(0)
    groups = groups.withColumn("free", free)
    e = F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("free").alias("n")), F.struct(F.lit(1 << 4).alias("e"), (F.col("n") - F.col("free")).alias("n"))))
    split = groups.select(*kind, e.alias("x")).where("x.n > 0")
    return split.groupBy("part", (F.col("mask") + F.col("x.e")).alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def _orders(n: int) -> Column:
    """All orders of the filters 0..n-1, by their letters: one literal."""
    return F.array(*[F.array(*[F.lit(f) for f in order]) for order in permutations(range(n))])


def folded(counted: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """(part, steps): for each cell one struct of MEASURES for each order and step, weighted by what the cell counts."""
    mask, zero = F.col("mask"), F.lit(0).cast("long")
    fails = lambda f: F.getbit(mask, f) == 1
    if_ = lambda c, x: F.when(c, F.col(x)).otherwise(zero)

    def step(state, f):
        hit, there = fails(f), state["there"]
        here = there & hit
        one = F.struct(if_(there & ~hit, "n").alias("kept"), if_(here, "n").alias("removed"), if_(hit & ~there, "n").alias("redundant"), if_(hit & (F.bit_count(mask) == 1), "n").alias("unique_fails"), if_(here, "good").alias("good_lost"), if_(here, "toxic").alias("toxic_lost"))
        return F.struct((there & ~hit).alias("there"), F.array_append(state["steps"], one).alias("steps"))

    kind = f"array<struct<{', '.join(f'{m}: bigint' for m in MEASURES)}>>"
    start = F.struct(F.lit(True).alias("there"), F.array().cast(kind).alias("steps"))
    walked = F.transform(_orders(n), lambda order: F.aggregate(order, start, step, lambda s: s["steps"]))
    return counted.select("part", F.flatten(walked).alias("steps"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, MEASURES and shapley, for docs of doc_id, text, lang and labels of doc_id, quality, toxic.

    shapley is what the step's filter removes at any step, summed over all orders.
    """
    n = len(FILTERS)
    names = F.array(*[F.lit("".join(FILTERS[f] for f in order)) for order in permutations(range(n))])
    rows = folded(cells(docs, labels)).select("part", F.posexplode("steps").alias("at", "s"))
    sums = rows.groupBy("part", "at").agg(*[F.sum(f"s.{m}").alias(m) for m in MEASURES])
    sums = sums.select("part", F.element_at(names, F.floor(F.col("at") / n).cast("int") + 1).alias("filter_order"), (F.col("at") % n + 1).cast("int").alias("step"), *MEASURES)
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return sums.withColumn("shapley", F.sum("removed").over(own))
