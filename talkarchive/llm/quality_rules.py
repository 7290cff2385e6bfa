"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Each rule bounds one ratio of a document; a document is kept if it passes the base rules and every rule of the table.
Words are runs of characters outside space and \\t-\\r. The repeated 3-word windows of a document are counted by
hashing its windows, and only documents with an equal pair of hashes are looked at further.

Cases: null and empty texts have no words, all counts 0, and fail the base rules; texts of under three words have no
window; very long texts stay one row; repeated rows are judged alike; an empty table gives an empty result. Columns
other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The word separators and the symbols that are counted.
SEPARATORS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages served.
STOP_WORDS = {
    "en": "the of and to a in is it that was for on are with be at by this",
    "de": "der die und das in ein zu mit den von auf für dem im",
    "fr": "de la le et les des en un une du que dans est pour qui sur",
    "es": "de la que el en y a los se del las un por con una es",
}
#: (ratio, comparison, limit): a document with that comparison true is rejected.
RULES = (
    ("mean_word_chars", "<", 2.0),
    ("mean_word_chars", ">", 14.0),
    ("symbols_per_word", ">", 0.3),
    ("exclamations_per_word", ">", 0.5),
    ("stop_word_share", "<", 0.02),
    ("duplicate_line_share", ">", 0.3),
    ("list_line_share", ">", 0.9),
)
MIN_WORDS, MAX_REPEAT_PERCENT, NGRAM = 50, 50, 3


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated(words: Column) -> Column:
    """How many words lie in 3-word windows that the text has twice or more."""
    at = lambda i, k: F.get(words, i + k)
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - NGRAM), lambda i: F.xxhash64(*[at(i, k) for k in range(NGRAM)]))

    def covered(ranked: Column) -> Column:
        # (hash, place) in order: a place repeats if a neighbour has the same hash.
        same = lambda i, k: F.get(ranked, i)["h"].eqNullSafe(F.get(ranked, i + k)["h"])
        again = F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), lambda i: same(i, 1) | ((i > 0) & same(i, -1)))
        places = F.array_sort(F.transform(again, lambda i: F.get(ranked, i)["i"]))
        # Each repeated place adds the words from the end of the one before, three at most.
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-NGRAM).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(NGRAM), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])

    ranked = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(ranked(h), covered)).otherwise(0)
    return F.when(F.size(words) >= NGRAM, _let(windows, some)).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, and the ratios that rules may bound, as a struct; all counts come from one projection."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    stop = sorted({w for x in STOP_WORDS.values() for w in x.split()})
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"), F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).alias("n_stop")))
    of_lines = _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).alias("n_lines"), F.size(F.filter(x, lambda y: y.rlike("^\\s*[-*•]"))).alias("n_list")))
    chars = F.struct(F.length(F.translate(text, SEPARATORS, "")).cast("long").alias("word_chars"), without(SYMBOLS).cast("long").alias("n_symbols"), without("!").alias("n_exclaim"))
    df = docs.select("doc_id", of_words.alias("w"), of_lines.alias("l"), chars.alias("c")).select("doc_id", "w.*", "l.*", "c.*")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    ratios = F.struct(
        share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "n_words").alias("symbols_per_word"), share("n_exclaim", "n_words").alias("exclamations_per_word"), share("n_stop", "n_words").alias("stop_word_share"),
        share("n_dup_lines", "n_lines").alias("duplicate_line_share"), share("n_list", "n_lines").alias("list_line_share"),
    )
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", ratios.alias("ratios"))


def compiled(rules=RULES) -> Column:
    """One boolean column: no rule of the table rejects."""
    bad = F.lit(False)
    for ratio, op, limit in rules:
        value = F.col(f"ratios.{ratio}")
        bad = bad | (value < limit if op == "<" else value > limit)
    return ~bad


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """measured(docs) with base_failed and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(rules)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratios")
