"""Column functions on text: folding, token sets, clocks, reasoning marks, scores. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Stop words of the duplicate check and of search, as the rules of matching require them.
DUPLICATE_STOPWORDS = "about after also because been from have into just more only should that their there these they this those were with would".split()
SEARCH_STOPWORDS = "about after before could does from have into should that them then they this when what where which who with were would".split()
#: Weight of a chunk type in search, and of a chunk as a match.
TYPE_WEIGHT = {"transcript": 1.0, "topic": 0.92, "summary": 0.86, "slide": 0.55, "similarity": 0.9}


def fold(c) -> Column:
    """Every run of Unicode whitespace as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def stripped(c) -> Column:
    """Without Unicode whitespace at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def duplicate_tokens(c) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(DUPLICATE_STOPWORDS))


def search_tokens(c) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(SEARCH_STOPWORDS)))


def inner_tokens(c) -> Column:
    """Search tokens with other characters on both sides: whole tokens of any text that has c inside."""
    words = F.regexp_extract_all(F.lower(c), F.lit("(?<=[^a-z0-9])[a-z0-9]{3,}(?=[^a-z0-9])"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(SEARCH_STOPWORDS))


def plain_tokens(c) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))


def bigrams(tokens: Column) -> Column:
    """Different neighbouring pairs a::b of a token list."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat(a, F.lit("::"), b))
    return F.array_distinct(pairs)


def phrases(tokens: Column) -> Column:
    """Different runs of 3 and of 4 tokens, joined by spaces."""
    after = lambda xs, k: F.slice(xs, k, F.greatest(F.size(xs) - (k - 1), F.lit(0)))
    two = F.zip_with(tokens, after(tokens, 2), lambda a, b: F.concat(a, F.lit(" "), b))
    three = F.zip_with(two, after(tokens, 3), lambda a, b: F.concat(a, F.lit(" "), b))
    four = F.zip_with(three, after(tokens, 4), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.array_compact(F.concat(three, four)))


_LETTER = r"[^A-Za-z0-9\s]*[A-Za-z0-9][^A-Za-z0-9\s]*"


def joined_letters(c) -> Column:
    """Folded text whose runs of three and more one-letter words, marks aside, are one word: `R O. C M` is `ROCM`."""
    run = rf"(?<!\S){_LETTER}(?: {_LETTER}){{2,}}(?!\S)"
    words = F.regexp_extract_all(fold(c), F.lit(run + r"|\S+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.when(w.contains(" "), F.regexp_replace(w, "[^A-Za-z0-9]", "")).otherwise(w)), " ")


def clock(seconds: Column) -> Column:
    """HH:MM:SS; null counts as 0."""
    s = F.floor(F.coalesce(seconds, F.lit(0))).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))


def short_clock(seconds: Column) -> Column:
    """MM:SS below an hour, HH:MM:SS from there on; null counts as 0."""
    whole = clock(seconds)
    return F.when(F.coalesce(seconds, F.lit(0)) < 3600, F.substring(whole, 4, 5)).otherwise(whole)


def seconds_of(clock_text: Column) -> Column:
    """Seconds of a number, MM:SS or HH:MM:SS; null for anything else."""
    p = F.split(clock_text, ":")
    at = lambda k: F.get(p, F.lit(k)).try_cast("double")
    return F.when(F.size(p) == 1, at(0)).when(F.size(p) == 2, at(0) * 60 + at(1)).when(F.size(p) == 3, at(0) * 3600 + at(1) * 60 + at(2))


def without_reasoning(c) -> Column:
    gone = F.regexp_replace(c, "(?is)<think>.*?</think>", "")
    return F.regexp_replace(F.regexp_replace(gone, "\n{3,}", "\n\n"), r"^(?U)\s+|(?U)\s+$", "")


def lexical_score(query: Column, query_tokens: Column, text: Column, text_tokens: Column) -> Column:
    """2 for the whole query inside the text, and the shares of query tokens and of text tokens that both have."""
    both = F.size(F.array_intersect(query_tokens, text_tokens))
    share = lambda n, of: F.when(F.size(of) > 0, n / F.size(of)).otherwise(0.0)
    return F.when(F.contains(F.lower(text), F.lower(query)), 2.0).otherwise(0.0) + share(both, query_tokens) + share(both, text_tokens)


def low_signal(c) -> Column:
    folded = fold(c)
    return (folded == "") | folded.rlike(r"^[:;\-|/ ]+$") | ~folded.rlike(r"[\p{L}\p{N}]")


def meaningful(c, kind: Column) -> Column:
    folded, long = fold(c), kind.isin("transcript", "summary")
    tokens = F.size(F.regexp_extract_all(F.lower(folded), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    enough = (tokens >= F.when(kind.isin("transcript", "summary", "topic"), 3).otherwise(2)) | (F.length(folded) >= F.when(long, 18).otherwise(12))
    return folded.rlike(r"\p{L}") & enough


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once: inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def token_counts(c, size: int = 64) -> Column:
    """How many of the text's tokens, repeats included, fall in each of `size` places named by their MD5; null: none."""
    tokens = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    at = F.transform(tokens, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") % size)
    return bound(at, lambda at: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(at) - F.size(F.array_remove(at, k))))


def token_vector(c, size: int = 64) -> Column:
    """The embedding used where no model is given: token counts at unit length, zeros for a text without tokens."""
    norm = lambda counts: F.greatest(F.sqrt(F.aggregate(counts, F.lit(0).cast("double"), lambda n, x: n + x * x)), F.lit(1e-12))
    unit = lambda counts: bound(norm(counts), lambda n: F.transform(counts, lambda x: (x / n).cast("float")))
    return bound(token_counts(c, size), unit)
