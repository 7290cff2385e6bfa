"""URL filters: allow and block rules, then logistic regression on hashed character n-grams of host and path.

A url's features are the different buckets of its n-grams of 3 to 5 characters, host and path apart, each of value
1 / sqrt(number of buckets). The weights are fitted by Spark's own LogisticRegression on a small table of labelled urls
(about 60; BUCKETS bounds the model, which rides in the plan as one array of numbers). A url that a rule fits takes the
rule's verdict, the others the model's. Everything is DataFrame functions; only the urls are read, nothing is shuffled.

Cases: a null url and one without `://` have an empty host and path, fit no rule and score by the intercept; very long
urls count whole; repeated rows are judged alike; of rules of one length the one of the longer host wins, then block;
without labelled urls, or with one label only, the score is the smoothed share of that label, 0.5 without any; block
means a score above 0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIZES, BUCKETS = (3, 4, 5), 1 << 12
#: Strength of the penalty on squared weights, as LogisticRegression's regParam.
PENALTY = 0.01
#: Rules that are compiled into the projection; a longer list is joined.
COMPILED = 1000

#: Rules of the query, as (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: The labelled urls: invented hosts, paths as such sites have them.
BLOCKED = """
http://casino-royal.example/play/slots http://www.free-bets.example/bonus/777 https://best-casino-win.example/jackpot http://bets-online.example/odds/today.html
http://cheap-pills.example/buy/now https://www.pills-discount.example/order?id=4 http://pharma-cheap.example/pills/blue https://m.cheap-meds.example/sale/
http://adult-x.example/videos/44 https://www.xxx-adult.example/gallery/9.html http://x-adult-cams.example/live http://blog.adult-pics.example/hot/12
http://spam-farm.example/page/1.html http://link-farm.example/out/9931 https://www.seo-spam.example/backlinks http://spam-links.example/en/list#top
http://ads-track.example/click?c=1 https://m.track-ads.example/pixel/4 http://ads-server.example/banner/88 http://click-track.example/redirect/5
http://free-prize-win.example/claim https://win-free-phone.example/now http://www.cheap-loans.example/apply http://loans-fast-cash.example/payday
http://warez-crack.example/download/keygen https://free-crack.example/serial/1 http://torrent-free.example/movie/771 http://cheap-replica.example/watches
"""
ALLOWED = """
http://garden-notes.example/roses/pruning https://www.townlibrary.example/catalog/item/20 http://riverschool.example/news/2020/term.html https://docs.toolkit.example/guide/install
http://blog.kitchenbench.example/bread/rye https://history-society.example/archive/1890/mill http://www.weatherroom.example/forecast/week https://museum.example/exhibits/clay
https://m.cityherald.example/politics/vote http://encyclopedia.example/wiki/Granite https://journal.example/articles/44/abstract http://www.orchestra.example/season/spring
https://forum.woodwork.example/thread/551?page=2 http://recipes.example/soup/leek#top https://www.university.example/courses/math http://poetry.example/en/17
https://blog.thornhill.example/en/853/ http://thether.example/fr/825?page=2 https://m.thorin.example/de/25#top http://tionary.example/es/414.html
https://www.thenation.example/en/148.html http://blog.otherlands.example/en/960 https://therapy-notes.example/de/252 http://interstate.example/fr/64.html
https://planets.example/orbits/mars http://www.beekeeping.example/hives/winter https://maps.example/trails/north/4 http://letters.example/1911/april
"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first `://` up to / ? # (A-Z lower-cased), and from there up to ? #; empty where there is none."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, k), F.lit("")) for k in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _grams(text: Column, mark: str) -> Column:
    """The n-grams of a text between ^ and $, each behind the mark of where it comes from; none of an empty text.

    The characters are bound once by a lambda: an expression named in one would be computed for each n-gram.
    """
    gram = lambda chars, n: F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)]))
    none = F.array().cast("array<string>")
    of = lambda chars: F.concat(*[F.when(F.size(chars) >= n, gram(chars, n)).otherwise(none) for n in SIZES])
    grams = F.get(F.transform(F.array(F.split(F.concat(F.lit("^"), text, F.lit("$")), "")), of), F.lit(0))
    return F.when(text == "", none).otherwise(grams)


def buckets(host: Column, path: Column, n: int = BUCKETS) -> Column:
    """The different buckets 0..n-1 of the n-grams of host and path, from an MD5: the same in any engine."""
    grams = F.concat(_grams(host, "h"), _grams(path, "p"))
    return F.array_distinct(F.transform(grams, lambda g: F.pmod(F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"), F.lit(n))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the labelled table, 1 for blocked."""
    return spark.createDataFrame([(u, label) for label, urls in ((1, BLOCKED), (0, ALLOWED)) for u in urls.split()], "url string, label int")


def fit(labelled: DataFrame, n: int = BUCKETS, penalty: float = PENALTY) -> tuple[float, list[float]]:
    """(intercept, n weights) of the logistic regression on (url, label)."""
    rows = labelled.where("label in (0, 1)").select(F.col("label").cast("double").alias("label"), *[c.alias(k) for k, c in zip(("host", "path"), host_and_path(F.col("url")))])
    seen = {int(r.label): r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return math.log((seen.get(1, 0) + 1) / (seen.get(0, 0) + 1)), [0.0] * n
    found = rows.select("label", buckets(F.col("host"), F.col("path"), n).alias("b"))
    value = lambda k: F.when(F.array_contains("b", k), 1 / F.sqrt(F.size("b"))).otherwise(0.0)
    vectors = found.select("label", array_to_vector(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), value)).alias("features")).coalesce(1)
    model = LogisticRegression(regParam=penalty, standardization=False, maxIter=200, tol=1e-9).fit(vectors)
    return float(model.intercept), [float(w) for w in model.coefficients.toArray()]


def _numbers(values) -> Column:
    return F.expr(f"array({', '.join(f'{x!r}D' for x in values)})")


def _parts(rule: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a rule."""
    at = rule.find("/") if "/" in rule else len(rule)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rule[:at])
    return host, rule[at:]


def _compiled(rules: list[tuple[str, str]]) -> Column:
    """The rule that fits host and path: the longest, as a struct (n, h, verdict, rule); null if none does."""
    kind = "array<struct<n: int, h: int, verdict: string, rule: string, host: string, path: string>>"
    if not rules:
        return F.lit(None).cast("struct<n: int, h: int, verdict: string, rule: string>")
    one = lambda verdict, rule, host, path: F.struct(F.lit(len(rule)).alias("n"), F.lit(len(host)).alias("h"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"), F.lit(host).alias("host"), F.lit(path).alias("path"))
    table = F.array(*[one(v, r, *_parts(r)) for v, r in rules]).cast(kind)
    fits = lambda r: ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["path"])
    return F.array_max(F.transform(F.filter(table, fits), lambda r: F.struct(r["n"].alias("n"), r["h"].alias("h"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows with the column `fit` of the rule that fits, from a table of any size: different hosts and paths meet the
    rules of every suffix of the host in an equi join."""
    at = F.instr("rule", "/")
    host = F.translate(F.when(at > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    table = rules.select("verdict", "rule", host.alias("_suffix")).withColumn("_start", F.expr("substring(rule, length(_suffix) + 1)")).distinct()
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = urls.withColumn("_suffix", F.explode(suffixes)).join(table, "_suffix").where(F.startswith("path", F.col("_start")))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("_suffix").alias("h"), "verdict", "rule")).alias("fit"))
    return rows.join(best, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, model: tuple[float, list[float]], threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score, for pages of page_id, url.

    rules: (verdict, rule) pairs, compiled into the projection if there are at most COMPILED, else joined; or a table
    of them (verdict, rule). A rule is a host and the start of a path, like `net/es/`; it fits subdomains too.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(rules, list) and len(rules) > COMPILED:
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, rule string")
    rows = rows.withColumn("fit", _compiled(rules)) if isinstance(rules, list) else _joined(rows, rules)
    intercept, weights = model
    found = buckets(F.col("host"), F.col("path"), len(weights))
    table = _numbers(weights)
    rows = rows.withColumn("_b", found)
    total = F.aggregate("_b", F.lit(0.0), lambda s, k: s + F.element_at(table, k.cast("int") + 1))
    margin = F.lit(intercept) + F.coalesce(F.try_divide(total, F.sqrt(F.size("_b").cast("double"))), F.lit(0.0))
    score = 1 / (1 + F.exp(-margin))
    verdict = F.coalesce("fit.verdict", F.when(score > threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))
