"""URL filters: logistic regression on hashed character n-grams of host and path, under explicit rules.

The model is trained from a small labelled URL table, any (url, blocked). `labelled_urls` makes one of data: a page
whose title begins the text of labelled documents has their label. N-grams are hashed with Spark SQL functions, so
training and scoring see the same features; the fit itself is full-batch gradient descent on the driver over at most
TRAINING_ROWS urls. Scoring is one DataFrame expression: the weights are a literal array of BUCKETS numbers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
NGRAMS = (3, 4, 5)
#: The documented bound of the labelled table: rows with the smallest hashes of their urls.
TRAINING_ROWS = 2_000
#: So many characters of a page's title, or of a document, tell which documents a page shows.
TITLE = 60
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end.

    A null url, or one without ://, has both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(url.isNotNull() & (at > 0), F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: (verdict, 'host/path')."""
    found_rule, found_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer one overrides
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found_rule = F.when(fits, F.lit(rule)).otherwise(found_rule)
        found_verdict = F.when(fits, F.lit(verdict)).otherwise(found_verdict)
    return found_rule, found_verdict


def _grams(text: Column, kind: str) -> Column:
    """Bucket numbers of all n-grams of one part of the url, with marks at both ends; all digits count as 0."""
    marked = F.concat(F.lit("^"), F.translate(text, "0123456789", "0000000000"), F.lit("$"))

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        found = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(marked, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))
        return F.when(F.length(marked) >= n, found).otherwise(F.array().cast("array<int>"))

    return F.concat(*map(of_length, NGRAMS))


def url_features(host: Column, path: Column) -> Column:
    """The url's distinct buckets; a host and a path n-gram of the same letters are different features."""
    return F.array_distinct(F.concat(_grams(host, "host"), _grams(path, "path")))


def fit(labelled: DataFrame, epochs: int = 300, rate: float = 4.0, ridge: float = 3e-4) -> tuple[float, list[float]]:
    """(intercept, weights) from a table (url, blocked int) of TRAINING_ROWS rows at most; rows with a null are left out.

    Features count 1 / sqrt(number of features), so long urls weigh like short ones.
    """
    host, path = split_url(F.col("url"))
    rows = labelled.where("url is not null and blocked is not null").select(F.col("blocked").cast("double").alias("y"), "url")
    sample = rows.orderBy(F.xxhash64("url"), "url", "y").limit(TRAINING_ROWS)
    data = sample.select("y", url_features(host, path).alias("x")).collect()
    bias, weights = 0.0, np.zeros(BUCKETS)
    if not data:
        return bias, weights.tolist()
    y, n = np.array([r.y for r in data]), len(data)
    size = np.array([len(r.x) for r in data])
    owner, bucket = np.repeat(np.arange(n), size), np.concatenate([np.array(r.x, np.int64) for r in data])
    scale = (1 / np.sqrt(np.maximum(size, 1)))[owner]
    used = np.unique(bucket)
    for _ in range(epochs):
        total = bias + np.bincount(owner, weights[bucket] * scale, n)
        miss = 0.5 * (1 + np.tanh(total / 2)) - y
        slopes = np.bincount(bucket, miss[owner] * scale, BUCKETS) / n
        bias -= rate * float(miss.mean())
        weights[used] -= rate * (slopes[used] + ridge * weights[used])
    return bias, weights.tolist()


def block_probability(features: Column, bias: float, weights: list[float]) -> Column:
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to a literal
    total = F.aggregate(features, F.lit(0.0), lambda a, i: a + F.element_at(table, i + 1))
    scale = F.sqrt(F.greatest(F.size(features), F.lit(1)).cast("double"))
    return 1 / (1 + F.exp(-(F.lit(bias) + total / scale)))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, block_probability): one row for each row of pages.

    Rules decide first, the model decides the rest: block from the threshold up. Null urls and urls without :// have
    an empty host and path and get the model's verdict on these. Repeated rows all stay; an empty table gives an
    empty result; an empty labelled table gives probability one half, which allows nothing to be blocked below it.
    """
    bias, weights = fit(labelled)
    host, path = split_url(F.col(url))
    parts = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    scored = parts.withColumn("block_probability", block_probability(url_features(F.col("host"), F.col("path")), bias, weights))
    by_model = F.when(F.col("block_probability") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "block_probability")


#: The rules of the production query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

def page_title(html: Column) -> Column:
    """The text of a page's first h1, as characters, up to TITLE of them; empty if there is none."""
    inside = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.substring(inside, 1, TITLE)


def labelled_urls(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) of the pages that show labelled documents.

    pages (url, html), documents (doc_id, text), labels (doc_id, quality, toxic). A page shows the documents whose
    texts begin with its title; it is labelled if all labelled ones of these agree: blocked if they are toxic or of low
    quality. Labels that are null tell nothing; pages without a title or a url have no row.
    """
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 0)
    marked = labels.select("doc_id", bad.alias("bad")).where("bad is not null")
    heads = documents.select("doc_id", F.substring("text", 1, TITLE).alias("title")).where("title <> ''").join(marked, "doc_id")
    agreed = heads.groupBy("title").agg(F.min("bad").alias("blocked"), F.max("bad").alias("most")).where(F.col("blocked") == F.col("most"))
    # a title may stand on very many pages, so each one's label is copied SALTS times and its pages are dealt to these
    dealt = agreed.select("title", "blocked", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")
    shown = pages.where("url is not null").select("url", page_title(F.col("html")).alias("title"), salt.alias("salt"))
    return shown.join(dealt, ["title", "salt"]).select("url", "blocked")


def held_out(labelled: DataFrame, threshold: float = 0.5) -> dict[str, float]:
    """Precision and recall of blocking on hosts that training does not see: every second host, by its hash, is held out."""
    host, path = split_url(F.col("url"))
    apart = F.pmod(F.xxhash64(host), F.lit(2)) == 1
    bias, weights = fit(labelled.where(~apart))
    hit = block_probability(url_features(host, path), bias, weights) >= threshold
    one = labelled.where(apart).select(hit.alias("hit"), (F.col("blocked") == 1).alias("bad"))
    r = one.agg(F.count("*").alias("rows"), F.count_if("bad").alias("bad"), F.count_if("hit").alias("blocked"), F.count_if(F.col("hit") & F.col("bad")).alias("right")).first()
    return {"rows": r.rows, "bad": r.bad, "blocked": r.blocked, "precision": r.right / r.blocked if r.blocked else 0.0, "recall": r.right / r.bad if r.bad else 0.0}


__all__ = ["BUCKETS", "RULES", "block_probability", "filter_urls", "fit", "held_out", "labelled_urls", "page_title", "rule_column", "split_url", "url_features"]
