"""Term expansion and scoring.

A scorer turns query tokens into (_iid, score, full, word_hits): `full` tells whether some property matched as many
(token, word) pairs as the query has tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.text import Analyzer
from .index import TextIndex, field_tokens


@dataclass(frozen=True)
class Bm25:
    """Parameters of BM25: term saturation, length normalisation, and a lower bound for frequencies."""

    k: float = 1.2
    b: float = 0.75
    d: float = 0.5


@dataclass(frozen=True)
class TextQuery:
    tokens: list[str]
    props: list[str]
    exact: bool = False
    tolerance: int = 0
    boost: dict[str, float] = field(default_factory=dict)
    threshold: float = 1.0
    relevance: Bm25 = Bm25()

    def __post_init__(self):
        if any(v <= 0 for v in self.boost.values()):
            raise EngineError("INVALID_BOOST_VALUE")


def matches(word: Column, token: Column, query: TextQuery) -> Column:
    """Whether an indexed word answers a query token: the same word, one that begins with it, or one near to it."""
    if query.exact:
        return word == token
    near = word.startswith(token)
    if query.tolerance:
        close = (F.abs(F.length(word) - F.length(token)) <= query.tolerance) & (F.levenshtein(word, token, query.tolerance) >= 0)
        return near | close
    return near


def matched_tokens(query: TextQuery, word: Column) -> Column:
    """The query tokens that a word answers."""
    return F.filter(F.array(*[F.lit(t) for t in query.tokens]), lambda t: matches(word, t, query))


def any_match(query: TextQuery, word: Column) -> Column:
    return reduce(lambda a, b: a | b, [matches(word, F.lit(t), query) for t in query.tokens])


def narrowed(index: TextIndex, query: TextQuery) -> TextIndex:
    """The index, or what a query needs of it where its tokens would have to be made anew."""
    return index.narrowed((query.tokens, query.props, query.exact, query.tolerance), query.props, lambda word: any_match(query, word))


def boosts(query: TextQuery) -> Column:
    out = F.lit(1.0)
    for prop, value in query.boost.items():
        out = F.when(F.col("prop") == prop, F.lit(float(value))).otherwise(out)
    return out


def bm25(tf: Column, df: Column, n_docs: Column, field_len: Column, avg_len: Column, p: Bm25) -> Column:
    """idf * (d + tf (k + 1)) / (tf + k (1 - b + b len / avg)), with a relative term frequency."""
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * (p.d + tf * (p.k + 1)) / (tf + p.k * (1 - p.b + p.b * field_len / avg_len))


def bm25_scores(index: TextIndex, query: TextQuery, allowed: DataFrame | None = None) -> DataFrame:
    """BM25 of every document that a query reaches. Statistics are those of the whole collection; `allowed` (_iid)
    limits the documents that are scored, not the counts. The statistics are one row for each property, or constants
    where the index knows them."""
    index = narrowed(index, query)
    found = index.postings(query.props, any_match(query, F.col("token")))
    counts = index.dictionary(query.props, any_match(query, F.col("token")))
    if allowed is not None:
        found = found.join(allowed, "_iid", "left_semi")
    rows = found.join(counts, ["prop", "token"])
    if index.known is not None:
        n, lengths = index.statistics(query.props)
        average = F.lit(None).cast("double")
        for prop, value in lengths.items():
            average = F.when(F.col("prop") == prop, F.lit(value)).otherwise(average)
        rows = rows.withColumn("n_docs", F.lit(n)).withColumn("avg_len", average)
    else:
        total = index.docs.agg(F.count("*").alias("n_docs"))
        rows = rows.join(F.broadcast(index.field_stats(query.props).crossJoin(F.broadcast(total))), "prop")
    rows = rows.withColumn("q", F.explode(matched_tokens(query, F.col("token"))))
    score = bm25(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("field_len"), F.col("avg_len"), query.relevance)
    per_field = rows.withColumn("s", score * boosts(query)).groupBy("_iid", "prop").agg(F.sum("s").alias("s"), F.count("*").alias("hits"))
    return per_field.groupBy("_iid").agg(F.sum("s").alias("score"), F.max(F.col("hits") == max(len(query.tokens), 1)).alias("full"))


def pt15_scores(index: TextIndex, query: TextQuery, allowed: DataFrame | None = None) -> DataFrame:
    """Scores by position: a text's tokens fall into 15 buckets, the first counts 14, the last 0."""
    if query.tolerance or query.exact:
        raise ValueError("this scorer knows no tolerance and no exact match")
    placed = index.placed.where(F.col("prop").isin(query.props)) if index.placed is not None else placed_tokens(index, query.props, index.docs)
    if allowed is not None:
        placed = placed.join(allowed, "_iid", "left_semi")
    hit = placed.where(any_match(query, F.col("token"))).withColumn("q", F.explode(matched_tokens(query, F.col("token"))))
    place = F.when(F.col("n") < 15, F.col("i")).otherwise(F.floor(F.col("i") * 15 / F.col("n")))
    scored = hit.withColumn("s", (14 - place) * boosts(query)).groupBy("_iid", "prop").agg(F.sum("s").alias("s"), F.count("*").alias("hits"))
    return scored.groupBy("_iid").agg(F.sum("s").cast("double").alias("score"), F.max(F.col("hits") == max(len(query.tokens), 1)).alias("full"))


def placed_tokens(index: TextIndex, props: list[str], rows: DataFrame) -> DataFrame:
    """(_iid, prop, n, i, token): each token of each text by its place among the text's n tokens."""
    if index.kept is not None and all(index.schema.types[p] == "string" for p in props):
        texts = index.kept.where(F.col("prop").isin(props))
    else:
        fields = F.array(*[F.struct(F.lit(p).alias("prop"), _texts_tokens(index, p).alias("tokens")) for p in props])
        texts = rows.select("_iid", F.explode(fields).alias("f")).select("_iid", "f.prop", F.explode("f.tokens").alias("tokens"))
    return texts.select("_iid", "prop", F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "token"))


def _texts_tokens(index: TextIndex, prop: str) -> Column:
    """Token arrays of a property's texts: one for a string, one for each element of an array."""
    column = index.schema.column(prop)
    if index.schema.types[prop] == "string[]":
        return F.transform(column, lambda c: index.analyzer.tokens(c, prop))
    tokens = field_tokens(index.schema, index.analyzer, prop)
    return F.when(tokens.isNotNull(), F.array(tokens))


def _tokens_of(index: TextIndex, prop: str, text: Column) -> Column:
    return index.analyzer.tokens(text, prop)


def sentence_postings(index: TextIndex, props: list[str], rows: DataFrame) -> DataFrame:
    """(_iid, prop, token, occ, mask, n): in how many sentences a token occurs, their bits, tokens of all sentences.

    Sentences end at . ? or !; the sentence number goes on after one of more than one token and stops at 19. A document is
    counted inside its row; for an analyzer of one's own, which gives columns, by an explosion and an aggregate.
    """
    schema, parts = index.schema, []
    plain = type(index.analyzer) is Analyzer
    for p in props:
        column = schema.column(p)
        text = F.array_join(column, ". ") if schema.types[p] == "string[]" else column
        sentences = F.split(text, r"[.?!]")
        if plain:
            raw = sentences if p in index.analyzer.tokenize_skip else F.transform(sentences, F.lower)
            parts.append(F.struct(F.lit(p).alias("prop"), _sentence_udf(index.analyzer, p)(raw).alias("found")))
        else:
            parts.append(F.struct(F.lit(p).alias("prop"), F.transform(sentences, partial(_tokens_of, index, p)).alias("sentences")))
    each = rows.select("_iid", F.explode(F.array(*parts)).alias("f")).select("_iid", "f.*")
    if plain:
        words = each.select("_iid", "prop", "found.n", F.explode("found.words").alias("w"))
        return words.select("_iid", "prop", "w.token", "w.occ", "w.mask", "n")
    each = each.where("sentences is not null")
    start = F.struct(F.lit(0).alias("bit"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("bits"))

    def number(a: Column, s: Column) -> Column:
        after = F.when(F.size(s) > 1, F.least(a["bit"] + 1, F.lit(19))).otherwise(a["bit"])
        return F.struct(after.alias("bit"), (a["n"] + F.size(s)).alias("n"), F.concat(a["bits"], F.array(a["bit"])).alias("bits"))

    numbered = each.withColumn("a", F.aggregate("sentences", start, number))
    cut = numbered.select("_iid", "prop", F.col("a.n").alias("n"), F.explode(F.arrays_zip("sentences", F.col("a.bits").alias("bits"))).alias("z"))
    words = cut.select("_iid", "prop", "n", F.col("z.bits").alias("bit"), F.explode("z.sentences").alias("token"))
    return words.groupBy("_iid", "prop", "token").agg(F.count("*").alias("occ"), F.bit_or(F.expr("shiftleft(1, bit)")).alias("mask"), F.max("n").alias("n"))


def _sentence_udf(analyzer: Analyzer, prop: str) -> Callable[[Column], Column]:
    """(n, words: token, occ, mask) of an array of sentences; in Python, so that a document needs no shuffle."""
    item = pa.struct([("token", pa.string()), ("occ", pa.int64()), ("mask", pa.int32())])

    @F.arrow_udf("n int, words array<struct<token: string, occ: bigint, mask: int>>")
    def count(texts: pa.Array) -> pa.Array:
        tokens, occ, masks, totals, ends = [], [], [], [], [0]
        for sentences in texts.to_pylist():
            found: dict[str, list[int]] = {}
            bit = total = 0
            for sentence in sentences or ():
                own = analyzer.lowered_tokens(sentence, prop)
                total += len(own)
                for t in own:
                    if t in found:
                        seen = found[t]
                        seen[0] += 1
                        seen[1] |= 1 << bit
                    else:
                        found[t] = [1, 1 << bit]
                if len(own) > 1 and bit < 19:
                    bit += 1
            tokens.extend(found)
            occ.extend(c for c, _ in found.values())
            masks.extend(m for _, m in found.values())
            totals.append(total)
            ends.append(len(tokens))
        items = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(occ, pa.int64()), pa.array(masks, pa.int32())], fields=list(item))
        return pa.StructArray.from_arrays([pa.array(totals, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=["n", "words"])

    return count


def qps_scores(index: TextIndex, query: TextQuery, allowed: DataFrame | None = None) -> DataFrame:
    """Scores by sentences: a matched word counts occ^2 / n, and 1 if it is a query token itself; words that share
    sentences add 2 for each shared one, which sums up to 2 (sum of bits - bits of the union)."""
    if index.kept is not None and index.stored is None and index.sentences is None:  # as lazy as the tokens are: the first search fills it
        index.sentences = sentence_postings(index, index.schema.searchable, index.docs).persist()
    if index.sentences is not None:
        found = index.sentences.where(F.col("prop").isin(query.props)).where(any_match(query, F.col("token")))
        found = found if allowed is None else found.join(allowed, "_iid", "left_semi")
    else:
        rows = index.docs if allowed is None else index.docs.join(allowed, "_iid", "left_semi")
        found = sentence_postings(index, query.props, rows).where(any_match(query, F.col("token")))
    own = F.when(F.col("token").isin(query.tokens), 1.0).otherwise(0.0)
    score = (F.col("occ") * F.col("occ") / F.col("n") + own) * boosts(query)
    hits = F.size(matched_tokens(query, F.col("token")))
    per_field = found.groupBy("_iid", "prop").agg(F.sum(score).alias("s"), F.sum(F.bit_count("mask")).alias("bits"), F.bit_or("mask").alias("mask"), F.sum(hits).alias("hits"))
    total = F.sum("s") + 2 * (F.sum("bits") - F.bit_count(F.bit_or("mask")))
    return per_field.groupBy("_iid").agg(total.alias("score"), F.max(F.col("hits") == max(len(query.tokens), 1)).alias("full"))


Scorer = Callable[[TextIndex, TextQuery, DataFrame | None], DataFrame]
SCORERS: dict[str, Scorer] = {"bm25": bm25_scores, "qps": qps_scores, "pt15": pt15_scores}


def tokens_found(index: TextIndex, query: TextQuery) -> DataFrame:
    """One row (found): how many query tokens answer to some word of the collection, before any filter."""
    words = narrowed(index, query).postings(query.props, any_match(query, F.col("token"))).select("token").distinct()
    return words.select(F.explode(matched_tokens(query, F.col("token"))).alias("q")).agg(F.countDistinct("q").alias("found"))


def apply_threshold(scored: DataFrame, index: TextIndex, query: TextQuery) -> DataFrame:
    """How many documents stay that do not match all tokens: threshold 1 keeps all, 0 none, between a share of them,
    best first."""
    kc, theta = max(len(query.tokens), 1), query.threshold
    if theta == 1 or (theta == 0 and kc == 1):
        return scored.select("_iid", "score")
    if theta == 0:
        return scored.where("full").crossJoin(F.broadcast(tokens_found(index, query))).where(F.col("found") == kc).select("_iid", "score")
    counts = scored.agg(F.sum(F.col("full").cast("long")).alias("n_full"), F.sum((~F.col("full")).cast("long")).alias("n_rest")).first()
    if not counts.n_full:
        return scored.select("_iid", "score")
    most = -int(-(counts.n_rest * theta) // 1)
    rest = scored.where("not full").orderBy(F.desc("score"), "_iid").limit(most)
    return scored.where("full").unionByName(rest).select("_iid", "score")


def merge_scores(lists: list[DataFrame], boost: float = 1.0, threshold: float = 0.0, keywords: int = 1) -> DataFrame:
    """Merge several (_iid, score) lists into one: a document of several lists has its score so far raised by half
    each time it comes again. Then the threshold decides how many documents stay that are not in `keywords` lists."""
    if boost == 0:
        raise EngineError("INVALID_BOOST_VALUE")
    tagged = [rows.select("_iid", F.lit(i).alias("i"), (F.col("score") * boost).alias("s")) for i, rows in enumerate(lists)]
    found = reduce(lambda a, b: a.unionByName(b), tagged).groupBy("_iid").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda a, x: a * 1.5 + x["s"])
    merged = found.select("_iid", total.alias("score"), F.size("all").alias("n"))
    if threshold == 1 or (threshold == 0 and keywords == 1):
        return merged.select("_iid", "score")
    counts = merged.agg(F.count("*").alias("rows"), F.sum((F.col("n") == keywords).cast("long")).alias("full"), F.max("n").alias("most")).first()
    full = counts.full if counts.most == keywords else 0
    if threshold == 0:
        return merged.where(F.col("n") == keywords if full else F.lit(False)).select("_iid", "score")
    last = max((full or 0) - 1, 0)
    kept = min(counts.rows, last + -int(-(threshold * (counts.rows - last)) // 1))
    return merged.orderBy(F.desc("n"), F.desc("score"), "_iid").limit(kept).select("_iid", "score")
