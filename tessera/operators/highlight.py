"""Positions of words in texts, and those that answer a query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..collection import Collection
from ..search import MOST_BROADCAST, SearchResult, search

WORD = r"[\p{L}0-9_'-]+"
MARK = "\x01"


def pieces(text: Column) -> Column:
    """A text cut at its words: every second piece is a word."""
    return F.split(F.regexp_replace(F.translate(text, MARK, "\x02"), f"({WORD})", f"{MARK}$1{MARK}"), MARK)


def positions(collection: Collection, docs: DataFrame | None = None) -> DataFrame:
    """(_iid, prop, token, start, length): every word of every string property, by its token. A word starts after the
    lengths of all pieces before it, which a window over each text adds up."""
    rows = collection.docs if docs is None else docs
    props = collection.schema.of_kind("string")
    fields = F.array(*[F.struct(F.lit(p).alias("prop"), pieces(collection.schema.column(p)).alias("pieces")) for p in props])
    each = rows.select("_iid", F.explode(fields).alias("f")).select("_iid", "f.prop", F.posexplode("f.pieces").alias("i", "word"))
    before = Window.partitionBy("_iid", "prop").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("length", F.length("word")).withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("int"))
    token = F.get(collection.analyzer.tokens(F.lower("word"), ""), 0)
    return placed.where("i % 2 = 1").select("_iid", "prop", token.alias("token"), "start", "length").where("token is not null")


def search_with_highlight(collection: Collection, params: dict) -> tuple[SearchResult, DataFrame]:
    """The result (its page is looked at, so not with preflight), and (id, prop, token, start, length) of the words of its page that answer the query: those that
    begin with a query token or, with a tolerance, that are near to one."""
    made = search(collection, params)
    docs = collection.docs
    page = made.page_frame.select("_iid")
    page = F.broadcast(page) if made.limit <= MOST_BROADCAST else page
    tokens, most = made.tokens, int(params.get("tolerance") or 0)

    def answers(q: str) -> Column:
        word, token = F.col("token"), F.lit(q)
        if most:
            return token.startswith(word) | (F.levenshtein(word, token, most) >= 0)
        return word.startswith(token)

    test = reduce(lambda a, b: a | b, map(answers, tokens), F.lit(False))
    stored = collection.positions
    held = positions(collection, docs.join(page, "_iid", "left_semi")) if stored is None else stored.join(page, "_iid", "left_semi")
    found = held.where(test)
    return made, found.join(docs.select("_iid", "id"), "_iid").select("id", "prop", "token", "start", "length")
