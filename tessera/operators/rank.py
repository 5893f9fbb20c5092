"""Order, pins, pages, distinct rows, facets and groups over a ranked set.

A ranking is a frame of (_iid, score, ...) with sort columns. No step numbers all rows: the order is a list of
columns, pages are top-k, and pins look at as many rows as their last position.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.text import LOCALES
from ..schema import Schema, inner, is_array, vector_size

LAST = 1 << 40
#: Frames of more rows are not broadcast by hint.
MOST_BROADCAST = 10_000
PIN_SCORE = 1_000_000.0


@dataclass(frozen=True)
class Ranking:
    """rows: (_iid, score, and what `order` needs)."""

    rows: DataFrame
    order: list[Column]

    def page(self, offset: int, limit: int) -> DataFrame:
        ordered = self.rows.orderBy(*self.order)
        return (ordered.offset(offset) if offset else ordered).limit(max(limit, 0))


def by_score(scored: DataFrame) -> Ranking:
    return Ranking(scored, [F.desc("score"), F.asc("_iid")])


def sort_by(scored: DataFrame, docs: DataFrame, schema: Schema, prop: str, descending: bool, language: str, locale: bool = True) -> Ranking:
    """By a property. Rows without a value come last either way; equal values keep the order of insertion, reversed if
    descending; equal `true` values come in reverse order of insertion if ascending."""
    kind = schema.types.get(prop)
    if kind not in ("string", "number", "boolean"):
        raise EngineError("UNABLE_TO_SORT_ON_UNKNOWN_FIELD", prop, ", ".join(schema.sortable))
    value = schema.column(prop)
    if kind == "string" and locale:
        value = F.collate(value, COLLATIONS.get(language, "UNICODE"))
    rows = scored.join(docs.select("_iid", value.alias("_value")), "_iid")
    tie = F.when(F.col("_value"), -F.col("_iid")).otherwise(F.col("_iid")) if kind == "boolean" else F.col("_iid")
    rows = rows.withColumn("_tie", tie)
    value = F.col("_value").desc_nulls_last() if descending else F.col("_value").asc_nulls_last()
    return Ranking(rows, [value, F.desc("_tie") if descending else F.asc("_tie")])


#: Spark's collations for locale codes; others sort by Unicode.
COLLATIONS = {name: code for name, code in LOCALES.items() if code in ("ar", "bg", "de", "es", "fi", "fr", "hu", "it", "lt", "nl", "no", "pt", "ro", "ru", "ta", "tr", "uk")} | {
    "danish": "da",
    "swedish": "sv",
    "czech": "cs",
    "greek": "el",
    "armenian": "hy",
    "serbian": "sr",
    "slovenian": "sl",
    "english": "UNICODE",
}


# ---- pins -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PinRule:
    """conditions: (anchoring is | starts_with | contains, pattern), all of which must hold; promote: (id, position)."""

    id: str
    conditions: tuple[tuple[str, str], ...]
    promote: tuple[tuple[str, int], ...]

    def holds(self, term: str) -> bool:
        text = term.strip().lower()
        tests = {"is": str.__eq__, "starts_with": str.startswith, "contains": str.__contains__}
        return all(tests[how](text, pattern.strip().lower()) for how, pattern in self.conditions)


def active_pins(rules: list[PinRule], term: str | None) -> list[tuple[str, int]]:
    """(id, position) by position: the first document of a position takes it, a document keeps its lowest one."""
    if not term:
        return []
    wanted = sorted((p for r in rules if r.holds(term) for p in r.promote), key=lambda p: p[1])
    out: dict[str, int] = {}
    taken: set[int] = set()
    for doc, position in wanted:
        if doc not in out and position not in taken:
            out[doc] = position
            taken.add(position)
    return sorted(out.items(), key=lambda p: p[1])


def pin(ranking: Ranking, docs: DataFrame, pins: list[tuple[str, int]]) -> Ranking:
    """Put pinned documents at their 0-based positions; others fill the places between. Pins are few and known."""
    if not pins:
        return ranking
    spark = docs.sparkSession
    known = {r.id: r["_iid"] for r in docs.where(F.col("id").isin([p[0] for p in pins])).select("id", "_iid").collect()}
    places = [(known[doc], position) for doc, position in pins if doc in known]
    if not places:
        return ranking
    iids = [iid for iid, _ in places]
    free = ranking.rows.where(~F.col("_iid").isin(iids))
    most = places[-1][1] + 1
    first = Ranking(free, ranking.order).page(0, most)
    slot = F.row_number().over(Window.orderBy(*ranking.order)) - 1
    for _, position in places:
        slot = F.when(slot >= position, slot + 1).otherwise(slot)
    numbered = first.select("_iid", slot.cast("long").alias("_slot"))
    numbered = F.broadcast(numbered) if most <= MOST_BROADCAST else numbered
    rest = free.join(numbered, "_iid", "left").withColumn("_slot", F.coalesce("_slot", F.lit(LAST)))
    given = spark.createDataFrame(places, "_iid long, _slot long")
    inside = ranking.rows.where(F.col("_iid").isin(iids))
    pinned = given.join(inside, "_iid", "left")
    pinned = pinned.withColumn("score", F.when(pinned["score"].isNotNull(), PIN_SCORE - F.col("_slot")).otherwise(0.0))
    return Ranking(rest.unionByName(pinned), [F.asc("_slot"), *ranking.order])


# ---- distinct, facets, groups -----------------------------------------------------------------------------------


def distinct_on(ranking: Ranking, docs: DataFrame, schema: Schema, prop: str) -> Ranking:
    """The first row of each value; rows without a value are dropped."""
    if prop not in schema.types:
        raise EngineError("UNKNOWN_GROUP_BY_PROPERTY", prop)
    rows = ranking.rows.join(docs.select("_iid", schema.column(prop).alias("_distinct")), "_iid").where("_distinct is not null")
    first = F.row_number().over(Window.partitionBy("_distinct").orderBy(*ranking.order))
    return Ranking(rows.withColumn("_rn", first).where("_rn = 1").drop("_rn", "_distinct"), ranking.order)


def facet(ranking: Ranking, docs: DataFrame, schema: Schema, prop: str, config: dict) -> DataFrame:
    """(value, count) of one facet over all rows of the ranking."""
    kind = schema.types.get(prop)
    if kind is None or vector_size(kind) or inner(kind) not in ("string", "number", "boolean", "enum"):
        raise EngineError("FACET_NOT_SUPPORTED", kind)
    column, array = schema.column(prop), is_array(kind)
    rows = ranking.rows.select("_iid").join(docs.select("_iid", column.alias("v")), "_iid")
    if inner(kind) == "number":
        counts = []
        for r in config["ranges"]:
            hits = F.sum(F.when(_in_range(array, r), 1).otherwise(0))
            counts.append(F.struct(F.lit(f"{r['from']}-{r['to']}").alias("value"), F.coalesce(hits, F.lit(0)).cast("long").alias("count")))
        return rows.agg(F.array(*counts).alias("f")).select(F.explode("f").alias("f")).select("f.value", "f.count")
    if array:
        rows = rows.select(F.explode(F.array_distinct("v")).alias("v"))
    missing = F.lit("") if inner(kind) in ("string", "enum") else F.lit("false")
    named = rows.select(F.coalesce(F.col("v").cast("string"), missing).alias("value"))
    counts = named.groupBy("value").agg(F.count("*").alias("count"))
    if kind != "string":
        return counts
    ordered = counts.orderBy(F.asc("count") if str(config.get("sort", "desc")).lower() == "asc" else F.desc("count"), "value")
    start, end = config.get("offset") or 0, config.get("limit", 10)
    return ordered.limit(end).offset(start)


def _in_range(array: bool, r: dict) -> Column:
    low, high = float(r["from"]), float(r["to"])
    return F.exists("v", lambda x: x.between(low, high)) if array else F.col("v").between(low, high)


def facet_size(ranking: Ranking, docs: DataFrame, schema: Schema, prop: str) -> DataFrame:
    """(count): how many values a facet has before it is cut."""
    return facet(ranking, docs, schema, prop, {"limit": (1 << 31) - 1, "ranges": []}).agg(F.count("*").alias("count"))


def grouped_rows(ranking: Ranking, docs: DataFrame, schema: Schema, props: list[str], max_result: int = 0) -> DataFrame:
    """Rows of the ranking that stand in a group, with g0, g1, ...: all values present, and for each property on its
    own among the first max_result rows of the value."""
    for p in props:
        kind = schema.types.get(p)
        if kind is None:
            raise EngineError("UNKNOWN_GROUP_BY_PROPERTY", p)
        if kind not in ("string", "number", "boolean"):
            raise EngineError("INVALID_GROUP_BY_PROPERTY", p, "string, number, boolean", kind)
    names = [f"g{i}" for i in range(len(props))]
    rows = ranking.rows.join(docs.select("_iid", *[schema.column(p).alias(n) for p, n in zip(props, names, strict=True)]), "_iid")
    if max_result:
        for n in names:
            at = F.row_number().over(Window.partitionBy(n).orderBy(*ranking.order))
            rows = rows.withColumn(f"_{n}", at)
        rows = rows.where(reduce(lambda a, b: a & b, [F.col(f"_{n}") <= max_result for n in names]))
    return rows.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])).drop(*[f"_{n}" for n in names])


def groups(ranking: Ranking, docs: DataFrame, schema: Schema, props: list[str], max_result: int = 0, reduce_with: Callable[[Column], Column] | None = None) -> DataFrame:
    """(values, result, place): one row for each combination of values that occurs; result is the array of its rows
    (id, score) in the ranking's order, or what reduce_with makes of that array. place: of each value, its rank among
    the property's values by first appearance in the ranking; groups come in the order of place.

    A group is one array, so it should be bounded by max_result where a value may hold a large share of the rows.
    """
    rows = grouped_rows(ranking, docs, schema, props, max_result).join(docs.select("_iid", "id"), "_iid")
    names = [f"g{i}" for i in range(len(props))]
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy(*ranking.order)))
    found = F.array_sort(F.collect_list(F.struct(F.col("_n"), F.col("id"), F.col("score"))))
    plain = F.transform(found, lambda r: F.struct(r["id"].alias("id"), r["score"].alias("score")))
    result = reduce_with(plain) if reduce_with else plain
    made = numbered.groupBy(*names).agg(result.alias("result"))
    for n in names:
        first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(n).orderBy(*ranking.order))).where("_n = 1")
        place = F.row_number().over(Window.orderBy(*ranking.order)).cast("long")  # one row for each value
        made = made.join(first.select(n, place.alias(f"_{n}")), n)
    return made.select(F.array(*[F.col(n).cast("string") for n in names]).alias("values"), "result", F.array(*[F.col(f"_{n}") for n in names]).alias("place")).orderBy("place")


def group_hits(hits: DataFrame, key: str) -> DataFrame:
    """(key, rows): the rows of a page of hits, gathered by the value of one of their columns."""
    columns = [F.col(f"`{c}`") for c in hits.columns if c != key]
    return hits.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("rows"))


def reduced_groups(ranking: Ranking, docs: DataFrame, schema: Schema, props: list[str], max_result: int, reducer: Callable[[list, Any, dict, int], Any], initial: Callable[[int], Any]) -> DataFrame:
    """(values, result as JSON): a Python reducer(values, accumulator, row, index) over the rows of each group."""
    import json

    import pandas as pd

    rows = groups(ranking, docs, schema, props, max_result).select("values", "result")

    def run(batches):
        for batch in batches:
            out = []
            for values, members in zip(batch["values"], batch["result"], strict=True):
                total = initial(len(members))
                for i, row in enumerate(members):
                    total = reducer(list(values), total, dict(row), i)
                out.append(json.dumps(total))
            yield pd.DataFrame({"values": batch["values"], "result": out})

    return rows.mapInPandas(run, "values array<string>, result string")
