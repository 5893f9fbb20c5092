"""search(collection, params): one call for full-text, vector and hybrid search."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cmp_to_key, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collection import Collection, to_document
from .errors import EngineError
from .functions.text import format_nanoseconds, whole_word
from .functions.vector import cosine
from .operators import rank
from .operators.rank import MOST_BROADCAST, Ranking
from .operators.score import Bm25, TextQuery, apply_threshold
from .plans.where import compile_where, geo_distance, geo_only
from .schema import vector_size

SIMILARITY = 0.8


@dataclass
class SearchResult:
    """Lazy frames: ranking (all rows), hits (the page), facets and groups by name."""

    collection: Collection
    ranking: Ranking
    page_frame: DataFrame | None
    facets: dict[str, DataFrame] = field(default_factory=dict)
    facet_sizes: dict[str, DataFrame] = field(default_factory=dict)
    groups: DataFrame | None = None
    full: Ranking | None = None
    include_vectors: bool = False
    limit: int = 10
    started: int = field(default_factory=time.perf_counter_ns)
    tokens: list[str] = field(default_factory=list)

    @property
    def count(self) -> int:
        """How many rows match, before distinct and pages."""
        return (self.full or self.ranking).rows.count()

    @property
    def hits(self) -> DataFrame:
        """(id, score, properties) of the page, in order; documents are joined to the page only."""
        if self.page_frame is None:
            return self.collection.docs.limit(0).select("id", F.lit(0.0).alias("score"))
        vectors = self.collection.schema.vectors
        docs = self.collection.docs
        shown = [F.lit(None).cast(f.dataType).alias(f.name) if f.name in vectors and not self.include_vectors else docs[f.name] for f in docs.schema.fields if f.name not in ("_iid", "id")]
        page = F.broadcast(self.page_frame) if self.limit <= MOST_BROADCAST else self.page_frame
        joined = docs.join(page, "_iid")
        return joined.orderBy(*self.ranking.order).select("id", "score", *shown)

    def collect(self) -> dict[str, Any]:
        """The whole answer as Python values."""
        hits = [{"id": r.id, "score": r.score, "document": to_document_hit(r)} for r in self.hits.collect()] if self.page_frame is not None else []
        out: dict[str, Any] = {"count": self.count, "hits": hits}
        if self.facets:
            sizes = {p: f.first()["count"] for p, f in self.facet_sizes.items()}
            out["facets"] = {p: {"count": sizes[p], "values": {r.value: r["count"] for r in f.collect()}} for p, f in self.facets.items()}
        if self.groups is not None:
            out["groups"] = [r.asDict(recursive=True) for r in self.groups.collect()]
        passed = time.perf_counter_ns() - self.started
        custom = self.collection.components.get("formatElapsedTime")
        out["elapsed"] = custom(passed) if custom else {"raw": passed, "formatted": format_nanoseconds(passed)}
        return out


def to_document_hit(row: Any) -> dict:
    made = to_document(row)
    made.pop("score", None)
    return made


def search(collection: Collection, params: dict) -> SearchResult:
    """params: term, mode, properties, where, exact, tolerance, threshold, boost, relevance, sortBy, distinctOn, offset,
    limit, facets, groupBy, vector, similarity, hybridWeights, includeVectors, preflight."""
    started = time.perf_counter_ns()
    params = dict(params)
    mode = params.get("mode", "fulltext")
    if mode not in ("fulltext", "vector", "hybrid"):
        raise EngineError("INVALID_SEARCH_MODE", mode)
    collection._run("beforeSearch", collection, params, collection.language)
    made = {"fulltext": _fulltext, "vector": _vector, "hybrid": _hybrid}[mode](collection, params)
    made.started = started
    collection._run("afterSearch", collection, params, collection.language, made)
    return made


def search_vector(collection: Collection, params: dict) -> SearchResult:
    return search(collection, params | {"mode": "vector"})


def _pages(collection: Collection, params: dict, ranking: Ranking, distinct: bool = True) -> SearchResult:
    offset, limit = params.get("offset", 0), params.get("limit", 10)
    docs, schema = collection.docs, collection.schema
    shown = rank.distinct_on(ranking, docs, schema, params["distinctOn"]) if distinct and params.get("distinctOn") else ranking
    made = SearchResult(collection, shown, None if params.get("preflight") else shown.page(offset, limit), full=ranking, include_vectors=params.get("includeVectors", False), limit=limit)
    for prop, config in (params.get("facets") or {}).items():
        made.facets[prop] = rank.facet(ranking, docs, schema, prop, config)
        made.facet_sizes[prop] = made.facets[prop].agg(F.count("*").alias("count")) if (config or {}).get("ranges") else rank.facet_size(ranking, docs, schema, prop)
    if grouping := params.get("groupBy"):
        props, most = grouping["properties"], grouping.get("maxResult", 0)
        reducer = grouping.get("reduce")
        if isinstance(reducer, dict):
            made.groups = rank.reduced_groups(ranking, docs, schema, props, most, reducer["reducer"], reducer["getInitialValue"])
        else:
            made.groups = rank.groups(ranking, docs, schema, props, most, reducer)
    return made


def _properties(collection: Collection, params: dict) -> list[str]:
    known, wanted = collection.schema.searchable, params.get("properties", "*")
    if wanted in (None, "*"):
        return known
    for p in wanted:
        if p not in known:
            raise EngineError("UNKNOWN_INDEX", p, ", ".join(known))
    return list(wanted)


def _allowed(collection: Collection, params: dict) -> Column | None:
    return compile_where(params["where"], collection.schema, collection.analyzer) if params.get("where") else None


def text_query(collection: Collection, params: dict) -> TextQuery | None:
    """The query of a term; None if the term has letters but no tokens, which matches nothing."""
    term = params.get("term") or ""
    tokens = collection.analyzer.query_tokens(term)
    if not tokens:
        if term:
            return None
        tokens = [""]
    relevance = Bm25(**{k: v for k, v in (params.get("relevance") or {}).items()})
    return TextQuery(tokens, _properties(collection, params), bool(params.get("exact")), int(params.get("tolerance") or 0), params.get("boost") or {}, params.get("threshold", 1), relevance)


def text_scores(collection: Collection, params: dict) -> DataFrame:
    """(_iid, score): documents that match the text part of a search, unordered."""
    docs, schema = collection.docs, collection.schema
    allowed = _allowed(collection, params)
    term, wanted = params.get("term"), params.get("properties")
    if term or wanted:
        query = text_query(collection, params)
        if query is None or not query.props:
            return docs.limit(0).select("_iid", F.lit(0.0).alias("score"))
        ids = None if allowed is None else docs.where(allowed).select("_iid")
        scored = collection.scorer(collection.index, query, ids)
        scored = apply_threshold(scored, collection.index, query)
        if params.get("exact") and term:
            scored = scored.join(docs.where(exact_filter(collection, term, query.props)).select("_iid"), "_iid", "left_semi")
        return scored
    if allowed is None:
        return docs.select("_iid", F.lit(0.0).alias("score"))
    by_place = geo_only(params["where"], schema)
    if by_place:
        away = docs.where(allowed).select("_iid", geo_distance(schema.column(by_place[0]), by_place[1]).alias("d"))
        most = away.agg(F.max("d").alias("most"))
        return away.crossJoin(F.broadcast(most)).select("_iid", (F.col("most") - F.col("d") + 1).alias("score"))
    return docs.where(allowed).select("_iid", F.lit(0.0).alias("score"))


def exact_filter(collection: Collection, term: str, props: list[str]) -> Column:
    """Some string property holds every word of the raw term as a whole word, in the same case."""
    words = [whole_word(w) for w in term.split()]
    strings = [p for p in props if collection.schema.types[p] == "string"]
    tests = [reduce(lambda a, b: a & b, [collection.schema.column(p).rlike(w) for w in words]) for p in strings]
    return F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), tests, F.lit(False)), F.lit(False))


def _ordered(collection: Collection, params: dict, scored: DataFrame) -> Ranking:
    by = params.get("sortBy")
    if not by:
        return rank.by_score(scored)
    if callable(by):
        return _by_function(collection, scored, by)
    if not collection.sort_enabled:
        raise EngineError("SORT_DISABLED")
    if by["property"] in collection.unsortable:
        raise EngineError("UNABLE_TO_SORT_ON_UNKNOWN_FIELD", by["property"], ", ".join(collection.schema.sortable))
    descending = str(by.get("order", "ASC")).upper() == "DESC"
    sort = collection.components.get("sorter") or rank.sort_by
    return sort(scored, collection.docs, collection.schema, by["property"], descending, collection.language, by.get("locale", True))


def _by_function(collection: Collection, scored: DataFrame, compare: Callable) -> Ranking:
    """A key function over columns (marked by `columns = True`) sorts in Spark; a comparator of two
    (id, score, document) tuples sorts on the driver, so it is for small results."""
    rows = scored.join(collection.docs, "_iid")
    if getattr(compare, "columns", False):
        keys = compare(rows)
        named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
        return Ranking(rows.select("_iid", "score", *named), [F.asc(f"_k{i}") for i in range(len(named))] + [F.asc("_iid")])
    data = rows.orderBy(F.desc("score"), "_iid").collect()
    done = sorted(data, key=cmp_to_key(lambda a, b: compare((a["_iid"], a.score, to_document_hit(a)), (b["_iid"], b.score, to_document_hit(b)))))
    placed = collection.spark.createDataFrame([(r["_iid"], float(r.score), i) for i, r in enumerate(done)], "_iid long, score double, _k0 long")
    return Ranking(placed, [F.asc("_k0")])


def active_pins(collection: Collection, term: str | None) -> list[tuple[str, int]]:
    return (collection.components.get("pinning") or rank.active_pins)(collection.all_pins(), term)


def _fulltext(collection: Collection, params: dict) -> SearchResult:
    ranking = _ordered(collection, params, text_scores(collection, params))
    ranking = rank.pin(ranking, collection.docs, active_pins(collection, params.get("term")))
    made = _pages(collection, params, ranking)
    made.tokens = collection.analyzer.query_tokens(params.get("term") or "")
    return made


def vector_scores(collection: Collection, params: dict) -> DataFrame:
    """(_iid, score): documents whose vector is similar enough."""
    given = params.get("vector")
    if not given:
        raise EngineError("MISSING_VECTOR_AND_SECURE_PROXY")
    if not isinstance(given, dict) or "value" not in given or "property" not in given:
        raise EngineError("INVALID_VECTOR_INPUT", ", ".join(given) if isinstance(given, dict) else type(given).__name__)
    kind = collection.schema.types.get(given["property"])
    size = vector_size(kind) if kind else None
    if not size:
        raise EngineError("UNKNOWN_VECTOR_PROPERTY", given["property"])
    if len(given["value"]) != size:
        raise EngineError("INVALID_INPUT_VECTOR", given["property"], size, len(given["value"]))
    allowed = _allowed(collection, params)
    docs = collection.docs if allowed is None else collection.docs.where(allowed)
    rows = docs.select("_iid", cosine(collection.schema.column(given["property"]), given["value"]).alias("score"))
    least = params.get("similarity")
    return rows.where(F.col("score") >= (SIMILARITY if least is None else least))


def _vector(collection: Collection, params: dict) -> SearchResult:
    """Best first; pins do not apply, since there is no term."""
    return _pages(collection, params, rank.by_score(vector_scores(collection, params)), distinct=False)


def hybrid_scores(collection: Collection, params: dict) -> DataFrame:
    """Text and vector scores, each divided by its largest, weighted and added; weights are one half unless both are
    given and neither is 0."""
    weights = params.get("hybridWeights") or {}
    text, vector = weights.get("text") or 0, weights.get("vector") or 0
    if not (text and vector):
        text = vector = 0.5

    def scaled(rows: DataFrame, name: str) -> DataFrame:
        top = rows.agg(F.max("score").alias("top"))
        share = F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0)
        return rows.crossJoin(F.broadcast(top)).select("_iid", share.alias(name))

    a, b = scaled(text_scores(collection, params), "t"), scaled(vector_scores(collection, params), "v")
    joined = a.join(b, "_iid", "full_outer")
    return joined.select("_iid", (F.lit(float(text)) * F.coalesce("t", F.lit(0.0)) + F.lit(float(vector)) * F.coalesce("v", F.lit(0.0))).alias("score"))


def _hybrid(collection: Collection, params: dict) -> SearchResult:
    if not params.get("term") and params.get("term") != "":
        raise EngineError("MISSING_TERM")
    ranking = rank.by_score(hybrid_scores(collection, params))
    ranking = rank.pin(ranking, collection.docs, active_pins(collection, params.get("term")))
    return _pages(collection, params | {"preflight": False}, ranking, distinct=False)
