"""Registered queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import Collection
from .functions.text import FOLD_FROM, FOLD_TO, SPLITTERS, Analyzer
from .operators import answers, highlight, rank
from .operators.rank import PinRule
from .search import search
from .session import shared_folder
from .sources import html
from .streaming import maintenance

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- collections over the tables ----


def documents(spark: SparkSession, sf_dir: str, **options) -> Collection:
    schema = {"text": "string", "lang": "enum", "source": "enum", "n_chars": "number"}
    return Collection.from_dataframe(spark, schema, table(spark, sf_dir, "documents"), "doc_id", "doc_id", unique=True, **options)


def parts(spark: SparkSession, sf_dir: str, **options) -> Collection:
    """Products; one in ten has no size, and tags are the words of the name."""
    schema = {"p_name": "string", "p_type": "string", "p_brand": "string", "p_size": "number", "p_retailprice": "number", "tags": "enum[]", "kind": "enum", "cheap": "boolean"}
    frame = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_type", "p_brand", "p_retailprice",
        F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("p_size"),
        F.split("p_name", " ").alias("tags"), F.col("p_type").alias("kind"), (F.col("p_retailprice") < 1000).alias("cheap"),
    )
    return Collection.from_dataframe(spark, schema, frame, "p_partkey", "p_partkey", unique=True, **options)


PART_SQL = """part_docs AS (SELECT p_partkey AS iid, p_name, p_type, p_brand, p_retailprice,
    CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS DOUBLE) END AS p_size, string_split(p_name, ' ') AS tags, p_retailprice < 1000 AS cheap FROM part)"""


def orders(spark: SparkSession, sf_dir: str) -> Collection:
    schema = {"status": "enum", "price": "number", "priority": "enum", "big": "boolean"}
    frame = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") > 100000).alias("big"))
    return Collection.from_dataframe(spark, schema, frame, "o_orderkey", "o_orderkey", unique=True)


def places(spark: SparkSession, sf_dir: str) -> Collection:
    lon = (F.col("c_custkey") * 7919 % 36000) / 100.0 - 180
    lat = (F.col("c_custkey") * 104729 % 17000) / 100.0 - 85
    frame = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.struct(lon.alias("lon"), lat.alias("lat")).alias("place"))
    return Collection.from_dataframe(spark, {"c_name": "string", "place": "geopoint"}, frame, "c_custkey", "c_custkey", unique=True)


PLACES_SQL = (
    "places AS (SELECT c_custkey AS iid, (c_custkey * 7919 % 36000) / 100.0 - 180 AS lon, (c_custkey * 104729 % 17000) / 100.0 - 85 AS lat FROM "
    "customer)"
)


def vectors(spark: SparkSession, sf_dir: str) -> Collection:
    frame = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    schema = {"text": "string", "embedding": "vector[64]", "label": "number"}
    return Collection.from_dataframe(spark, schema, frame, "vec_id", "vec_id", unique=True)


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 7").first().embedding)


def ranked(found, name: str) -> DataFrame:
    rows = found.full.rows if hasattr(found, "full") and found.full is not None else found.rows
    return rows.select(F.col("_iid").alias(name), F.round("score", 6).alias("score"))


def page(found, name: str) -> DataFrame:
    """Rows of the page by key, with their place in it."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(*found.ranking.order)).cast("long")  # of a page
    return found.page_frame.select(F.col("_iid").alias(name), place.alias("place"))


# ---- SQL pieces ----


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens_sql(column: str, language: str = "english") -> str:
    split = f"string_split_regex(lower({column}), {quote(SPLITTERS[language])})"
    return f"list_distinct(list_filter(list_transform({split}, lambda t: translate(t, {quote(FOLD_FROM)}, {quote(FOLD_TO)})), lambda t: t <> ''))"


def match_sql(word: str, token: str, mode: str, tolerance: int = 0) -> str:
    if mode == "exact":
        return f"{word} = {token}"
    prefix = f"starts_with({word}, {token})"
    return f"({prefix} OR levenshtein({word}, {token}) <= {tolerance})" if tolerance else prefix


def scored_sql(source: str, iid: str, props: dict[str, float], tokens: list[str], mode: str = "prefix", tolerance: int = 0, where: str | None = None, with_part: bool = False, columns: str = "") -> str:
    """CTEs that end in r(iid, score, full) and found(n)."""
    analysed = " UNION ALL ".join(f"SELECT iid, {quote(p)} AS prop, CAST({b} AS DOUBLE) AS boost, {tokens_sql(p)} AS toks FROM docs WHERE {p} IS NOT NULL" for p, b in props.items())
    first = f"{PART_SQL}, docs AS (SELECT * FROM part_docs)" if with_part else f"docs AS (SELECT {iid} AS iid, * FROM {source})"
    keep = f"WHERE m.iid IN (SELECT iid FROM docs WHERE {where})" if where else ""
    return f"""{first},
an AS ({analysed}),
stats AS (SELECT prop, avg(len(toks)) AS avg_len FROM an GROUP BY prop),
post AS (SELECT iid, prop, boost, len(toks) AS flen, unnest(toks) AS token FROM an),
dict AS (SELECT prop, token, count(*) AS df FROM post GROUP BY prop, token),
q AS (SELECT unnest([{", ".join(map(quote, tokens))}]) AS q),
m AS (SELECT p.*, q.q FROM post p JOIN q ON {match_sql("p.token", "q.q", mode, tolerance)}),
found AS (SELECT count(DISTINCT q) AS n FROM m),
s AS (SELECT m.iid, m.prop, count(*) AS hits,
    sum(boost * ln(1 + (total.n - df + 0.5) / (df + 0.5)) * (0.5 + (1.0 / flen) * 2.2) / ((1.0 / flen) + 1.2 * (1 - 0.75 + 0.75 * flen / avg_len))) AS s
    FROM m JOIN dict USING (prop, token) JOIN stats USING (prop) CROSS JOIN (SELECT count(*) AS n FROM docs) total {keep} GROUP BY m.iid, m.prop),
r AS (SELECT iid, sum(s) AS score, bool_or(hits = {max(len(tokens), 1)}) AS full_match FROM s GROUP BY iid)"""


# ---- full text ----

DOC_TERM = "the wh"
DOC_TOKENS = ["the", "wh"]
DOC = scored_sql("documents", "doc_id", {"text": 1}, DOC_TOKENS)
RANKED_DOC = "SELECT iid AS doc_id, round(score, 6) AS score FROM r"


@query("bm25_prefix", f"WITH {DOC} {RANKED_DOC}")
def bm25_prefix(spark, sf_dir):
    return ranked(search(documents(spark, sf_dir), {"term": DOC_TERM}), "doc_id")


@query("bm25_top_page",
    f"WITH {DOC} SELECT iid AS doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, iid) AS place FROM r ORDER BY round(score, 9) DESC, iid "
    f"LIMIT 10")
def bm25_top_page(spark, sf_dir):
    return page(search(documents(spark, sf_dir), {"term": DOC_TERM}), "doc_id")


@query("bm25_exact_term",
    f"WITH {scored_sql('documents', 'doc_id', {'text': 1}, ['than', 'with'], 'exact')} {RANKED_DOC} WHERE iid IN (SELECT iid FROM docs WHERE "
    f"regexp_matches(text, '(^|[^A-Za-z0-9_])than([^A-Za-z0-9_]|$)') AND regexp_matches(text, '(^|[^A-Za-z0-9_])with([^A-Za-z0-9_]|$)'))")
def bm25_exact_term(spark, sf_dir):
    return ranked(search(documents(spark, sf_dir), {"term": "than with", "exact": True}), "doc_id")


@query("exact_case_sensitive",
    f"WITH {scored_sql('documents', 'doc_id', {'text': 1}, ['of'], 'exact')} {RANKED_DOC} WHERE iid IN (SELECT iid FROM docs WHERE "
    f"regexp_matches(text, '(^|[^A-Za-z0-9_])Of([^A-Za-z0-9_]|$)'))")
def exact_case_sensitive(spark, sf_dir):
    return ranked(search(documents(spark, sf_dir), {"term": "Of", "exact": True}), "doc_id")


@query("bm25_fuzzy", f"WITH {scored_sql('documents', 'doc_id', {'text': 1}, ['thand'], 'fuzzy', 1)} {RANKED_DOC}")
def bm25_fuzzy(spark, sf_dir):
    return ranked(search(documents(spark, sf_dir), {"term": "thand", "tolerance": 1}), "doc_id")


PART_SCORED = scored_sql("part", "p_partkey", {"p_name": 2.5, "p_type": 1}, ["st"], with_part=True)


@query("bm25_multi_prop_boost", f"WITH {PART_SCORED} SELECT iid AS p_partkey, round(score, 6) AS score FROM r")
def bm25_multi_prop_boost(spark, sf_dir):
    return ranked(search(parts(spark, sf_dir), {"term": "st", "properties": ["p_name", "p_type"], "boost": {"p_name": 2.5}}), "p_partkey")


@query("bm25_empty_term", f"WITH {scored_sql('part', 'p_partkey', {'p_name': 1}, [''], with_part=True)} SELECT iid AS p_partkey, round(score, 6) AS score FROM r")
def bm25_empty_term(spark, sf_dir):
    return ranked(search(parts(spark, sf_dir), {"term": "", "properties": ["p_name"]}), "p_partkey")


@query("bm25_filtered", f"WITH {scored_sql('documents', 'doc_id', {'text': 1}, DOC_TOKENS, where='n_chars > 2000')} {RANKED_DOC}")
def bm25_filtered(spark, sf_dir):
    return ranked(search(documents(spark, sf_dir), {"term": DOC_TERM, "where": {"n_chars": {"gt": 2000}}}), "doc_id")


LONG_WHERE = "n_chars >= 1000 AND lang IN ('en', 'fr')"


@query("long_text_complex_filter",
    f"WITH "
    f"{scored_sql('documents', 'doc_id', {'text': 1}, ['the', 'than', 'with', 'inging', 'for', 'tion', 'of', 'and', 'that'], where=LONG_WHERE)} "
    f"{RANKED_DOC}")
def long_text_complex_filter(spark, sf_dir):
    where = {"n_chars": {"gte": 1000}, "lang": {"in": ["en", "fr"]}}
    return ranked(search(documents(spark, sf_dir), {"term": "the than with inging for tion of and that", "where": where}), "doc_id")


THRESHOLD = scored_sql("documents", "doc_id", {"text": 1}, ["inging", "than", "wher"])
THRESHOLD_TERM = "inging than wher"


@query("threshold_0", f"WITH {THRESHOLD} {RANKED_DOC} WHERE full_match AND (SELECT n FROM found) = 3")
def threshold_0(spark, sf_dir):
    return ranked(search(documents(spark, sf_dir), {"term": THRESHOLD_TERM, "threshold": 0}), "doc_id")


@query(
    "threshold_half",
    f"""WITH {THRESHOLD}, rest AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, iid) AS rn FROM r WHERE NOT full_match)
{RANKED_DOC} WHERE full_match OR (SELECT count(*) FROM r WHERE full_match) = 0 OR iid IN (SELECT iid FROM rest WHERE rn <= ceil((SELECT count(*) FROM rest) * 0.5))""",
)
def threshold_half(spark, sf_dir):
    return ranked(search(documents(spark, sf_dir), {"term": THRESHOLD_TERM, "threshold": 0.5}), "doc_id")


@query("threshold_1", f"WITH {THRESHOLD} {RANKED_DOC}")
def threshold_1(spark, sf_dir):
    return ranked(search(documents(spark, sf_dir), {"term": THRESHOLD_TERM, "threshold": 1}), "doc_id")


@query("tokens_german", f"SELECT doc_id, CAST(len({tokens_sql('text', 'german')}) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def tokens_german(spark, sf_dir):
    tokens = Analyzer.create("german").tokens(F.col("text"), "text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(tokens).cast("long").alias("n"))


@query("dictionary_df",
    f"WITH {PART_SQL}, an AS (SELECT {tokens_sql('p_name')} AS t FROM part_docs), x AS (SELECT unnest(t) AS token FROM an) SELECT 'p_name' AS "
    f"prop, token, count(*) AS df FROM x GROUP BY token")
def dictionary_df(spark, sf_dir):
    return parts(spark, sf_dir).index.dictionary(["p_name"])


@query("field_stats",
    f"WITH an AS (SELECT {tokens_sql('text')} AS t FROM documents WHERE text IS NOT NULL) SELECT 'text' AS prop, round(avg(len(t)), 6) AS avg_len "
    f"FROM an")
def field_stats(spark, sf_dir):
    return documents(spark, sf_dir).index.field_stats(["text"]).select("prop", F.round("avg_len", 6).alias("avg_len"))


# ---- filters ----


def where_query(name: str, collection: Callable, key: str, where: dict, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return search(collection(spark, sf_dir), {"where": where}).ranking.rows.select(F.col("_iid").alias(key))


for op, value, test in (
    ("gt", 150000, "> 150000"),
    ("gte", 150000, ">= 150000"),
    ("lt", 50000, "< 50000"),
    ("lte", 50000, "<= 50000"),
    ("eq", 100000.5, "= 100000.5"),
    ("between", [50000, 60000], "BETWEEN 50000 AND 60000"),
):
    where_query(f"where_num_{op}", orders, "o_orderkey", {"price": {op: value}}, f"SELECT o_orderkey FROM orders WHERE o_totalprice {test}")
where_query("where_bool", orders, "o_orderkey", {"big": True}, "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
where_query("where_enum_eq", orders, "o_orderkey", {"status": {"eq": "F"}}, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
where_query("where_enum_in", orders, "o_orderkey", {"priority": {"in": ["1-URGENT", "2-HIGH"]}},
    "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
where_query("where_enum_nin", orders, "o_orderkey", {"priority": {"nin": ["1-URGENT", "2-HIGH"]}},
    "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
where_query(
    "where_and_or_not",
    orders,
    "o_orderkey",
    {"and": [{"or": [{"status": {"eq": "F"}}, {"price": {"gt": 200000}}]}, {"not": {"priority": {"eq": "1-URGENT"}}}]},
    "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT coalesce(o_orderpriority = '1-URGENT', false)",
)
where_query("where_empty_and", orders, "o_orderkey", {"and": []}, "SELECT o_orderkey FROM orders WHERE false")
where_query("where_missing_not", parts, "p_partkey", {"not": {"p_size": {"gt": 20}}},
    f"WITH {PART_SQL} SELECT iid AS p_partkey FROM part_docs WHERE NOT coalesce(p_size > 20, false)")
where_query("where_string_terms", documents, "doc_id", {"text": ["inging", "wher"]},
    f"SELECT doc_id FROM documents WHERE list_has_any({tokens_sql('text')}, ['inging', 'wher'])")
TAGS_SQL = (
    "SELECT p_partkey FROM part WHERE {}(string_split(p_name, ' '), [(SELECT string_split(p_name, ' ')[1] FROM part WHERE p_partkey = 1), "
    "(SELECT string_split(p_name, ' ')[2] FROM part WHERE p_partkey = 1)])"
)


def tags_query(name: str, op: str, function: str) -> None:
    @query(name, TAGS_SQL.format(function))
    def run(spark, sf_dir):
        first = table(spark, sf_dir, "part").where("p_partkey = 1").first().p_name.split(" ")[:2]
        return search(parts(spark, sf_dir), {"where": {"tags": {op: first}}}).ranking.rows.select(F.col("_iid").alias("p_partkey"))


tags_query("where_arr_all", "containsAll", "list_has_all")
tags_query("where_arr_any", "containsAny", "list_has_any")


# ---- order and pages ----


def sorted_query(name: str, prop: str, order: str, sql_order: str, offset: int = 0, limit: int = 25) -> None:
    @query(name,
        f"WITH {PART_SQL}, o AS (SELECT iid, row_number() OVER (ORDER BY {sql_order}) AS rn FROM part_docs) SELECT iid AS p_partkey, rn - {offset} AS "
        f"place FROM o WHERE rn > {offset} AND rn <= {offset + limit}")
    def run(spark, sf_dir):
        return page(search(parts(spark, sf_dir), {"sortBy": {"property": prop, "order": order, "locale": False}, "offset": offset, "limit": limit}), "p_partkey")


sorted_query("sort_number_asc", "p_size", "ASC", "p_size ASC NULLS LAST, iid")
sorted_query("sort_number_desc_nulls_last", "p_size", "DESC", "p_size DESC NULLS LAST, iid DESC")
sorted_query("sort_string", "p_name", "ASC", "p_name ASC NULLS LAST, iid")
sorted_query("sort_bool", "cheap", "ASC", "cheap ASC NULLS LAST, CASE WHEN cheap THEN -iid ELSE iid END")
sorted_query("page_offset_limit", "p_retailprice", "DESC", "p_retailprice DESC NULLS LAST, iid DESC", 30, 15)


@query("distinct_on",
    f"WITH {PART_SCORED}, d AS (SELECT iid, row_number() OVER (PARTITION BY p_brand ORDER BY round(score, 9) DESC, iid) AS rn FROM r JOIN "
    f"part_docs USING (iid) WHERE p_brand IS NOT NULL) SELECT iid AS p_partkey FROM d WHERE rn = 1")
def distinct_on(spark, sf_dir):
    found = search(parts(spark, sf_dir), {"term": "st", "properties": ["p_name", "p_type"], "boost": {"p_name": 2.5}, "distinctOn": "p_brand"})
    return found.ranking.rows.select(F.col("_iid").alias("p_partkey"))


# ---- facets and groups ----


@query("facet_string",
    f"WITH {PART_SCORED} SELECT p_brand AS value, count(*) AS count FROM r JOIN part_docs USING (iid) GROUP BY p_brand ORDER BY count DESC, value "
    f"LIMIT 10")
def facet_string(spark, sf_dir):
    return search(parts(spark, sf_dir), {"term": "st", "properties": ["p_name", "p_type"], "facets": {"p_brand": {}}}).facets["p_brand"]


RANGES = [(0, 10), (5, 25), (25, 50), (60, 70)]


@query("facet_number_ranges", f"WITH {PART_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}-{b}' AS value, CAST(count(*) FILTER (p_size BETWEEN {a} AND {b}) AS BIGINT) AS count FROM part_docs" for a, b in RANGES))
def facet_number_ranges(spark, sf_dir):
    return search(parts(spark, sf_dir), {"facets": {"p_size": {"ranges": [{"from": a, "to": b} for a, b in RANGES]}}}).facets["p_size"]


@query("facet_bool", f"WITH {PART_SQL} SELECT CAST(coalesce(cheap, false) AS VARCHAR) AS value, count(*) AS count FROM part_docs GROUP BY 1")
def facet_bool(spark, sf_dir):
    return search(parts(spark, sf_dir), {"facets": {"cheap": {}}}).facets["cheap"]


@query("facet_enum", f"WITH {PART_SQL} SELECT p_type AS value, count(*) AS count FROM part_docs GROUP BY 1")
def facet_enum(spark, sf_dir):
    return search(parts(spark, sf_dir), {"facets": {"kind": {}}}).facets["kind"]


@query("facet_enum_array", f"WITH {PART_SQL}, x AS (SELECT unnest(list_distinct(tags)) AS value FROM part_docs) SELECT value, count(*) AS count FROM x GROUP BY value")
def facet_enum_array(spark, sf_dir):
    return search(parts(spark, sf_dir), {"facets": {"tags": {}}}).facets["tags"]


@query(
    "group_1",
        f"WITH {PART_SQL}, k AS (SELECT iid, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, iid DESC) AS n "
        f"FROM part_docs WHERE p_brand IS NOT NULL) SELECT p_brand AS g0, iid AS p_partkey FROM k WHERE n <= 3",
)
def group_1(spark, sf_dir):
    made = parts(spark, sf_dir)
    found = search(made, {"sortBy": {"property": "p_retailprice", "order": "DESC"}})
    return rank.grouped_rows(found.ranking, made.docs, made.schema, ["p_brand"], 3).select("g0", F.col("_iid").alias("p_partkey"))


@query(
    "group_2_max",
    f"""WITH {PART_SQL}, k AS (SELECT iid, p_brand, cheap, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, iid DESC) AS a,
    row_number() OVER (PARTITION BY cheap ORDER BY p_retailprice DESC NULLS LAST, iid DESC) AS b FROM part_docs)
    SELECT p_brand AS g0, cheap AS g1, iid AS p_partkey FROM k WHERE a <= 40 AND b <= 40 AND p_brand IS NOT NULL AND cheap IS NOT NULL""",
)
def group_2_max(spark, sf_dir):
    made = parts(spark, sf_dir)
    found = search(made, {"sortBy": {"property": "p_retailprice", "order": "DESC"}})
    return rank.grouped_rows(found.ranking, made.docs, made.schema, ["p_brand", "cheap"], 40).select("g0", "g1", F.col("_iid").alias("p_partkey"))


@query("group_reduce",
    f"WITH {PART_SCORED} SELECT p_brand AS g0, count(*) AS n, round(sum(score), 6) AS total FROM r JOIN part_docs USING (iid) WHERE p_brand IS "
    f"NOT NULL GROUP BY p_brand")
def group_reduce(spark, sf_dir):
    def total(rows):
        return F.struct(F.size(rows).cast("long").alias("n"), F.round(F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["score"]), 6).alias("total"))

    found = search(parts(spark, sf_dir), {"term": "st", "properties": ["p_name", "p_type"], "boost": {"p_name": 2.5}, "groupBy": {"properties": ["p_brand"], "reduce": total}})
    return found.groups.select(F.col("values")[0].alias("g0"), "result.n", "result.total")


# ---- vectors ----

COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[]))"


@query("vector_topk",
    f"SELECT vec_id, row_number() OVER (ORDER BY c DESC, vec_id) AS place FROM (SELECT vec_id, {COSINE} AS c FROM embeddings) WHERE c >= 0.1 "
    f"ORDER BY c DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    found = search(vectors(spark, sf_dir), {"mode": "vector", "vector": {"value": query_vector(spark, sf_dir), "property": "embedding"}, "similarity": 0.1})
    return page(found, "vec_id")


@query("vector_where", f"SELECT vec_id, round({COSINE}, 6) AS score FROM embeddings WHERE label BETWEEN 0 AND 3 AND {COSINE} >= 0.1")
def vector_where(spark, sf_dir):
    params = {"mode": "vector", "vector": {"value": query_vector(spark, sf_dir), "property": "embedding"}, "similarity": 0.1, "where": {"label": {"between": [0, 3]}}}
    return ranked(search(vectors(spark, sf_dir), params), "vec_id")


HYBRID = scored_sql("(SELECT e.vec_id, e.embedding, d.text FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)", "vec_id", {"text": 1}, DOC_TOKENS) + f""",
v AS (SELECT vec_id AS iid, {COSINE} AS score FROM embeddings WHERE {COSINE} >= 0.1),
t2 AS (SELECT iid, score / max(score) OVER () AS t FROM r), v2 AS (SELECT iid, score / max(score) OVER () AS v FROM v)"""


def hybrid_query(name: str, weights: dict | None, a: float, b: float) -> None:
    @query(name,
        f"WITH {HYBRID} SELECT coalesce(t2.iid, v2.iid) AS vec_id, round({a} * coalesce(t, 0) + {b} * coalesce(v, 0), 6) AS score FROM t2 FULL OUTER "
        f"JOIN v2 ON t2.iid = v2.iid")
    def run(spark, sf_dir):
        params = {"mode": "hybrid", "term": DOC_TERM, "vector": {"value": query_vector(spark, sf_dir), "property": "embedding"}, "similarity": 0.1}
        return ranked(search(vectors(spark, sf_dir), params | ({"hybridWeights": weights} if weights else {})), "vec_id")


hybrid_query("hybrid_default", None, 0.5, 0.5)
hybrid_query("hybrid_weights", {"text": 0.8, "vector": 0.2}, 0.8, 0.2)


# ---- places ----

CENTRE = {"lon": 9.19, "lat": 45.46}
HAVERSINE = "2 * 6371000 * atan2(sqrt({a}), sqrt(1 - {a}))".format(a=
    "(pow(sin((radians(lat) - radians(45.46)) / 2), 2) + cos(radians(45.46)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(9.19)) / 2), "
    "2))")
POLYGON = [{"lon": -20.0, "lat": -10.0}, {"lon": 60.5, "lat": -30.25}, {"lon": 90.0, "lat": 40.0}, {"lon": 20.0, "lat": 12.5}, {"lon": -30.0, "lat": 55.0}]


def polygon_sql() -> str:
    out = []
    for a, b in zip(POLYGON, [POLYGON[-1], *POLYGON[:-1]], strict=True):
        slope = (b["lon"] - a["lon"]) / (b["lat"] - a["lat"])
        out.append(f"(CASE WHEN ({a['lat']} > lat) <> ({b['lat']} > lat) AND lon < CAST({slope!r} AS DOUBLE) * (lat - {a['lat']}) + {a['lon']} THEN 1 ELSE 0 END)")
    return "(" + " + ".join(out) + ") % 2 = 1"


def geo_query(name: str, condition: dict, sql: str) -> None:
    where_query(name, places, "c_custkey", {"place": condition}, f"WITH {PLACES_SQL} SELECT iid AS c_custkey FROM places WHERE {sql}")


geo_query("geo_radius_in", {"radius": {"coordinates": CENTRE, "value": 4000, "unit": "km"}}, f"{HAVERSINE} <= 4000000")
geo_query("geo_radius_out", {"radius": {"coordinates": CENTRE, "value": 4000, "unit": "mi", "inside": False}}, f"{HAVERSINE} > 4000 * 1609.344")
geo_query("geo_polygon", {"polygon": {"coordinates": POLYGON}}, polygon_sql())
geo_query("geo_polygon_out", {"polygon": {"coordinates": POLYGON, "inside": False}}, f"NOT ({polygon_sql()})")


@query("geo_score",
    f"WITH {PLACES_SQL}, d AS (SELECT iid, {HAVERSINE} AS d FROM places WHERE {HAVERSINE} <= 4000000) SELECT iid AS c_custkey, round(max(d) OVER "
    f"() - d + 1, 3) AS score FROM d")
def geo_score(spark, sf_dir):
    found = search(places(spark, sf_dir), {"where": {"place": {"radius": {"coordinates": CENTRE, "value": 4000, "unit": "km"}}}})
    return found.ranking.rows.select(F.col("_iid").alias("c_custkey"), F.round("score", 3).alias("score"))


# ---- pins ----


def pin_query(name: str, promote: tuple[tuple[str, int], ...], pins: list[tuple[int, int]]) -> None:
    """pins: the key and position of each pin that holds, by position."""
    slot = "rn"
    for _, position in pins:
        slot = f"(CASE WHEN {slot} >= {position} THEN {slot} + 1 ELSE {slot} END)"
    ids = ", ".join(str(k) for k, _ in pins)
    pinned = " UNION ALL ".join(f"SELECT {k} AS iid, {p} AS slot" for k, p in pins)
    sql = f"""WITH {PART_SCORED}, o AS (SELECT iid, row_number() OVER (ORDER BY round(score, 9) DESC, iid) - 1 AS rn FROM r WHERE iid NOT IN ({ids})),
    a AS (SELECT iid, {slot} AS slot FROM o UNION ALL {pinned}) SELECT iid AS p_partkey, row_number() OVER (ORDER BY slot) AS place FROM a ORDER BY slot LIMIT 12"""

    @query(name, sql)
    def run(spark, sf_dir):
        made = parts(spark, sf_dir)
        made.insert_pin(PinRule("rule", (("contains", "st"),), promote))
        return page(search(made, {"term": "st", "properties": ["p_name", "p_type"], "boost": {"p_name": 2.5}, "limit": 12}), "p_partkey")


pin_query("pin_inside", (("7", 0), ("11", 3)), [(7, 0), (11, 3)])
pin_query("pin_conflict", (("7", 2), ("11", 2), ("7", 5), ("13", 6)), [(7, 2), (13, 6)])
pin_query("pin_outside", (("no such part", 1), ("5", 4)), [(5, 4)])


# ---- changes ----


@query("upsert_merge",
    "SELECT doc_id, CAST(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE n_chars END AS DOUBLE) AS n_chars FROM documents UNION ALL SELECT doc_id + "
    "1000000, CAST(2 AS DOUBLE) FROM documents WHERE doc_id % 100 = 0")
def upsert_merge(spark, sf_dir):
    made, frame = documents(spark, sf_dir), table(spark, sf_dir, "documents")
    changed = frame.where("doc_id % 10 = 0").withColumn("n_chars", F.lit(1))
    new = frame.where("doc_id % 100 = 0").withColumn("doc_id", F.col("doc_id") + 1000000).withColumn("n_chars", F.lit(2))
    made.upsert_dataframe(changed.unionByName(new), "doc_id", "doc_id", unique=True)
    return made.docs.select(F.col("_iid").alias("doc_id"), "n_chars")


@query("remove_stats", f"WITH {scored_sql('(SELECT * FROM documents WHERE doc_id % 3 <> 0)', 'doc_id', {'text': 1}, DOC_TOKENS)} {RANKED_DOC}")
def remove_stats(spark, sf_dir):
    made = documents(spark, sf_dir)
    made.remove_dataframe(made.docs.where("_iid % 3 = 0").select("id"))
    return ranked(search(made, {"term": DOC_TERM}), "doc_id")


@query("full_scan", "SELECT doc_id, CAST(0 AS DOUBLE) AS score FROM documents")
def full_scan(spark, sf_dir):
    return ranked(search(documents(spark, sf_dir), {}), "doc_id")


# ---- other scorers ----

PT15_SQL = f"""WITH d AS (SELECT doc_id AS iid, text FROM documents WHERE text IS NOT NULL),
w AS (SELECT iid, string_split_regex(lower(text), {quote(SPLITTERS["english"])}) AS ws FROM d),
f AS (SELECT iid, generate_subscripts(ws, 1) AS pos, translate(unnest(ws), {quote(FOLD_FROM)}, {quote(FOLD_TO)}) AS token FROM w),
u AS (SELECT iid, token, min(pos) AS pos FROM f WHERE token <> '' GROUP BY iid, token),
n AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY iid) AS n FROM u),
q AS (SELECT unnest(['the', 'wh']) AS q)
SELECT iid AS doc_id, CAST(sum(14 - CASE WHEN n < 15 THEN i ELSE CAST(floor(i * 15 / n) AS BIGINT) END) AS DOUBLE) AS score FROM n JOIN q ON starts_with(token, q.q) GROUP BY iid"""


@query("pt15_score", PT15_SQL)
def pt15_score(spark, sf_dir):
    return ranked(search(documents(spark, sf_dir, scorer="pt15"), {"term": DOC_TERM}), "doc_id")


QPS_SQL = f"""WITH d AS (SELECT doc_id AS iid, string_split_regex(text, '[.?!]') AS ss FROM documents WHERE text IS NOT NULL),
s AS (SELECT iid, generate_subscripts(ss, 1) AS k, {tokens_sql("unnest(ss)")} AS toks FROM d),
s1 AS (SELECT iid, k, toks, len(toks) AS n FROM s),
b AS (SELECT iid, toks, n, least(coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY iid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 19) AS bit,
    sum(n) OVER (PARTITION BY iid) AS total FROM s1),
t AS (SELECT iid, total, bit, unnest(toks) AS token FROM b),
g AS (SELECT iid, token, count(*) AS occ, max(total) AS total, bit_or(CAST(pow(2, bit) AS BIGINT)) AS mask FROM t GROUP BY iid, token)
SELECT iid AS doc_id, round(sum(occ * occ / total + CASE WHEN token IN ('the', 'wh') THEN 1 ELSE 0 END) + 2 * (sum(bit_count(mask)) - bit_count(bit_or(mask))), 6) AS score
FROM g WHERE starts_with(token, 'the') OR starts_with(token, 'wh') GROUP BY iid"""


@query("qps_score", QPS_SQL)
def qps_score(spark, sf_dir):
    return ranked(search(documents(spark, sf_dir, scorer="qps"), {"term": DOC_TERM}), "doc_id")


@query("bm25_stemmed")
def bm25_stemmed(spark, sf_dir):
    return ranked(search(documents(spark, sf_dir, analyzer=Analyzer.create("english", stemming=True)), {"term": "anding hewhing"}), "doc_id")


# ---- pages, highlights, chats ----


@query("html_records")
def html_records(spark, sf_dir):
    found = html.html_records(table(spark, sf_dir, "pages"), "page_id", "html")
    return found.select("page_id", "n", "type", "content", "path")


@query("html_sections")
def html_sections(spark, sf_dir):
    return html.html_sections(table(spark, sf_dir, "pages"), "page_id", "html")


@query("html_fields")
def html_fields(spark, sf_dir):
    return html.html_fields(table(spark, sf_dir, "pages"), "page_id", "html")


@query("highlight_positions", f"""WITH d AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS ws FROM part), w AS (SELECT p_partkey, ws, generate_subscripts(ws, 1) AS i FROM d)
SELECT p_partkey, lower(ws[i]) AS token, CAST(coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: len(x) + 1)), 0) AS INTEGER) AS start, CAST(len(ws[i]) AS INTEGER) AS length FROM w""")
def highlight_positions(spark, sf_dir):
    made = parts(spark, sf_dir)
    rows = highlight.positions(made).where("prop = 'p_name'")
    return rows.select(F.col("_iid").alias("p_partkey"), "token", "start", "length")


@query(
    "rag_retrieve",
    f"""WITH qs AS (SELECT conv_id, turn, unnest({tokens_sql("text")}) AS token FROM conversations WHERE role = 'user'),
ds AS (SELECT doc_id, unnest({tokens_sql("text")}) AS token FROM documents WHERE text IS NOT NULL),
c AS (SELECT conv_id, turn, doc_id, count(*) AS shared FROM qs JOIN ds USING (token) GROUP BY conv_id, turn, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY shared DESC, doc_id) AS rn FROM c)
SELECT conv_id, turn, CAST(rn AS INTEGER) AS rank, CAST(doc_id AS VARCHAR) AS id, shared FROM k WHERE rn <= 3""",
)
def rag_retrieve(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return answers.retrieve(documents(spark, sf_dir), asked, ["conv_id", "turn"], "text", "text", 3)


# ---- streams ----


@query("event_windows",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, "
    "2")
def event_windows(spark, sf_dir):
    found = maintenance.event_windows(table(spark, sf_dir, "events"))
    return found.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def streamed(spark: SparkSession, frame: DataFrame, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files; the pattern lets a table be one file or a folder."""
    pattern = f"{name}.parquet*"
    return spark.readStream.schema(frame.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{pattern}")


def drained(running: DataFrame, label: str) -> DataFrame:
    """The last state of a running table, when its stream has been read to its end: each batch writes it anew to the
    shared folder, so the driver holds no rows."""
    spark = running.sparkSession
    path = shared_folder(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state")

    running.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(running.schema).parquet(f"{path}/state")


@query("stream_event_windows", ORACLES["event_windows"])
def stream_event_windows(spark, sf_dir):
    """The stream read to its end; its running table is the batch result."""
    source = streamed(spark, table(spark, sf_dir, "events"), sf_dir, "events")
    found = drained(maintenance.event_windows(source), "windows")
    return found.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_incremental_df", f"WITH x AS (SELECT unnest({tokens_sql('p_name')}) AS token FROM part) SELECT token, count(*) AS df FROM x GROUP BY token")
def stream_incremental_df(spark, sf_dir):
    made = parts(spark, sf_dir)
    source = streamed(spark, table(spark, sf_dir, "part"), sf_dir, "part").withColumn("op", F.lit(1))
    return drained(maintenance.stream_frequencies(source, made.schema, made.analyzer, "p_name"), "frequencies").select("token", "df")
