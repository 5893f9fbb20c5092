"""Merging of score lists, sets, flat documents, places, stored indexes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.collection import Collection
from tessera.errors import EngineError
from tessera.functions import documents, geo, sets
from tessera.operators.score import merge_scores
from tessera.schema import Schema, conform_columns
from tessera.search import search


def plain_merge(lists, boost, threshold, keywords):
    found: dict = {}
    for part in lists:
        for i, s in part:
            old = found.get(i)
            found[i] = (old[0] * 1.5 + s * boost, old[1] + 1) if old else (s * boost, 1)
    rows = sorted(((n, s, -i) for i, (s, n) in found.items()), reverse=True)
    if threshold == 1 or (threshold == 0 and keywords == 1):
        return {-i: s for _, s, i in rows}
    full = 0
    while full < len(rows) and rows[full][0] == keywords:
        full += 1
    if threshold == 0:
        return {-i: s for _, s, i in rows[:full]}
    last = max(full - 1, 0)
    return {-i: s for _, s, i in rows[: min(len(rows), last + math.ceil(threshold * (len(rows) - last)))]}


@pytest.mark.parametrize(("threshold", "keywords"), [(1, 2), (0, 1), (0, 2), (0.5, 2), (0.3, 5)])
def test_merge(spark, threshold, keywords):
    rnd = random.Random(4)
    lists = [[(i, float(rnd.randint(1, 9))) for i in rnd.sample(range(12), 7)] for _ in range(2)]
    frames = [spark.createDataFrame(part, "_iid long, score double") for part in lists]
    found = {r["_iid"]: r.score for r in merge_scores(frames, 2.0, threshold, keywords).collect()}
    assert found == plain_merge(lists, 2.0, threshold, keywords)
    with pytest.raises(EngineError):
        merge_scores(frames, 0)


def test_sets(spark):
    a, b, c = (spark.createDataFrame([(i,) for i in x], "_iid long") for x in ([1, 2, 3, 3], [2, 3, 4], [3, 5]))
    ids = lambda f: sorted(r["_iid"] for r in f.collect())
    assert ids(sets.intersection([a, b, c])) == [3] and ids(sets.union([a, c])) == [1, 2, 3, 5] and ids(sets.difference(a, b)) == [1]
    one = spark.range(1).select(sets.array_intersection([F.array(F.lit(3), F.lit(1)), F.array(F.lit(1), F.lit(3)), F.array(F.lit(3))])).first()[0]
    assert one == [3]


def test_flat_documents(spark):
    doc = {"a": {"b": 1, "p": {"lat": 1.0, "lon": 2.0}}, "c": [1], "d": None}
    assert documents.flatten(doc)["a.b"] == 1
    assert documents.properties(doc, ["a.b", "a.p", "a", "c", "c.x", "d", "z.y"]) == {"a.b": 1, "a.p": {"lat": 1.0, "lon": 2.0}, "c": [1]}
    frame = spark.createDataFrame([(1, ((2.0, 3.0), "x"))], "n int, s struct<p:struct<lon:double,lat:double>,t:string>")
    assert frame.select(*documents.flat_columns(frame)).columns == ["n", "s.p", "s.t"]


def test_numbers_as_enums(spark):
    frame = spark.createDataFrame([(1, [1.5, 2.0])], "e int, es array<double>")
    schema = Schema.of({"e": "enum", "es": "enum[]"})
    assert frame.select(*conform_columns(frame, schema)).first() == ("#1", ["#1.5", "#2"])


def test_places():
    import numpy as np

    origin = {"lon": 0.0, "lat": 0.0}
    assert geo.vincenty_metres(np.array([0.0, 1.0, np.nan]), np.array([0.0, 0.0, 0.0]), origin)[:2] == pytest.approx([0.0, 111319.49], abs=0.01)
    square = [{"lon": x, "lat": y} for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))]
    assert geo.centroid(square) == {"lon": 1.0, "lat": 1.0}
    assert geo.metres(2, "mi") == pytest.approx(3218.688)


@pytest.mark.parametrize("way", ["cached", "written"])
def test_stored_index_gives_the_same(spark, sf, tmp_path, way):
    frame = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    make = lambda: Collection.from_dataframe(spark, {"text": "string", "n_chars": "number"}, frame, "doc_id", "doc_id")
    plain, stored = make(), make()
    stored = stored.cache_index() if way == "cached" else stored.checkpoint(str(tmp_path / "c"))
    for params in ({"term": "the wh"}, {"term": "thand", "tolerance": 1}, {"term": "than with", "threshold": 0, "where": {"n_chars": {"gt": 500}}}):
        rows = [sorted((r["_iid"], round(r.score, 9)) for r in search(db, params).ranking.rows.collect()) for db in (plain, stored)]
        assert rows[0] == rows[1]


@pytest.mark.parametrize("scorer", ["qps", "pt15"])
def test_kept_tokens_give_the_same(spark, sf, scorer):
    frame = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    make = lambda: Collection.from_dataframe(spark, {"text": "string", "n_chars": "number"}, frame, "doc_id", "doc_id", scorer=scorer)
    for params in ({"term": "the wh"}, {"term": "the", "where": {"n_chars": {"gt": 500}}}):
        rows = [sorted((r["_iid"], round(r.score, 9)) for r in search(db, params).ranking.rows.collect()) for db in (make(), make().cache_index())]
        assert rows[0] == rows[1]


def test_pushdown(spark, sf, tmp_path):
    """A prefix search over a written index reads only its property's folder and pushes the prefix to the files."""
    frame = spark.read.parquet(f"{sf}/part.parquet")
    db = Collection.from_dataframe(spark, {"p_name": "string", "p_type": "string"}, frame, "p_partkey", "p_partkey").checkpoint(str(tmp_path / "i"))
    plan = db.index.postings(["p_name"], F.col("token").startswith("st"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,st)" in plan and "PartitionFilters" in plan and "prop" in plan


def test_filters_reach_the_scan(spark, sf):
    frame = spark.read.parquet(f"{sf}/orders.parquet").withColumnsRenamed({"o_totalprice": "price", "o_orderstatus": "status"})
    db = Collection.from_dataframe(spark, {"price": "number", "status": "enum"}, frame, "o_orderkey", "o_orderkey")
    found = search(db, {"where": {"and": [{"price": {"gt": 1000}}, {"status": {"in": ["F", "O"]}}]}}).ranking.rows
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "In(o_orderstatus" in plan
    assert "o_orderpriority" not in plan
    scored = search(db, {"where": {"not": {"price": {"gt": 1000}}}})
    assert scored.count == frame.where("price <= 1000").count()


def test_stored_search_scans_postings_once(spark, sf, tmp_path):
    """A page on a stored index reads the postings once; document frequencies come from the dictionary."""
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    db = Collection.from_dataframe(spark, {"text": "string"}, frame, "doc_id", "doc_id").checkpoint(str(tmp_path / "one"))
    plan = search(db, {"term": "the wh"}).page_frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # the postings and the dictionary
    assert "analysed" not in plan and "Generate" in plan


def test_ids_of_frames(spark):
    """Internal ids go on after those of a frame, and repeated ids raise."""
    frame = spark.createDataFrame([(i, f"zebra {i}") for i in range(5, 9)], "k long, t string")
    db = Collection.from_dataframe(spark, {"t": "string"}, frame, "k", "k")
    db.insert({"id": "new", "t": "unicorn"})
    assert [(r["_iid"], r.id) for r in db.docs.where("t = 'unicorn'").collect()] == [(9, "new")]
    assert [h["id"] for h in search(db, {"term": "unicorn"}).collect()["hits"]] == ["new"]
    for bad in (frame.union(frame), frame.withColumn("k", F.lit(1).cast("long")), frame.withColumn("k", F.lit(None).cast("long"))):
        with pytest.raises(EngineError) as e:
            Collection.from_dataframe(spark, {"t": "string"}, bad, "k", "k")
        assert e.value.code == "DOCUMENT_ALREADY_EXISTS"
    with pytest.raises(EngineError):
        db.insert_dataframe(frame, "k", "k")
    with pytest.raises(EngineError):
        db.upsert_dataframe(frame.union(frame), "k", "k")


def test_small_inserts_wait_in_memory(spark, monkeypatch):
    """Many small inserts make one branch of the plan, not one each."""
    from tessera import collection

    monkeypatch.setattr(collection, "PENDING", 15)
    db = Collection(spark, {"t": "string"})
    for i in range(40):
        db.insert({"id": str(i), "t": f"text {i}"})
    plan = db.docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 4
    assert db.count() == 40 and db.get_by_id("39")["t"] == "text 39"
    with pytest.raises(EngineError):
        db.insert({"id": "39", "t": "again"})
    with pytest.raises(EngineError):
        db.insert({"id": "1", "t": "again"})
    assert db.remove("39") and db.count() == 39
