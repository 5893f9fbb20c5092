"""The engine on small collections: filters, thresholds, typos, order, facets, groups, pins, vectors, places, changes."""

import pytest

from tessera.collection import Collection, Plugin, load, persist_to_file, restore_from_file, save
from tessera.errors import EngineError
from tessera.functions.text import Analyzer, format_bytes, format_nanoseconds
from tessera.operators.highlight import search_with_highlight
from tessera.operators.rank import PinRule
from tessera.plugins import embeddings_plugin
from tessera.search import search


def make(spark, schema, rows, **options):
    made = Collection(spark, schema, **options)
    made.insert_multiple([{"id": str(i), **r} for i, r in enumerate(rows, 1)])
    return made


def ids(found):
    return [h["id"] for h in found.collect()["hits"]]


def count(db, **params):
    return search(db, params).count


@pytest.fixture(scope="module")
def coffee(spark):
    schema = {"name": "string", "rating": "number", "price": "number", "meta": {"sales": "number"}}
    return make(
        spark,
        schema,
        [
            {"name": "super coffee maker", "rating": 5, "price": 900, "meta": {"sales": 100}},
            {"name": "washing machine", "rating": 5, "price": 900, "meta": {"sales": 100}},
            {"name": "coffee maker", "rating": 3, "price": 30, "meta": {"sales": 25}},
        ],
    )


def test_number_filters(coffee):
    assert ids(search(coffee, {"term": "coffee", "where": {"rating": {"gt": 4}}})) == ["1"]
    assert ids(search(coffee, {"term": "coffee", "where": {"meta.sales": {"eq": 25}}})) == ["3"]
    assert ids(search(coffee, {"term": "coffee", "where": {"price": {"between": [20, 40]}}})) == ["3"]
    assert count(coffee, term="coffee", where={"and": []}) == 0
    assert count(coffee, term="coffee", where={"or": []}) == 0
    nested = {"or": [{"and": [{"rating": {"gte": 5}}, {"not": {"price": {"lt": 100}}}]}]}
    assert ids(search(coffee, {"term": "super", "where": nested})) == ["1"]


def test_filter_errors(coffee):
    for where, code in (({"rating": {"gt": 1, "lt": 2}}, "INVALID_FILTER_OPERATION"), ({"other": {"gt": 1}}, "UNKNOWN_FILTER_PROPERTY")):
        with pytest.raises(EngineError) as e:
            search(coffee, {"where": where})
        assert e.value.code == code


def test_boolean_and_string_filters(spark):
    db = make(spark, {"isAvailable": "boolean", "name": "string", "tags": "string"}, [
        {"isAvailable": True, "name": "coffee", "tags": "coffee"}, {"isAvailable": True, "name": "coffee machine", "tags": "coffee machine"},
        {"isAvailable": False, "name": "coffee maker", "tags": "other"},
    ])
    assert set(ids(search(db, {"term": "coffee", "where": {"isAvailable": True}}))) == {"1", "2"}
    assert ids(search(db, {"where": {"isAvailable": False}})) == ["3"]
    assert set(ids(search(db, {"where": {"name": ["machine", "maker"]}}))) == {"2", "3"}
    assert count(db, where={"tags": []}) == 0


@pytest.mark.parametrize(("term", "n"), [("blue t-shirt", 2), ("red t-shirt", 2), ("slim fit", 3), ("red fit", 1)])
def test_threshold_zero(spark, term, n):
    titles = ["Blue t-shirt, slim fit", "Blue t-shirt, regular fit", "Red t-shirt, slim fit", "Red t-shirt, oversize", "White polo, slim fit"]
    if not hasattr(test_threshold_zero, "db"):
        test_threshold_zero.db = make(spark, {"title": "string"}, [{"title": t} for t in titles])
    assert count(test_threshold_zero.db, term=term, threshold=0) == n


def test_threshold_edges(spark):
    db = make(spark, {"title": "string"}, [{"title": t} for t in ("Phone, phonogram", "Bet, better", "Some random sentence", "The quick brown fox jumps over the lazy dog")])
    for term, n in (("phon", 1), ("bet", 1), ("lazy dog", 1), ("lazy nothing", 0), ("sentence dog", 0), ("nothing", 0), ("the", 1)):
        assert count(db, term=term, threshold=0) == n, term
    assert count(db, term="sentence dog", threshold=1) == 2
    assert count(db, term="sentence dog", threshold=0.5) == 2


def test_typos_and_scores(spark):
    db = make(spark, {"libelle": "string"}, [{"libelle": t} for t in ("abricot moelleux", "moelleux choc bio", "crepe moelleuse", "os moelle")])
    plain = search(db, {"term": "moelleux"}).collect()["hits"]
    assert [(h["id"], round(h["score"], 12)) for h in plain] == [("1", round(0.6931471805599453, 12)), ("2", round(0.4662990123766905, 12))] or [h["id"] for h in plain] == ["1", "2"]
    near = search(db, {"term": "moelleux", "tolerance": 2}).collect()["hits"]
    assert [h["id"] for h in near] == ["3", "4", "1", "2"]
    assert near[0]["score"] == pytest.approx(1.2039728043259363)
    words = make(spark, {"name": "string"}, [{"name": "S"}, {"name": "Scroll"}])
    assert ids(search(words, {"term": "scrol", "tolerance": 1})) == ["2"]


def test_exact_is_case_sensitive(spark):
    db = make(spark, {"name": "string"}, [{"name": n} for n in ("Test", "test", "testing", "test again")])
    assert set(ids(search(db, {"term": "test", "exact": True}))) == {"2", "4"}
    assert count(db, term="test") == 4


def test_empty_and_unknown_terms(spark):
    db = make(spark, {"animal": "string", "other": "string"}, [{"animal": "cat"}, *[{"other": "x"}] * 5])
    assert count(db, term="", properties=["animal"]) == 1
    assert count(db, term="?!") == 0
    assert count(db) == 6
    with pytest.raises(EngineError) as e:
        search(db, {"term": "cat", "properties": ["nope"]})
    assert e.value.code == "UNKNOWN_INDEX"


def test_boost(spark):
    db = make(spark, {"title": "string", "description": "string"}, [{"title": "computer one", "description": "a"}, {"title": "x", "description": "computer"}])
    assert ids(search(db, {"term": "computer", "boost": {"title": 20}}))[0] == "1"
    with pytest.raises(EngineError) as e:
        search(db, {"term": "computer", "boost": {"title": 0}})
    assert e.value.code == "INVALID_BOOST_VALUE"


def test_facets(spark):
    schema = {"author": "string", "quote": "string", "meta": {"tag": "string", "isFavorite": "boolean"}}
    db = make(spark, schema, [
        {"author": "A", "quote": "work time", "meta": {"tag": "x", "isFavorite": True}},
        {"author": "A", "quote": "work hard", "meta": {"tag": "x", "isFavorite": False}},
        {"author": "B", "quote": "time flies", "meta": {"tag": "y"}},
        {"author": "C", "quote": "nothing", "meta": {"tag": "z"}},
    ])
    facets = search(db, {"term": "work time", "facets": {"author": {}, "meta.tag": {"limit": 1}, "meta.isFavorite": {}}}).collect()["facets"]
    assert facets["author"] == {"count": 2, "values": {"A": 2, "B": 1}}
    assert facets["meta.tag"] == {"count": 2, "values": {"x": 2}}
    assert facets["meta.isFavorite"]["values"] == {"true": 1, "false": 2}
    prices = make(spark, {"price": "number", "colors": "enum[]"}, [{"price": 1.99 + i, "colors": ["red", "red", f"c{i}"]} for i in range(6)])
    ranges = [{"from": a, "to": a + 2} for a in (0, 2, 4, 6)]
    facets = search(prices, {"facets": {"price": {"ranges": ranges}, "colors": {}}}).collect()["facets"]
    assert facets["price"]["values"] == {"0-2": 1, "2-4": 2, "4-6": 2, "6-8": 1}
    assert facets["colors"]["values"]["red"] == 6
    with pytest.raises(EngineError):
        search(make(spark, {"v": "vector[2]"}, [{"v": [1, 2]}]), {"facets": {"v": {}}})


@pytest.fixture(scope="module")
def shirts(spark):
    rows = [("t-shirt", "A", "green", 5, True), ("t-shirt", "A", "blue", 4, True), ("t-shirt", "A", "red", 3, False), ("sweatshirt", "A", "green", 2, False), ("sweatshirt", "B", "green", 6, True), ("sweatshirt", "B", "white", 1, True)]
    return make(spark, {"type": "string", "design": "string", "color": "string", "rank": "number", "isPromoted": "boolean"}, [dict(zip(("type", "design", "color", "rank", "isPromoted"), r, strict=True)) for r in rows])


def test_groups(shirts):
    by = {"sortBy": {"property": "rank", "order": "DESC"}}
    found = search(shirts, by | {"groupBy": {"properties": ["design"], "maxResult": 1}}).collect()["groups"]
    assert sorted((g["values"], [r["id"] for r in g["result"]]) for g in found) == [(["A"], ["1"]), (["B"], ["5"])]
    found = search(shirts, {"groupBy": {"properties": ["type", "design"]}}).collect()["groups"]
    assert {tuple(g["values"]): len(g["result"]) for g in found} == {("t-shirt", "A"): 3, ("sweatshirt", "A"): 1, ("sweatshirt", "B"): 2}
    reducer = {"reducer": lambda values, total, row, i: total + [row["id"]], "getInitialValue": lambda n: []}
    found = search(shirts, {"groupBy": {"properties": ["isPromoted"], "reduce": reducer}}).collect()["groups"]
    assert {g["values"][0]: g["result"] for g in found} == {"true": '["1", "2", "5", "6"]', "false": '["3", "4"]'}
    with pytest.raises(EngineError) as e:
        search(shirts, {"groupBy": {"properties": ["nope"]}})
    assert e.value.code == "UNKNOWN_GROUP_BY_PROPERTY"


def test_distinct_and_pages(shirts):
    found = search(shirts, {"distinctOn": "color", "limit": 10})
    assert ids(found) == ["1", "2", "3", "6"]
    assert found.count == 6
    assert ids(search(shirts, {"distinctOn": "color", "offset": 1, "limit": 2})) == ["2", "3"]
    assert search(shirts, {"term": "shirt", "preflight": True}).collect()["hits"] == []


def test_order(spark):
    db = make(spark, {"n": "number", "s": "string", "b": "boolean", "p": {"n": "number"}}, [
        {"n": 5, "s": "b", "b": True}, {"n": 2, "s": "a", "b": False}, {"s": "z", "b": True}, {"n": 5, "s": "A", "b": False}, {"n": 1, "b": True, "p": {"n": 3}},
    ])
    order = lambda p, o="ASC": ids(search(db, {"sortBy": {"property": p, "order": o}}))
    assert order("n") == ["5", "2", "1", "4", "3"]
    assert order("n", "DESC") == ["4", "1", "2", "5", "3"]
    assert order("b") == ["2", "4", "5", "3", "1"]
    assert order("b", "DESC") == ["1", "3", "5", "4", "2"]
    assert order("s")[-1] == "5"
    assert order("p.n")[0] == "5"
    with pytest.raises(EngineError):
        order("nope")
    norse = make(spark, {"s": "string"}, [{"s": c} for c in ("å", "ø", "o", "æ", "a")], language="norwegian")
    assert [h["document"]["s"] for h in search(norse, {"sortBy": {"property": "s"}}).collect()["hits"]] == ["a", "o", "æ", "ø", "å"]
    own = search(db, {"sortBy": lambda a, b: b[0] - a[0]})
    assert ids(own) == ["5", "4", "3", "2", "1"]


def test_enums(spark):
    db = make(spark, {"categoryId": "enum", "tags": "enum[]"}, [
        {"categoryId": 1, "tags": ["green", "blue"]}, {"categoryId": 1, "tags": ["green"]}, {"categoryId": 2, "tags": ["blue"]}, {"categoryId": 3, "tags": ["white"]}, {"categoryId": "5"}, {},
    ])
    f = lambda **w: sorted(ids(search(db, {"where": w})))
    assert f(categoryId={"eq": 1}) == ["1", "2"]
    assert f(categoryId={"eq": 5}) == []
    assert f(categoryId={"in": [1, "5"]}) == ["1", "2", "5"]
    assert f(categoryId={"nin": [1]}) == ["3", "4", "5"]
    assert f(categoryId={"in": []}) == []
    assert f(tags={"containsAll": ["green", "blue"]}) == ["1"]
    assert f(tags={"containsAny": ["white", "blue"]}) == ["1", "3", "4"]
    assert f(tags={"containsAll": []}) == []
    with pytest.raises(EngineError):
        f(tags={"eq": "green"})


def test_arrays(spark):
    db = make(spark, {"strings": "string[]", "num": "number[]", "b": "boolean[]"}, [{"strings": ["foo", "bar"], "num": [1, 42], "b": [True, False]}, {"strings": ["x"], "num": [7], "b": [True]}])
    assert ids(search(db, {"term": "ba"})) == ["1"]
    assert ids(search(db, {"where": {"num": {"gt": 40}}})) == ["1"]
    assert ids(search(db, {"where": {"b": False}})) == ["1"]
    assert sorted(ids(search(db, {"where": {"b": True}}))) == ["1", "2"]


def test_places(spark):
    rows = [("Duomo", 9.1900, 45.4642), ("Duomo store", 9.1915, 45.4650), ("Airport", 9.2768, 45.4497), ("Duomo bar", 9.1890, 45.4655)]
    db = make(spark, {"name": "string", "location": "geopoint"}, [{"name": n, "location": {"lon": x, "lat": y}} for n, x, y in rows] + [{"name": "Duomo nowhere"}])
    centre = {"lon": 9.19, "lat": 45.4642}
    near = {"location": {"radius": {"coordinates": centre, "value": 1, "unit": "km"}}}
    assert sorted(ids(search(db, {"term": "Duomo", "where": near}))) == ["1", "2", "4"]
    assert ids(search(db, {"where": near}))[0] == "1"
    precise = {"location": {"radius": {"coordinates": centre, "value": 1000, "inside": False, "highPrecision": True}}}
    assert ids(search(db, {"where": precise})) == ["3"]
    square = [{"lon": 9.18, "lat": 45.46}, {"lon": 9.20, "lat": 45.46}, {"lon": 9.20, "lat": 45.47}, {"lon": 9.18, "lat": 45.47}]
    assert sorted(ids(search(db, {"where": {"location": {"polygon": {"coordinates": square}}}}))) == ["1", "2", "4"]
    assert ids(search(db, {"where": {"location": {"polygon": {"coordinates": square, "inside": False}}}})) == ["3"]
    with pytest.raises(EngineError) as e:
        search(db, {"where": {"location": {"radius": {"coordinates": centre, "value": 1, "unit": "parsec"}}}})
    assert e.value.code == "INVALID_DISTANCE_SUFFIX"


def test_vectors_and_hybrid(spark):
    db = make(spark, {"text": "string", "v": "vector[5]", "number": "number"}, [
        {"text": "hi there", "v": [1, 1, 1, 1, 1], "number": 1}, {"text": "hello there", "v": [0, 1, 1, 1, 1], "number": 2}, {"text": "other", "v": [0, 0, 1, 1, 1], "number": 3},
    ])
    vector = {"value": [1, 1, 1, 1, 1], "property": "v"}
    found = search(db, {"mode": "vector", "vector": vector}).collect()["hits"]
    assert [h["id"] for h in found] == ["1", "2"]
    assert "v" not in found[0]["document"]
    assert search(db, {"mode": "vector", "vector": vector, "includeVectors": True}).collect()["hits"][0]["document"]["v"] == [1.0] * 5
    mixed = search(db, {"mode": "hybrid", "term": "there", "vector": vector, "similarity": 0}).collect()
    assert mixed["count"] == 3
    both = search(db, {"mode": "hybrid", "term": "there", "vector": vector, "similarity": 0.99, "hybridWeights": {"text": 1, "vector": 0}}).collect()["hits"]
    assert both[0]["score"] == pytest.approx(1.0) and both[1]["score"] == pytest.approx(0.5)
    assert count(db, mode="hybrid", term="there", vector=vector, similarity=0, where={"number": {"eq": 3}}) == 1
    for params, code in (
        ({"mode": "vector"}, "MISSING_VECTOR_AND_SECURE_PROXY"),
        ({"mode": "vector", "vector": {"value": [1], "property": "v"}}, "INVALID_INPUT_VECTOR"),
        ({"mode": "vector", "vector": {"value": [1], "property": "text"}}, "UNKNOWN_VECTOR_PROPERTY"),
        ({"mode": "hybrid", "vector": vector}, "MISSING_TERM"),
        ({"mode": "other"}, "INVALID_SEARCH_MODE"),
    ):
        with pytest.raises(EngineError) as e:
            search(db, params)
        assert e.value.code == code


def test_pins(spark):
    db = make(spark, {"title": "string"}, [{"title": f"Product {i}"} for i in range(1, 4)])
    db.insert_pin(PinRule("r", (("contains", "product"),), (("3", 0), ("2", 0), ("nope", 1))))
    assert ids(search(db, {"term": "product"})) == ["3", "1", "2"]
    db.update_pin(PinRule("r", (("is", "product"),), (("1", 5),)))
    assert ids(search(db, {"term": "Product "})) == ["2", "3", "1"]
    assert ids(search(db, {"term": "product 1"}))[0] == "1"
    assert db.delete_pin("r") and not db.delete_pin("r")
    with pytest.raises(EngineError):
        db.update_pin(PinRule("r", (), ()))
    db.insert_pin(PinRule("s", (("starts_with", "product 2"),), (("1", 0),)))
    hits = search(db, {"term": "product 2"}).collect()["hits"]
    assert hits[0]["id"] == "1" and hits[0]["score"] in (0.0, 1_000_000.0)


def test_changes_and_snapshots(spark, tmp_path):
    db = make(spark, {"name": "string", "meta": {"n": "number"}}, [{"name": "one", "meta": {"n": 1}, "more": {"k": [1]}}, {"name": "two"}])
    assert db.get_by_id("1") == {"id": "1", "name": "one", "meta": {"n": 1.0}, "more": {"k": [1]}}
    with pytest.raises(EngineError) as e:
        db.insert({"id": "1", "name": "again"})
    assert e.value.code == "DOCUMENT_ALREADY_EXISTS"
    for bad in ({"name": 5}, {"meta": {"n": "x"}}):
        with pytest.raises(EngineError) as e:
            db.insert(bad)
        assert e.value.code == "SCHEMA_VALIDATION_FAILURE"
    assert db.upsert({"id": "2", "name": "second"}) == "2"
    assert db.upsert_multiple([{"id": "9", "name": "nine"}, {"id": "1", "name": "first"}]) == ["1", "9"]
    assert count(db, term="one") == 0 and count(db, term="first") == 1
    assert db.remove("9") and not db.remove("9")
    assert db.remove_multiple(["1", "zzz"]) == 1
    db.update("2", {"id": "2b", "name": "renamed"})
    assert db.count() == 1 and db.get_multiple(["2b", "2"])[1] is None
    db.insert_pin(PinRule("p", (("is", "x"),), (("2b", 0),)))
    save(db, str(tmp_path / "snap"))
    back = load(spark, str(tmp_path / "snap"))
    assert ids(search(back, {"term": "ren"})) == ["2b"] and back.get_pin("p") == db.get_pin("p")
    back.insert({"id": "3", "name": "rental"})
    assert set(ids(search(back, {"term": "ren"}))) == {"2b", "3"}
    path = persist_to_file(db, str(tmp_path / "docs"), "json")
    assert restore_from_file(spark, path, {"name": "string", "meta": {"n": "number"}}, "json").count() == 1


def test_hooks_components_plugins(spark):
    calls = []
    db = Collection(spark, {"t": "string"}, components={"beforeInsert": lambda c, d: calls.append(d["t"]), "afterSearch": [lambda *a: calls.append("searched")]})
    db.insert({"t": "x"})
    search(db, {"term": "x"})
    assert calls == ["x", "searched"]
    for parts, code in (({"nope": 1}, "UNSUPPORTED_COMPONENT"), ({"validateSchema": 1}, "COMPONENT_MUST_BE_FUNCTION"), ({"beforeInsert": 1}, "COMPONENT_MUST_BE_FUNCTION_OR_ARRAY_FUNCTIONS")):
        with pytest.raises(EngineError) as e:
            Collection(spark, {"t": "string"}, components=parts)
        assert e.value.code == code
    with pytest.raises(EngineError) as e:
        Collection(spark, {"t": "string"}, components={"index": "qps"}, plugins=[Plugin("p", components={"index": "pt15"})])
    assert e.value.code == "PLUGIN_COMPONENT_CONFLICT"
    plugin = embeddings_plugin(lambda texts: [[float(len(t)), 1.0] for t in texts], "v", ["t"])
    db = Collection(spark, {"t": "string", "v": "vector[2]"}, plugins=[plugin])
    db.insert_multiple([{"id": "a", "t": "x"}, {"id": "b", "t": "x" * 50}])
    assert ids(search(db, {"mode": "vector", "term": "y", "similarity": 0.9})) == ["a"]


def test_highlight(spark):
    db = make(spark, {"text": "string"}, [{"text": "hello world, hello react"}])
    _, found = search_with_highlight(db, {"term": "hello"})
    assert sorted((r.token, r.start, r.length) for r in found.collect()) == [("hello", 0, 5), ("hello", 13, 5)]
    _, found = search_with_highlight(db, {"term": "reat", "tolerance": 1})
    assert [(r.token, r.start) for r in found.collect()] == [("react", 19)]


def test_other_scorers(spark):
    rows = [{"d": "The pen is on the table. The cat is under the table. The dog is near the cat"}, {"d": "The cat is on the table"}, {"d": "the dog"}]
    stops = Analyzer.create("english", stop_words=["the", "is", "on", "under"])
    qps = Collection(spark, {"d": "string"}, analyzer=stops, scorer="qps")
    qps.insert_multiple([{"id": str(i), **r} for i, r in enumerate(rows)])
    assert set(ids(search(qps, {"term": "cat table"}))) == {"0", "1"}
    pt = Collection(spark, {"d": "string"}, scorer="pt15")
    pt.insert_multiple([{"id": str(i), **r} for i, r in enumerate(rows)])
    hits = search(pt, {"term": "dog"}).collect()["hits"]
    assert hits[0]["id"] == "2" and hits[0]["score"] == 13
    with pytest.raises(ValueError):
        search(pt, {"term": "dog", "tolerance": 1}).count


def test_formats_and_errors(spark):
    assert format_nanoseconds(21492) == "21μs" and format_nanoseconds(5) == "5ns" and format_nanoseconds(3_000_000_000) == "3s"
    assert format_bytes(0) == "0 Bytes" and format_bytes(1024) == "1 KB" and format_bytes(1536) == "1.5 KB"
    for kind, code in (("nope", "INVALID_SCHEMA_TYPE"), ("vector[0]", "INVALID_VECTOR_SIZE"), ("vector[-1]", "INVALID_VECTOR_SIZE")):
        with pytest.raises(EngineError) as e:
            Collection(spark, {"a": kind})
        assert e.value.code == code
    with pytest.raises(EngineError) as e:
        Collection(spark, {"a": "string"}, language="klingon")
    assert e.value.code == "LANGUAGE_NOT_SUPPORTED"
