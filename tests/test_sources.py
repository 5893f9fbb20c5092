"""HTML, Markdown, nested pages, streams, the registry of queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.collection import Collection
from tessera.functions.text import Analyzer
from tessera.operators.answers import AnswerSession
from tessera import state_queries  # noqa: F401, registers more queries
from tessera.queries import ORACLES, QUERIES
from tessera.schema import Schema
from tessera.sources import html
from tessera.streaming import maintenance

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def records(spark, source, **options):
    frame = spark.createDataFrame([("f", source)], "path string, html string")
    rows = html.html_records(frame, **options).collect()
    return [(r.type, r.content, r.path, r.properties) for r in sorted(rows, key=lambda r: (r.n, r["o"] if "o" in r else 0))]


def test_html_records(spark):
    page = "<!DOCTYPE html><html><head>\n<title>Test</title></head><body><p>a</p><p>b</p></body></html>"
    assert records(spark, page)[0][:2] == ("title", "Test")
    two = "<body><p>a</p><p>b</p></body>"
    assert [r[:2] for r in records(spark, two)] == [("p", "a b")]
    assert len(records(spark, two, merge="split")) == 2
    assert len(records(spark, two, merge="both")) == 3
    assert len(records(spark, "<p>a</p><h1>x</h1><p>b</p>")) == 3
    assert len(records(spark, "<div><p>a</p></div><div><p>b</p></div>")) == 2
    assert records(spark, '<p id="first">First</p><p id="second">Second</p>') == [("p", "First Second", "root[0].html[1].body[0]", {"id": "first"})]


def test_html_transforms(spark):
    page = "<html><head></head><body><h1>Heading</h1></body></html>"
    change = lambda **new: lambda node, context: {**node, **new} if node["tag"] == "h1" else node
    assert records(spark, page, transform=change(tag="h2"))[0][:3] == ("h2", "Heading", "root[0].html[1].body[0]")
    assert records(spark, page, transform=change(content="New content"))[0][:2] == ("h1", "New content")
    assert records(spark, page, transform=change(tag="h2", content="x", raw="<div><p>Hello</p></div>"))[0][:3] == ("p", "Hello", "root[0].html[1].body[0].div[0]")


def test_markdown(spark):
    found = records(spark, "# Title\nSome content\n\n## Subtitle\nSome more content\n", kind="md")
    assert [r[:2] for r in found] == [("h1", "Title"), ("p", "Some content"), ("h2", "Subtitle"), ("p", "Some more content")]


def test_sections_and_fields(spark):
    page = "<body><h1>Main</h1><p>a</p><div>b</div><h2>Next One</h2><p>c</p></body>"
    frame = spark.createDataFrame([("/x", page), ("/y", "<p>only</p>")], "path string, html string")
    rows = {(r.path, r.content, r.section) for r in html.html_sections(frame).collect()}
    assert rows == {("/x#main", "a\nb\n", "Main"), ("/x#next-one", "c\n", "Main"), ("/y", "only", "")}
    fields = {r.path: (r.h1, r.content) for r in html.html_fields(frame, path_filter="/x").collect()}
    assert fields == {"/x": ("Main", "Main a b Next One c")}
    nested = spark.createDataFrame([("/p", "T", '{"a#Alpha": "one", "": "zero"}')], "url string, title string, data string")
    assert {(r.url, r.section, r.content) for r in html.page_sections(nested).collect()} == {("/p", "T", "one\nzero"), ("/p#a", "Alpha", "one"), ("/p", "", "zero")}


def test_streams(spark, tmp_path):
    schema, analyzer = Schema.of({"t": "string"}), Analyzer.create()
    rows = [(1, 1, "a b"), (2, 1, "b c"), (1, -1, "a b")]
    changes = spark.createDataFrame(rows, "_iid long, op int, t string")
    deltas = {(r.token, r.df) for r in maintenance.document_deltas(changes.where("op = 1"), schema, analyzer).collect()}
    assert deltas == {("a", 1), ("b", 2), ("c", 1)}
    source = str(tmp_path / "in")
    spark.createDataFrame([("1", "x"), ("2", "y")], "id string, t string").write.parquet(source)
    stream = spark.readStream.schema("id string, t string").parquet(source)
    maintenance.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("1", "z")], "id string, t string").write.mode("append").parquet(source)
    maintenance.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.id, r.t) for r in maintenance.current(spark, str(tmp_path / "out")).collect()} == {("1", "z"), ("2", "y")}
    events = maintenance.SearchEvents(spark, str(tmp_path / "events"), most=2)
    for term in "abc":
        events.add(term, 1, 0)
    events.flush()
    assert spark.read.parquet(str(tmp_path / "events")).count() == 3


def test_sessions(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert maintenance.event_sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_answer_session(spark):
    db = Collection(spark, {"t": "string"})
    db.insert_multiple([{"id": "1", "t": "cats purr"}, {"id": "2", "t": "dogs bark"}])
    chat = AnswerSession(db, lambda messages, sources: [h["id"] for h in sources["hits"]])
    assert chat.ask({"term": "cats"}) == "1"
    assert [m["role"] for m in chat.messages] == ["user", "assistant"]
    assert chat.regenerate_last() == "1" and len(chat.messages) == 2
    chat.clear()
    assert chat.messages == []


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    def plain(v):
        return round(v, 5) if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v

    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    other = sorted(repr([plain(dict(zip(found.columns, r, strict=True))[c]) for c in columns]) for r in found.fetchall())
    assert rows == other


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_records_leave_python_in_slices():
    """no more rows are made than a slice holds before they are given on."""
    made = []
    frames = html.sliced((made.append(i) or (i, "x") for i in range(2 * html.SLICE + 5)), ["k", "t"])
    assert len(next(frames)) == html.SLICE == len(made)
    assert [len(f) for f in frames] == [html.SLICE, 5]


def test_open_references(spark):
    """&amp without a semicolon is & to browsers and stays as it is where only closed references count."""
    page = '<head><title>a &amp;&amp b&lt</title><script>x && "&amp;"</script></head><article><h1 id="q&amp=1">a &amp;&amp b&lt</h1></article>'
    assert html.text_nodes(page)[0].content == "a && b<"
    title, script, h1 = html.text_nodes(page, closed=True)
    assert (title.content, script.content, h1.content, h1.properties) == ("a &&amp b&lt", 'x && "&amp;"', "a &&amp b&lt", {"id": "q&amp=1"})
    plain = page.replace('<script>x && "&amp;"</script>', "").replace(' id="q&amp=1"', "")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages AS SELECT 1 AS page_id, ? AS html", [plain])
    frame = spark.createDataFrame([(1, plain)], "page_id int, html string")
    texts = html.html_records(frame, "page_id", "html", merge="split", closed=True).groupBy("page_id", "content").count()
    titles = html.html_fields(frame, "page_id", "html", closed=True).select("page_id", "title", "h1")
    for name, found in (("html_texts", texts), ("page_titles", titles)):
        assert [tuple(r) for r in found.collect()] == duck.execute(ORACLES[name]).fetchall(), name


def test_retrieval_counts_in_cells(spark, monkeypatch):
    """with cells of a few rows the result is that of all pairs, and no join or shuffle sees the pairs."""
    from tessera.operators import answers

    monkeypatch.setattr(answers, "CELL_DOCUMENTS", 7)
    monkeypatch.setattr(answers, "CELL_QUESTIONS", 3)
    texts = [" ".join(f"w{(i * j) % 11}" for j in range(1, 2 + i % 6)) for i in range(40)] + [None, ""]
    asked = [" ".join(f"w{(3 * i + j) % 13}" for j in range(4)) for i in range(8)] + ["nothing", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    made = Collection.from_dataframe(spark, {"t": "string"}, docs, "k", "k", unique=True)
    found = answers.retrieve(made, spark.createDataFrame(list(enumerate(asked)), "q int, a string"), ["q"], "a", "t", 3)
    wanted = set()
    for q, a in enumerate(asked):
        shared = sorted((-len(set((a or "").split()) & set((t or "").split())), k) for k, t in enumerate(texts))
        wanted |= {(q, r, str(k), -n) for r, (n, k) in enumerate(shared[:3], 1) if n < 0}
    assert {tuple(r) for r in found.collect()} == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "CoGroup" in plan
