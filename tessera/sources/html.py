"""HTML and Markdown as rows: text records, heading sections, page fields.

Parsing is Python's html.parser in mapInPandas; whatever follows (merging of neighbours) works on columns.
"""

from __future__ import annotations

import html as html_text
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


@dataclass
class Node:
    """An element, or a text (tag is empty)."""

    tag: str
    text: str = ""
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    def content(self) -> str:
        return self.text if not self.tag else "".join(c.content() for c in self.children)

    def raw(self) -> str:
        if not self.tag:
            return html_text.escape(self.text, quote=False)
        head = "".join(f' {k}="{html_text.escape(v)}"' for k, v in self.attributes.items())
        return f"<{self.tag}{head}>" + ("" if self.tag in VOID else "".join(c.raw() for c in self.children) + f"</{self.tag}>")

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()


#: An ampersand that begins no reference that ends in a semicolon.
OPEN_REFERENCE = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


class _Builder(HTMLParser):
    """closed: only references that end in a semicolon are characters; browsers also read some that do not (&amp, &copy)."""

    def __init__(self, closed: bool = False):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]
        self.closed, self.sign = closed, ""

    def feed(self, data: str) -> None:
        if self.closed and OPEN_REFERENCE.search(data):
            self.sign = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in data)  # stands for such an ampersand
            data = OPEN_REFERENCE.sub(self.sign, data)
        super().feed(data)

    def _plain(self, text: str) -> str:
        return text.replace(self.sign, "&") if self.sign else text

    def _node(self, tag: str, attrs: list) -> Node:
        return Node(self._plain(tag), attributes={self._plain(k): self._plain(v or "") for k, v in attrs})

    def _add(self, node: Node) -> None:
        self.stack[-1].children.append(node)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        while len(self.stack) > 1 and self.stack[-1].tag in ends:
            self.stack.pop()
        node = self._node(tag, attrs)
        self._add(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(self._node(tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        tag = self._plain(tag)
        if any(n.tag == tag for n in self.stack[1:]):
            while self.stack.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        data = self._plain(data)
        last = self.stack[-1].children[-1:]
        if last and not last[0].tag:
            last[0].text += data
        else:
            self._add(Node("", data))

    def handle_comment(self, data: str) -> None:
        self._add(Node("#comment"))

    def handle_decl(self, decl: str) -> None:
        self._add(Node("#doctype"))


def fragment(source: str, closed: bool = False) -> list[Node]:
    builder = _Builder(closed)
    builder.feed(source)
    builder.close()
    return builder.root.children


def document(source: str, closed: bool = False) -> Node:
    """The tree of a page: a root with at most a doctype and one html element with a head and a body."""
    found = fragment(source, closed)
    lead = [n for n in found if n.tag in ("#doctype", "#comment")]
    page = next((n for n in found if n.tag == "html"), None)
    parts = page.children if page else [n for n in found if n not in lead]
    head = next((n for n in parts if n.tag == "head"), None)
    body = next((n for n in parts if n.tag == "body"), None)
    loose = [n for n in parts if n is not head and n is not body]
    head = head or Node("head")
    early = []
    if body is None:
        while loose and (loose[0].tag in IN_HEAD or (not loose[0].tag and not loose[0].text.strip())):
            early.append(loose.pop(0))
    head.children += [n for n in early if n.tag]
    if body is None:
        body = Node("body", children=loose)
    made = Node("html", attributes=page.attributes if page else {}, children=[head, body])
    return Node("#root", children=[*lead, made])


def markdown_to_html(source: str) -> str:
    """The common parts of Markdown: headings, paragraphs, lists, quotes, code, emphasis, links, images, rules."""

    def inline(text: str) -> str:
        text = html_text.escape(text, quote=False)
        text = re.sub(r"`([^`]+)`", r"<code>\1</code>", text)
        text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", r'<img alt="\1" src="\2">', text)
        text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)", r'<a href="\2">\1</a>', text)
        text = re.sub(r"(\*\*|__)(.+?)\1", r"<strong>\2</strong>", text)
        return re.sub(r"(?<![\w*])([*_])([^*_]+)\1(?![\w*])", r"<em>\2</em>", text)

    out: list[str] = []
    lines = source.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif fence := re.match(r"\s*(```|~~~)\s*(\S*)", line):
            body = []
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(fence[1]):
                body.append(lines[i])
                i += 1
            i += 1
            out.append("<pre><code>" + html_text.escape("\n".join(body) + "\n", quote=False) + "</code></pre>")
        elif head := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            n = len(head[1])
            out.append(f"<h{n}>{inline(head[2])}</h{n}>")
            i += 1
        elif re.fullmatch(r"\s*([-*_])(\s*\1){2,}\s*", line):
            out.append("<hr>")
            i += 1
        elif item := re.match(r"\s*(?:([-*+])|\d+[.)])\s+", line):
            kind = "ul" if item[1] else "ol"
            items = []
            while i < len(lines) and (m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", lines[i])):
                items.append(f"<li>{inline(m[1])}</li>")
                i += 1
            out.append(f"<{kind}>\n" + "\n".join(items) + f"\n</{kind}>")
        elif line.lstrip().startswith(">"):
            body = []
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                body.append(lines[i].lstrip()[1:].lstrip())
                i += 1
            out.append("<blockquote>\n" + markdown_to_html("\n".join(body)) + "\n</blockquote>")
        elif line.lstrip().startswith("<"):
            body = []
            while i < len(lines) and lines[i].strip():
                body.append(lines[i])
                i += 1
            out.append("\n".join(body))
        else:
            body = []
            while i < len(lines) and lines[i].strip() and not re.match(r"#{1,6}\s|\s*```|\s*[-*+]\s|\s*>", lines[i]):
                body.append(lines[i].strip())
                i += 1
            out.append(f"<p>{inline(chr(10).join(body))}</p>")
    return "\n".join(out)


@dataclass
class Record:
    type: str
    content: str
    path: str
    properties: dict[str, str]


Transform = Callable[[dict, dict], dict]


def _transformed(node: Node, change: Transform, context: dict) -> Node:
    """The user's function sees tag, content, raw and properties; a changed raw form wins over tag and content."""
    seen = {"tag": node.tag, "content": node.content(), "raw": node.raw(), "properties": dict(node.attributes)}
    made = change(dict(seen), context)
    if made.get("raw", seen["raw"]) != seen["raw"]:
        new = next((n for n in fragment(made["raw"]) if n.tag), Node("span"))
    else:
        new = Node(made.get("tag", node.tag), attributes=dict(node.attributes), children=node.children)
        if made.get("content", seen["content"]) != seen["content"]:
            new.children = [Node("", made["content"])]
    new.attributes.update(made.get("additionalProperties") or {})
    return new


def text_nodes(source: str, base_path: str = "", transform: Transform | None = None, context: dict | None = None, closed: bool = False) -> list[Record]:
    """One record for each text that is not blank: its element's tag, and the path of the element's parent."""
    out: list[Record] = []

    def visit(node: Node, parent: Node, path: str, context: dict) -> None:
        if not node.tag:
            if node.text.strip():
                out.append(Record(parent.tag, node.text.strip(), path.rpartition(".")[0], dict(parent.attributes)))
            return
        if node.tag.startswith("#"):
            return
        if transform:
            node = _transformed(node, transform, context)
        for i, child in enumerate(node.children):
            visit(child, node, f"{path}.{node.tag}[{i}]", context)

    for i, child in enumerate(document(source, closed).children):
        visit(child, Node("#root"), f"{base_path}root[{i}]", dict(context or {}))
    return out


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, source): whole files, by any path that Spark reads."""
    rows = spark.read.format("binaryFile").load(glob)
    return rows.select("path", F.decode("content", "UTF-8").alias("source"))


#: Records that a Python worker gives on at once; a batch of pages has many times as many.
SLICE = 1000


def sliced(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of SLICE at most, so that memory does not depend on how many a batch of pages has."""
    while held := list(itertools.islice(rows, SLICE)):
        yield pd.DataFrame(held, columns=columns)


def html_records(pages: DataFrame, key: str = "path", source: str = "html", merge: str = "merge", kind: str = "html", transform: Transform | None = None, context: dict | None = None, base_path: bool = False, closed: bool = False) -> DataFrame:
    """(key, n, type, content, path, properties): the text records of each page, in order. A key of the name `path` is
    called `page`, since path is the record's place in its page.

    merge: neighbours of the same tag and parent become one record, joined by a space, with the properties of the
    first; split: none do; both: single records, and the merged one after them. closed: references without a semicolon
    stay as they are written.
    """
    spark_key = pages.schema[key].dataType.simpleString()
    name = "page" if key == "path" else key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return sliced(made(batches), ["k", "n", "type", "content", "path", "properties"])

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for k, text in zip(batch["k"], batch["s"], strict=True):
                page = markdown_to_html(text or "") if kind == "md" else text or ""
                for n, r in enumerate(text_nodes(page, f"{k}/" if base_path else "", transform, context, closed)):
                    yield k, n, r.type, r.content, r.path, r.properties

    given = pages.select(F.col(key).alias("k"), F.col(source).alias("s"))
    found = given.mapInPandas(run, f"k {spark_key}, n int, type string, content string, path string, properties map<string,string>")
    if merge == "split":
        return found.withColumnRenamed("k", name)
    by_page = Window.partitionBy("k").orderBy("n")
    container = F.regexp_replace("path", r"\[\d+\]$", "")
    before = F.lag(F.struct(container.alias("c"), F.col("type"))).over(by_page)
    fresh = F.when(before.isNull() | (before["c"] != container) | (before["type"] != F.col("type")), 1).otherwise(0)
    numbered = found.withColumn("g", F.sum(fresh.cast("long")).over(by_page))
    kept = F.map_entries("properties").alias("properties")  # maps have no order, their entries have
    gathered = F.array_sort(F.collect_list(F.struct("n", "content", "path", kept)))
    first = F.element_at("rows", 1)
    overlay = F.aggregate("rows", F.create_map().cast("map<string,string>"), lambda a, r: F.map_concat(a, F.map_from_entries(F.filter(r["properties"], lambda e: ~F.map_contains_key(a, e["key"])))))
    merged = (
        numbered.groupBy("k", "g", "type")
        .agg(gathered.alias("rows"))
        .select("k", F.element_at("rows", -1)["n"].alias("last"), first["n"].alias("n"), "type", F.array_join(F.transform("rows", lambda r: r["content"]), " ").alias("content"), first["path"].alias("path"), overlay.alias("properties"))
    )
    if merge == "merge":
        return merged.drop("last").withColumnRenamed("k", name)
    single = found.select("k", F.col("n").alias("last"), "n", "type", "content", "path", "properties", F.lit(0).alias("o"))
    return single.unionByName(merged.withColumn("o", F.lit(1))).select(F.col("k").alias(name), F.col("last").alias("n"), "o", "type", "content", "path", "properties")


def slug(title: str) -> str:
    """A heading as it stands in an address."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", title) if not unicodedata.combining(c))
    return re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s$*_+~.()'\"!\-:@]+", "", plain, flags=re.ASCII).strip()).lower()


def sections(source: str) -> list[tuple[str, str, str, str]]:
    """(title, heading, content, section): the texts of the elements between a heading and the next; section is the
    first h1 of the page. A page without headings is one section without a title."""
    root = document(source)
    out: list[tuple[str, str, str]] = []
    for parent in root.walk():
        elements = [n for n in parent.children if n.tag and not n.tag.startswith("#")]
        for i, n in enumerate(elements):
            if n.tag in HEADINGS:
                body = ""
                for after in elements[i + 1 :]:
                    if after.tag in HEADINGS:
                        break
                    body += after.content().strip() + "\n"
                out.append((n.content().strip(), n.tag, body))
    if not out:
        body = next((n for n in root.walk() if n.tag == "body"), root)
        return [("", "", " ".join(t for t in (n.text.strip() for n in body.walk() if not n.tag) if t), "")]
    title = next((t for t, h, _ in out if h == "h1"), "")
    return [(t, h, b, title) for t, h, b in out]


def html_sections(pages: DataFrame, key: str = "path", source: str = "html", base: str = "") -> DataFrame:
    """(key, n, title, header, content, section, path): heading sections; path ends in the heading's slug. A key of the
    name `path` is called `page`."""
    kind = pages.schema[key].dataType.simpleString()
    name = "page" if key == "path" else key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, t, h, b, s, f"{base}{k}#{slug(t)}" if t else f"{base}{k}") for k, text in zip(batch["k"], batch["s"], strict=True) for n, (t, h, b, s) in enumerate(sections(text or ""))]
            yield pd.DataFrame(rows, columns=[name, "n", "title", "header", "content", "section", "path"])

    return pages.select(F.col(key).alias("k"), F.col(source).alias("s")).mapInPandas(run, f"{name} {kind}, n int, title string, header string, content string, section string, path string")


STEP = re.compile(r"([>\s]*)((?:[\w*-]+|(?=[.#\[:]))(?:[.#][\w-]+|\[[^\]]*\]|:first-child)*)")
PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]|(:first-child)")


@dataclass
class Step:
    """One compound of a selector: its tag, its tests, and whether it must be a child of the step before."""

    child: bool
    tag: str
    tests: list[tuple]

    def fits(self, node: Node, parent: Node) -> bool:
        if not node.tag or node.tag.startswith("#") or self.tag not in ("", "*", node.tag):
            return False
        for mark, name, attribute, how, value, first in self.tests:
            given = node.attributes.get({".": "class", "#": "id"}.get(mark, attribute or ""))
            if first:
                fine = next((c for c in parent.children if c.tag and not c.tag.startswith("#")), None) is node
            elif mark == ".":
                fine = name in (given or "").split()
            elif mark == "#":
                fine = given == name
            elif given is None or not how:
                fine = given is not None
            else:
                tests = {"=": given == value, "~=": value in given.split(), "^=": given.startswith(value), "$=": given.endswith(value), "*=": value in given}
                fine = tests[how]
            if not fine:
                return False
        return True


def parse_selector(selector: str) -> list[list[Step]]:
    """A list of selectors: tags, classes, ids, attributes, :first-child, joined by blanks (inside) or > (child)."""
    out = []
    for one in selector.split(","):
        steps, at, one = [], 0, one.strip()
        while at < len(one):
            m = STEP.match(one, at)
            if not m or m.end() == at or not m[2]:
                raise ValueError(f"selector not understood: {selector}")
            tag = re.match(r"[\w*-]*", m[2])[0]
            steps.append(Step(">" in m[1], tag.lower(), PART.findall(m[2][len(tag) :])))
            at = m.end()
        out.append(steps)
    return out


def select(root: Node, selector: str) -> list[Node]:
    """The elements below root that a selector picks, in the order of the page, each once."""
    wanted, found = parse_selector(selector), []

    def reached(steps: list[Step], way: list[Node]) -> bool:
        """Whether way, from root to an element, ends in what the steps pick."""
        if not steps[-1].fits(way[-1], way[-2]):
            return False
        if len(steps) == 1:
            return True
        ends = [len(way) - 1] if steps[-1].child else range(2, len(way))
        return any(reached(steps[:-1], way[:k]) for k in ends if k >= 2)

    def visit(way: list[Node]) -> None:
        for c in way[-1].children:
            if c.tag and not c.tag.startswith("#"):
                if any(steps and reached(steps, [*way, c]) for steps in wanted):
                    found.append(c)
                visit([*way, c])

    visit([root])
    return found


def html_fields(
    pages: DataFrame, key: str = "path", source: str = "html", content: str = "body", path_filter: str | None = None, title: str = "title", heading: str = "h1", closed: bool = False
) -> DataFrame:
    """(key, title, h1, content): the first elements that the selectors of title and heading pick, and the texts of
    all that the selector of the content picks, scripts and styles left out. closed: as for html_records."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["k"], batch["s"], strict=True):
                root = document(text or "", closed)
                first = [next((n.content().strip() for n in select(root, wanted)), "") for wanted in (title, heading)]
                body = " ".join(t.text.strip() for n in select(root, content) for t in _shown(n) if t.text.strip())
                rows.append((k, *first, body))
            yield pd.DataFrame(rows, columns=[key, "title", "h1", "content"])

    rows = pages if path_filter is None else pages.where(F.col(key).cast("string").rlike(path_filter))
    return rows.select(F.col(key).alias("k"), F.col(source).alias("s")).mapInPandas(run, f"{key} {kind}, title string, h1 string, content string")


RECORD_SCHEMA = {"type": "string", "content": "string", "path": "string"}


def populate(collection, pages: DataFrame, key: str = "path", source: str = "html", **options):
    """Insert the text records of pages into a collection whose schema holds properties of RECORD_SCHEMA; their ids are
    the page's key and the record's number. Options are those of html_records."""
    records = html_records(pages, key, source, **options)
    page = "page" if key == "path" else key
    return collection.insert_dataframe(records.withColumn("record_id", F.concat_ws("#", page, "n", *(["o"] if "o" in records.columns else []))), "record_id", unique=True)


def populate_from_glob(collection, glob: str, **options):
    """The same for files, by any path that Spark reads."""
    return populate(collection, read_files(collection.spark, glob), "path", "source", **options)


def _shown(node: Node) -> Iterator[Node]:
    """The texts below a node, but for scripts and styles."""
    for c in node.children:
        if not c.tag:
            yield c
        elif c.tag not in RAW:
            yield from _shown(c)


def page_sections(pages: DataFrame, url: str = "url", title: str = "title", data: str = "data") -> DataFrame:
    """(url, title, section, content) of nested page JSON {"hash#title": text}: one row for each section, and one for
    the page with all its text."""
    parsed = F.from_json(data, "map<string,string>")
    each = pages.select(F.col(url).alias("url"), F.col(title).alias("title"), F.explode(parsed).alias("k", "content"))
    part = each.select(F.concat(F.col("url"), F.when(F.substring_index("k", "#", 1) != "", F.concat(F.lit("#"), F.substring_index("k", "#", 1))).otherwise(F.lit(""))).alias("url"), "title", F.regexp_extract("k", "#(.*)$", 1).alias("section"), "content")
    whole = pages.select(F.col(url).alias("url"), F.col(title).alias("title"), F.col(title).alias("section"), F.array_join(F.map_values(parsed), "\n").alias("content"))
    return whole.unionByName(part)
