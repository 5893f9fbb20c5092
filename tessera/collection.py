"""Collections: typed documents, their index, and the operations that change them.

A collection is immutable tables behind a few methods: an insert, update or delete makes new frames out of the old
ones (unions and anti-joins), and nothing runs before a result is asked for. `checkpoint` writes the state out.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError
from .functions.documents import nested
from .functions.text import Analyzer
from .operators.index import TextIndex, by_token, dense_numbers
from .operators.rank import PinRule
from .operators.score import SCORERS, Scorer
from .schema import Schema, conform_columns, python_document

#: The names of the hooks.
HOOKS = [
    f"{when}{what}{many}"
    for when in ("before", "after")
    for what in ("Insert", "Remove", "Update", "Upsert", "Search")
    for many in ("", "Multiple")
    if not (what == "Search" and many)
] + ["beforeLoad", "afterLoad", "afterCreate"]

#: The components that may be replaced. getDocumentIndexId(document) gives an id;
#: getDocumentProperties(document, paths) the values that are indexed, by path; a sorter sorts like rank.sort_by; pinning
#: gives the pins of a term like rank.active_pins. Documents are always stored as tables.
FUNCTION_COMPONENTS = ["validateSchema", "getDocumentIndexId", "getDocumentProperties", "formatElapsedTime"]
OBJECT_COMPONENTS = ["tokenizer", "index", "sorter", "pinning"]

#: Documents that wait in memory before they become a table.
PENDING = 10_000


@dataclass
class Plugin:
    """A named set of hooks, and components it puts in place."""

    name: str
    hooks: dict[str, Callable] = field(default_factory=dict)
    components: dict[str, Any] = field(default_factory=dict)
    extra: Any = None
    frame: Callable[[Collection, DataFrame], DataFrame] | None = None  # what it makes of frames that are inserted


class Collection:
    """create(schema, ...): documents of one schema and one language."""

    def __init__(
        self,
        spark: SparkSession,
        schema: dict,
        language: str | None = None,
        analyzer: Analyzer | None = None,
        scorer: str | Scorer = "bm25",
        sort_enabled: bool = True,
        unsortable: Iterable[str] = (),
        components: dict[str, Any] | None = None,
        plugins: Iterable[Plugin] = (),
        id: str | None = None,
    ):
        self.spark, self.schema = spark, Schema.of(schema)
        self.id = id or uuid.uuid4().hex
        parts = dict(components or {})
        self.plugins = list(plugins)
        for plugin in self.plugins:
            for name, value in plugin.components.items():
                if name in parts:
                    raise EngineError("PLUGIN_COMPONENT_CONFLICT", name, plugin.name)
                parts[name] = value
        for name, value in parts.items():
            if name in HOOKS:
                for f in value if isinstance(value, list) else [value]:
                    if not callable(f):
                        raise EngineError("COMPONENT_MUST_BE_FUNCTION_OR_ARRAY_FUNCTIONS", name)
            elif name in FUNCTION_COMPONENTS:
                if not callable(value):
                    raise EngineError("COMPONENT_MUST_BE_FUNCTION", name)
            elif name not in OBJECT_COMPONENTS:
                raise EngineError("UNSUPPORTED_COMPONENT", name)
        self.components = parts
        custom = analyzer or parts.get("tokenizer")
        if custom is not None and language is not None:
            raise EngineError("NO_LANGUAGE_WITH_CUSTOM_TOKENIZER")
        self.analyzer: Analyzer = custom or Analyzer.create(language or "english")
        self.language = getattr(self.analyzer, "language", "english")
        chosen = parts.get("index", scorer)
        self.scorer: Scorer = SCORERS[chosen] if isinstance(chosen, str) else chosen
        self.sort_enabled, self.unsortable = sort_enabled, frozenset(unsortable)
        self.pins: dict[str, PinRule] = {}
        self.positions: DataFrame | None = None  # of words, as a snapshot may hold them
        self._base = spark.createDataFrame([], self._row_type())
        self._empty = True
        self._pending: dict[str, tuple] = {}
        self._view: DataFrame | None = None
        self._next: int | None = 1
        self._index: TextIndex | None = None
        self._run("afterCreate", self)

    # ---- state ----

    def _row_type(self) -> T.StructType:
        own = [T.StructField("_iid", T.LongType()), T.StructField("id", T.StringType())]
        return T.StructType(own + [f for f in self.schema.struct().fields if f.name != "id"] + [T.StructField("_extra", T.StringType())])

    @property
    def docs(self) -> DataFrame:
        """(_iid, id, properties, _extra as JSON)"""
        return self._docs

    @property
    def _docs(self) -> DataFrame:
        """Documents inserted one by one wait in memory, PENDING at most, and are one branch of the plan."""
        if self._view is None:
            self._view = self._base.unionByName(self.spark.createDataFrame(list(self._pending.values()), self._row_type())) if self._pending else self._base
        return self._view

    def _set(self, docs: DataFrame, index: TextIndex | None = None) -> None:
        self._base, self._empty, self._pending, self._view, self._index = docs, False, {}, docs, index
        self.positions = None

    def _first_free(self) -> int:
        """The next internal id; looked up once after a load that brought its own."""
        if self._next is None:
            self._next = (self._docs.agg(F.max("_iid")).first()[0] or 0) + 1
        return self._next

    @property
    def index(self) -> TextIndex:
        if self._index is None:
            self._index = TextIndex(self.schema, self.analyzer, self._docs)
        return self._index

    def cache_index(self) -> Collection:
        self._index = self.index.cached()
        return self

    def checkpoint(self, path: str) -> Collection:
        """Write documents and index out and go on from the files."""
        save(self, path)
        fresh = load(self.spark, path, self)
        self._set(fresh._docs, fresh._index)
        return self

    def _run(self, hook: str, *args: Any) -> None:
        for f in [*_listed(self.components.get(hook)), *[p.hooks[hook] for p in self.plugins if hook in p.hooks]]:
            f(*args)

    # ---- insert ----

    @staticmethod
    def from_dataframe(spark: SparkSession, schema: dict, frame: DataFrame, id_column: str, iid: str | None = None, unique: bool = False, **options) -> Collection:
        """A collection of a frame's rows. iid: a unique integral column that gives the order of insertion; without
        one, rows are numbered in the order of their ids. unique: see insert_dataframe."""
        made = Collection(spark, schema, **options)
        made.insert_dataframe(frame, id_column, iid, unique)
        return made

    def _check_new(self, rows: DataFrame, iid: str | None) -> None:
        """Raise if ids repeat among new rows (_id, _iid), or with the documents that are there: narrow aggregates."""
        keys = {"_id": "id", "_iid": "_iid"} if iid else {"_id": "id"}
        for new, old in keys.items():
            every = rows.select(F.col(new).alias("k")) if self._empty and not self._pending else rows.select(F.col(new).alias("k")).union(self._docs.select(old))
            again = every.where("k is not null").groupBy("k").count().where("count > 1").select("k").head(1)
            if again or (new == "_iid" and rows.where("_iid is null").head(1)):
                raise EngineError("DOCUMENT_ALREADY_EXISTS", again[0].k if again else None)

    def insert_dataframe(self, frame: DataFrame, id_column: str | None = None, iid: str | None = None, unique: bool = False) -> Collection:
        """Insert a frame's rows. Ids, and internal ids where iid names them, that repeat or are there already raise
        DOCUMENT_ALREADY_EXISTS. unique: the caller knows that none do (a primary key), so nothing is looked up."""
        for f in self._frame_hooks():
            frame = f(self, frame)
        self._run("beforeInsertMultiple", self, frame)
        keys = [(F.col(f"`{id_column}`").cast("string") if id_column else F.uuid()).alias("_id")]
        keys += [F.col(f"`{iid}`").cast("long").alias("_iid")] if iid else []
        names = [n for n in frame.columns if n in self.schema.nested]
        rows = frame.select(*keys, *[F.col(f"`{n}`") for n in names])
        if not unique and (id_column or iid):
            self._check_new(rows, iid)
        if iid is None:
            first = self._first_free()
            rows = dense_numbers(rows, ["_id"], "_iid", first)
            self._next = first + rows.count()
        else:
            self._next = None
        body = conform_columns(rows, self.schema, skip=("id",))
        self._set(self._docs.unionByName(rows.select("_iid", F.col("_id").alias("id"), *body, F.lit(None).cast("string").alias("_extra"))))
        self._run("afterInsertMultiple", self, frame)
        return self

    def _frame_hooks(self) -> list[Callable[[Collection, DataFrame], DataFrame]]:
        """What plugins make of frames before they are inserted."""
        return [p.frame for p in self.plugins if p.frame is not None]

    def _python_rows(self, documents: list[dict]) -> list[tuple]:
        rows, names = [], [f.name for f in self._row_type().fields][2:-1]
        id_of, values_of = self.components.get("getDocumentIndexId"), self.components.get("getDocumentProperties")
        for d in documents:
            given = id_of(d) if id_of else d.get("id")
            if given is not None and not isinstance(given, str):
                raise EngineError("DOCUMENT_ID_MUST_BE_STRING", type(given).__name__)
            self._validate(d)
            made = python_document(self.schema, nested(values_of(d, list(self.schema.types))) if values_of else d)
            extra = {k: v for k, v in d.items() if k not in self.schema.nested and k != "id"}
            rows.append((given or uuid.uuid4().hex, *[made.get(n) for n in names], json.dumps(extra) if extra else None))
        return rows

    def _validate(self, document: dict) -> None:
        check = self.components.get("validateSchema")
        if check and (bad := check(document, self.schema.nested)):
            raise EngineError("SCHEMA_VALIDATION_FAILURE", bad)

    def _append(self, rows: list[tuple]) -> list[str]:
        ids = [r[0] for r in rows]
        present = {i for i, n in Counter(ids).items() if n > 1} | (self._pending.keys() & set(ids))
        if not present and not self._empty:
            present = {r.id for r in self._base.where(F.col("id").isin(ids)).select("id").collect()}
        if present:
            raise EngineError("DOCUMENT_ALREADY_EXISTS", sorted(present)[0])
        first = self._first_free()
        self._pending |= {r[0]: (first + i, *r) for i, r in enumerate(rows)}
        self._next = first + len(rows)
        self._view = self._index = self.positions = None
        if len(self._pending) > PENDING:
            self._set(self._docs)
        return ids

    def insert(self, document: dict) -> str:
        self._run("beforeInsert", self, document)
        (made,) = self._append(self._python_rows([document]))
        self._run("afterInsert", self, made, document)
        return made

    def insert_multiple(self, documents: list[dict], batch_size: int = 1000, timeout: int = 0) -> list[str]:
        """All or nothing. batch_size and timeout pace other engines and mean nothing here."""
        self._run("beforeInsertMultiple", self, documents)
        ids = self._append(self._python_rows(documents)) if documents else []
        self._run("afterInsertMultiple", self, documents)
        return ids

    # ---- look-ups ----

    def count(self) -> int:
        return self._docs.count()

    def get_by_id(self, id: str) -> dict | None:
        found = self._docs.where(F.col("id") == id).limit(1).collect()
        return to_document(found[0]) if found else None

    def get_multiple(self, ids: list[str]) -> list[dict | None]:
        found = {r.id: to_document(r) for r in self._docs.where(F.col("id").isin(ids)).collect()}
        return [found.get(i) for i in ids]

    # ---- changes ----

    def remove(self, id: str) -> bool:
        return self.remove_multiple([id], _hooks=("beforeRemove", "afterRemove")) == 1

    def remove_multiple(self, ids: list[str], batch_size: int = 1000, _hooks: tuple[str, str] = ("beforeRemoveMultiple", "afterRemoveMultiple")) -> int:
        self._run(_hooks[0], self, ids)
        gone = self._docs.where(F.col("id").isin(ids)).count()
        self._set(self._docs.where(~F.col("id").isin(ids)))
        self._run(_hooks[1], self, ids)
        return gone

    def remove_dataframe(self, ids: DataFrame) -> Collection:
        """Remove by a frame with a column id."""
        self._set(self._docs.join(ids.select("id"), "id", "left_anti").select(*self._docs.columns))
        return self

    def update(self, id: str, document: dict) -> str:
        """Remove and insert; the new document has a new id unless it carries one."""
        self._run("beforeUpdate", self, id)
        self._python_rows([document])
        self.remove(id)
        made = self.insert(document)
        self._run("afterUpdate", self, made)
        return made

    def update_multiple(self, ids: list[str], documents: list[dict]) -> list[str]:
        self._run("beforeUpdateMultiple", self, ids)
        self._python_rows(documents)
        self.remove_multiple(ids)
        made = self.insert_multiple(documents)
        self._run("afterUpdateMultiple", self, made)
        return made

    def upsert(self, document: dict) -> str:
        self._run("beforeUpsert", self, document)
        known = document.get("id") and self._docs.where(F.col("id") == document["id"]).limit(1).count()
        made = self.update(document["id"], document) if known else self.insert(document)
        self._run("afterUpsert", self, made, document)
        return made

    def upsert_multiple(self, documents: list[dict]) -> list[str]:
        """Ids of updated documents first, then of inserted ones."""
        self._run("beforeUpsertMultiple", self, documents)
        self._python_rows(documents)
        wanted = [d["id"] for d in documents if d.get("id")]
        known = {r.id for r in self._docs.where(F.col("id").isin(wanted)).select("id").collect()} if wanted else set()
        old = [d for d in documents if d.get("id") in known]
        new = [d for d in documents if d.get("id") not in known]
        made = (self.update_multiple([d["id"] for d in old], old) if old else []) + (self.insert_multiple(new) if new else [])
        self._run("afterUpsertMultiple", self, made)
        return made

    def upsert_dataframe(self, frame: DataFrame, id_column: str, iid: str | None = None, unique: bool = False) -> Collection:
        """Rows of the frame replace rows of the same id; one anti-join and one union. Ids that repeat inside the frame
        raise, unless `unique` says that none do."""
        self._set(self._docs.join(frame.select(F.col(id_column).cast("string").alias("id")), "id", "left_anti").select(*self._docs.columns))
        return self.insert_dataframe(frame, id_column, iid, unique)

    # ---- pins ----

    def insert_pin(self, rule: PinRule) -> None:
        if rule.id in self.pins:
            raise EngineError("DOCUMENT_ALREADY_EXISTS", rule.id)
        self.pins[rule.id] = rule

    def update_pin(self, rule: PinRule) -> None:
        if rule.id not in self.pins:
            raise EngineError("DOCUMENT_DOES_NOT_EXIST", rule.id)
        self.pins[rule.id] = rule

    def delete_pin(self, id: str) -> bool:
        return self.pins.pop(id, None) is not None

    def get_pin(self, id: str) -> PinRule | None:
        return self.pins.get(id)

    def all_pins(self) -> list[PinRule]:
        return list(self.pins.values())


def _listed(value: Any) -> list:
    return value if isinstance(value, list) else [value] if value else []


def to_document(row: Any) -> dict:
    """A row as the document it came from: no nulls, extra keys back in place."""

    def clean(value: Any) -> Any:
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items() if v is not None}
        return value

    made = clean(row.asDict(recursive=True))
    made.pop("_iid", None)
    return made | json.loads(made.pop("_extra", None) or "{}")


# ---- snapshots --------------------------------------------------------------------------------------------------


def _about(collection: Collection, more: tuple[str, ...] = ()) -> dict:
    """What a snapshot says beside its tables. Functions (stemmers, hooks, scorers of one's own) are not saved."""
    named = [n for n, s in SCORERS.items() if s is collection.scorer]
    return {
        "schema": collection.schema.nested,
        "language": collection.language,
        "scorer": named[0] if named else "bm25",
        "next": collection._first_free(),
        "pins": [[r.id, r.conditions, r.promote] for r in collection.all_pins()],
        "more": list(more),
    }


def _described(spark: SparkSession, about: dict, like: Collection | None = None, **options) -> Collection:
    options = ({"analyzer": like.analyzer, "scorer": like.scorer} if like else {"language": about["language"], "scorer": about["scorer"]}) | options
    if options.get("analyzer") is not None:
        options.pop("language", None)
    made = Collection(spark, about["schema"], **options)
    for i, conditions, promote in about["pins"]:
        made.insert_pin(PinRule(i, tuple(map(tuple, conditions)), tuple(map(tuple, promote))))
    return made


def save(collection: Collection, path: str, more: tuple[str, ...] = ()) -> None:
    """A snapshot: documents, postings, dictionary and statistics as Parquet, and one row that describes the rest.

    more: `sentences` and `placed` for the scorers by sentence and by position, `positions` for highlights.
    """
    collection.docs.write.mode("overwrite").parquet(f"{path}/docs")
    docs = collection.spark.read.schema(collection._row_type()).parquet(f"{path}/docs")
    TextIndex(collection.schema, collection.analyzer, docs).write(path, tuple(m for m in more if m != "positions"))
    if "positions" in more:
        from .operators.highlight import positions

        by_token(positions(collection, docs)).write.partitionBy("prop").mode("overwrite").parquet(f"{path}/positions")
    _write_text(collection.spark, json.dumps(_about(collection, more)), f"{path}/manifest")


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "about string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, like: Collection | None = None, **options) -> Collection:
    """A collection from a snapshot. Functions (stemmers, hooks, scorers) are not saved; pass them again."""
    about = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    made = _described(spark, about, like, **options)
    made._run("beforeLoad", made)
    docs = spark.read.schema(made._row_type()).parquet(f"{path}/docs")
    more = tuple(m for m in about.get("more", []) if m != "positions")
    made._set(docs, TextIndex.read(made.schema, made.analyzer, docs, path, more) if made.schema.searchable else None)
    made._next = about["next"]
    if "positions" in about.get("more", []):
        made.positions = spark.read.parquet(f"{path}/positions")
    made._run("afterLoad", made)
    return made


#: The formats of files; those of bytes are for collections that fit on the driver.
FILE_FORMATS, BYTE_FORMATS = ("parquet", "orc", "json"), ("json", "binary")


def persist_to_file(collection: Collection, path: str | None = None, format: str = "parquet") -> str:
    """Documents in one of FILE_FORMATS and all else that a snapshot holds but the index; path: `collection.<format>` by
    default. Returns the path."""
    path = path or f"collection.{format}"
    getattr(collection.docs.write.mode("overwrite"), format)(f"{path}/docs")
    _write_text(collection.spark, json.dumps(_about(collection) | {"format": format}), f"{path}/manifest")
    return path


def restore_from_file(spark: SparkSession, path: str, schema: dict | None = None, format: str | None = None, **options) -> Collection:
    """The collection that was persisted: documents, pins, language and scorer; its index is made when it is asked for.
    schema and format are those of the manifest unless given."""
    about = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    made = _described(spark, about | ({"schema": schema} if schema else {}), **options)
    made._set(getattr(spark.read.schema(made._row_type()), format or about["format"])(f"{path}/docs"))
    made._next = about["next"]
    return made


def persist(collection: Collection, format: str = "json") -> bytes:
    """The collection as bytes, for one that fits on the driver: JSON, or JSON compressed."""
    rows = [json.loads(r[0]) for r in collection.docs.select(F.to_json(F.struct("*"))).collect()]
    data = json.dumps(_about(collection) | {"docs": rows}).encode()
    return zlib.compress(data) if format == "binary" else data


def restore(spark: SparkSession, data: bytes, format: str = "json", **options) -> Collection:
    about = json.loads(zlib.decompress(data) if format == "binary" else data)
    made = _described(spark, about, **options)
    lines = spark.createDataFrame([(json.dumps(d),) for d in about["docs"]], "d string")
    made._set(lines.select(F.from_json("d", made._row_type()).alias("d")).select("d.*"))
    made._next = about["next"]
    return made


__all__ = ["Collection", "Plugin", "load", "persist", "persist_to_file", "restore", "restore_from_file", "save", "to_document"]
