"""Schemas: property types, their Spark types, and the check of documents."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError

SCALARS = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "enum": T.StringType()}
GEOPOINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
VECTOR = re.compile(r"vector\[(-?\d*\.?\d*)\]")


def is_array(kind: str) -> bool:
    return kind.endswith("[]")


def inner(kind: str) -> str:
    return kind.removesuffix("[]")


def vector_size(kind: str) -> int | None:
    """The length of a vector type; None for other types."""
    found = VECTOR.fullmatch(kind)
    if not found:
        return None
    if not found[1].isdigit() or int(found[1]) <= 0:
        raise EngineError("INVALID_VECTOR_SIZE", found[1])
    return int(found[1])


def spark_type(kind: str) -> T.DataType:
    if kind == "geopoint":
        return GEOPOINT
    if vector_size(kind):
        return T.ArrayType(T.FloatType())
    return T.ArrayType(SCALARS[inner(kind)]) if is_array(kind) else SCALARS[kind]


@dataclass(frozen=True)
class Schema:
    """Flat paths ('meta.tag') to types, from a nested definition."""

    types: dict[str, str]
    nested: dict

    @staticmethod
    def of(definition: dict) -> Schema:
        flat: dict[str, str] = {}

        def walk(part: dict, head: str) -> None:
            for name, kind in part.items():
                path = f"{head}{name}"
                if isinstance(kind, dict):
                    walk(kind, f"{path}.")
                elif not isinstance(kind, str) or not (inner(kind) in SCALARS or kind == "geopoint" or vector_size(kind)):
                    raise EngineError("INVALID_SCHEMA_TYPE", kind, path)
                else:
                    flat[path] = kind

        walk(definition, "")
        return Schema(flat, definition)

    def struct(self) -> T.StructType:
        def build(part: dict) -> T.StructType:
            return T.StructType([T.StructField(n, build(k) if isinstance(k, dict) else spark_type(k), True) for n, k in part.items()])

        return build(self.nested)

    def of_kind(self, *kinds: str) -> list[str]:
        return [p for p, k in self.types.items() if k in kinds]

    @property
    def searchable(self) -> list[str]:
        return self.of_kind("string", "string[]")

    @property
    def sortable(self) -> list[str]:
        return self.of_kind("string", "number", "boolean")

    @property
    def vectors(self) -> list[str]:
        return [p for p, k in self.types.items() if vector_size(k)]

    def column(self, path: str) -> Column:
        return F.col(".".join(f"`{p}`" for p in path.split(".")))

    def is_flat(self, path: str) -> bool:
        return "." not in path


def enum_text(value: object) -> str:
    """An enum value as the text that stands for it: numbers are marked, so that 1 and '1' differ."""
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        raise EngineError("INVALID_DOCUMENT_PROPERTY", "enum", "string or number", type(value).__name__)
    return value if isinstance(value, str) else f"#{float(value):g}"


def python_document(schema: Schema, document: dict) -> dict:
    """Check one Python document and give it Spark's forms; unknown keys go to `_extra` as JSON by the caller."""

    def convert(part: dict, doc: dict, head: str) -> dict:
        out = {}
        for name, kind in part.items():
            path, value = f"{head}{name}", doc.get(name)
            if isinstance(kind, dict):
                if value is not None and not isinstance(value, dict):
                    raise EngineError("SCHEMA_VALIDATION_FAILURE", path)
                out[name] = convert(kind, value or {}, f"{path}.")
            else:
                out[name] = None if value is None else _value(kind, value, path)
        return out

    return convert(schema.nested, document, "")


def _value(kind: str, value: object, path: str) -> object:
    def fits(one: object, of: str) -> bool:
        return {
            "string": isinstance(one, str),
            "number": isinstance(one, int | float) and not isinstance(one, bool),
            "boolean": isinstance(one, bool),
            "enum": isinstance(one, str | int | float) and not isinstance(one, bool),
        }[of]

    size = vector_size(kind)
    if size:
        if not isinstance(value, list | tuple) or len(value) != size:
            raise EngineError("SCHEMA_VALIDATION_FAILURE", path)
        return [float(v) for v in value]
    if kind == "geopoint":
        if not isinstance(value, dict) or not all(fits(value.get(k), "number") for k in ("lon", "lat")):
            raise EngineError("SCHEMA_VALIDATION_FAILURE", path)
        return {"lon": float(value["lon"]), "lat": float(value["lat"])}
    values = list(value) if is_array(kind) and isinstance(value, list | tuple) else [value]
    if is_array(kind) != isinstance(value, list | tuple) or not all(fits(v, inner(kind)) for v in values):
        raise EngineError("SCHEMA_VALIDATION_FAILURE", path)
    made = [float(v) if inner(kind) == "number" else enum_text(v) if inner(kind) == "enum" else v for v in values]
    return made if is_array(kind) else made[0]


def conform_columns(frame: DataFrame, schema: Schema, skip: tuple[str, ...] = ()) -> list[Column]:
    """The frame's columns cast to the schema's types; those it lacks are null, columns of no property are left out."""
    have = {f.name: f.dataType for f in frame.schema.fields}

    def cast(name: str, kind: T.DataType, source: Column, found: T.DataType | None) -> Column:
        if found is None:
            return F.lit(None).cast(kind)
        if isinstance(kind, T.StructType):
            if not isinstance(found, T.StructType):
                raise EngineError("SCHEMA_VALIDATION_FAILURE", name)
            parts = {f.name: f.dataType for f in found.fields}
            made = F.struct(*[cast(f"{name}.{f.name}", f.dataType, source[f.name], parts.get(f.name)).alias(f.name) for f in kind.fields])
            return F.when(source.isNotNull(), made)
        return source.cast(kind)

    def enum_or_cast(f: T.StructField) -> Column:
        kind, found = schema.types.get(f.name, ""), have.get(f.name)
        element = found.elementType if isinstance(found, T.ArrayType) else found
        if inner(kind) == "enum" and isinstance(element, T.NumericType):
            column = F.col(f"`{f.name}`")
            return F.transform(column, number_text) if is_array(kind) else number_text(column)
        return cast(f.name, f.dataType, F.col(f"`{f.name}`"), found)

    return [enum_or_cast(f).alias(f.name) for f in schema.struct().fields if f.name not in skip]


def number_text(value: Column) -> Column:
    """enum_text of a column of numbers."""
    number = value.cast("double")
    whole = number == F.floor(number)
    return F.concat(F.lit("#"), F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string")))

