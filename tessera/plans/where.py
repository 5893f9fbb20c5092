"""Filters: a where clause becomes one boolean column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import geo
from ..functions.text import Analyzer
from ..schema import Schema, enum_text, inner, is_array, vector_size

NUMBER_OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "gt": lambda c, v: c > F.lit(float(v)),
    "gte": lambda c, v: c >= F.lit(float(v)),
    "lt": lambda c, v: c < F.lit(float(v)),
    "lte": lambda c, v: c <= F.lit(float(v)),
    "eq": lambda c, v: c == F.lit(float(v)),
    "between": lambda c, v: c.between(float(v[0]), float(v[1])),
}


def compile_where(where: dict, schema: Schema, analyzer: Analyzer) -> Column:
    """A row whose property is null meets no condition: the condition is null, which a filter takes for false, and
    `not` takes for false before it turns it around. So conditions stay plain comparisons that reach the scan.

    `and`, `or` and `not` rule at their level: with one of them, in this order, the other keys of the level are not
    looked at. An empty list of either gives no rows.
    """
    for name, join in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
        if where.get(name) is not None:
            parts = [compile_where(w, schema, analyzer) for w in where[name]]
            return reduce(join, parts) if parts else F.lit(False)
    if where.get("not") is not None:
        return ~F.coalesce(compile_where(where["not"], schema, analyzer), F.lit(False))
    parts = [_condition(path, value, schema, analyzer) for path, value in where.items()]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)


def _any(column: Column, array: bool, test: Callable[[Column], Column]) -> Column:
    return F.exists(column, test) if array else test(column)


def _condition(path: str, value: object, schema: Schema, analyzer: Analyzer) -> Column:
    kind = schema.types.get(path)
    if kind is None or vector_size(kind):
        raise EngineError("UNKNOWN_FILTER_PROPERTY", path)
    column, array = schema.column(path), is_array(kind)
    if kind == "geopoint":
        return geo_condition(column, value)
    if inner(kind) == "boolean":
        return _any(column, array, lambda c: c == F.lit(bool(value)))
    if inner(kind) == "string":
        if not isinstance(value, str | list | tuple):
            raise EngineError("INVALID_FILTER_OPERATION", 0)
        terms = [value] if isinstance(value, str) else value
        tokens = list(dict.fromkeys(t for term in terms for t in analyzer.query_tokens(term, path)))
        if not tokens:
            return F.lit(False)
        wanted = F.array(*[F.lit(t) for t in tokens])
        found = F.flatten(F.transform(column, lambda c: analyzer.tokens(c, path))) if array else analyzer.tokens(column, path)
        return F.arrays_overlap(found, wanted)
    if not isinstance(value, dict) or len(value) != 1:
        raise EngineError("INVALID_FILTER_OPERATION", len(value) if isinstance(value, dict) else 0)
    ((name, operand),) = value.items()
    if inner(kind) == "number":
        if name not in NUMBER_OPERATORS:
            raise EngineError("INVALID_FILTER_OPERATION", name)
        return _any(column, array, lambda c: NUMBER_OPERATORS[name](c, operand))
    return _enum_condition(column, array, name, operand)


def _enum_condition(column: Column, array: bool, name: str, operand: object) -> Column:
    if array:
        if name not in ("containsAll", "containsAny"):
            raise EngineError("INVALID_FILTER_OPERATION", name)
        wanted = [F.lit(enum_text(v)) for v in operand]
        if not wanted:
            return F.lit(False)
        if name == "containsAny":
            return F.arrays_overlap(column, F.array(*wanted))
        return column.isNotNull() & (F.size(F.array_except(F.array(*wanted), column)) == 0)
    if name == "eq":
        return column == F.lit(enum_text(operand))
    if name == "in":
        return column.isin([enum_text(v) for v in operand]) if operand else F.lit(False)
    if name == "nin":
        return column.isNotNull() & (~column.isin([enum_text(v) for v in operand]) if operand else F.lit(True))
    raise EngineError("INVALID_FILTER_OPERATION", name)


def geo_condition(column: Column, value: object) -> Column:
    """Points within (or outside of) a radius or a polygon; a missing point meets neither."""
    shape = next((k for k in ("radius", "polygon") if isinstance(value, dict) and k in value), None)
    if shape is None:
        raise EngineError("INVALID_FILTER_OPERATION", 0)
    spec = value[shape]
    inside = spec.get("inside", True)
    lon, lat = column["lon"], column["lat"]
    if shape == "radius":
        reach = geo.metres(spec["value"], spec.get("unit", "m"))
        away = geo.distance(lon, lat, spec["coordinates"], spec.get("highPrecision", False))
        return away <= reach if inside else away > reach
    within = F.when(column.isNotNull(), geo.in_polygon(lon, lat, spec["coordinates"]))
    return within if inside else ~within


def geo_only(where: dict, schema: Schema) -> tuple[str, dict] | None:
    """The geopoint filter of a clause that is nothing else, for ranking by distance."""
    if len(where or {}) != 1:
        return None
    ((path, value),) = where.items()
    return (path, value) if schema.types.get(path) == "geopoint" else None


def geo_distance(column: Column, value: dict) -> Column:
    """The distance by which a geo-only search ranks: from the centre, or from the polygon's centroid."""
    if "radius" in value:
        spec = value["radius"]
        return geo.distance(column["lon"], column["lat"], spec["coordinates"], spec.get("highPrecision", False))
    spec = value["polygon"]
    return geo.distance(column["lon"], column["lat"], geo.centroid(spec["coordinates"]), spec.get("highPrecision", False))
