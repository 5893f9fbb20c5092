"""Nested documents as flat paths, for Python documents and for frames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(document: dict, head: str = "") -> dict[str, Any]:
    """{'a': {'b': 1}} as {'a.b': 1}."""
    out: dict[str, Any] = {}
    for name, value in document.items():
        if isinstance(value, dict):
            out |= flatten(value, f"{head}{name}.")
        else:
            out[f"{head}{name}"] = value
    return out


def nested(flat: dict[str, Any]) -> dict:
    """{'a.b': 1} as {'a': {'b': 1}}."""
    out: dict = {}
    for path, value in flat.items():
        *heads, name = path.split(".")
        part = out
        for h in heads:
            part = part.setdefault(h, {})
        part[name] = value
    return out


def is_point(value: Any) -> bool:
    return isinstance(value, dict) and all(isinstance(value.get(k), int | float) for k in ("lat", "lon"))


def properties(document: dict, paths: list[str]) -> dict[str, Any]:
    """The values at dotted paths. Points are values; other objects, and paths that lead nowhere, are left out."""
    out = {}
    for path in paths:
        value: Any = document
        for name in path.split("."):
            value = value.get(name) if isinstance(value, dict) and not is_point(value) else None
        if value is not None and (not isinstance(value, dict) or is_point(value)):
            out[path] = value
    return out


def flat_columns(frame: DataFrame) -> list[Column]:
    """Every leaf of a frame's structs as a column of its dotted name; points stay whole."""
    out: list[Column] = []

    def walk(kind: T.StructType, head: str) -> None:
        for f in kind.fields:
            path = f"{head}{f.name}"
            inner = f.dataType
            if isinstance(inner, T.StructType) and {x.name for x in inner.fields} != {"lon", "lat"}:
                walk(inner, f"{path}.")
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path.split("."))).alias(path))

    walk(frame.schema, "")
    return out
