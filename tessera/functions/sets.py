"""Sets of ids as frames, and arrays as sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersection(frames: list[DataFrame], key: str = "_iid") -> DataFrame:
    """Ids that all frames hold."""
    first, *rest = [f.select(key) for f in frames]
    return reduce(lambda a, b: a.join(b, key, "left_semi"), rest, first).distinct()


def union(frames: list[DataFrame], key: str = "_iid") -> DataFrame:
    return reduce(lambda a, b: a.union(b), [f.select(key) for f in frames]).distinct()


def difference(frame: DataFrame, other: DataFrame, key: str = "_iid") -> DataFrame:
    return frame.select(key).join(other.select(key), key, "left_anti").distinct()


def array_intersection(arrays: list[Column]) -> Column:
    """Elements that all arrays hold, in the order of the first."""
    return reduce(F.array_intersect, arrays)


def keep_ids(scored: DataFrame, allowed: DataFrame, key: str = "_iid") -> DataFrame:
    """The scored rows whose id is allowed."""
    return scored.join(allowed.select(key), key, "left_semi")
