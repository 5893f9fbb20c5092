"""Helpers that the operators share: the shared folder, staged tables, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any, TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none (a local test) a folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


_staged: list[str] = []


def fresh_dir(spark: SparkSession, label: str) -> str:
    _staged.append(f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _staged[-1]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage, survives lost executors, and keeps several readers from computing df again.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Remove the staged tables and files that this process wrote, once no result that reads them is needed any more;
    returns how many folders went."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    gone = 0
    while _staged:
        path = paths(_staged.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def trimmed(run: Callable[[Iterator[T]], Iterator[T]]) -> Callable[[Iterator[T]], Iterator[T]]:
    """A function over batches that gives freed memory back to the system as its task ends. Python workers wait for other
    tasks, several an executor, and would keep what their largest batches took."""

    def wrapped(batches: Iterator[T]) -> Iterator[T]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim is not None:
                trim(0)

    return wrapped


_held: dict[str, Any] = {}


def held(name: str, make: Callable[[], T]) -> T:
    """What an operator keeps in a Python worker between batches and tasks, such as a tokenizer. Workers serve one
    operator after another, so what others kept is dropped when a new one begins."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def key_columns(key: str) -> list[Column]:
    """A key as two columns without nulls, so that pandas keeps it exact."""
    value = F.col(f"`{key}`").cast("long")
    return [F.coalesce(value, F.lit(0)).alias("k"), value.isNull().alias("k_null")]


def key_array(batch: pd.DataFrame) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(batch["k"].to_numpy(np.int64), batch["k_null"].to_numpy(bool))


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when it grows past its bound."""

    BOUND = 50_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
