"""A quality classifier by ordinal cumulative-link regression.

Grades are ordered, 0 the worst. One weight vector over hashed text features gives a document's score s; ordered
thresholds t_0 < t_1 < ... turn it into tail probabilities P(grade > j) = sigmoid(s - t_j). The expected grade is
their sum. All grades share the weights; the thresholds are kept in order by fitting logarithms of their gaps.

Features are the distinct words (letters, lower case), their first letters, the shapes of what surrounds them in their
tokens, and a few ratios of the whole text, each hashed to one of BUCKETS; each counts once a document.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, trimmed

BUCKETS = 1 << 17
#: The documented bound of the training sample: labelled rows with the smallest hashes.
SAMPLE_ROWS = 6_000
#: Buckets met in fewer training rows get no weight, since so few rows do not tell what they mean.
SUPPORT = 5

PREFIXES = (2, 3, 4)
LETTERS = re.compile(r"[^\W\d_]+")


class TokenBuckets(dict):
    """token -> its row in a table of buckets (word, shape, beginnings of the word); bounded."""

    BOUND = 200_000

    def __init__(self):
        self.table = np.zeros((self.BOUND, 2 + len(PREFIXES)), np.int32)

    def __missing__(self, token: str) -> int:
        word = "".join(LETTERS.findall(token))
        rest = LETTERS.sub("", token)
        case = "U" if len(word) > 1 and word.isupper() else "l"
        shape = f"{case}{'d' if re.search(r'[0-9]', rest) else re.sub(r'(.)\1+', r'\1+', rest)}"
        word = word.lower()
        row = len(self)
        self.table[row] = [_bucket("w", word), _bucket("s", shape), *(_bucket("p", word[:n]) for n in PREFIXES)]
        self[token] = row
        return row

    def of(self, tokens: set[str]) -> np.ndarray:
        if len(self) + len(tokens) > self.BOUND:
            self.clear()
        if len(tokens) > self.BOUND:
            first = list(tokens)
            return np.concatenate([self.of(set(first[at : at + self.BOUND])) for at in range(0, len(first), self.BOUND)])
        return self.table[np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))].ravel()


def _bucket(kind: str, name: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{name}") % BUCKETS


def _level(part: float) -> int:
    return min(10, math.ceil(part * 10))


def features(text: str) -> np.ndarray:
    """Distinct buckets of a whole text, in ascending order. A null or empty text has one feature of its own."""
    words = (text or "").split()
    if not words:
        return np.array([_bucket("r", "empty")], np.int32)
    distinct = set(words)
    lines = text.split("\n")
    n = len(words)
    ratios = [
        _bucket("r", f"distinct words {_level(len(distinct) / n)} of 2^{n.bit_length()}"),
        _bucket("r", f"distinct lines {_level(len(set(lines)) / len(lines))}"),
        _bucket("r", f"same as the word before {_level(sum(map(operator.eq, words, words[1:])) / n)}"),
        _bucket("r", f"signs only {_level(sum(not w[0].isalnum() for w in words) / n)}"),
    ]
    tokens, flags = held("ordinal", lambda: (TokenBuckets(), np.zeros(BUCKETS, bool)))
    flags[tokens.of(distinct)] = True
    flags[ratios] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found.astype(np.int32)


@dataclass
class OrdinalModel:
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.weights
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, ridge: float = 3.0, rate: float = 0.1, steps: int = 200, support: int = SUPPORT) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam over all rows, with steps that shrink to nothing so that it settles."""
    if not len(rows) or levels < 2:
        return OrdinalModel(np.zeros(0, int), np.zeros(0), np.arange(levels - 1, dtype=float) - 10.0)
    flat = np.concatenate(rows)
    kept = np.flatnonzero(np.bincount(flat, minlength=BUCKETS) >= support)
    column = np.full(BUCKETS, -1, np.int32)
    column[kept] = np.arange(len(kept), dtype=np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    column = column[flat]
    owner, column = owner[column >= 0], column[column >= 0]
    n = len(rows)
    share = np.array([(grades > j).mean() for j in range(levels - 1)]).clip(0.5 / n, 1 - 0.5 / n)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    p = np.concatenate([np.zeros(len(kept)), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    k = len(kept)
    for step in range(1, steps + 1):
        t = p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))])
        s = np.bincount(owner, p[column], minlength=n)
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        high, low = _sigmoid(edges[grades + 1] - s), _sigmoid(edges[grades] - s)  # P(grade) = high - low
        likely = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high), low * (1 - low)
        ds = (dh - dl) / likely  # of the negative logarithm, by s
        dt = np.array([(-dh[grades == j] / likely[grades == j]).sum() + (dl[grades == j + 1] / likely[grades == j + 1]).sum() for j in range(levels - 1)])
        dgap = np.exp(p[k + 1 :]) * np.array([dt[j + 1 :].sum() for j in range(levels - 2)])
        g = np.concatenate([np.bincount(column, ds[owner], minlength=k) + ridge * p[:k], [dt.sum()], dgap]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t = p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))])
    return OrdinalModel(kept, p[:k].copy(), t)


def train(docs: DataFrame, graded: DataFrame, levels: int, sample_rows: int = SAMPLE_ROWS, support: int = SUPPORT, key: str = "doc_id", text: str = "text") -> OrdinalModel:
    """Fit on the graded rows (key, grade) with the smallest hashes, sample_rows at most; their ids are broadcast.

    Rows with a null key or grade are left out; a key with several grades takes the lowest.
    """
    clean = graded.where(F.col(key).isNotNull() & F.col("grade").isNotNull() & F.col("grade").between(0, levels - 1))
    chosen = clean.groupBy(key).agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64(key), key).limit(sample_rows)
    texts = docs.select(F.col(key), F.col(text).alias("t")).join(F.broadcast(chosen), key).select("grade", "t", F.xxhash64(key).alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                yield pd.DataFrame({"grade": part["grade"], "h": part["h"], "x": [features(t) for t in part["t"]]})

    data = texts.mapInPandas(trimmed(run), "grade int, h long, x array<int>").orderBy("h", "grade", "x").limit(sample_rows).toPandas()
    return fit([np.asarray(x, np.int32) for x in data["x"]], data["grade"].to_numpy(np.int64), levels, support=support)


def _graded(docs: DataFrame, model: OrdinalModel, text: str, keep_tail: int | None, threshold: float) -> DataFrame:
    """The columns of docs as c0, c1, ... and score, expected_grade, tail, keep; batches pass through as Arrow."""
    j = len(model.thresholds) - 1 if keep_tail is None else keep_tail
    names = [f"c{i}" for i in range(len(docs.columns))]
    of_text = names[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for b in batches:
            s = np.array([dense[features(t)].sum() for t in b.column(of_text).to_pylist()], np.float64)
            tails = _sigmoid(s[:, None] - model.thresholds[None, :])
            made = [pa.array(s), pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64())), pa.array(tails[:, j] >= threshold)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *made], [*names, "score", "expected_grade", "tail", "keep"])

    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    made = T.StructType().add("score", "double").add("expected_grade", "double").add("tail", T.ArrayType(T.DoubleType())).add("keep", "boolean")
    return given.mapInArrow(trimmed(run), T.StructType(given.schema.fields + made.fields))


def grade(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text", keep_tail: int | None = None, threshold: float = 0.5) -> DataFrame:
    """(key, score, expected_grade, tail array, keep) of every whole text.

    tail[j] is P(grade > j). keep: the tail probability of `keep_tail` (the highest by default) is threshold or more.
    Null and empty texts share one feature and are graded by it; equal texts are graded alike; every row stays; an
    empty table gives an empty result.
    """
    found = _graded(docs.select(key, text), model, text, keep_tail, threshold)
    return found.select(F.col("c0").alias(key), "score", "expected_grade", "tail", "keep")


def kept_documents(docs: DataFrame, model: OrdinalModel, text: str = "text", keep_tail: int | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the model keeps, with the columns of docs."""
    found = _graded(docs, model, text, keep_tail, threshold).where("keep")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def label_grade(quality: Column, toxic: Column) -> Column:
    """The grade of a labelled document: 0 toxic, 1 of low quality, 2 good; null where a label that decides is null."""
    return F.when(toxic == 1, 0).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 2)
