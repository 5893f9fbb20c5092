"""Exact top-k inner-product search by pivot-table elimination.

Vectors are quantised to floor(scale * x), so all scores are integers. Many stored vectors serve as pivots, well spread
(farthest first in a bounded sample), and each vector's distances to them are computed once and stored with it: the
pivot table. For a query q and a candidate x the triangle inequality gives, for every pivot p,
|d(q,p) - d(x,p)| <= d(q,x); the largest of these is the lower bound. Since q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2, a
lower bound on the distance is an upper bound on the score. Candidates are evaluated in the order of their bounds,
slice by slice, until k scores are above the next bound: then no later candidate can enter, ties included.

The steps:

1. Rows are ordered by their nearest pivot and packed into blocks of bounded size. A block has its vectors, its pivot
   table, and of each pivot the least and greatest distance; query vectors are packed in the same way.
2. The pivots are rows too, so a query's k-th best pivot is a first threshold. Pairs of a query block and a row block
   whose bound lies below every threshold are eliminated whole.
3. Each query block is searched in the row block with the best bound first. The k-th scores found there are the
   thresholds with which the remaining pairs are eliminated, and those left are searched, by the queries that the
   block's bound does not eliminate one by one.
4. A search sends query blocks, the smaller side, to row blocks; no row block is copied for the queries it meets.
   What comes back is k rows a query and pair at most; a last top-k merges them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, trimmed

EXACT, EXACT_SINGLE = 2.0**53, 2.0**24
#: The documented bound of the sample that pivots are chosen from: the rows with the smallest hashes.
SAMPLE_ROWS = 1024
NOTHING = -np.inf
#: Distances are stored as single floats; differences of two of them are exact to this part of the greater one.
ROUNDING = 5e-7
#: Candidates of the first slice; each later one is four times as long.
SLICE = 64

BLOCK = "blk long, dim int, n int, ids binary, own binary, data binary, tab binary, lo array<double>, hi array<double>, norm double, best binary"


def _quantised(values: list, scale: float) -> np.ndarray:
    return np.floor(np.asarray(values, np.float64) * scale)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows b with a: by floats where every sum stays exact, else by Python's integers."""
    if a.size and b.size:
        most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[-1]
        if most >= EXACT:
            wide = [[int(x) for x in row] for row in b]
            return np.array([sum(int(x) * y for x, y in zip(a, row, strict=True)) for row in wide], dtype=object)
        if b.dtype == np.float32 and most >= EXACT_SINGLE:
            return b.astype(np.float64) @ a.astype(np.float64)
    return b @ a.astype(b.dtype)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (pivot, row)."""
    rows, pivots = rows.astype(np.float64), pivots.astype(np.float64)
    square = (pivots**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * pivots @ rows.T
    return np.sqrt(np.maximum(square, 0))


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of a sample at most, no two equal: each next one is the farthest from those chosen."""
    if not len(sample):
        return sample
    away = _distances(sample, sample.mean(0, keepdims=True))[0]
    chosen: list[int] = [int(away.argmax())]
    near = _distances(sample, sample[chosen])[0]
    while len(chosen) < n and near.max() > 0.5:  # distances of different integer vectors are 1 at least
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[0])
    return sample[chosen]


def _narrow(data: np.ndarray) -> bytes:
    """Stored as single floats where these hold the integers exactly."""
    return data.astype("<f4" if not data.size or np.abs(data).max() < EXACT_SINGLE else "<f8").tobytes()


def _wide(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * n * dim else "<f8").reshape(n, dim)


def _block(blk: int, dim: int, ids: np.ndarray, own: np.ndarray, data: np.ndarray, table: np.ndarray, best: np.ndarray | None = None) -> tuple:
    """own: (block, place) of each vector, which tells rows with equal ids apart."""
    table = table.astype("<f4")
    lo, hi = (table.min(1), table.max(1)) if len(table) else (np.zeros(0), np.zeros(0))
    norm = float((data.astype(np.float64) ** 2).sum(1).max())
    return blk, dim, len(ids), ids.astype("<i8").tobytes(), own.astype("<i8").tobytes(), _narrow(data), table.tobytes(), lo.tolist(), hi.tolist(), norm, None if best is None else best.astype("<f8").tobytes()


_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def _packed(batches: Iterator[pd.DataFrame], scale: float, size: int, pivots: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    """Rows (id, vec) to blocks of `size` vectors at most, one dimension each."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def block(dim: int) -> pd.DataFrame:
        parts = waiting.pop(dim)
        ids, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        blk = uuid.uuid4().int >> 65
        own = np.stack([np.full(len(ids), blk), np.arange(len(ids))], 1)
        return pd.DataFrame([_block(blk, dim, ids, own, data, _distances(data, pivots.get(dim, np.zeros((0, dim)))))], columns=_NAMES)

    for batch in batches:
        for dim, rows in batch.groupby(batch["vec"].map(len)):
            ids, data = rows["id"].to_numpy(np.int64), _quantised(list(rows["vec"]), scale).reshape(len(rows), dim)
            for at in range(0, len(ids), size):
                waiting.setdefault(dim, []).append((ids[at : at + size], data[at : at + size]))
                if sum(len(p[0]) for p in waiting[dim]) >= size:
                    yield block(dim)
    for dim in list(waiting):
        yield block(dim)


def _first_thresholds(data: np.ndarray, table: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the pivots that are other vectors; these are rows, so k rows score as much."""
    if len(pivots) < k:
        return np.full(len(data), NOTHING)
    scores = np.where(table.T > 0.5, (data.astype(np.float64) @ pivots.T.astype(np.float64)), NOTHING)
    return np.sort(scores, 1)[:, -k]


def _questions(batches: Iterator[pd.DataFrame], every: int, size: int, k: int, pivots: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    """The query vectors of row blocks, packed again, with their first thresholds."""
    waiting: dict[int, list[tuple]] = {}

    def block(dim: int) -> pd.DataFrame:
        ids, own, data, table = (np.concatenate(x) for x in zip(*waiting.pop(dim), strict=True))
        table = table.T
        best = _first_thresholds(data, table, pivots.get(dim, np.zeros((0, dim))), k)
        return pd.DataFrame([_block(uuid.uuid4().int >> 65, dim, ids, own, data, table, best)], columns=_NAMES)

    for batch in batches:
        for b in batch.itertuples():
            ids, own, data = np.frombuffer(b.ids, "<i8"), np.frombuffer(b.own, "<i8").reshape(-1, 2), _wide(b.data, b.n, b.dim)
            table = np.frombuffer(b.tab, "<f4").reshape(-1, b.n).T
            asked = np.flatnonzero(ids % every == 0)
            for at in range(0, len(asked), size):
                part = asked[at : at + size]
                waiting.setdefault(b.dim, []).append((ids[part], own[part], data[part].astype(np.float64), table[part]))
                if sum(len(p[0]) for p in waiting[b.dim]) >= size:
                    yield block(b.dim)
    for dim in list(waiting):
        yield block(dim)


def _greatest(both: np.ndarray, low: np.ndarray, most: float) -> np.ndarray:
    """The greatest score at a distance of low or more, with room for the rounding of the distances. both: the sum of
    the two squared norms; most: the greatest distance that low comes from."""
    low = np.maximum(low - ROUNDING * most, 0).astype(np.float64)
    return (both - low**2) / 2 + 1e-9 * both + 1e-6


def _in_slices(able: np.ndarray, bound: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Candidates in the order of their bounds, by slices: none of a slice has a higher bound than one before it."""
    cuts, at = [], step
    while at < len(able):
        cuts.append(at)
        step *= 4
        at += step
    order = able[np.argpartition(-bound[able], cuts)] if cuts else able
    yield from np.split(order, cuts)


def search_block(q: np.ndarray, place: int, of_query: np.ndarray, least: float, ids: np.ndarray, rows: np.ndarray, table: np.ndarray, norm: np.ndarray, most: float, k: int) -> tuple[list[tuple[int, int]], int]:
    """The k best (-score, id) of one block for a query, of those that reach `least`, and how many were evaluated.

    place: the query's own place in the block, or -1. table: (pivot, row). most: the greatest distance to a pivot.
    """
    own = float((q.astype(np.float64) ** 2).sum())
    low, gap = np.zeros(len(ids), table.dtype), np.empty(len(ids), table.dtype)
    for p in range(len(table)):
        np.subtract(table[p], of_query[p], out=gap)
        np.maximum(low, np.abs(gap, out=gap), out=low)
    bound = _greatest(norm + own, low, most)
    if place >= 0:
        bound[place] = NOTHING
    able = np.flatnonzero(bound >= least) if least > NOTHING else np.delete(np.arange(len(ids)), [place] if place >= 0 else [])
    best: list[tuple[int, int]] = []
    done = 0
    for part in _in_slices(able, bound, max(SLICE, k)):
        part = part[bound[part] >= least]
        if not len(part):  # so are all later ones: their bounds are lower still
            break
        scores = _products(q, rows)[part] if len(part) * 2 > len(rows) else _products(q, rows[part])
        done += len(part)
        keep = scores >= least
        best = sorted([*best, *((-int(s), int(x)) for s, x in zip(scores[keep], ids[part][keep], strict=True))])[:k]
        if len(best) == k:
            least = max(least, float(-best[-1][0]))
    return best, done


def _search(batches: Iterator[pd.DataFrame], k: int, report: bool) -> Iterator[pd.DataFrame]:
    """Rows of one partition, sorted so that a row block (side 0) comes before the query blocks that it meets."""
    names = ["query_blk", "query_own", "query_place", "query_id", "vec_id", "score", "evaluated", "met"]
    held: tuple | None = None
    for batch in batches:
        out: list[tuple] = []
        for b in batch.itertuples():
            data, table, ids = _wide(b.data, b.n, b.dim), np.frombuffer(b.tab, "<f4").reshape(-1, b.n), np.frombuffer(b.ids, "<i8")
            if b.side == 0:
                held = b.r, ids, data, table, (data.astype(np.float64) ** 2).sum(1)
                lo, hi, norm = np.asarray(b.lo), np.asarray(b.hi), b.norm
                reach = float(hi.max(initial=0))
                continue
            assert held is not None and held[0] == b.r
            own, least = np.frombuffer(b.own, "<i8").reshape(-1, 2), np.frombuffer(b.best, "<f8")
            low = np.maximum(table - hi[:, None], lo[:, None] - table).max(0, initial=0) if len(table) else np.zeros(b.n)
            most = max(reach, float(table.max(initial=0)))
            upper = _greatest(norm + (data.astype(np.float64) ** 2).sum(1), low, most)
            for i in np.flatnonzero(upper >= least):
                place = int(own[i, 1]) if own[i, 0] == b.r else -1
                best, done = search_block(data[i], place, table[:, i], float(least[i]), *held[1:], most, k)
                if report:
                    out.append((b.blk, *own[i], ids[i], 0, 0, done, len(held[1]) - (place >= 0)))
                else:
                    out += [(b.blk, *own[i], ids[i], x, -s, 0, 0) for s, x in best]
        yield pd.DataFrame(out, columns=names).astype("int64")


def _raised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Query blocks with the thresholds of the rows found for them: found holds (block, place, k-th score)."""
    for batch in batches:
        for i, found in enumerate(batch["found"]):
            if found is not None and len(found):
                own = np.frombuffer(batch["own"].iloc[i], "<i8").reshape(-1, 2)
                best = np.frombuffer(batch["best"].iloc[i], "<f8").copy()
                known = {(r["query_own"], r["query_place"]): float(r["least"]) for r in found}
                for j, (a, b) in enumerate(own.tolist()):
                    best[j] = max(best[j], known.get((a, b), NOTHING))
                batch.at[batch.index[i], "best"] = best.tobytes()
        yield batch[_NAMES]


def _upper(a: str, b: str) -> Column:
    """The greatest score that any vectors of two blocks can have: of each pivot, the gap between the ranges of distances."""
    gaps = F.zip_with(F.arrays_zip(f"{a}.lo", f"{a}.hi"), F.arrays_zip(f"{b}.lo", f"{b}.hi"), lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0)))
    most = F.greatest(F.array_max(f"{a}.hi"), F.array_max(f"{b}.hi"))
    low = F.greatest(F.coalesce(F.array_max(gaps) - most * ROUNDING, F.lit(0.0)), F.lit(0.0))
    both = F.col(f"{a}.norm") + F.col(f"{b}.norm")
    return (both - low * low) / 2 + both * 1e-9 + 1e-6


def _met(pairs: DataFrame, blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """Row blocks, each followed by the query blocks of its pairs (blk, r)."""
    rows = blocks.join(pairs.select(F.col("r").alias("blk")).distinct(), "blk", "left_semi").select(F.col("blk").alias("r"), F.lit(0).alias("side"), *_NAMES)
    asked = questions.join(pairs, "blk").select("r", F.lit(1).alias("side"), *_NAMES)
    return rows.unionByName(asked).repartition("r").sortWithinPartitions("r", "side")


def _searched(vectors: DataFrame, k: int, query_every: int, scale: float, pivots: int, query_block: int, row_block: int, key: str, vector: str, report: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, blocks, questions)"""
    spark = vectors.sparkSession
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = (
        vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
        .where(F.col("id").isNotNull() & (F.size("vec") > 0))
        .where(F.forall("vec", fine))
    )
    by_dim: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect():
        by_dim.setdefault(len(r.vec), []).append(r.vec)
    chosen = {dim: spread_pivots(_quantised(x, scale), pivots) for dim, x in by_dim.items()}

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near, away = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for dim, at in batch.groupby(batch["vec"].map(len)).indices.items():
                if dim in chosen:
                    table = _distances(_quantised(list(batch["vec"].iloc[at]), scale), chosen[dim])
                    near[at], away[at] = table.argmin(0), table.min(0)
            yield batch.assign(dim=batch["vec"].map(len), near=near, away=away)

    placed = rows.mapInPandas(trimmed(nearest), "id long, vec array<double>, dim int, near long, away double").withColumn("tie", F.monotonically_increasing_id())
    order = ["dim", "near", "away", "id", "tie"]
    near_ones = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("id", "vec")
    blocks = stage(near_ones.mapInPandas(trimmed(lambda it: _packed(it, scale, row_block, chosen)), BLOCK), "blocks")
    questions = stage(blocks.mapInPandas(trimmed(lambda it: _questions(it, query_every, query_block, k, chosen)), BLOCK), "queries")

    least = F.udf(lambda b: float(np.frombuffer(b, "<f8").min()), "double")

    def pairs_of(asked: DataFrame) -> DataFrame:
        """(r, blk, upper): pairs of blocks whose bound reaches some threshold of the query block."""
        a = asked.select("dim", F.struct("blk", "lo", "hi", "norm", least("best").alias("least")).alias("a"))
        names = a.groupBy("dim").agg(F.collect_list("a").alias("as"))  # bounds of the query blocks
        b = blocks.select("dim", F.struct("blk", "lo", "hi", "norm").alias("b"))
        met = b.join(names, "dim").select("b", F.explode("as").alias("a")).select("a", "b", _upper("a", "b").alias("upper"))
        return met.where(F.col("upper") >= F.col("a.least")).select(F.col("b.blk").alias("r"), F.col("a.blk").alias("blk"), "upper")

    schema = "query_blk long, query_own long, query_place long, query_id long, vec_id long, score long, evaluated long, met long"

    def search(pairs: DataFrame, asked: DataFrame, report: bool = False) -> DataFrame:
        return _met(pairs, blocks, asked).mapInPandas(trimmed(lambda it: _search(it, k, report)), schema)

    first = stage(pairs_of(questions).groupBy("blk").agg(F.max_by("r", F.struct("upper", "r")).alias("r")), "first")
    found = stage(search(first, questions), "found")
    kth = found.groupBy("query_blk", "query_own", "query_place").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    known = kth.groupBy(F.col("query_blk").alias("blk")).agg(F.collect_list(F.struct("query_own", "query_place", "least")).alias("found"))
    raised = stage(questions.join(known, "blk", "left").mapInPandas(trimmed(_raised), BLOCK), "raised")
    rest = stage(pairs_of(raised).join(first, ["blk", "r"], "left_anti").select("blk", "r"), "rest")
    if report:
        found = search(first, questions, True).unionByName(search(rest, raised, True))
    else:
        found = found.unionByName(search(rest, raised))
    return found, blocks, questions


def top_k(
    vectors: DataFrame,
    k: int = 5,
    query_every: int = 50,
    scale: float = 256.0,
    pivots: int = 64,
    query_block: int = 512,
    row_block: int = 4096,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by query_every, its k best other rows.

    Ties go to the smaller id. Rows with a null id, a null vector, an empty one or one that holds nulls, NaN or
    infinities take no part. Vectors meet only those of their own length. Repeated ids are rows of their own: each one
    that is asked has a ranking of its own, and only the row itself is no candidate of it. Scores must fit 64 bits. An
    empty table gives an empty result. Other columns are not looked at.
    """
    found, _, _ = _searched(vectors, k, query_every, scale, pivots, query_block, row_block, key, vector, False)
    ranked = Window.partitionBy("query_own", "query_place", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def elimination(
    vectors: DataFrame,
    k: int = 5,
    query_every: int = 50,
    scale: float = 256.0,
    pivots: int = 64,
    query_block: int = 512,
    row_block: int = 4096,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """One row (evaluated, met, candidates): how many scores a search computes, of the candidates in the pairs of blocks
    that it searches, and of all candidates of all queries."""
    found, blocks, questions = _searched(vectors, k, query_every, scale, pivots, query_block, row_block, key, vector, True)
    sizes = blocks.groupBy("dim").agg(F.sum("n").alias("rows")).join(questions.groupBy("dim").agg(F.sum("n").alias("asked")), "dim")
    total = sizes.agg(F.sum(F.col("asked") * (F.col("rows") - 1)).alias("candidates"))
    return found.agg(F.sum("evaluated").alias("evaluated"), F.sum("met").alias("met")).crossJoin(total)
