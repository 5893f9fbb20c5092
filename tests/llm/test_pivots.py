import math
import random

import numpy as np
import pytest

from tessera.llm.pivots import elimination, search_block, spread_pivots, top_k


def plain(rows, k=5):
    q = {}
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v in kept:
        if i % 50 == 0:
            q[i] = v
    for i, v in q.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in kept if j != i and len(w) == len(v))[:k]
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(found, 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, "z") for i, v in rows], "vec_id long, embedding array<float>, id int, score double, vec string")


@pytest.mark.parametrize("kind", ["random", "ties", "clusters", "norms"])
def test_against_brute_force(spark, kind):
    rnd = random.Random(kind)
    make = {
        "random": lambda i: [rnd.gauss(0, 0.2) for _ in range(16)],
        "ties": lambda i: [float(rnd.randint(0, 1)) for _ in range(4)] + [0.5] * 4,
        "clusters": lambda i: [(i % 5) / 4 + rnd.gauss(0, 0.01) for _ in range(8)],
        "norms": lambda i: [rnd.gauss(0, 0.1) * (1 + i % 40) for _ in range(8)],
    }[kind]
    rows = [(i, [float(np.float32(x)) for x in make(i)]) for i in range(420)]
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(frame(spark, rows), pivots=8, query_block=4, row_block=64).collect()}
    assert found == plain(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, None]), (100, None), (150, []), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (3, [1.0, 2.0, 3.0]), (300, [2.0, 2.0, 2.0]), (350, [1e12, 3.0])]
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(frame(spark, rows)).collect()}
    exact = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert found == plain(exact)
    assert top_k(frame(spark, rows).limit(0)).count() == 0


def clustered(n, dim=8, groups=40, seed=4):
    """Vectors of one length in tight groups."""
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(groups, dim))
    data = centre[rnd.integers(0, groups, n)] + rnd.normal(scale=0.02, size=(n, dim))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    return [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(data)]


def test_eliminates_on_clusters(spark):
    """Most candidates of clustered vectors are never evaluated, many not even met, and the result is exact."""
    rows = clustered(3000)
    options = {"pivots": 32, "query_block": 8, "row_block": 128}
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(frame(spark, rows), **options).collect()}
    assert found == plain(rows)
    r = elimination(frame(spark, rows), **options).first()
    assert r.candidates == 60 * 2999
    assert r.evaluated < 0.2 * r.candidates and r.met < 0.6 * r.candidates, r


def test_repeated_ids(spark):
    """Rows of one id are asked one by one, and are candidates of one another."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0])]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(frame(spark, rows), k=2, scale=1.0).collect())
    assert found == sorted([(50, 1, 1, 2), (50, 2, 2, 0), (50, 1, 2, 2), (50, 2, 50, 1), (50, 1, 2, 2), (50, 2, 50, 1)])


def test_bounds_stop_exactly():
    """Whatever the pivots and the threshold, a block's best rows that reach the threshold are found."""
    rnd = np.random.default_rng(8)
    for trial in range(60):
        rows = rnd.integers(-6, 7, (90, 4)).astype(np.float32)
        ids, q = rnd.permutation(90).astype(np.int64), rnd.integers(-6, 7, 4).astype(np.float32)
        pivots = spread_pivots(rows.astype(float), trial % 9)
        table = np.sqrt(((pivots[:, None] - rows[None]) ** 2).sum(2)).astype(np.float32) if len(pivots) else np.zeros((0, 90), np.float32)
        of_query = np.sqrt(((pivots - q) ** 2).sum(1)).astype(np.float32)
        most = float(max(table.max(initial=0), of_query.max(initial=0)))
        least = float(rnd.integers(-20, 60)) if trial % 3 else -np.inf
        best, done = search_block(q, 7, of_query, least, ids, rows, table, (rows.astype(float) ** 2).sum(1), most, 5)
        scores = sorted((-int(s), int(i)) for p, (s, i) in enumerate(zip(rows @ q, ids, strict=True)) if p != 7 and s >= least)
        assert best == scores[:5] and done <= 89
