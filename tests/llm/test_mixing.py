import math

import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import GRID, mix, mixed_documents, token_estimate


def table(docs_of):
    sizes = {"big": 300, "mid": 60, "low": 30, None: 15}
    return docs_of([(k * 1000 + i, "word " * (5 + i % 9), s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)])


def plain_exponent(tokens, entropy, most):
    total = sum(tokens)
    p = [t / total for t in tokens]
    for x in range(GRID + 1):
        e = x / GRID
        z = sum(q**e for q in p)
        h = -sum(q**e / z * math.log(q**e / z) for q in p)
        if h <= entropy * math.log(len(p)) + 1e-9 and (max(p) / min(p)) ** (1 - e) <= most + 1e-9:
            return e
    return 1.0


@pytest.mark.parametrize(("entropy", "most"), [(0.95, 2.0), (0.8, 100.0), (1.0, 3.0), (0.1, 2.0)])
def test_exponent_and_weights(docs_of, entropy, most):
    docs = table(docs_of)
    mixed = mix(docs, entropy=entropy, max_repeat=most, blocks=16).persist()
    tokens = {r.source: r.t for r in docs.groupBy("source").agg(F.sum(token_estimate(F.col("text"))).alias("t")).collect()}
    e = plain_exponent(list(tokens.values()), entropy, most)
    assert mixed.first().mix_exponent == pytest.approx(e, abs=1.01 / GRID)
    e = mixed.first().mix_exponent
    got = {r.source: r.t for r in mixed.groupBy("row.source").agg(F.sum(token_estimate(F.col("row.text"))).alias("t")).collect()}
    mass = sum((t / sum(tokens.values())) ** e for t in tokens.values())
    for s, t in tokens.items():
        weight = (t / sum(tokens.values())) ** e / mass
        assert got[s] / sum(got.values()) == pytest.approx(weight, abs=0.02)
        assert got[s] <= most * t + 20
    assert mixed.select("row.doc_id").distinct().count() == docs.count()


def test_budget_and_order(docs_of):
    docs = table(docs_of)
    mixed = mix(docs, entropy=0.9, max_repeat=50.0, budget=2000, blocks=8).persist()
    total = mixed.agg(F.sum(token_estimate(F.col("row.text")))).first()[0]
    assert 2000 <= total <= 2000 + 4 * 15
    rows = mixed.orderBy("mix_position").collect()
    assert {r.row.source for r in rows[: len(rows) // 4]} == {"big", "mid", "low", None}
    first = [(r.row.source, r.mix_block) for r in rows if r.mix_epoch == 0]
    seen: dict = {}
    for s, b in first:  # blocks come whole, one after another
        assert seen.setdefault(s, [b])[-1] == b or b not in seen[s]
        if seen[s][-1] != b:
            seen[s].append(b)
    again = mix(docs, entropy=0.9, max_repeat=50.0, budget=2000, blocks=8)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.collect()))


def test_odd_rows(odd, empty):
    made = mixed_documents(odd)
    assert made.columns == odd.columns and made.count() == odd.count()
    assert mixed_documents(empty).count() == 0


def test_blocks_grow_with_the_corpus(docs_of, monkeypatch):
    from tessera.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 5)
    made = mix(table(docs_of))
    assert made.agg(F.max("mix_block")).first()[0] > mixing.LEAST_BLOCKS
    assert made.select("row.doc_id").distinct().count() == table(docs_of).count()


def test_staged_tables_go(spark, docs_of):
    from tessera.llm import common

    common._staged.clear()
    kept = common.stage(docs_of([(1, "x")]), "some")
    assert kept.count() == 1 and common.drop_staged(spark) == 1 and not common._staged
