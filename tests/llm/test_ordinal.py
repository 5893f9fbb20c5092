import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.ordinal import features, fit, grade, kept_documents, label_grade, train

WORDS = [f"{a}{b}o" for a in "bcdfghklmn" for b in "aeiouaeiouxyzvwrstpq"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        g = i % 3
        words = [rnd.choice(WORDS) for _ in range(30)]
        if g == 0:
            words[5] = words[20] = "rude"
        if g == 1:
            words = [w + "###" for w in words]
        out.append((i, " ".join(words), g))
    return out


def test_gradient_and_held_out_accuracy():
    rows = texts(900)
    x = [features(t) for _, t, _ in rows]
    y = np.array([g for _, _, g in rows])
    model = fit(x[:600], y[:600], 3)
    assert (np.diff(model.thresholds) > 0).all()
    dense = model.dense()
    s = np.array([dense[f].sum() for f in x[600:]])
    found = (s[:, None] > model.thresholds[None, :]).sum(1)
    assert (found == y[600:]).mean() > 0.97


def test_on_frames(spark, docs_of, odd, empty):
    rows = texts(300)
    docs = docs_of([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, int(g != 1), int(g == 0)) for i, _, g in rows] + [(None, 1, 0), (1, None, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    model = train(docs, labels.select("doc_id", label_grade(F.col("quality"), F.col("toxic")).alias("grade")), 3, sample_rows=250)
    found = {r.doc_id: r for r in grade(docs, model).collect()}
    assert sum(found[i].keep == (g == 2) for i, _, g in rows) > 290
    assert all(abs(r.expected_grade - sum(r.tail)) < 1e-9 and r.tail[0] >= r.tail[1] for r in found.values())
    assert kept_documents(docs, model).columns == docs.columns
    assert kept_documents(docs, model).count() == sum(r.keep for r in found.values())
    assert grade(odd, model).count() == odd.count()
    same = {r.score for r in grade(odd.where("doc_id in (4, 5)"), model).collect()}
    assert len(same) == 1
    assert grade(empty, model).count() == 0 and kept_documents(empty, model).count() == 0
    none = train(docs, labels.select("doc_id", F.lit(None).cast("int").alias("grade")), 3)
    assert grade(docs, none).count() == 300


def objective(p, rows, grades, levels, ridge):
    """The penalised mean negative log-likelihood, from the definition: one weight a feature, then the thresholds."""
    weights, t = p[: len(p) - levels + 1], [-math.inf, *p[len(p) - levels + 1 :], math.inf]
    total = 0.0
    for x, g in zip(rows, grades, strict=True):
        s = sum(weights[i] for i in x)
        at = [0.0 if v == -math.inf else 1.0 if v == math.inf else 1 / (1 + math.exp(s - v)) for v in (t[g], t[g + 1])]
        total -= math.log(max(at[1] - at[0], 1e-12))
    return (total + ridge / 2 * sum(w * w for w in weights)) / len(rows)


@pytest.mark.parametrize("levels", [2, 3, 4])
def test_fit_against_another_optimiser(levels):
    """A plain descent along numerical gradients of the definition ends at the same model."""
    rnd = random.Random(levels)
    rows = [sorted(rnd.sample(range(5), rnd.randint(1, 3))) for _ in range(50)]
    grades = [min(levels - 1, max(0, round(sum(x) / 3 + rnd.gauss(0, 0.7)))) for x in rows]
    grades[:levels] = range(levels)
    model = fit([np.array(x, np.int32) for x in rows], np.array(grades), levels, ridge=1.0, steps=600)
    found = [*model.dense()[:5], *model.thresholds]
    p = [0.0] * 5 + [j - (levels - 2) / 2 for j in range(levels - 1)]
    for _ in range(1500):
        slope = []
        for i in range(len(p)):
            up, down = list(p), list(p)
            up[i], down[i] = up[i] + 1e-5, down[i] - 1e-5
            slope.append((objective(up, rows, grades, levels, 1.0) - objective(down, rows, grades, levels, 1.0)) / 2e-5)
        p = [v - g for v, g in zip(p, slope, strict=True)]
    assert objective(found, rows, grades, levels, 1.0) == pytest.approx(objective(p, rows, grades, levels, 1.0), abs=1e-4)
    assert np.allclose(found, p, atol=0.05)


def test_scores_against_plain_sums(spark, docs_of):
    """Every graded row against the definition: the sum of its features' weights, and the tails of all thresholds."""
    rows = texts(120, seed=3) + [(500, None, 0), (501, "", 0), (502, "x" * 40 + "!?" * 30 + " RUDE rude 12:30", 0)]
    docs = docs_of([(i, t) for i, t, _ in rows])
    model = fit([features(t) for _, t, _ in rows], np.array([g for _, _, g in rows]), 3)
    dense = model.dense()
    for r in grade(docs, model).collect():
        s = sum(dense[i] for i in features(dict((i, t) for i, t, _ in rows)[r.doc_id]))
        tail = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        assert r.score == pytest.approx(s) and list(r.tail) == pytest.approx(tail)
        assert r.expected_grade == pytest.approx(sum(tail)) and r.keep == (tail[-1] >= 0.5)
