import random

import numpy as np
import pytest

from tessera.llm import ngram_join as nj


def plain(rows, n=5, threshold=0.8):
    """(doc_id -> (class_id, n_links)) by all pairs."""
    sets = []
    for _, t in rows:
        w = nj.text_words(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted((d, min(least[find(i)]), links[i]) for i, (d, _) in enumerate(rows))


def corpus(seed, groups=12, size=9, copies=0):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 30, 80, 120]))]
        for _ in range(rnd.randint(1, size)):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, rows[0][1].upper()) for i in range(copies)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4, 256])
def test_against_all_pairs(docs_of, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    rows = corpus(3, copies=5)
    found = sorted((r.doc_id, r.class_id, r.n_links) for r in nj.jaccard_join(docs_of(rows)).collect())
    assert found == plain(rows)


def test_one_large_group(docs_of, monkeypatch):
    """Hundreds of near copies of one text: no link is lost, whatever the size of the group."""
    monkeypatch.setattr(nj, "BLOCK", 32)
    rnd = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(220):
        text = list(base)
        for _ in range(rnd.randint(0, 3)):
            text[rnd.randrange(120)] = f"x{rnd.randrange(1000)}"
        rows.append((i, " ".join(text)))
    found = sorted((r.doc_id, r.class_id, r.n_links) for r in nj.jaccard_join(docs_of(rows)).collect())
    right = plain(rows)
    missed = sum(b[2] - a[2] for a, b in zip(found, right, strict=True))
    assert 0 <= missed <= 0.001 * sum(b[2] for b in right)
    assert [r[1] for r in found] == [r[1] for r in right]


def test_odd_rows(odd, empty, docs_of):
    found = sorted(((r.doc_id, r.class_id, r.n_links) for r in nj.jaccard_join(odd).collect()), key=str)
    assert len(found) == odd.count()
    assert [r for r in found if r[0] in (4, 5)] == [(4, 4, 2), (4, 4, 2), (5, 4, 2)]
    assert all(r[2] == 0 and r[1] == r[0] for r in found if r[0] in (1, 2, 3, 6, 7))
    assert nj.jaccard_join(empty).count() == 0
    kept = nj.near_duplicates_removed(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 1, 2, 3, 4, 6, 7], key=str)
    chain = [(i, " ".join(f"a{j}" for j in range(4 * i, 4 * i + 80))) for i in range(5)]
    assert {r.class_id for r in nj.jaccard_join(docs_of(chain)).collect()} == {0}


def test_banding_and_matrix_overlaps():
    bands, rows = nj.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 128
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, 30).astype(np.uint64)) for _ in range(40)]
    pairs = np.array([(i, j) for i in range(40) for j in range(i + 1, 40)])
    assert nj._overlaps(sets, pairs).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in pairs]


def test_one_key_with_several_texts(docs_of):
    texts = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(4)]
    rows = [(1, t) for t in texts] + [(1, texts[0]), (2, texts[1].upper()), (3, texts[2] + " more"), (4, "quite another text of its own")]
    kept = sorted((r.doc_id, r.text) for r in nj.near_duplicates_removed(docs_of(rows)).collect())
    assert kept == sorted([(1, t) for t in texts] + [(4, "quite another text of its own")])


def components_of(rows, n=5, threshold=0.8):
    """A component's number for each row, by all pairs; rows without words are alone with their equals."""
    sets = []
    for _, t in rows:
        w = nj.text_words(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            linked = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold if sets[i] and sets[j] else rows[i] == rows[j]
            if linked and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return root


def test_repeated_and_null_keys(docs_of):
    """Keys that are null, or repeat with linked and unlinked texts: one row of each component stays."""
    rnd = random.Random(12)
    texts = [" ".join(f"w{g}x{j if rnd.random() > 0.01 else -j}" for j in range(60)) for g in range(6) for _ in range(4)] + [None, "", "  "]
    rows = [(rnd.choice([None, None, 1, 1, 2, 3]), rnd.choice(texts)) for _ in range(120)]
    found = sorted((r.doc_id, r.text) if r.doc_id is not None else (-1, r.text) for r in nj.near_duplicates_removed(docs_of(rows)).fillna("-", ["text"]).collect())
    root = components_of(rows)
    kept = {}
    for r, (k, t) in zip(root, rows, strict=True):
        kept.setdefault(r, []).append((k is None, k or 0, t))
    assert len(found) == len(kept)
    least = sorted((-1 if none else k) for none, k, _ in (min(v, key=lambda x: x[:2]) for v in kept.values()))
    assert sorted(k for k, _ in found) == least
    links = nj.jaccard_join(docs_of(rows))
    assert links.count() == len(rows)


def test_many_rows_without_a_key(spark, docs_of):
    """Texts are found again by key and hash: what is read for verification grows with the rows, not their square."""
    texts = [" ".join(f"w{i % 150}x{j}" for j in range(40)) + (" more" if i % 2 else "") for i in range(300)]
    rows = docs_of([(None, t) for t in texts])
    found = nj.jaccard_join(rows).collect()
    assert len(found) == 300 and {r.n_links for r in found} == {1} and {r.class_id for r in found} == {None}
    assert nj.near_duplicates_removed(rows).count() == 150


def test_groups_by_n_grams(docs_of, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_GRAMS", 300)
    rows = corpus(4, copies=5)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in nj.jaccard_join(docs_of(rows)).collect()) == plain(rows)


def test_recall_against_exact_pairs():
    """Bands and rows for the target recall find the pairs at the threshold and above."""
    rnd = np.random.default_rng(5)
    bands, rows = nj.banding(0.8, 0.9995)
    hit = total = 0
    for _ in range(400):
        base = rnd.integers(0, 1 << 62, 90).astype(np.uint64)
        other = np.concatenate([base[:80], rnd.integers(0, 1 << 62, 10).astype(np.uint64)])  # 80 of 100: similarity 0.8
        a, b = nj.signatures([np.unique(base), np.unique(other)], bands, rows)
        total, hit = total + 1, hit + bool((a == b).any())
    assert hit / total >= 0.99
