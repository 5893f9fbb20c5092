import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import sentencepiece_scan as sp

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return sp.Lattice(MODEL)


@pytest.mark.parametrize("alphabet", [list("abcdefghi"), ["the", "ing", "er", "漢", "é", "🎉", "\n", "un"], [" ", "a", "hello"], ["=", "==", "-", "http", "www", "▁", " ", "\t", "0"]])
def test_scan_equals_library(lattice, alphabet):
    rnd = random.Random(len(alphabet))
    for _ in range(12):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(80, 500)))
        assert sp.encode_giant(lattice, text, chunk=rnd.choice([70, 129])) == lattice.library.encode(text)


def test_products_are_associative(lattice):
    text = "aababcabcdabcde" * 40
    z = sp.spaced(text)
    a, b, c = (sp.transfer(lattice, z, p, q) for p, q in ((0, 100), (100, 200), (200, 300)))
    left, right = sp.maxplus(sp.maxplus(a, b), c), sp.maxplus(a, sp.maxplus(b, c))
    assert np.array_equal(left, right)
    assert np.array_equal(left, sp.transfer(lattice, z, 0, 300))


def test_frames(lattice, docs_of, odd, empty):
    rnd = random.Random(5)
    long = "".join(rnd.choice(["abc", " the", "ing", "漢", "  "]) for _ in range(3000))
    rows = [(1, long), (2, long), (3, "short text"), (4, "z" * 2000), (5, " " * 700)]
    docs = docs_of(rows)
    found = {r.doc_id: list(r.ids) for r in sp.encode(docs, MODEL, giant=500, chunk=300).collect()}
    assert found == {i: lattice.library.encode(t) for i, t in rows}
    digests = {r.doc_id: r for r in sp.encoded_and_decoded(docs, MODEL, giant=500, chunk=300).collect()}
    for i, t in rows:
        assert digests[i].round_trip and digests[i].decoded_chars == len(t)
        assert digests[i].ids_crc32 == zlib.crc32(np.array(found[i], "<u4").tobytes())
    marked = sp.encode_checked(docs, MODEL, giant=500, chunk=300).collect()
    assert {r.doc_id: list(r.ids) for r in marked} == found and all(r.round_trip for r in marked)
    lost = sp.encode_checked(docs_of([(1, "a\u0000\u2028 b"), (2, "▁"), (3, "plain")]), MODEL).collect()
    assert {r.doc_id: r.round_trip for r in lost} == {i: lattice.library.decode(lattice.library.encode(t)) == t for i, t in [(1, "a\u0000\u2028 b"), (2, "▁"), (3, "plain")]}
    texts = {r.doc_id: r.text for r in sp.decode(sp.encode(docs, MODEL), MODEL).collect()}
    assert texts == dict(rows)
    odds = sp.encoded_and_decoded(odd, MODEL).collect()
    assert len(odds) == odd.count() and sum(r.doc_id is None for r in odds) == 1
    assert all(r.round_trip for r in odds)
    assert sp.encode(empty, MODEL).count() == 0


def test_tree_of_products(lattice, docs_of):
    """Several levels of products give the library's ids, whatever the fan."""
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice(["abc", " the", "ing", "漢", "  ", "zzzz"]) for _ in range(n))) for i, n in enumerate([2500, 900, 2501, 150])]
    for fan in (2, 5):
        found = {r.doc_id: list(r.ids) for r in sp.encode(docs_of(rows), MODEL, giant=500, chunk=100, fan=fan).collect()}
        assert found == {i: lattice.library.encode(t) for i, t in rows}


def test_groups_agree_with_one_chain(lattice):
    """States inside groups, given those at the groups' ends, are those of the whole chain."""
    text = "abcab theing  z漢" * 120
    z = sp.spaced(text)
    places = [*range(0, len(z), 90), len(z)]
    chain = [sp.transfer(lattice, z, p, q) for p, q in zip(places, places[1:], strict=False)]
    whole = sp.inner_states(chain, 0, None)
    at = 0
    for lo in range(0, len(chain), 4):
        part = chain[lo : lo + 4]
        assert sp.inner_states(part, at, whole[min(lo + 4, len(chain)) - 1]) == whole[lo : lo + 4]
        at = whole[min(lo + 4, len(chain)) - 1]


def test_back_pointers_without_cuts(lattice):
    """Between two states of a stretch without spaces the pieces come from the lattice alone."""
    text = "internationalization" * 8
    z = sp.spaced(text)
    ids = lattice.library.encode(text)
    ends = np.cumsum([len(lattice.library.id_to_piece(i)) for i in ids])
    assert lattice.piece_ids(z, lattice.way(z, (0, 0), len(z), (int(ends[-2]), int(ends[-1])))) == ids
