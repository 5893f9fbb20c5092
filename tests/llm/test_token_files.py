import io
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard

from tessera.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_quick_way_equals_library():
    from tokenizers import Tokenizer

    texts = ["Don't stop! it's 12²½ x_y --- «ñandú» ŒUVRE", "<|endoftext|> a", "İstanbul ǆ ﬁ Σας", "''s 'tis we'll've", "a\u00adb\u00a0c", "", " \n\t ", "é漢🎉", "ſt ŉ ĸ Ÿ", "a" * 3000, "e\u0301"]
    library = Tokenizer.from_file(PATH)
    found = tf.WordEncoder(PATH).encode(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_one_file():
    out = io.BytesIO()
    writer = tf.FrameWriter(out, frame_bytes=64)
    docs = [(i * 3, np.arange(i % 9, dtype="<u4").tobytes()) for i in range(50)] + [(None, b"\x01\0\0\0")]
    for d, b in docs:
        writer.add(d, b)
    writer.finish()
    reader = tf.FrameReader(io.BytesIO(out.getvalue()))
    assert [reader.document(n).tobytes() for n in range(51)] == [b for _, b in docs]
    assert reader.find(33) == [11] and reader.find(1) == []
    one = tf.FrameReader(io.BytesIO(out.getvalue()))
    one.document(30)
    assert one.fetched == 1 and len(one.frames) > 5
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True)
    assert plain.read(len(b"".join(b for _, b in docs))) == b"".join(b for _, b in docs)
    damaged = bytearray(out.getvalue())
    bad = tf.FrameReader(io.BytesIO(bytes(damaged)))
    bad.frames = bad.frames.copy()
    bad.frames[0, 2] ^= 1
    with pytest.raises(ValueError):
        bad.document(3)


def test_frames(docs_of, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 101, f"Text number {i} " * (i % 5)) for i in range(100)]
    found = {r.doc_id: r for r in tf.token_files(docs_of(rows), PATH).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odds = tf.token_files(odd, PATH).orderBy("start").collect()
    assert len(odds) == odd.count() and odds[0].doc_id is None
    assert [r.start for r in odds] == [sum(x.n_tokens for x in odds[:i]) for i in range(len(odds))]
    assert tf.token_files(empty, PATH).count() == 0


def test_random_texts_equal_library():
    from tokenizers import Tokenizer

    rnd = random.Random(11)
    alphabet = [*"abcXYZ019 '-_.,!?\n\t", " the", "'s", "'ll", "ing", "é", "ß", "ñ", "²", "½", "Œ", "\u00a0", "«", "漢"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    library = Tokenizer.from_file(PATH)
    found = tf.WordEncoder(PATH).encode(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_long_documents_go_on_in_frames():
    out = io.BytesIO()
    writer = tf.FrameWriter(out, frame_bytes=64)
    docs = [(1, 3), (2, 200), (3, 16), (4, 17), (5, 0), (6, 1), (7, 40)]
    for d, n in docs:
        writer.add(d, np.arange(n, dtype="<u4").tobytes())
    writer.finish()
    reader = tf.FrameReader(io.BytesIO(out.getvalue()))
    assert reader.frames[:, 1].max() <= 128
    assert [reader.document(n).tolist() for n in range(len(docs))] == [list(range(n)) for _, n in docs]


def test_requested_documents_only(spark, docs_of, monkeypatch, tmp_path):
    """Reading some documents gives their ids, and opens no frame without one of them."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = [(i // 2, f"some words of text {i} " * 20) for i in range(400)] + [(None, "no key")]
    path = f"file://{tmp_path}/ids"
    manifest = tf.write_files(docs_of(rows), path, PATH, 2, partitions=5)
    wanted = [3, 77, 77, 150, 9999, None]
    found = tf.read_documents(manifest, path, spark.createDataFrame([(i,) for i in wanted], "doc_id long"))
    right = sorted((i, [*library.encode(t, add_special_tokens=False).ids, 2]) for i, t in rows if i in {3, 77, 150})
    assert sorted((r.doc_id, list(r.ids)) for r in found.collect()) == right
    assert tf.read_documents(manifest, path, spark.createDataFrame([], "doc_id long")).count() == 0
    files = manifest.where("first is not null").collect()
    with open(files[0].file, "rb") as f:
        reader = tf.FrameReader(f)
        reader.document(reader.find(files[0]["first"])[0])
        assert reader.fetched == 1


def test_one_key_over_several_files(docs_of):
    """A key, null or not, that holds most rows is spread over files, and starts still add up."""
    rows = [(None, f"text {i % 50}") for i in range(300)] + [(5, "same")] * 200
    found = sorted(tf.token_files(docs_of(rows), PATH).collect(), key=lambda r: r.start)
    assert len(found) == 500 and [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(500)]
    assert [r.doc_id for r in found] == [None] * 300 + [5] * 200


def test_known_words_cost_less_than_the_pattern():
    """Words met before take less CPU than the tokenizer's pattern over the text alone."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnopé", k=rnd.randint(1, 8))) for _ in range(5000)]
    texts = [" ".join(rnd.choices(words, k=3000)) + ", don't." for _ in range(60)]
    pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{tf.LETTERS}]+|[{tf.NUMBERS}]|[^\\s{tf.LETTERS}{tf.NUMBERS}]+")
    encoder = tf.WordEncoder(PATH)
    encoder.encode(texts)

    def least(run):
        spent = []
        for _ in range(7):
            begun = time.process_time()
            run()
            spent.append(time.process_time() - begun)
        return min(spent)

    assert least(lambda: encoder.encode(texts)) < least(lambda: [pattern.findall(t.lower()) for t in texts])


def test_every_quick_character_in_its_place():
    """Characters at ends of texts, twice, in words, by apostrophes; texts of a batch do not touch each other."""
    from tokenizers import Tokenizer

    forms = ["{0}", "{0}{0}", "a{0}b", "'{0}s", "9{0}'d{0}'RE", " {0}' {0}'s's'tt", "'", "s", "{0}'l", "l"]
    texts = [f.format(chr(c)) for c in range(0x250) for f in forms]
    library = Tokenizer.from_file(PATH)
    right = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    encoder = tf.WordEncoder(PATH)
    assert encoder.encode(texts) == right
    assert encoder.encode([]) == [] and encoder.encode(["", " ", "\n"]) == [b"", b"", b""]


def test_forgotten_words_are_asked_again(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tf.WordEncoder, "REMEMBERED", 5)
    encoder, library = tf.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for i in range(6):
        texts = [f"word{chr(97 + i)} again and some words more", f"only{chr(98 + i)} here"]
        assert [np.frombuffer(f, "<u4").tolist() for f in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.words) < 20
