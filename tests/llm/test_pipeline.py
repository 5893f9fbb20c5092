"""The pipeline's stages and the registered queries, whole and row by row, against plain versions on the smallest tables."""

import hashlib
import math
import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_mixing import plain_exponent
from test_ngram_join import components_of
from test_sanitize import plain, plain_spans
from test_urls import plain as plain_url
from test_urls import plain_features

from tessera.llm import ngram_join, ordinal, queries, urls
from tessera.llm.common import stage


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def stages(spark, sf):
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], sf), name))
    return out


def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def shape(word):
    return "[number]" if re.search(r"\d", word) else "[Name]" if word[0].isupper() else "[word]"


def sanitised(text, spans):
    out, end = "", 0
    for span in filter(None, spans.split(",")):
        kind, a, b = span.split(":")
        a, b = int(a), int(b)
        out += text[end : max(end, a)] + (shape(text[a:b]) if kind == "hint" else f"[{kind}]")
        end = max(end, b)
    return out + text[end:]


def test_stages(spark, sf, stages):
    given, good, single, clean, mixed, ids = stages
    assert all(s.columns == given.columns for s in stages[:-1])
    graded = queries.table(spark, sf, "labels").select("doc_id", ordinal.label_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    dense = (model := ordinal.train(given, graded, levels=3)).dense()
    expect = {r.doc_id for r in given.collect() if sum(dense[i] for i in ordinal.features(r.text)) >= model.thresholds[1]}
    assert {r.doc_id for r in good.collect()} == expect

    rows = [(r.doc_id, r.text) for r in good.collect()]
    least: dict = {}
    for (i, _), root in zip(rows, components_of(rows), strict=True):
        least[root] = min(i, least.get(root, i))
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values())

    texts = {r.doc_id: r.text for r in single.collect()}
    spans = plain_spans(texts.values())
    assert {r.doc_id: r.text for r in clean.collect()} == {i: t if not t else sanitised(t, spans[t]) for i, t in texts.items()}

    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {(r.doc_id, r.text) for r in mixed.collect()} == set(texts.items())
    assert mixed.count() <= 2 * len(texts)
    found = ids.collect()
    assert len(found) == mixed.count()
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in found)
    lib = library()
    assert all(list(r.ids) == lib.encode(texts[r.doc_id] or "") and r.round_trip == (lib.decode(list(r.ids)) == (texts[r.doc_id] or "")) for r in found)
    assert corpus_pipeline.run(spark, sf).count() == ids.count()


def test_quality_held_out(spark):
    """On labelled documents that training does not see, kept ones are good and others are not."""
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    graded = queries.table(spark, sf, "labels").select("doc_id", ordinal.label_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = ordinal.train(docs, graded.where(~out), levels=3)
    rows = ordinal.grade(docs, model).join(graded.where(out).where("grade is not null"), "doc_id").select("keep", "grade").collect()
    assert len(rows) > 60
    assert sum(r.keep == (r.grade == 2) for r in rows) >= 0.85 * len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.sql(queries.ORACLES[name])
    columns = found.columns
    rows = sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, sf).collect())
    assert rows == sorted(found.fetchall())


def collected(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def test_op1(spark, sf, docs):
    rows = collected(spark, sf, "op1_reshard")
    raw = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    assert sorted(r.doc_id for r in rows) == sorted(raw)
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw[r.doc_id]) + 16, zlib.crc32(raw[r.doc_id]), "bytes", None) for r in rows)
    source = {d["doc_id"]: d["source"] for d in docs}
    assert all(r.old_shard == zlib.crc32(source[r.doc_id].encode()) % 32 for r in rows if source[r.doc_id] is not None)
    shards: dict = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) <= set(range(40)) and all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    sizes = [sum(r["size"] for r in shards.get(j, [])) for j in range(40)]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in rows)


def test_op2(spark, sf, docs):
    graded = queries.table(spark, sf, "labels").select("doc_id", ordinal.label_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    dense = (model := ordinal.train(queries.table(spark, sf, "documents"), graded, levels=3)).dense()
    text = {d["doc_id"]: d["text"] for d in docs}
    rows = collected(spark, sf, "op2_ordinal_quality")
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        tail = [1 / (1 + math.exp(t - sum(dense[i] for i in ordinal.features(text[r.doc_id])))) for t in model.thresholds]
        assert [r.p_not_toxic, r.p_good, r.expected_grade] == pytest.approx([*tail, sum(tail)]) and r.keep == (tail[1] >= 0.5)


def test_op3(spark, sf):
    pages, *more = (queries.table(spark, sf, n) for n in ("pages", "documents", "labels"))
    bias, weights = urls.fit(urls.labelled_urls(pages, *more))
    url = {r.page_id: r.url for r in pages.collect()}
    rows = collected(spark, sf, "op3_url_filter")
    assert sorted(r.page_id for r in rows) == sorted(url)
    for r in rows:
        host, path, rule, verdict = plain_url(url[r.page_id])
        x = plain_features(url[r.page_id])
        p = 1 / (1 + math.exp(-(bias + sum(weights[i] for i in x) / math.sqrt(len(x) or 1))))
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.block_probability == pytest.approx(p)
        assert r.verdict == (verdict or ("block" if p >= 0.5 else "allow"))


def test_op4(spark, sf, docs):
    lib, text = library(), {d["doc_id"]: d["text"] or "" for d in docs}
    rows = collected(spark, sf, "op4_sentencepiece")
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        ids = lib.encode(text[r.doc_id])
        back = lib.decode(ids)
        assert (r.n_tokens, r.ids_crc32, r.decoded_chars, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(back), back == text[r.doc_id])


def test_op6(spark, sf, docs):
    text = {d["doc_id"]: d["text"] or "" for d in docs}
    spans = plain_spans(text.values())
    rows = collected(spark, sf, "op6_pii")
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        base = plain(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[3] == k for b in base) for k in ("email", "ip", "card", "phone")]
        assert r.spans == spans[text[r.doc_id]]


def test_op8(spark, sf, docs):
    """Weights by the plain search of the exponent; every row once in each epoch that its block reaches."""
    rows = collected(spark, sf, "op8_temperature_mix")
    tokens: dict = {}
    size = {d["doc_id"]: max(1, math.ceil(len((d["text"] or "").encode()) / 4)) for d in docs}
    for d in docs:
        tokens[d["source"]] = tokens.get(d["source"], 0) + size[d["doc_id"]]
    e = rows[0].mix_exponent
    assert e == pytest.approx(plain_exponent(list(tokens.values()), 0.95, 2.0), abs=1.01 / 4096)
    total = sum(tokens.values())
    mass = sum((t / total) ** e for t in tokens.values())
    cover = mass * max((t / total) ** (1 - e) for t in tokens.values())
    seen: dict = {}
    for r in rows:
        assert r.mix_weight == pytest.approx((tokens[r.source] / total) ** e / mass)
        seen.setdefault(r.source, []).append(r)
    for source, t in tokens.items():
        quota = max(t, math.floor(seen[source][0].mix_weight * cover * total))
        got = sum(size[r.doc_id] for r in seen[source])
        assert quota <= got < quota + max(size.values())
        assert {r.doc_id for r in seen[source] if r.mix_epoch == 0} == {d["doc_id"] for d in docs if d["source"] == source}
        assert len({(r.doc_id, r.mix_epoch) for r in seen[source]}) == len(seen[source])


def test_op9(spark, sf, docs):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    found = {r.doc_id: r for r in collected(spark, sf, "op9_token_files")}
    assert len(found) == len(docs)
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        r = found[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op10(spark, sf, docs):
    rows = {r.doc_id: r for r in collected(spark, sf, "op10_avi_media")}
    assert len(rows) == len(docs)
    for d in docs:
        raw, r = (d["text"] or "").encode(), rows[d["doc_id"]]
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > len(payload) and r.feature.startswith("shots=") and r.error is None
    same = random.Random(1).sample(docs, 20)
    assert all(rows[a["doc_id"]].media_sha256 == rows[b["doc_id"]].media_sha256 for a in same for b in docs if a["text"] == b["text"])


def test_recall_of_the_join(spark):
    """Links found against all pairs that share an n-gram."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    holders, sets = {}, {}
    for i, t in rows:
        w = ngram_join.text_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for found in holders.values() for k, a in enumerate(found) for b in found[k + 1 :]}
    links = dict.fromkeys(sets, 0)
    for a, b in pairs:
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            links[a] += 1
            links[b] += 1
    found = {r.doc_id: r.n_links for r in queries.op5_ngram_join(spark, sf).collect()}
    assert all(found[i] <= n for i, n in links.items())
    assert sum(found.values()) >= 0.999 * sum(links.values()) > 0
