"""Analysis: columns and queries give the same tokens; stems; a plain-Python scorer as a second opinion."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.collection import Collection
from tessera.errors import EngineError
from tessera.functions.cjk import ScriptAnalyzer
from tessera.functions.stem import STEMMERS, porter
from tessera.functions.text import SPLITTERS, Analyzer, count_by_language, fold
from tessera.operators import score
from tessera.search import search


@pytest.mark.parametrize("language", sorted(SPLITTERS))
def test_column_and_query_agree(spark, language):
    texts = ["Hello, world! It's well-known: àèé ÀÉ ñ ß", "", "x_y-z 12.5 Ærø Çok ışık", "Привет мир ёж їжак", "कमल அம்மா αβγ άλφα", "  "]
    a = Analyzer.create(language)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", a.tokens(F.col("t"), "t").alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: a.query_tokens(t) for i, t in enumerate(texts)}


def test_all_languages_are_counted_in_one_pass(spark):
    """one look at each text gives what each language's own analysis gives, and the query's plan splits no text."""
    from tessera.state_queries import tokens_by_language

    texts = ["Hello, world! It's well-known: àèé ÀÉ ñ ß e e", "", "x_y-z 12.5 Ærø Çok ışık a-a a", "Привет мир ёж їжак", "कमल அம்மா αβγ άλφα", "  ", "é e É-e 'e' e_ ĳ i\u2028b\u00a0b"]
    languages = list(SPLITTERS)
    wanted = [[len(Analyzer.create(n).query_tokens(t)) for n in languages] for t in texts]
    assert list(count_by_language((t.lower() for t in texts), languages)) == wanted
    plan = tokens_by_language(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "split" not in plan and "regexp" not in plan


def test_column_tokens_take_no_lambda(spark):
    """F5 to F21: words are found by a class that is not negated and folded as one text, in compiled code."""
    frame = spark.createDataFrame([("Été à la plage",)], "t string").select(Analyzer.create("french").tokens(F.col("t"), "t").alias("x"))
    assert frame.first().x == ["ete", "a", "la", "plage"]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "[^" not in plan


def test_a_search_analyses_texts_once(spark):
    """F6 to F20: postings, dictionary and statistics of a search come from one analysis, and a second look at the same
    query from none; another query is looked up anew."""
    asked = []

    class Noted(Analyzer):
        def tokens(self, text, prop):
            asked.append(prop)
            return super().tokens(text, prop)

    db = Collection(spark, {"t": "string"}, analyzer=Noted())
    db.insert_multiple([{"id": str(i), "t": t} for i, t in enumerate(["ab abc b", "b ba", "", "cab ab"])])
    for term, threshold in (("ab b", 0), ("ab b", 1), ("ca", 1)):
        found = search(db, {"term": term, "threshold": threshold})
        assert found.collect()["count"] == {("ab b", 0): 1, ("ab b", 1): 3, ("ca", 1): 1}[term, threshold]
        expected = plain_scores(["ab abc b", "b ba", "", "cab ab"], term)
        if threshold:
            assert {r["_iid"] - 1: round(r.score, 9) for r in found.ranking.rows.collect()} == {i: round(s, 9) for i, s in expected.items()}
    assert asked == ["t", "t"]


def test_sentences_are_counted_in_their_row(spark):
    """texts are analysed once for the scorer by sentences, without a shuffle of all words, by both ways alike."""

    class Own(Analyzer):
        """Not the library's own class, so sentences are counted by columns."""

    texts = ["Ab abc. B ab? ab! é É. " * 3, "b. ba", "", "a. b. " * 25 + "ab c", "x"]
    rows = {}
    for kind in (Analyzer, Own):
        db = Collection(spark, {"t": "string", "u": "string"}, analyzer=kind(), scorer="qps")
        db.insert_multiple([{"id": str(i), "t": t, **({"u": t[::-1]} if i % 2 else {})} for i, t in enumerate(texts)])
        found = search(db, {"term": "ab b", "threshold": 0.5}).ranking.rows
        index = score.sentence_postings(db.index, ["t", "u"], db.docs)
        rows[kind] = {tuple(r) for r in found.collect()}, {tuple(r) for r in index.select("_iid", "prop", "token", "occ", "mask", "n").collect()}
        assert index.schema["occ"].dataType.simpleString() == "bigint" and index.schema["mask"].dataType.simpleString() == "int"
        if kind is Analyzer:
            assert "Aggregate" not in index._jdf.queryExecution().optimizedPlan().toString()
    assert rows[Analyzer] == rows[Own] and all(rows[Analyzer])


def test_options(spark):
    a = Analyzer.create("english", stemming=True, stop_words=["the"], stemmer_skip=["raw"], tokenize_skip=["whole"])
    one = lambda text, prop: spark.createDataFrame([(text,)], "t string").select(a.tokens(F.col("t"), prop)).first()[0]
    assert one("the Connected connects", "t") == ["connect"] == a.query_tokens("the connecting")
    assert one("connections", "raw") == ["connections"]
    assert one("The Whole Text", "whole") == ["The Whole Text"] or len(one("The Whole Text", "whole")) == 1
    assert Analyzer.create("english", allow_duplicates=True).query_tokens("a b a") == ["a", "b", "a"]
    assert Analyzer.create("english", stop_words=lambda words: [*words[:0], "x"]).query_tokens("x y") == ["y"]
    for options, code in (({"language": "sanskrit", "stemming": True}, "MISSING_STEMMER"), ({"stemmer": 5}, "INVALID_STEMMER_FUNCTION_TYPE"), ({"stop_words": [1]}, "CUSTOM_STOP_WORDS_MUST_BE_FUNCTION_OR_ARRAY")):
        with pytest.raises(EngineError) as e:
            Analyzer.create(**options)
        assert e.value.code == code


def test_fold():
    assert fold("ÀÉçßŁőž×÷") == "AEcsLoz×÷"


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
     ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condition"), ("connection", "connec"), ("vietnamization", "vietnam"),
     ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("replacement", "replac"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"),
     ("roll", "roll"), ("is", "is"), ("yes", "ye")],
)
def test_porter(word, stem):
    assert porter(word) == stem


@pytest.mark.parametrize(
    ("language", "word", "stem"),
    [("german", "aufeinanderfolgenden", "aufeinanderfolg"), ("german", "häuser", "haus"), ("german", "kategorischen", "kategor"), ("german", "freundlichkeit", "freundlich"), ("german", "katers", "kat"),
     ("swedish", "jaktkarlarne", "jaktkarl"), ("swedish", "klockornas", "klock"), ("swedish", "friskt", "frisk"), ("norwegian", "havnedistriktene", "havnedistrikt"), ("norwegian", "opplysningen", "opplysning"),
     ("danish", "undersøgelserne", "undersøg"), ("danish", "indtage", "indtag"), ("russian", "важнейшими", "важн"), ("russian", "красивая", "красив"), ("russian", "книгами", "книг"), ("russian", "бегавшая", "бега")],
)
def test_other_stems(language, word, stem):
    assert STEMMERS[language](word) == stem


def plain_scores(texts: list[str], term: str, tolerance: int = 0) -> dict[int, float]:
    def tokens(t):
        return list(dict.fromkeys(w for w in (fold(x) for x in re.split(SPLITTERS["english"], t.lower())) if w))

    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1] <= tolerance

    docs = {i: tokens(t) for i, t in enumerate(texts)}
    average = sum(map(len, docs.values())) / len(docs)
    out: dict[int, float] = {}
    for q in tokens(term):
        for word in {w for d in docs.values() for w in d if w.startswith(q) or (tolerance and near(w, q))}:
            holders = [i for i, d in docs.items() if word in d]
            idf = math.log(1 + (len(docs) - len(holders) + 0.5) / (len(holders) + 0.5))
            for i in holders:
                tf = 1 / len(docs[i])
                out[i] = out.get(i, 0) + idf * (0.5 + tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len(docs[i]) / average))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("ab abc b ba cab ca".split()), min_size=1, max_size=6).map(" ".join), min_size=1, max_size=6), st.sampled_from(["ab", "ca b", "abd"]), st.integers(0, 1))
def test_scores_against_plain_python(spark, texts, term, tolerance):
    db = Collection(spark, {"t": "string"})
    db.insert_multiple([{"id": str(i), "t": t} for i, t in enumerate(texts)])
    rows = search(db, {"term": term, "tolerance": tolerance}).ranking.rows.collect()
    expected = plain_scores(texts, term, tolerance)
    assert {r["_iid"] - 1: round(r.score, 9) for r in rows} == {i: round(s, 9) for i, s in expected.items()}


def test_running_average(spark):
    db = Collection(spark, {"t": "string"})
    db.insert_multiple([{"t": "a b c"}, {}, {"t": "a"}, {}])
    average = 0.0
    for n, length in enumerate([3, None, 1, None], 1):
        if length is not None:
            average = (average * (n - 1) + length) / n
    assert db.index.sequential_average("t").first().avg_len == pytest.approx(average)


@pytest.mark.parametrize("language", ["japanese", "mandarin"])
def test_scripts_without_spaces(spark, language):
    a = ScriptAnalyzer(language, stop_words=("の",))
    texts = ["東京都の天気 カメラ sunny", "早睡早起身体好", "", "々々 ABC123"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", a.tokens(F.col("t"), "t").alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: a.query_tokens(t) for i, t in enumerate(texts)}
    assert a.query_tokens(texts[0]) == ["東京", "京都", "天気", "カメラ", "sunny"]
    db = Collection(spark, {"t": "string"}, analyzer=a)
    db.insert_multiple([{"id": "1", "t": texts[1]}, {"id": "2", "t": texts[0]}])
    assert [h["id"] for h in search(db, {"term": "天気"}).collect()["hits"]] == ["2"]


def test_stemmers_stand_any_word():
    """No stemmer fails or lengthens a word by more than a letter, whatever the letters."""
    import random

    from tessera.functions.stem import STEMMERS

    for language, stem in STEMMERS.items():
        rnd = random.Random(language)
        for _ in range(3000):
            word = "".join(rnd.choice("aeioucdlmnrstgmqyáéèçäößабнщть") for _ in range(rnd.randint(1, 12)))
            assert len(stem(word)) <= len(word) + word.count("ß") + 1, (language, word)


def test_stem_samples():
    from tessera.functions.stem import STEMMERS
    from tessera.state_queries import stem_rows

    assert [(n, w, STEMMERS[n](w)) for n, w, _ in stem_rows()] == stem_rows()
