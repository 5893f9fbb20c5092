"""Text analysis: the same tokens from a column (as an expression) and from a query (in Python)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

#: The characters that part words, by language (negated classes of those that do not). Texts are in
#: lower case when they are split, so case needs no flag.
SPLITTERS = {
    "arabic": "[^a-z0-9أ-ي]+",
    "armenian": "[^a-z0-9ա-ֆ]+",
    "bulgarian": "[^a-z0-9а-яА-Я]+",
    "czech": "[^A-Z0-9a-zěščřžýáíéúůóťďĚŠČŘŽÝÁÍÉÓÚŮŤĎ-]+",
    "danish": "[^a-z0-9æøåÆØÅ]+",
    "dutch": "[^A-Za-zàèéìòóù0-9_'-]+",
    "english": "[^A-Za-zàèéìòóù0-9_'-]+",
    "finnish": "[^a-z0-9äöÄÖ]+",
    "french": "[^a-z0-9äâàéèëêïîöôùüûœç-]+",
    "german": "[^a-z0-9A-ZäöüÄÖÜß]+",
    "greek": "[^a-z0-9α-ωά-ώ]+",
    "hungarian": "[^a-z0-9áéíóöőúüűÁÉÍÓÖŐÚÜŰ]+",
    "indian": "[^a-z0-9अ-ह]+",
    "indonesian": "[^a-z0-9]+",
    "irish": "[^a-z0-9áéíóúÁÉÍÓÚ]+",
    "italian": "[^A-Za-zàèéìòóù0-9_'-]+",
    "lithuanian": "[^a-z0-9ąčęėįšųūžĄČĘĖĮŠŲŪŽ]+",
    "nepali": "[^a-z0-9अ-ह]+",
    "norwegian": "[^a-z0-9_æøåÆØÅäÄöÖüÜ]+",
    "portuguese": "[^a-z0-9à-úÀ-Ú]",
    "romanian": "[^a-z0-9ăâîșțĂÂÎȘȚ]+",
    "russian": "[^a-z0-9а-яА-ЯёЁ]+",
    "sanskrit": "[^a-z0-9A-Zāīūṛḷṃṁḥśṣṭḍṇṅñḻḹṝ]+",
    "serbian": "[^a-z0-9čćžšđČĆŽŠĐ]+",
    "slovenian": "[^a-z0-9čžšČŽŠ]+",
    "spanish": "[^a-z0-9A-Zá-úÁ-ÚñÑüÜ]+",
    "swedish": "[^a-z0-9_åÅäÄöÖüÜ-]+",
    "tamil": "[^a-z0-9அ-ஹ]+",
    "turkish": "[^a-z0-9çÇğĞıİöÖşŞüÜ]+",
    "ukrainian": "[^a-z0-9а-яА-ЯіїєІЇЄ]+",
}
#: The same as the words between: to find them is much faster than to split, since Java tests a negated class slowly.
WORDS = {language: "[" + splitter.removeprefix("[^").removesuffix("+") + "+" for language, splitter in SPLITTERS.items()}

#: Locale codes for sorting.
LOCALES = {
    "arabic": "ar", "armenian": "am", "bulgarian": "bg", "czech": "cz", "danish": "dk", "dutch": "nl", "english": "en",
    "finnish": "fi", "french": "fr", "german": "de", "greek": "gr", "hungarian": "hu", "indian": "in", "indonesian": "id",
    "irish": "ie", "italian": "it", "lithuanian": "lt", "nepali": "np", "norwegian": "no", "portuguese": "pt",
    "romanian": "ro", "russian": "ru", "sanskrit": "sk", "serbian": "rs", "slovenian": "ru", "spanish": "es",
    "swedish": "se", "tamil": "ta", "turkish": "tr", "ukrainian": "uk",
}

#: Letters with marks and the letters they count as.
FOLD_FROM = (
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿĀāĂăĄąĆćĈĉĊċČčĎďĐđĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĦħĨĩĪīĬĭĮįİı"
    "ĲĳĴĵĶķĸĹĺĻļĽľĿŀŁłŃńŅņŇňŉŊŋŌōŎŏŐőŒœŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŦŧŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽžſ"
)
FOLD_TO = (
    "AAAAAAACEEEEIIIIENOOOOOOUUUUYPsaaaaaaaceeeeiiiienoooooouuuuypyAaAaAaCcCcCcCcDdDdEeEeEeEeEeGgGgGgGgHhHhIiIiIiIiIi"
    "IiJjKkkLlLlLlLlLlNnNnNnnNnOoOoOoOoRrRrRrSsSsSsSsTtTtTtUuUuUuUuUuUuWwYyYZzZzZzs"
)
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def fold(text: str) -> str:
    return text.translate(_FOLD)


def fold_column(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


@dataclass(frozen=True)
class Analyzer:
    """How text becomes tokens: lower case, split, stop words, stem, fold, drop the empty, keep the first of equals."""

    language: str = "english"
    stemmer: Callable[[str], str] | None = None
    stop_words: tuple[str, ...] = ()
    allow_duplicates: bool = False
    stemmer_skip: frozenset[str] = field(default_factory=frozenset)
    tokenize_skip: frozenset[str] = field(default_factory=frozenset)

    @staticmethod
    def create(
        language: str = "english",
        stemming: bool = False,
        stemmer: Callable[[str], str] | None = None,
        stop_words: list[str] | Callable[[list[str]], list[str]] | bool | None = None,
        allow_duplicates: bool = False,
        stemmer_skip: list[str] = (),
        tokenize_skip: list[str] = (),
    ) -> Analyzer:
        """Check options. English stemming has a stemmer of its own; other languages need one. Stop words are off
        unless a list is given, or a function that makes one from the defaults."""
        from .stem import STEMMERS
        from .stopwords import default_stop_words

        if language not in SPLITTERS:
            raise EngineError("LANGUAGE_NOT_SUPPORTED", language)
        if stemmer is not None and not callable(stemmer):
            raise EngineError("INVALID_STEMMER_FUNCTION_TYPE")
        if (stemming or stemmer) and stemmer is None:
            stemmer = STEMMERS.get(language)
            if stemmer is None:
                raise EngineError("MISSING_STEMMER", language)
        words = stop_words
        if callable(words):
            words = words(default_stop_words(language))
        if words in (None, False):
            words = []
        if not isinstance(words, list | tuple) or not all(isinstance(w, str) for w in words):
            raise EngineError("CUSTOM_STOP_WORDS_MUST_BE_FUNCTION_OR_ARRAY")
        return Analyzer(language, stemmer, tuple(words), allow_duplicates, frozenset(stemmer_skip), frozenset(tokenize_skip))

    def _stems(self, prop: str | None) -> bool:
        return self.stemmer is not None and prop not in self.stemmer_skip

    def tokens(self, text: Column, prop: str) -> Column:
        """Tokens of a string column; null for null. Words are folded as one text, and only where some letter is not
        ASCII, since functions of arrays that take a lambda are not compiled and cost more than all else."""
        if prop in self.tokenize_skip:
            words = F.when(text.isNotNull(), F.array(text))
        else:
            words = self._distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS[self.language]), F.lit(0)))
        if self.stop_words:
            stops = F.array(*[F.lit(w) for w in self.stop_words])
            words = F.filter(words, lambda w: ~F.array_contains(stops, w))
        if self._stems(prop):
            words = _stem_udf(self.stemmer)(words)
        if prop in self.tokenize_skip or self._stems(prop):  # words of any characters
            words = self._distinct(F.transform(words, fold_column))
        else:
            folded = F.split(fold_column(F.array_join(words, " ")), " ")  # none of the words has a space
            words = F.when(F.octet_length(text) > F.char_length(text), self._distinct(folded)).otherwise(words)
        return F.array_remove(words, "")

    def _distinct(self, words: Column) -> Column:
        return words if self.allow_duplicates else F.array_distinct(words)

    def query_tokens(self, text: str, prop: str | None = None) -> list[str]:
        """The same for one text of a query; a query names no property unless it comes from a filter."""
        return self.lowered_tokens(text if prop in self.tokenize_skip else text.lower(), prop)

    def lowered_tokens(self, text: str, prop: str | None = None) -> list[str]:
        """The same for a text that is in lower case already."""
        words = [text] if prop in self.tokenize_skip else re.findall(WORDS[self.language], text)
        if self.stop_words:
            words = [w for w in words if w not in self.stop_words]
        if self._stems(prop):
            words = [self.stemmer(w) if w else w for w in words]
        if not text.isascii() or self._stems(prop):
            words = map(fold, words)
        found = filter(None, words)
        return list(found) if self.allow_duplicates else list(dict.fromkeys(found))


#: Runs of characters that belong to words in some language; those that no class above keeps part words in all.
COARSE = re.compile(r"[A-Za-z0-9_'\-\x80-\U0010ffff]+")
REMEMBERED = 20_000


def count_by_language(texts: Iterator[str], languages: list[str]) -> Iterator[list[int]]:
    """For each text, in lower case: how many distinct tokens it has in each language, without stop words and stems. A run
    of ASCII letters and digits is one token in all of them. Other runs are looked at once for all languages that keep
    the same ones of the text's other characters."""
    finders = [re.compile(WORDS[n]) for n in languages]
    alike: dict[frozenset[str], list[list[int]]] = {}
    for text in texts:
        runs = set(COARSE.findall(text))
        other = [r for r in runs if not (r.isascii() and r.isalnum())]
        if not other:
            yield [len(runs)] * len(languages)
            continue
        runs.difference_update(other)
        rest = " ".join(other)
        signs = frozenset(c for c in set(rest) if not (c.isascii() and c.isalnum()))
        if signs not in alike:
            if len(alike) > REMEMBERED:
                alike.clear()
            groups: dict[tuple[bool, ...], list[int]] = {}
            for i, f in enumerate(finders):
                groups.setdefault(tuple(f.match(c) is not None for c in signs), []).append(i)
            alike[signs] = list(groups.values())
        out = [0] * len(languages)
        for group in alike[signs]:
            n = len(runs) + len(set(fold(" ".join(finders[group[0]].findall(rest))).split()) - runs)
            for i in group:
                out[i] = n
        yield out


def _stem_udf(stemmer: Callable[[str], str]):
    """Stems arrays of words batch by batch; each distinct word of a batch is stemmed once."""

    @F.pandas_udf("array<string>")
    def stem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            out = []
            for words in batch:
                if words is None:
                    out.append(None)
                    continue
                for w in words:
                    if w not in known:
                        known[w] = stemmer(w) if w else w
                out.append([known[w] for w in words])
            yield pd.Series(out)

    return stem


def whole_word(term: str) -> str:
    """A pattern of a term as a whole word, with ASCII word boundaries."""
    head = r"(?<![A-Za-z0-9_])" if re.match(r"[A-Za-z0-9_]", term) else r"(?<=[A-Za-z0-9_])"
    tail = r"(?![A-Za-z0-9_])" if re.search(r"[A-Za-z0-9_]$", term) else r"(?=[A-Za-z0-9_])"
    return head + re.sub(r"([^\w\s])", r"\\\1", term, flags=re.ASCII) + tail


def bounded_levenshtein(term: Column, word: Column, most: int) -> Column:
    """Whether a word is within `most` edits of a term, or begins with it."""
    return word.startswith(term) | (F.levenshtein(term, word, most) >= 0)


def format_nanoseconds(value: int) -> str:
    for unit, size in (("s", 1_000_000_000), ("ms", 1_000_000), ("μs", 1_000)):
        if value >= size:
            return f"{value // size}{unit}"
    return f"{value}ns"


def format_bytes(size: int, decimals: int = 2) -> str:
    if size == 0:
        return "0 Bytes"
    units = ["Bytes", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]
    power = 0
    while size >= 1024 ** (power + 1) and power < len(units) - 1:
        power += 1
    text = f"{size / 1024**power:.{max(0, decimals)}f}"
    return f"{text.rstrip('0').rstrip('.') if '.' in text else text} {units[power]}"
