"""Stop words: Spark's own lists, by language."""

from __future__ import annotations

#: Languages that Spark has lists for.
KNOWN = ["danish", "dutch", "english", "finnish", "french", "german", "hungarian", "italian", "norwegian", "portuguese", "russian", "spanish", "swedish", "turkish"]


def default_stop_words(language: str) -> list[str]:
    """Spark's stop words of a language; none where it has no list, or where no session runs."""
    from pyspark.ml.feature import StopWordsRemover
    from pyspark.sql import SparkSession

    if language not in KNOWN or SparkSession.getActiveSession() is None:
        return []
    return list(StopWordsRemover.loadDefaultStopWords(language))
