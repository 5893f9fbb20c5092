"""Chinese and Japanese text without spaces.

Words need a dictionary, which Spark does not have. These analyzers take runs of one script as words and runs of
ideographs as overlapping pairs of characters, the usual way to search such text without one. Letters keep their case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = "[\u4e00-\u9fff\u3400-\u4dbf々]+|[\u3041-\u309f]+|[\u30a0-\u30ffー]+|[A-Za-z0-9_]+"
IDEOGRAPHS = "^[\u4e00-\u9fff\u3400-\u4dbf々]"


@dataclass(frozen=True)
class ScriptAnalyzer:
    """Tokens by script, without repetition unless allowed; stop words are dropped."""

    language: str = "japanese"
    stop_words: tuple[str, ...] = ()
    allow_duplicates: bool = False

    def tokens(self, text: Column, prop: str) -> Column:
        runs = F.regexp_extract_all(text, F.lit(f"({RUN})"), 1)

        def pairs(run: Column) -> Column:
            split = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
            return F.when(run.rlike(IDEOGRAPHS) & (F.length(run) > 2), split).otherwise(F.array(run))

        found = F.flatten(F.transform(runs, pairs))
        if self.stop_words:
            found = F.filter(found, lambda w: ~w.isin(list(self.stop_words)))
        return F.when(text.isNotNull(), found if self.allow_duplicates else F.array_distinct(found))

    def query_tokens(self, text: str, prop: str | None = None) -> list[str]:
        found: list[str] = []
        for run in re.findall(RUN, text):
            found += [run[i : i + 2] for i in range(len(run) - 1)] if re.match(IDEOGRAPHS, run) and len(run) > 2 else [run]
        found = [w for w in found if w not in self.stop_words]
        return found if self.allow_duplicates else list(dict.fromkeys(found))
