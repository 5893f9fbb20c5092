"""Ready-made plugins: embeddings, search events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collection import Collection, Plugin
from .functions.vector import l2_normalised

Embed = Callable[[list[str]], list[list[float]]]


def embedded(frame: DataFrame, properties: list[str], embed: Embed, target: str) -> DataFrame:
    """The frame with a vector column: the properties' texts, joined by '. ', embedded batch by batch, of length 1."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([l2_normalised(v) for v in embed(texts.tolist())])

    return frame.withColumn(target, run(F.concat_ws(". ", *[F.col(p) for p in properties])))


def embeddings_plugin(embed: Embed, property: str, properties: list[str]) -> Plugin:
    """Documents get a vector as they are inserted, and searches that have none get their term's."""

    def before_insert(collection: Collection, document: dict) -> None:
        document.setdefault(property, l2_normalised(embed([". ".join(str(document[p]) for p in properties if document.get(p))])[0]))

    def before_insert_many(collection: Collection, documents) -> None:
        for d in documents if isinstance(documents, list) else []:
            before_insert(collection, d)

    def frame(collection: Collection, documents: DataFrame) -> DataFrame:
        return documents if property in documents.columns else embedded(documents, properties, embed, property)

    def before_search(collection: Collection, params: dict, language: str) -> None:
        if params.get("mode") in ("vector", "hybrid") and not params.get("vector"):
            params["vector"] = {"property": property, "value": l2_normalised(embed([params.get("term") or ""])[0])}

    return Plugin("embeddings", {"beforeInsert": before_insert, "beforeInsertMultiple": before_insert_many, "beforeSearch": before_search}, frame=frame)


def events_plugin(events) -> Plugin:
    return Plugin("search-events", {"afterSearch": events.hook()})
