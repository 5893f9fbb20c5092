"""Structured Streaming: documents that arrive go into an index on disk, search events into windows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import Analyzer
from ..operators.index import TextIndex, frequencies, write_dictionary, write_postings
from ..schema import Schema


def document_deltas(changes: DataFrame, schema: Schema, analyzer: Analyzer) -> DataFrame:
    """(prop, token, df, docs): what a batch of changes adds to the document frequencies.

    changes: _iid, op (+1 for an inserted document, -1 for a removed one) and the properties. Counts add up over
    batches, so nothing drifts.
    """
    index = TextIndex(schema, analyzer, changes)
    props = schema.searchable
    rows = index.analysed(props).join(changes.select("_iid", "op"), "_iid")
    return rows.select("prop", F.explode(F.array_distinct("tokens")).alias("token"), "op").groupBy("prop", "token").agg(F.sum("op").cast("long").alias("df"))


def updated_index(index: TextIndex, inserted: DataFrame, removed: DataFrame, path: str) -> None:
    """Write under path what a stored index becomes when documents (in the form of Collection.docs) are inserted and
    others (_iid) removed. Postings of removed documents go and those of inserted ones come; document frequencies and
    field statistics change by their differences, so that only texts that come or go are analysed."""
    schema, analyzer, props = index.schema, index.analyzer, index.schema.searchable
    leaving = TextIndex(schema, analyzer, index.docs.join(removed.select("_iid").distinct(), "_iid", "left_semi"))
    gone = index.postings(props).join(removed.select("_iid"), "_iid", "left_semi")
    kept = index.postings(props).join(removed.select("_iid"), "_iid", "left_anti")
    coming = TextIndex(schema, analyzer, inserted)
    staying = index.analysed(props).join(removed.select("_iid"), "_iid", "left_anti")
    staying.unionByName(coming.analysed(props)).write.partitionBy("prop").mode("overwrite").parquet(f"{path}/analysed")
    new = coming.postings(props)
    write_postings(kept.unionByName(new), path)

    repeated = analyzer.allow_duplicates
    minus = frequencies(gone, repeated).withColumn("df", -F.col("df"))
    changed = index.dictionary(props).unionByName(frequencies(new, repeated)).unionByName(minus)
    write_dictionary(changed.groupBy("prop", "token").agg(F.sum("df").alias("df")).where("df > 0"), path)

    def fields(rows: DataFrame, sign: int) -> DataFrame:
        return rows.groupBy("prop").agg((sign * F.sum("field_len")).alias("total"), (sign * F.count("*")).alias("n_fields"))

    old = index.stored["field_stats"]
    sums = old.select("prop", (F.col("avg_len") * F.col("n_fields")).alias("total"), "n_fields")
    sums = sums.unionByName(fields(coming.analysed(props), 1)).unionByName(fields(leaving.analysed(props), -1)).groupBy("prop").agg(F.sum("total").alias("total"), F.sum("n_fields").alias("n_fields"))
    n = index.statistics([])[0] + inserted.count() - leaving.docs.count()
    stats = sums.where("n_fields > 0").select("prop", (F.col("total") / F.col("n_fields")).alias("avg_len"), "n_fields", F.lit(n).cast("long").alias("n_docs"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/field_stats")


def stream_frequencies(changes: DataFrame, schema: Schema, analyzer: Analyzer, prop: str) -> DataFrame:
    """The same as a running aggregate of a stream: (token, df), kept current by Spark's state store."""
    tokens = analyzer.tokens(schema.column(prop), prop)
    return changes.select(F.explode(F.array_distinct(tokens)).alias("token"), "op").groupBy("token").agg(F.sum("op").cast("long").alias("df"))


def ingest(source: DataFrame, target: str, checkpoint: str, key: str = "id", once: bool = True) -> StreamingQuery:
    """Upsert a stream of documents into a versioned Parquet table: each batch appends its rows with a version, and
    readers take the newest of a key. Appends are safe to repeat, since a batch writes a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def current(spark: SparkSession, target: str, key: str = "id") -> DataFrame:
    """The newest row of each key of an ingested table."""
    rows = spark.read.parquet(target)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_version")))
    return rows.withColumn("_rn", newest).where("_rn = 1").drop("_rn", "_version", "batch")


def event_windows(events: DataFrame, time: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """(window_start, by..., n, total): counts of events in tumbling or sliding windows, with a watermark for streams."""
    marked, kind = watermarked(events, time, late)
    span = F.window(time, size, slide) if slide else F.window(time, size)
    counts = marked.groupBy(span.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("w.start").cast(kind).alias("window_start"), *by, "n", "total")


def watermarked(events: DataFrame, time: str, late: str) -> tuple[DataFrame, str]:
    """The events with a watermark if they are a stream, and the type of their times. A watermark needs times with a
    zone; times without one count as the session's."""
    kind = events.schema[time].dataType.simpleString()
    if not events.isStreaming:
        return events, kind
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late), kind


def event_sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """(user, session_start, session_end, n): sessions that end after a gap."""
    marked, kind = watermarked(events, time, late)
    return marked.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").cast(kind).alias("session_start"), F.col("w.end").cast(kind).alias("session_end"), "n")


def search_event_sink(events: DataFrame, target: str, checkpoint: str, flush: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Append search events to a table, flushed by time."""
    writer = events.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=flush)).start()


class SearchEvents:
    """Events of one process, written when there are `most` of them, when `seconds` have passed since the last writing
    as another event comes, or on flush."""

    def __init__(self, spark: SparkSession, target: str, most: int = 25, seconds: float = 5.0):
        self.spark, self.target, self.most, self.seconds = spark, target, most, seconds
        self.held: list[tuple] = []
        self.written = time.monotonic()

    def add(self, term: str, hits: int, elapsed: int) -> None:
        self.held.append((term, hits, elapsed))
        if len(self.held) >= self.most or time.monotonic() - self.written >= self.seconds:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.spark.createDataFrame(self.held, "term string, hits long, elapsed long").coalesce(1).write.mode("append").parquet(self.target)
            self.held = []
        self.written = time.monotonic()

    def hook(self) -> Callable:
        """For afterSearch; elapsed: nanoseconds until the hits were counted."""

        def note(collection, params: dict, language: str, result) -> None:
            hits = result.count
            self.add(params.get("term") or "", hits, time.perf_counter_ns() - result.started)

        return note
