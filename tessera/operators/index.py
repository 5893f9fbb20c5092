"""The inverted index as plain tables.

analysed   (prop, _iid, tokens, field_len)     one row for each document and text property; on disk partitioned by prop
postings   (prop, token, _iid, tf, field_len)  exploded; on disk partitioned by prop, range-partitioned and sorted by
                                               token and document, so that no word has to fit into one file
dictionary (prop, token, df)                   on disk sorted by token; a search reads document frequencies from it
field_stats(prop, avg_len, n_fields, n_docs)   one row for each text property
sentences, placed                              what the scorers by sentence and by position look at, stored on demand
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Analyzer
from ..schema import Schema, is_array


def field_tokens(schema: Schema, analyzer: Analyzer, path: str) -> Column:
    """Tokens of one property of a document; an array's elements count as one text."""
    column = schema.column(path)
    if is_array(schema.types[path]):
        found = F.flatten(F.transform(F.filter(column, lambda c: c.isNotNull()), lambda c: analyzer.tokens(c, path)))
        return F.when(column.isNotNull(), found if analyzer.allow_duplicates else F.array_distinct(found))
    return analyzer.tokens(column, path)


@dataclass
class TextIndex:
    schema: Schema
    analyzer: Analyzer
    docs: DataFrame
    stored: dict[str, DataFrame] | None = None
    kept: DataFrame | None = None
    known: tuple[int, dict[str, float]] | None = None
    sentences: DataFrame | None = None
    placed: DataFrame | None = None
    looked_up: tuple[object, TextIndex] | None = None

    def narrowed(self, query: object, props: list[str], keep: Callable[[Column], Column]) -> TextIndex:
        """The same index with only those tokens that answer a query, and the fields' lengths and averages as they are.
        Without stored or kept tokens a search would analyse the texts for each of postings, dictionary and statistics;
        these few tokens are kept by Spark, as the first action asks for them, until the next query takes their place."""
        if self.stored is not None or self.kept is not None:
            return self
        if self.looked_up is None or self.looked_up[0] != query:
            if self.looked_up is not None:
                self.looked_up[1].kept.unpersist()
            rows = self.analysed(props).select("prop", "_iid", F.filter("tokens", keep).alias("tokens"), "field_len").persist()
            self.looked_up = query, TextIndex(self.schema, self.analyzer, self.docs, kept=rows)
        return self.looked_up[1]

    def analysed(self, props: list[str]) -> DataFrame:
        """One pass over docs: the properties' tokens side by side, then one row each."""
        if self.kept is not None:
            return self.kept.where(F.col("prop").isin(props))
        fields = F.array(*[F.struct(F.lit(p).alias("prop"), field_tokens(self.schema, self.analyzer, p).alias("tokens")) for p in props])
        rows = self.docs.select("_iid", F.explode(fields).alias("f")).select("f.prop", "_iid", "f.tokens").where("tokens is not null")
        return rows.withColumn("field_len", F.size("tokens"))

    def postings(self, props: list[str], keep: Column | None = None) -> DataFrame:
        """Rows of the postings; `keep` is a condition on `token`, applied before the arrays are exploded."""
        if self.stored is not None:
            rows = self.stored["postings"].where(F.col("prop").isin(props))
            return rows if keep is None else rows.where(keep)
        rows = self.analysed(props).select("prop", "_iid", "field_len", F.explode("tokens").alias("token"))
        rows = rows if keep is None else rows.where(keep)
        if self.analyzer.allow_duplicates:
            rows = rows.groupBy("prop", "token", "_iid", "field_len").agg(F.count("*").alias("n"))
        else:
            rows = rows.withColumn("n", F.lit(1))
        return rows.select("prop", "token", "_iid", (F.col("n") / F.col("field_len")).alias("tf"), "field_len")

    def field_stats(self, props: list[str]) -> DataFrame:
        """(prop, avg_len): the mean number of tokens over the documents that have the property."""
        if self.stored is not None:
            return self.stored["field_stats"].where(F.col("prop").isin(props)).select("prop", "avg_len")
        return self.analysed(props).groupBy("prop").agg(F.avg("field_len").alias("avg_len"))

    def dictionary(self, props: list[str], keep: Column | None = None) -> DataFrame:
        """(prop, token, df)"""
        if self.stored is not None:
            rows = self.stored["dictionary"].where(F.col("prop").isin(props))
            return (rows if keep is None else rows.where(keep)).select("prop", "token", "df")
        return frequencies(self.postings(props, keep), self.analyzer.allow_duplicates)

    def sequential_average(self, prop: str) -> DataFrame:
        """(prop, avg_len) as it comes out when documents arrive one by one and those without the property leave the
        average as it is: len_i weighs 1/N times j/(j-1) for each later document j without the property."""
        tokens = field_tokens(self.schema, self.analyzer, prop)
        numbered = dense_numbers(self.docs.select("_iid", F.size(tokens).alias("len"), tokens.isNull().alias("missing")), ["_iid"], "n")
        factor = F.when(F.col("missing") & (F.col("n") > 1), F.log(F.col("n") / (F.col("n") - 1))).otherwise(0.0)
        after = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
        rows = numbered.withColumn("up", F.coalesce(F.sum(factor).over(after), F.lit(0.0)))
        total = F.sum(F.when(~F.col("missing"), F.col("len") * F.exp("up")).otherwise(0.0))
        return rows.agg((total / F.max("n")).alias("avg_len")).select(F.lit(prop).alias("prop"), "avg_len")

    def write(self, path: str, more: tuple[str, ...] = ()) -> None:
        """Write the tables under path; more: `sentences`, `placed`. Texts are analysed once, into a table of tokens that
        the others are made of."""
        props, spark = self.schema.searchable, self.docs.sparkSession
        if not props:
            return
        self.analysed(props).write.partitionBy("prop").mode("overwrite").parquet(f"{path}/analysed")
        made = TextIndex(self.schema, self.analyzer, self.docs, kept=spark.read.parquet(f"{path}/analysed"))
        write_postings(made.postings(props), path)
        write_dictionary(frequencies(made.postings(props), self.analyzer.allow_duplicates), path)
        stats = made.analysed(props).groupBy("prop").agg(F.avg("field_len").alias("avg_len"), F.count("*").alias("n_fields"))
        stats.crossJoin(F.broadcast(self.docs.agg(F.count("*").alias("n_docs")))).coalesce(1).write.mode("overwrite").parquet(f"{path}/field_stats")
        for name in more:
            from . import score

            rows = {"sentences": score.sentence_postings, "placed": score.placed_tokens}[name](made, props, self.docs)
            if name == "sentences":  # analysed for itself, so written once before it is ordered
                rows.write.mode("overwrite").parquet(f"{path}/unordered")
                rows = spark.read.parquet(f"{path}/unordered")
            by_token(rows).write.partitionBy("prop").mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(schema: Schema, analyzer: Analyzer, docs: DataFrame, path: str, more: tuple[str, ...] = ()) -> TextIndex:
        """The index whose tables `write` left under path. The field statistics, a row for each property, are read now."""
        spark = docs.sparkSession
        stored = {n: spark.read.parquet(f"{path}/{n}") for n in ("analysed", "postings", "dictionary", "field_stats", *more)}
        found = stored["field_stats"].collect()
        known = (found[0].n_docs, {r.prop: r.avg_len for r in found}) if found else (docs.count(), {})
        return TextIndex(schema, analyzer, docs, stored, stored["analysed"], known, stored.get("sentences"), stored.get("placed"))

    def statistics(self, props: list[str]) -> tuple[int, dict[str, float]]:
        """The number of documents and each property's mean length; asked for once and then remembered."""
        if self.known is None:
            every = self.schema.searchable
            self.known = self.docs.count(), {r.prop: r.avg_len for r in self.field_stats(every).collect()}
        return self.known[0], {p: a for p, a in self.known[1].items() if p in props}

    def cached(self) -> TextIndex:
        """The same index with its tokens kept by Spark and its statistics by the driver, for many searches."""
        if not self.schema.searchable:
            return self
        if self.stored is not None:
            self.statistics([])
            return self
        made = TextIndex(self.schema, self.analyzer, self.docs, kept=self.analysed(self.schema.searchable).persist())
        made.statistics([])
        return made


def frequencies(postings: DataFrame, repeated: bool = False) -> DataFrame:
    """(prop, token, df): in how many documents a token occurs; where tokens may repeat, how often it does."""
    weight = F.round(F.col("tf") * F.col("field_len")) if repeated else F.lit(1)
    return postings.groupBy("prop", "token").agg(F.sum(weight).cast("long").alias("df"))


def by_token(rows: DataFrame) -> DataFrame:
    """Rows by ranges of (prop, token, document), so that a frequent word is spread over partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "prop", "token", "_iid").sortWithinPartitions("prop", "token", "_iid")


def write_postings(postings: DataFrame, path: str) -> None:
    by_token(postings).write.partitionBy("prop").mode("overwrite").parquet(f"{path}/postings")


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    n = int(dictionary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dictionary.repartitionByRange(n, "prop", "token").sortWithinPartitions("prop", "token").write.partitionBy("prop").mode("overwrite").parquet(f"{path}/dictionary")


def dense_numbers(frame: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Consecutive numbers in the order of some columns, without one task for all rows: rows are range-partitioned,
    and each partition adds the number of rows before it. The driver sees one count for each partition."""
    spark = frame.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = frame.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).persist()
    counts = sorted(parts.groupBy("_p").count().collect())
    starts, at = [], first - 1
    for p, c in counts:
        starts.append((p, at))
        at += c
    offsets = spark.createDataFrame(starts, "_p int, _start long")
    inside = Window.partitionBy("_p").orderBy(*order)
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, F.row_number().over(inside) + F.col("_start")).drop("_p", "_start")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
