"""A corpus pipeline of the llm operators: quality, near duplicates, personal data, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, ordinal, sanitize, sentencepiece_scan
from tessera.llm.common import stage
from tessera.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are good (neither toxic nor of low quality) with a probability of one half or more."""
    labels = table(spark, sf_dir, "labels")
    graded = labels.select("doc_id", ordinal.label_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return ordinal.kept_documents(docs, ordinal.train(docs, graded, levels=3))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class that is linked by a Jaccard similarity of 0.8 or more on five-word n-grams."""
    return ngram_join.near_duplicates_removed(docs, threshold=0.8, n=5, recall=0.9995)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and terms that reveal it, in the texts; no document goes."""
    return sanitize.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat rows of scarce sources so that the mix meets its target; every row stays at least once."""
    return mixing.mixed_documents(docs, entropy=0.95, max_repeat=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text_crc32, ids, round_trip): the SentencePiece ids of every text, and whether they decode to it."""
    return sentencepiece_scan.encode_checked(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix_sources), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs


#: The classifier, the token ids and the hashes are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None
