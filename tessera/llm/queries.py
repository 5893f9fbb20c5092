"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout keeps each source in one of 32 shards; 40 even shards are written, and read back."""
    from .sharding import resharded

    old = F.pmod(F.crc32(F.col("source")), F.lit(32)).cast("int")
    placed = resharded(table(spark, sf_dir, "documents"), old, shards=40, old_shards=32)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 toxic, 1 of low quality, 2 good; a document is kept if it is good with a probability of one half."""
    from .ordinal import grade, label_grade, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    graded = labels.select("doc_id", label_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    out = grade(docs, train(docs, graded, levels=3))
    tail = [F.col("tail")[0].alias("p_not_toxic"), F.col("tail")[1].alias("p_good")]
    return out.select("doc_id", "expected_grade", *tail, "keep")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled urls are those of pages that show labelled documents."""
    from .urls import RULES, filter_urls, labelled_urls

    pages, docs, labels = (table(spark, sf_dir, name) for name in ("pages", "documents", "labels"))
    return filter_urls(pages, labelled_urls(pages, docs, labels), RULES)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_scan import encoded_and_decoded

    return encoded_and_decoded(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), threshold=0.8, n=5, recall=0.9995)


#: All pairs by an inverted index; components by recursion.
OP5_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS w FROM documents
), grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
        ELSE [w[i:i + 4] FOR i IN generate_series(1, len(w) - 4)] END) AS g FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS hits
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT u, v FROM common JOIN sizes s ON s.doc_id = u JOIN sizes t ON t.doc_id = v
    WHERE hits / (s.n + t.n - hits) >= 0.8
), reach AS (
    SELECT u AS node, v AS other FROM links UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.other
)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(other) FROM reach r WHERE r.node = d.doc_id), d.doc_id)) AS class_id,
       (SELECT count(*) FROM links l WHERE l.u = d.doc_id) AS n_links
FROM documents d
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sanitize import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50, scale=256.0)


OP7_SQL = """
WITH v AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
           CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
    FROM v a JOIN v b ON b.vec_id <> a.vec_id AND len(a.q) = len(b.q)
    WHERE a.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattest mix with at most 0.95 of the greatest entropy in which no source comes more than twice."""
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), entropy=0.95, max_repeat=2.0)
    kept = ["mix_exponent", "mix_weight", "mix_epoch", "mix_block", "mix_position"]
    return mixed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), *kept)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op10_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features, with_media

    return media_features(with_media(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_reshard": op1_reshard,
    "op2_ordinal_quality": op2_ordinal_quality,
    "op3_url_filter": op3_url_filter,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_ngram_join": op5_ngram_join,
    "op6_pii": op6_pii,
    "op7_pivot_topk": op7_pivot_topk,
    "op8_temperature_mix": op8_temperature_mix,
    "op9_token_files": op9_token_files,
    "op10_avi_media": op10_avi_media,
}
ORACLES: dict[str, str] = {"op5_ngram_join": OP5_SQL, "op7_pivot_topk": OP7_SQL}
