"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets a weight in proportion to p ** e. The exponent e runs from 1 (as found)
to 0 (all sources alike). The smallest e on a grid of 1 / 4096 is searched for which the mix has the target entropy
at most and repeats no source more often than allowed; both hold on from there up, so the grid is bisected (16 ways
at a time, one small aggregate each). Weights times the budget are the sources' quotas.

A quota is realised in epochs. In each epoch a source's blocks of rows (rows whose hash falls in one bucket) come in
a new permutation; the last epoch stops where the quota is spent. `mix_position` (0 to 1) interleaves the sources:
sorted by it, every stretch of the mix has the sources' weights.

Only DataFrame functions are used. Nothing is collected but 17 rows of aggregates for each step of the search.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, utf8_size

GRID = 4096
WAYS = 16
LEAST_BLOCKS, BLOCK_TOKENS = 256, 4_000_000


def token_estimate(text: Column) -> Column:
    """Tokens of a text: a quarter of its UTF-8 bytes, 1 at least (also for null and empty texts)."""
    return F.greatest(F.lit(1), F.ceil(utf8_size(text) / 4)).cast("long")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def exponent_stats(totals: DataFrame, total: int, exponents: list[float]) -> dict[float, dict]:
    """For each exponent: mass, entropy, the budget (in corpus sizes) that covers every source once, its repetition."""
    share = F.col("tokens") / F.lit(float(total))
    e = F.col("e")
    rows = (
        totals.withColumn("e", F.explode(F.array(*[F.lit(float(x)) for x in exponents])))
        .groupBy("e")
        .agg(
            F.sum(F.pow(share, e)).alias("mass"),
            F.sum(F.pow(share, e) * F.log(share)).alias("weighted"),
            F.max(F.pow(share, 1 - e)).alias("least"),
            F.max(F.pow(share, e - 1)).alias("most"),
        )
        .collect()
    )
    return {r.e: {"mass": r.mass, "entropy": math.log(r.mass) - r.e * r.weighted / r.mass, "cover": r.mass * r.least, "thin": r.most / r.mass} for r in rows}


def find_exponent(totals: DataFrame, total: int, sources: int, entropy: float, max_repeat: float, budget: int | None) -> tuple[float, dict]:
    """The smallest exponent that keeps both limits, with its stats. At 1, the shares as found, the search ends."""

    def fits(s: dict) -> bool:
        size = s["cover"] if budget is None else budget / total
        return s["entropy"] <= entropy * math.log(sources) + 1e-9 and size * s["thin"] <= max_repeat + 1e-9

    low, high, known = -1, GRID, {}  # low fails, high fits
    while high - low > 1:
        step = max(1, -(-(high - low) // WAYS))
        tries = [x for x in range(low + step, high, step)] or [low + 1]
        stats = exponent_stats(totals, total, [x / GRID for x in tries])
        for x in tries:
            known[x] = stats[x / GRID]
            if fits(known[x]):
                high = x
                break
            low = x
    if high not in known:
        known[high] = exponent_stats(totals, total, [high / GRID])[high / GRID]
    return high / GRID, known[high]


def mix(
    docs: DataFrame,
    entropy: float = 0.95,
    max_repeat: float = 2.0,
    budget: int | None = None,
    blocks: int | None = None,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The columns of docs in a struct `row`, with mix_exponent, mix_weight, mix_epoch, mix_block, mix_position.

    entropy: the mix's most, as a part of the logarithm of the number of sources. max_repeat: how often a source may
    come, on average over its rows. budget: tokens in all; None takes the least budget with which every row comes
    once or more, so nothing is lost.
    A null source is a source of its own; null and empty texts count one token; equal rows all stay; a row that comes
    in several epochs is returned once for each; an empty table gives an empty result.
    """
    if blocks is None:
        corpus = docs.agg(F.sum(token_estimate(F.col(text)))).first()[0] or 0
        blocks = max(LEAST_BLOCKS, -(-corpus // BLOCK_TOKENS))
    made = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        made.alias("row"),
        _source_key(F.col(source)).alias("src"),
        token_estimate(F.col(text)).alias("tok"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"),
    ).withColumn("blk", F.pmod("h", F.lit(blocks)).cast("int"))
    sums = stage(rows.groupBy("src", "blk").agg(F.sum("tok").alias("tokens")), "mix")
    totals = sums.groupBy("src").agg(F.sum("tokens").alias("tokens"))
    whole = totals.agg(F.sum("tokens").alias("total"), F.count("*").alias("n")).first()
    total, sources = whole.total or 1, max(1, whole.n)
    if whole.n:
        e, stats = find_exponent(totals, total, sources, entropy, max_repeat, budget)
    else:
        e, stats = 1.0, {"mass": 1.0, "cover": 1.0}
    weight = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(e)) / F.lit(stats["mass"])
    if budget is None:
        quota = F.greatest(F.col("tokens"), F.floor(weight * F.lit(stats["cover"] * total)))
    else:
        quota = F.floor(weight * F.lit(float(budget)))
    quotas = totals.select("src", F.col("tokens").alias("source_tokens"), weight.alias("weight"), quota.cast("long").alias("quota"))
    epochs = F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("source_tokens")).cast("int"))
    permuted = Window.partitionBy("src", "epoch").orderBy(F.xxhash64(F.lit(seed), "src", "epoch", "blk"), "blk").rowsBetween(Window.unboundedPreceding, 0)
    plan = (
        sums.join(quotas.where("quota > 0"), "src")
        .withColumn("epoch", F.explode(epochs))
        .withColumn("before", F.sum("tokens").over(permuted) - F.col("tokens") + F.col("epoch") * F.col("source_tokens"))
        .where("before < quota")
        .select("src", "blk", "epoch", "before", "quota", "weight")
    )
    in_block = Window.partitionBy("src", "blk").orderBy("h", "tok").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("ahead", F.sum("tok").over(in_block) - F.col("tok"))
    at = F.col("before") + F.col("ahead")
    return (
        placed.join(plan, ["src", "blk"])
        .where(at < F.col("quota"))
        .select(
            "row",
            F.lit(e).alias("mix_exponent"),
            F.col("weight").alias("mix_weight"),
            F.col("epoch").alias("mix_epoch"),
            F.col("blk").alias("mix_block"),
            (at / F.col("quota")).alias("mix_position"),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix with the columns of docs only; a row stands once for each of its epochs."""
    return mix(docs, **options).select("row.*")
