"""N-gram Jaccard join by MinHash banding.

Two documents are linked if the Jaccard similarity of their sets of word n-grams reaches the threshold. Documents
with the same words form one class and are compared once. The steps:

1. Each class gets a MinHash signature. Rows per band and the number of bands are chosen for a target recall at the
   threshold (`banding`); the band hashes are the only candidates' keys.
2. Band hashes that two or more classes share are buckets. Buckets of exactly the same classes are kept once.
3. The n-gram sets of classes in buckets meet in groups of bounded size: a bucket of more than BLOCK classes, or of
   more than BLOCK_GRAMS n-grams, is dealt into blocks, and each pair of blocks is a group. A pair of classes is verified on its full sets in the first band
   that it shares, so no pair is counted twice, and none is left out however large its bucket is.
4. A group returns, for each class, the links it verified and one peer of its component there, never the pairs.
   Components follow from these edges by minimum labels with pointer jumping.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, held, key_array, key_columns, mix64, stage, trimmed

BLOCK = 256
BLOCK_GRAMS = 4_000_000  # n-grams of one block, 8 bytes each
SLICE = 150_000  # n-grams hashed at a time


def banding(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which the bands needed for the recall fit into most_hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)) if threshold < 1 else 1, 1)
    for rows in range(1, most_hashes + 1):
        match = threshold**rows
        bands = 1 if match >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - match))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def _odd(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def text_words(text: str | None) -> list[str]:
    """The words of a text: runs of characters other than white space, in lower case."""
    return (text or "").lower().split()


def shingles(words: list[str], n: int) -> np.ndarray:
    """Hashes of the word n-grams, repeated ones included. Fewer than n words make one n-gram of all of them."""
    if not words:
        return np.zeros(0, np.uint64)
    h = held("ngrams", WordHashes).of(words)
    k = min(n, len(h))
    factors = _odd(n, 11)
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * factors[i]
    return mix64(total)


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes of non-empty sets, one row each."""
    out = np.empty((len(sets), bands), np.int64)
    multipliers, fold = _odd(bands * rows, 23), _odd(rows, 37)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (not held or held + len(sets[end]) <= SLICE):
            held += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64)]).astype(np.int64)
        product = np.empty_like(flat)
        for b in range(bands):
            total = np.full(end - at, b + 1, np.uint64)
            for r in range(rows):
                np.multiply(flat, multipliers[b * rows + r], out=product)
                total += mix64(np.minimum.reduceat(product, starts)) * fold[r]
            out[at:end, b] = mix64(total).view(np.int64)
        at = end
    return out


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _signed(docs: DataFrame, n: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                words = [text_words(t) for t in part["t"]]
                names = [xxhash.xxh3_128_digest(" ".join(w)) if w else None for w in words]
                full = [i for i, w in enumerate(words) if w]
                found: list = [None] * len(part)
                if full:
                    for i, row in zip(full, signatures([shingles(words[i], n) for i in full], bands, rows), strict=True):
                        found[i] = row.tobytes()
                grams = [max(1, len(w) - n + 1) if w else 0 for w in words]
                yield pd.DataFrame({key: key_array(part), "h": part["h"], "class": names, "bands": found, "grams": grams})

    given = docs.select(*key_columns(key), F.col(text).alias("t"), text_hash(F.col(text)).alias("h"))
    return given.mapInPandas(trimmed(run), f"{key} long, h long, class binary, bands binary, grams long")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(class, set) of rows (class, t) whose words make that class: sorted distinct n-gram hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                names, found = [], []
                for name, t in zip(part["class"], part["t"], strict=True):
                    words = text_words(t)
                    if words and xxhash.xxh3_128_digest(" ".join(words)) == bytes(name):
                        names.append(name)
                        found.append(np.unique(shingles(words, n)).tobytes())
                yield pd.DataFrame({"class": names, "set": found})

    return texts.mapInPandas(trimmed(run), "class binary, set binary")


def _overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets: pair by pair if few, else by products of presence matrices."""
    if len(pairs) <= 6 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # an n-gram of one set alone adds to no intersection
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for lo in range(0, len(values), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        if a < b:
            seen, local = np.unique(column[a:b], return_inverse=True)
            present = np.zeros((len(sets), len(seen)), np.float32)
            present[owner[a:b], local] = 1
            total += present @ present.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def verified_links(band: int, side: np.ndarray, across: bool, bands: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """The pairs (i, j), i < j, of one group that are similar and share no earlier band. across: only from side to side."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    can = np.triu(np.ones((n, n), bool), 1)
    if across:
        can &= side[:, None] != side[None, :]
    can &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9
    for b in range(band):
        can &= bands[:, b][:, None] != bands[:, b][None, :]
    pairs = np.argwhere(can)
    if not len(pairs):
        return pairs
    both = _overlaps(sets, pairs)
    union = size[pairs[:, 0]] + size[pairs[:, 1]] - both
    return pairs[both / union >= threshold]


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[tuple]]:
    """Rows of one key at a time, from batches in which equal keys are neighbours."""
    held: list[tuple] = []
    name = None
    for batch in batches:
        for row, now in zip(batch.itertuples(index=False, name=None), batch[keys].itertuples(index=False, name=None), strict=True):
            if held and now != name:
                yield held
                held = []
            name = now
            held.append(row)
    if held:
        yield held


def _verifier(threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = ["band", "hash", "a", "b", "class", "blk", "copies", "bands", "set"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in _runs((b[columns] for b in batches), columns[:4]):
            group = list({row[4]: row for row in group}.values())
            if len(group) > 1:
                band, _, a, b = group[0][:4]
                sets = [np.frombuffer(r[8], np.uint64) for r in group]
                bands = np.stack([np.frombuffer(r[7], np.int64) for r in group])
                side = np.array([r[5] for r in group])
                pairs = verified_links(band, side, a != b, bands, sets, threshold)
                if len(pairs):
                    copies = np.array([r[6] for r in group], np.int64)
                    links = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(group)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(group))
                    root = _roots(len(group), pairs)
                    out += [(group[i][4], group[root[i]][4], int(links[i])) for i in np.flatnonzero(links)]
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=["class", "peer", "links"])
                out = []
        yield pd.DataFrame(out, columns=["class", "peer", "links"]).astype({"links": "int64"})

    return run


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the least node of each connected component; edges (u, v), in either direction.

    Every round takes the least label among the neighbours and then the label of the label; the tables of each round
    are written to the shared folder.
    """
    both = stage(edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), label)
    labels = stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).select(F.col("u").alias("node"), "c"), label)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("best"))
        new = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("c").alias("old"), F.least("c", "best").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("c").alias("next"))
        moved = stage(new.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("next", "c")).alias("c")), label)
        changed = moved.where("old <> c").limit(1).count()
        labels = moved.select("node", "c")
        if not changed:
            return labels.withColumnRenamed("c", "component")


def _joined(docs: DataFrame, threshold: float, n: int, recall: float, key: str, text: str) -> DataFrame:
    """(key, h, class, component, class_id, n_links) of every row, h being its text's hash. component: the least class
    that its class is connected with; unlike class_id it tells apart unlinked texts of one key."""
    bands, rows = banding(threshold, recall)
    signed = stage(_signed(docs, n, bands, rows, key, text), "signed")
    # one row stands for its class: its key and the hash of its text, which no other class has, find the text again
    one = F.min(F.struct(key, "h"))
    classes = stage(signed.where("class is not null").groupBy("class").agg(F.min(key).alias("rep"), one.alias("one"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max("grams").alias("grams")), "classes")
    # band b of the packed signature is 8 bytes
    split = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.substring(F.col("bands"), b * 8 + 1, F.lit(8)).alias("hash")))
    banded = classes.select("class", "grams", F.explode(split).alias("s")).select("class", "grams", "s.band", "s.hash")
    shared = (
        banded.groupBy("band", "hash")
        .agg(F.count("*").alias("n"), F.sum("grams").alias("all"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.bit_xor(F.xxhash64("class")).alias("x"))
        .where("n > 1")
        .withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_GRAMS)).cast("int"))
    )
    buckets = stage(shared.groupBy("n", "blocks", "lo", "hi", "x").agg(F.min(F.struct("band", "hash")).alias("s")).select("s.band", "s.hash", "blocks"), "buckets")
    members = stage(banded.select("class", "band", "hash").join(buckets, ["band", "hash"]), "members")

    wanted = members.select("class").distinct().join(classes.select("class", "one", "copies", "bands"), "class")
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), text_hash(F.col(text)).alias("h"))
    held = wanted.select("class", F.col(f"one.{key}").alias("k"), F.col("one.h").alias("h"))
    found = texts.join(held, (texts["h"] == held["h"]) & texts["k"].eqNullSafe(held["k"])).select("class", "t")
    sets = _sets(found, n).groupBy("class").agg(F.first("set").alias("set"))

    blocks = F.col("blocks")
    blk = F.pmod(F.xxhash64(F.col("class"), F.lit(5)), blocks).cast("int")
    grouped = (
        members.join(wanted.select("class", "copies", "bands"), "class")
        .join(sets, "class")
        .withColumn("blk", blk)
        .withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("band", "hash", F.least("blk", "o").alias("a"), F.greatest("blk", "o").alias("b"), "class", "blk", "copies", "bands", "set")
        .repartition("band", "hash", "a", "b")
        .sortWithinPartitions("band", "hash", "a", "b")
    )
    links = stage(grouped.mapInPandas(trimmed(_verifier(threshold)), "class binary, peer binary, links long"), "links")
    component = components(links.select(F.col("class").alias("u"), F.col("peer").alias("v")))
    linked = classes.join(component.withColumnRenamed("node", "class"), "class").select("class", "rep", "component")
    least = linked.groupBy("component").agg(F.min("rep").alias("class_id"))
    of_class = linked.join(least, "component").select("class", "component", "class_id").join(links.groupBy("class").agg(F.sum("links").alias("links")), "class", "left")
    summary = stage(
        classes.join(of_class, "class", "left").select(
            "class", F.coalesce("component", "class").alias("component"), F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
        ),
        "summary",
    )
    # rows without words have no class; the join spreads them by their key
    own = F.concat(F.lit("-"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")
    out = signed.select(key, "h", F.col("class").isNull().alias("alone"), F.coalesce("class", own).alias("class")).join(summary.withColumn("alone", F.lit(False)), ["class", "alone"], "left")
    return out.select(
        key, "h", "alone", "class", F.coalesce("component", "class").alias("component"), F.coalesce("class_id", F.col(key)).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9995, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links): one row for each row of docs.

    class_id: the least key of all documents that are connected by links. n_links: the number of other documents with
    a similarity of threshold or more, those with the same words included.
    Null texts and texts without words have no n-grams: they link to none and their class is their own key. Texts of
    fewer than n words have one n-gram of all their words. Null keys take part and get the class of the others; rows
    with equal keys and texts count as copies; an empty table gives an empty result. Other columns are not looked at.
    class_id is a key: where one key has several unlinked texts, their classes have the same class_id.
    """
    return _joined(docs, threshold, n, recall, key, text).select(key, "class_id", "n_links")


def near_duplicates_removed(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9995, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class of linked documents: that with the least key (nulls last) and, of this key, the
    least text hash. Documents without links all stay, those of one key, or without a key, with several texts too.
    Rows of the same key and text are one document, whether the key is null or not; rows without words link to none
    and stay once for each key and text.
    """
    found = _joined(docs.select(key, text), threshold, n, recall, key, text)
    none, known = F.col(key).isNull().alias("_none"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_key")
    first = found.where(~F.col("alone")).groupBy("component").agg(F.min(F.struct(none, known, F.col("h").alias("_h"))).alias("m")).select("m.*")
    kept = first.unionByName(found.where("alone").select(none, known, F.col("h").alias("_h")).distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows, same = docs.select(row.alias("row"), text_hash(F.col(text)).alias("_h"), known, none), ["_none", "_key", "_h"]
    return rows.join(kept, same, "left_semi").dropDuplicates(same).select("row.*")
