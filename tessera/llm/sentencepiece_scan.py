"""SentencePiece encoding and decoding, with a max-plus parallel scan over chunks of giant documents.

The model is a SentencePiece BPE model with byte fallback, and the ids are those that its library gives. A sequence
of pieces is the encoding of a text exactly if every two neighbours are: pieces a, b fit if the library encodes ab as
a, b. So encoding is a best path through the lattice of pieces, with weight 0 for neighbours that fit and minus
infinity for others, and one path alone has a finite weight. (Scores of a unigram model would be other weights of the
same lattice; a BPE model's scores are merge ranks and cannot be added, so they are not used as weights.)

A document of more than GIANT characters is cut into chunks at any place. The state at a boundary is the piece that
covers the last character before it. A chunk's matrix holds, for each state at its start and each at its end, the
weight of the best path between them. Matrices combine associatively under (max, +). They are combined as a tree: the
products of FAN neighbours make the next level, until one product is left of each document; on the way down, prefix
and suffix products inside each group of FAN leave one state at each of its boundaries, given those at its ends. So a
task never holds more than FAN matrices of a document, and the depth is the logarithm of its length. Then each chunk
is traced back on its own, between the pieces fixed at its two ends, along back-pointers. No piece goes on over a space
that follows a letter, so such places part a chunk into independent segments: the lattice is searched only from the
chunk's ends to the nearest such places, and what lies between these is encoded as a text of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, key_array, key_columns, stage, trimmed

GIANT = 16_384
CHUNK = 8_192
FAN = 64  # matrices that one task combines at a time
SLICE = 1_000_000  # characters that the library gets at a time
SPACE = "▁"
NEVER = -np.inf


class Lattice:
    """The pieces of a model, and which of them may be neighbours."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        normal = [i for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        names = [lib.id_to_piece(i) for i in normal]
        self.apart = next(c for c in "\n\u0000\u0001" if not any(c in n for n in names))
        self.lead = len(lib.encode(self.apart))
        found = self.raw_many(names)
        self.pieces = {n: i for n, i, ids in zip(names, normal, found, strict=True) if ids == [i]}
        self.longest = max(map(len, self.pieces))
        self.known: dict[tuple[str, str], bool] = {}

    def raw_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts without the space that the library puts before a text. A character of no piece shields it."""
        return [ids[self.lead :] for ids in self.library.encode([self.apart + t.replace(SPACE, " ") for t in texts], num_threads=1)]

    def raw(self, text: str) -> list[int]:
        return self.raw_many([text])[0] if text else []

    def fit(self, a: str, b: str) -> bool:
        if (a, b) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[a, b] = a not in self.pieces or b not in self.pieces or self.raw(a + b) == [self.pieces[a], self.pieces[b]]
        return self.known[a, b]

    def from_place(self, z: str, s: int) -> list[int]:
        """Ends of the pieces that start at s; a character of no piece stands alone."""
        ends = [e for e in range(s + 1, min(len(z), s + self.longest) + 1) if z[s:e] in self.pieces]
        return ends if ends and ends[0] == s + 1 else [s + 1, *ends]

    def states(self, z: str, p: int) -> list[tuple[int, int]]:
        """The pieces that cover the character before p, in a fixed order; the start of a text has one empty state."""
        if p == 0:
            return [(0, 0)]
        return [(s, e) for s in range(max(0, p - self.longest), p) for e in self.from_place(z, s) if e >= p]

    def reach(self, z: str, states: list[tuple[int, int]], until: int) -> dict[tuple[int, int], int]:
        """For each piece (s, e) with s <= until that follows from some of the states: which ones, as bits."""
        seen: dict[tuple[int, int], int] = {}
        at: dict[int, list[tuple[int, int]]] = {}
        for k, state in enumerate(states):
            seen[state] = 1 << k
            at.setdefault(state[1], []).append(state)
        for e in range(min(at), until + 1):
            for f in self.from_place(z, e) if e in at and e < len(z) else []:
                bits = 0
                for s, _ in at[e]:
                    if s == e or self.fit(z[s:e], z[e:f]):
                        bits |= seen[s, e]
                if bits:
                    seen[e, f] = bits
                    at.setdefault(f, []).append((e, f))
        return seen


    def way(self, z: str, start: tuple[int, int], until: int, goal: tuple[int, int] | None) -> list[tuple[int, int]]:
        """The pieces after start on the path to goal or, without one, to the piece that ends at `until`."""
        back: dict[tuple[int, int], tuple[int, int] | None] = {start: None}
        at: dict[int, list[tuple[int, int]]] = {start[1]: [start]}
        for e in range(start[1], until):
            for f in self.from_place(z, e) if e in at else []:
                for s, _ in at[e]:
                    if s == e or self.fit(z[s:e], z[e:f]):
                        back[e, f] = s, e
                        at.setdefault(f, []).append((e, f))
                        break
        here = goal if goal is not None else next((x for x in at.get(until, []) if x in back), None)
        if here is None or here not in back:
            raise ValueError("no path through the lattice")
        out = []
        while here != start:
            out.append(here)
            here = back[here]
        return out[::-1]

    def piece_ids(self, z: str, pieces: list[tuple[int, int]]) -> list[int]:
        found: list[int] = []
        for s, e in pieces:
            known = self.pieces.get(z[s:e])
            found += self.raw(z[s:e]) if known is None else [known]
        return found


def hard_cuts(z: str, p: int, q: int) -> tuple[int, int] | None:
    """The first and last place in (p, q) where a space follows another character; no piece goes over it."""
    a = p + 1
    while True:
        a = z.find(SPACE, a, q)
        if a < 0:
            return None
        if z[a - 1] != SPACE:
            break
        a += 1
    b = q
    while True:
        b = z.rfind(SPACE, a, b)
        if z[b - 1] != SPACE:
            return a, b


def transfer(lattice: Lattice, z: str, p: int, q: int) -> np.ndarray:
    """The chunk's max-plus matrix, from the states at p to the states at q (the whole text's end: its last pieces)."""
    rows, columns = lattice.states(z, p), lattice.states(z, q)
    out = np.full((len(rows), len(columns)), NEVER)
    cuts = hard_cuts(z, p, q)
    if cuts is None:
        seen = lattice.reach(z, rows, q - 1)
        for j, piece in enumerate(columns):
            for i in range(len(rows)):
                if seen.get(piece, 0) >> i & 1:
                    out[i, j] = 0.0
        return out
    a, b = cuts
    into = lattice.reach(z, rows, a - 1)
    enter = 0
    for (_, e), bits in into.items():
        enter |= bits if e == a else 0
    leave = lattice.reach(z, [(b, b)], q - 1)
    for i in range(len(rows)):
        for j, piece in enumerate(columns):
            if enter >> i & 1 and leave.get(piece, 0):
                out[i, j] = 0.0
    return out


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = maxplus(out, m)
    return out


def inner_states(matrices: list[np.ndarray], entry: int, end: int | None) -> list[int]:
    """The state at each matrix's end on the best path from the state `entry` to `end` (None: to the best one)."""
    ahead = [matrices[0][entry][None, :]]
    for m in matrices[1:]:
        ahead.append(maxplus(ahead[-1], m))
    behind = np.zeros((matrices[-1].shape[1], 1))
    if end is not None:
        behind[:] = NEVER
        behind[end] = 0.0
    out = [0] * len(matrices)
    for k in range(len(matrices) - 1, -1, -1):
        total = ahead[k][0] + behind[:, 0]
        out[k] = int(total.argmax())
        if total[out[k]] == NEVER:
            raise ValueError("no path through the lattice")
        behind = maxplus(matrices[k], behind)
    return out


def trace(lattice: Lattice, z: str, p: int, q: int, entry: int, end: int) -> list[int]:
    """Ids of the pieces that follow the entry state up to the end state: back-pointers from either end to the nearest
    places that no piece goes over, and the library for the segments between these."""
    first, last = lattice.states(z, p)[entry], lattice.states(z, q)[end]
    if last == first or last[0] < first[1]:
        return []
    cuts = hard_cuts(z, p, q)
    if cuts is None:
        return lattice.piece_ids(z, lattice.way(z, first, q, last))
    a, b = cuts
    head = lattice.way(z, first, a, None) if first[1] < a else []
    tail = lattice.way(z, (b, b), q, last)
    return lattice.piece_ids(z, head) + lattice.raw(z[a:b]) + lattice.piece_ids(z, tail)


def spaced(text: str) -> str:
    """The text as the library sees it: a space in front, spaces written as pieces have them."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def lattice_of(path: str) -> Lattice:
    return held(f"lattice {path}", lambda: Lattice(path))


def encode_giant(lattice: Lattice, text: str, chunk: int = CHUNK) -> list[int]:
    """The scan on one machine; the DataFrame form deals the same steps to tasks."""
    z = spaced(text)
    places = [*range(0, len(z), chunk), len(z)]
    if len(places) > 2 and places[-1] - places[-2] <= lattice.longest:
        del places[-2]
    spans = list(zip(places, places[1:], strict=False))
    ends = inner_states([transfer(lattice, z, p, q) for p, q in spans], 0, None)
    return [i for (p, q), e, x in zip(spans, [0, *ends], ends, strict=False) for i in trace(lattice, z, p, q, e, x)]


def _slices(texts: list[str]) -> Iterator[slice]:
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE:
            yield slice(at, i)
            at, held = i, 0
        held += len(t)
    yield slice(at, len(texts))


def _packed(m: np.ndarray) -> tuple[int, bytes]:
    return len(m), (m == 0).astype("u1").tobytes()


def _unpacked(rows: int, m: bytes) -> np.ndarray:
    return np.where(np.frombuffer(m, "u1").reshape(rows, -1) == 1, 0.0, NEVER)


def _grouped(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows with equal name and grp, which come one after another."""
    held: list[tuple] = []
    for batch in batches:
        for row in batch[["name", "grp", *columns]].itertuples(index=False, name=None):
            if held and held[-1][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def boundary_states(chunks: DataFrame, model: str, fan: int, parts: int) -> DataFrame:
    """(name, n, entry, end): the states at both ends of every chunk (name, n, base, p, q, z) on its document's path."""

    def matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = lattice_of(model)
        for b in batches:
            found = [_packed(transfer(lattice, r.z, r.p - r.base, r.q - r.base)) for r in b.itertuples()]
            yield pd.DataFrame({"name": b["name"], "n": b["n"], "rows": [r for r, _ in found], "m": [m for _, m in found]})

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, ["n", "rows", "m"]):
            rows, m = _packed(product([_unpacked(*g[3:]) for g in group]))
            yield pd.DataFrame({"name": [group[0][0]], "n": [group[0][1]], "rows": [rows], "m": [m]})

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in _grouped(batches, ["n", "rows", "m", "entry", "end"]):
            ends = inner_states([_unpacked(*g[3:5]) for g in group], int(group[0][5]), int(group[0][6]) if group[0][6] >= 0 else None)
            out += [(g[0], g[2], a, b) for g, a, b in zip(group, [int(group[0][5]), *ends], ends, strict=False)]
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=["name", "n", "entry", "end"])
                out = []
        yield pd.DataFrame(out, columns=["name", "n", "entry", "end"]).astype({"n": "int64", "entry": "int32", "end": "int32"})

    def in_groups(level: DataFrame) -> DataFrame:
        dealt = level.withColumn("grp", F.floor(F.col("n") / fan).cast("long"))
        return dealt.repartition(parts, "name", "grp").sortWithinPartitions("name", "grp", "n")

    schema = "name string, n long, rows int, m binary"
    most = chunks.agg(F.max("n")).first()[0] or 0
    levels = [chunks.mapInPandas(trimmed(matrix), schema)]
    if most < fan:  # one level, read once
        found = in_groups(levels[0].withColumns({"entry": F.lit(0), "end": F.lit(-1)}))
        return found.mapInPandas(trimmed(down), "name string, n long, entry int, end int")
    levels = [stage(levels[0], "matrices")]
    while most >= fan:
        levels.append(stage(in_groups(levels[-1]).mapInPandas(trimmed(up), schema), "matrices"))
        most //= fan
    states = levels[-1].select("name", F.lit(0).cast("long").alias("grp")).distinct().select("name", "grp", F.lit(0).alias("entry"), F.lit(-1).alias("end"))
    for level in reversed(levels):
        both = level.withColumn("grp", F.floor(F.col("n") / fan).cast("long")).join(states, ["name", "grp"])
        states = in_groups(both).mapInPandas(trimmed(down), "name string, n long, entry int, end int")
        if level is not levels[0]:
            states = stage(states, "states").withColumnRenamed("n", "grp")
    return states


Finish = Callable[[Any, pd.DataFrame], pd.DataFrame]


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(key, text_crc32, ids): the ids of every whole text, without begin and end ids.

    Null and empty texts have no ids. Texts of more than `giant` characters are scanned in chunks, equal ones once.
    Repeated rows all stay; an empty table gives an empty result. Other columns are not looked at.
    """
    return _encoded(docs, model, key, text, giant, chunk, fan, None, "text_crc32 long, ids array<int>")


def _encoded(docs: DataFrame, model: str, key: str, text: str, giant: int, chunk: int, fan: int, finish: Finish | None, columns: str) -> DataFrame:
    """(key, columns): what finish(library, frame of key, text_crc32, ids) makes of each text's ids, in the task that has
    them, so that ids that only digests are wanted of do not travel."""
    if chunk <= 64:
        raise ValueError("chunks must be longer than pieces")
    rows = docs.select(*key_columns(key), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("crc", F.crc32("t"))

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lib = lattice_of(model).library
        for b in batches:
            texts = b["t"].tolist()
            for s in _slices(texts):
                ids = lib.encode(texts[s], num_threads=1)
                ids = ids if finish else [np.array(x, np.int32) for x in ids]
                made = pd.DataFrame({key: key_array(b.iloc[s]), "text_crc32": b["crc"].iloc[s].to_numpy(), "ids": ids})
                yield finish(lib, made) if finish else made

    small = rows.where(F.length("t") <= giant).mapInPandas(trimmed(plain), f"{key} long, {columns}")
    large = rows.where(F.length("t") > giant).withColumn("name", F.sha2("t", 256))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        margin = lattice_of(model).longest
        for b in batches:
            for name, t in zip(b["name"], b["t"], strict=True):
                z = spaced(t)
                places = [*range(0, len(z), chunk), len(z)]
                if len(places) > 2 and places[-1] - places[-2] <= margin:
                    del places[-2]
                spans = list(zip(places, places[1:], strict=False))
                for at in range(0, len(spans), 1000):
                    part = [(name, at + i, max(0, p - margin), p, q, z[max(0, p - margin) : q + margin]) for i, (p, q) in enumerate(spans[at : at + 1000])]
                    yield pd.DataFrame(part, columns=["name", "n", "base", "p", "q", "z"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = large.select("name", "t").dropDuplicates(["name"]).mapInPandas(trimmed(cut), "name string, n long, base long, p long, q long, z string")
    chunks = stage(pieces.repartition(parts, "name", "n"), "chunks")

    states = boundary_states(chunks, model, fan, parts)

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = lattice_of(model)
        for b in batches:
            ids = [np.array(trace(lattice, r.z, r.p - r.base, r.q - r.base, r.entry, r.end), np.int32) for r in b.itertuples()]
            yield pd.DataFrame({"name": b["name"], "n": b["n"], "ids": ids})

    traced = chunks.join(states, ["name", "n"]).mapInPandas(trimmed(back), "name string, n long, ids array<int>")
    whole = traced.groupBy("name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])).alias("ids"))
    joined = large.select(F.when(~F.col("k_null"), F.col("k")).alias(key), F.col("crc").alias("text_crc32"), "name").join(whole, "name").select(key, "text_crc32", "ids")
    if finish:

        def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lib = lattice_of(model).library
            for b in batches:
                for at in range(0, len(b), 200):
                    part = b.iloc[at : at + 200]
                    yield finish(lib, pd.DataFrame({key: key_array(part), "text_crc32": part["text_crc32"].to_numpy(), "ids": [x.tolist() for x in part["ids"]]}))

        joined = joined.select(*key_columns(key), "text_crc32", "ids").mapInPandas(trimmed(last), f"{key} long, {columns}")
    return small.unionByName(joined)


def decode(encoded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, text_crc32, ids, text) of rows (key, text_crc32, ids): the decoded texts. Null ids give a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lib = lattice_of(model).library
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                texts = [None if x is None else lib.decode(x.tolist()) for x in part["ids"]]
                yield pd.DataFrame({key: key_array(part), "text_crc32": part["text_crc32"], "ids": part["ids"], "text": texts})

    return encoded.select(*key_columns(key), "text_crc32", "ids").mapInPandas(trimmed(run), f"{key} long, text_crc32 long, ids array<int>, text string")


def encode_checked(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(key, text_crc32, ids, round_trip): as encode, and whether the decoded ids give the text again."""

    def finish(lib: Any, b: pd.DataFrame) -> pd.DataFrame:
        return b.assign(ids=[np.array(x, np.int32) for x in b["ids"]], round_trip=_same(lib, b))

    return _encoded(docs, model, key, text, giant, chunk, fan, finish, "text_crc32 long, ids array<int>, round_trip boolean")


def _same(lib: Any, b: pd.DataFrame) -> list[bool]:
    return [zlib.crc32(lib.decode(x).encode()) == c for x, c in zip(b["ids"], b["text_crc32"], strict=True)]


def ids_checksum(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def encoded_and_decoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(key, n_tokens, ids_crc32, decoded_chars, round_trip): digests of the ids, and whether decoding gives the text."""

    def finish(lib: Any, b: pd.DataFrame) -> pd.DataFrame:
        back = [lib.decode(x) for x in b["ids"]]
        return pd.DataFrame(
            {
                key: b[key],
                "n_tokens": [len(x) for x in b["ids"]],
                "ids_crc32": [ids_checksum(x) for x in b["ids"]],
                "decoded_chars": [len(t) for t in back],
                "round_trip": [zlib.crc32(t.encode()) == c for t, c in zip(back, b["text_crc32"], strict=True)],
            }
        )

    return _encoded(docs, model, key, text, giant, chunk, fan, finish, "n_tokens long, ids_crc32 long, decoded_chars long, round_trip boolean")
