"""Token ids in files of independent zstandard frames.

One file holds the documents of one range of doc_id, in ascending order:

    frame 0 | frame 1 | ... | document index (skippable frame) | seek table (skippable frame)

Each frame holds the ids of some consecutive documents as little-endian unsigned 32-bit integers and decompresses on
its own; a document longer than a frame goes on in frames of its own. The document index lists (frame, offset in the
frame, ids) of each document. The seek table comes last and
follows the public seekable format: compressed size, decompressed size and checksum (the low 32 bits of xxh64) of each
frame, then the number of frames, a flag byte and a magic number. A reader fetches the last bytes, then the table,
then only the frames of the documents asked for, and checks each against its checksum.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, held, key_array, key_columns, stage, trimmed

#: Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 1 << 18
FILE_BYTES, MOST_FILES = 128 << 20, 100_000
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("ids", "<u8")])


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Builds one file; add() takes documents in order."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.limit = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.open: list[bytes] = []
        self.filled = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if len(ids) > self.limit and self.filled:
            self._close_frame()
        self.index.append((doc_id or 0, doc_id is None, len(self.frames), self.filled, len(ids) // 4))
        whole = self.limit // 4 * 4
        for at in range(0, len(ids), whole) if len(ids) > self.limit else [0]:
            part = ids[at : at + whole] if len(ids) > self.limit else ids
            self.open.append(part)
            self.filled += len(part)
            if self.filled >= whole:
                self._close_frame()

    def _close_frame(self) -> None:
        raw = b"".join(self.open)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), checksum(raw)))
        self.open, self.filled = [], 0

    def finish(self) -> None:
        if self.open:
            self._close_frame()
        index = self.packer.compress(np.array(self.index, INDEX).tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index) + 4) + index + struct.pack("<I", checksum(index)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Reads from a seekable file object, no more than the frames asked for."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, os.SEEK_END)
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        table = size - 9 - 12 * frames
        self.frames = np.frombuffer(self._at(table, 12 * frames), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        at = int(self.starts[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        index, mark = self._at(at + 8, length - 4), struct.unpack("<I", self._at(at + 4 + length, 4))[0]
        if magic != INDEX_MAGIC or checksum(index) != mark:
            raise ValueError("the document index is damaged")
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(index), INDEX)
        self.held, self.raw = -1, b""
        self.fetched = 0

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def frame(self, k: int) -> bytes:
        if k != self.held:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if checksum(raw) != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.held, self.raw, self.fetched = k, raw, self.fetched + 1
        return self.raw

    def document(self, n: int) -> np.ndarray:
        """The ids of the n-th document."""
        d = self.index[n]
        k, at, left, parts = int(d["frame"]), int(d["offset"]), 4 * int(d["ids"]), []
        while left:
            parts.append(self.frame(k)[at : at + left])
            k, at, left = k + 1, 0, left - len(parts[-1])
        return np.frombuffer(b"".join(parts), "<u4")

    def find(self, doc_id: int) -> list[int]:
        """The places of the documents with this id, by binary search; nulls come first and are not looked at."""
        first = int(self.index["null"].sum())
        lo, hi = (int(np.searchsorted(self.index["doc_id"][first:], doc_id, side)) for side in ("left", "right"))
        return list(range(first + lo, first + hi))


#: Letters (lower case) and numbers that the quick split knows; texts with other characters take the library's own way.
LETTERS, NUMBERS = "a-zªµºß-öø-ž", "0-9²³¹¼½¾"
QUICK = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u012f\\u0131-\\u017e]")
SPACE, LETTER, NUMBER, OTHER, LEAD, ODD = range(6)


def _kind(c: str) -> int:
    """What the quick split takes a character for; ODD if it does not know it."""
    if not QUICK.match(c):
        return ODD
    return next((k for k, signs in ((SPACE, r"\s"), (LETTER, LETTERS), (NUMBER, NUMBERS)) if re.match(f"[{signs}]", c.lower())), OTHER)


#: Kinds and lower case of the first code points, which UTF-8 writes in one byte or two, and of single bytes: those that
#: lead two bytes are looked up by their code point, those of longer characters are odd.
KINDS = np.array([_kind(chr(c)) for c in range(0x180)], np.uint8)
LOWER = np.array([ord(chr(c).lower()) if k != ODD else c for c, k in enumerate(KINDS)], np.uint16)
BYTE_KINDS = np.concatenate([KINDS[:0x80], np.full(0x40, OTHER), np.full(0x40, ODD)]).astype(np.uint8)
BYTE_KINDS[0xC2:0xC6] = LEAD
BYTE_LOWER = np.concatenate([LOWER[:0x80], np.arange(0x80, 0x100)]).astype(np.uint8)


def split_words(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray, list[int]]:
    """The words of UTF-8 texts in lower case, as the tokenizer's pattern splits them ('s, 't, 're, 've, 'm, 'll, 'd, else
    runs of letters, single numbers, runs of other signs), the place of each text's first word (and the number of all),
    and the texts that it cannot split, which have no words here. Looks at bytes of all texts at once."""
    data = np.frombuffer(b"\n".join([*texts, b"\n\n"]), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    kind, low = BYTE_KINDS[data], BYTE_LOWER[data]
    lead = np.flatnonzero(kind == LEAD)
    code = (data[lead].astype(np.uint16) & 0x1F) << 6 | data[lead + 1] & 0x3F
    kind[lead] = kind[lead + 1] = KINDS[code]
    low[lead], low[lead + 1] = 0xC0 | LOWER[code] >> 6, 0x80 | LOWER[code] & 0x3F
    special = np.flatnonzero(data == ord("<"))
    special = special[data[special + 1] == ord("|")]
    odd = np.unique(np.searchsorted(bounds, np.concatenate([np.flatnonzero(kind == ODD), special]), "right") - 1).tolist()
    for i in odd:
        kind[bounds[i] : bounds[i + 1]] = SPACE
    first = np.empty(len(data), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == NUMBER
    first[lead + 1] = False
    mark = np.flatnonzero(low == ord("'"))
    mark = mark[first[mark] & (kind[mark] != SPACE)]
    one, two = low[mark + 1], low[mark + 1].astype(np.uint16) << 8 | low[mark + 2]
    size = np.isin(one, np.frombuffer(b"stmd", np.uint8)) + 2 * np.isin(two, np.frombuffer(b"revell", ">u2"))
    mark, size = mark[size > 0], size[size > 0]
    first[mark + 1] = False
    after = mark + 1 + size
    first[after[kind[after] == LETTER]] = True
    solid = kind != SPACE
    first &= solid
    packed, starts = low[solid], np.flatnonzero(first[solid])
    ends = np.append(starts, len(packed))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    return words, np.searchsorted(np.flatnonzero(first), bounds), odd


class Places(dict):
    """word -> its place among the words looked up so far."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


class WordEncoder:
    """Ids of texts by a tokenizer whose words are encoded one by one; remembers the ids of words.

    The quick way splits plain Latin text as the tokenizer's own pattern does, a batch at once, and asks the library for
    words not met before. Texts with other characters, or with something like a special token, go to the library whole.
    """

    REMEMBERED = 900_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        #: The same model for words that are split and in lower case already.
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        pieces = self.library.get_vocab()
        self.last = np.zeros(max(pieces.values()) + 1, bool)
        self.last[[i for piece, i in pieces.items() if piece.endswith(self.library.model.end_of_word_suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.ids = Places(), pa.array([], pa.large_binary())

    def _learn(self, words: list[bytes]) -> pa.LargeBinaryArray:
        """Encode new words as one text, in which spaces part them; the last id of a word shows that it is one."""
        (found,) = self.model.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        cuts = np.concatenate([[0], 4 * (np.flatnonzero(self.last[ids]) + 1)])
        if len(cuts) != len(words) + 1:  # a word that the library splits otherwise
            return pa.array([self._whole(w.decode()) for w in words], pa.large_binary())
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens."""
        known = len(self.ids)
        if known > self.REMEMBERED or known != len(self.words):
            self.forget()
            known = 0
        words, starts, odd = split_words([t.encode() for t in texts])
        words = words.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        new = list(itertools.islice(reversed(self.words), len(self.words) - known))[::-1]
        self.ids = pa.concat_arrays([self.ids, *(self._learn(new[at : at + 1000]) for at in range(0, len(new), 1000))])
        found = self.ids.take(pa.array(places)).take(words.indices)
        _, ends, flat = found.buffers()
        cuts = np.frombuffer(ends, np.int64)[starts].tolist() if len(found) else [0] * len(starts)
        flat = memoryview(flat or b"")
        out = [bytes(flat[a:b]) for a, b in itertools.pairwise(cuts)]
        for i in odd:
            out[i] = self._whole(texts[i])
        return out


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, kept between tasks."""
    return held(f"encoder {path}", lambda: WordEncoder(path))


def _bounded(texts: list[str], chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of a batch with a bounded number of characters each, one text at least."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield slice(at, i)
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def _estimated_bytes(docs: DataFrame) -> int:
    """The size of one source as the planner knows it; 0 if it does not, or where several sources meet."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    return size if plan.collectLeaves().size() == 1 and size < 1 << 60 else 0


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode and write docs under path; returns the manifest (part, file, documents, ids, first, last), part in ascending
    order of key; first and last are the least and greatest key of a file, null if it has only null keys.

    A task writes under a name of its own, so an attempt that is lost or repeated harms no other; only files in the
    manifest count. There are as many files as the tables' estimated size asks for. Rows of one key are ordered by their
    text's hash and then by their place, so that a key with very many rows is spread over several files.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_FILES, -(-_estimated_bytes(docs) // FILE_BYTES)))
    given = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t"), F.col("place")]
    ordered = given.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).select("k", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(path)
        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        out, ids = None, 0
        for batch in batches:
            if out is None:
                if not len(batch):
                    continue
                name = f"{root}/{uuid.uuid4().hex}.ids.zst"
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(name, compression=None)
                writer = FrameWriter(out)
            texts = batch["t"].tolist()
            keys = [None if k is pd.NA else int(k) for k in key_array(batch)]
            for s in _bounded(texts):
                for k, b in zip(keys[s], enc.encode(texts[s]), strict=True):
                    writer.add(k, b + end)
                    ids += len(b) // 4 + 1
        if out is not None:
            writer.finish()
            out.close()
            known = [i[0] for i in writer.index if not i[1]]
            ends = pd.array([known[0], known[-1]] if known else [pd.NA, pd.NA], "Int64")
            yield pd.DataFrame({"file": [name], "documents": [len(writer.index)], "ids": [ids], "first": ends[:1], "last": ends[1:]})

    written = ordered.select(*key_columns("k"), "t").mapInPandas(trimmed(run), "file string, documents long, ids long, first long, last long")
    return stage(written.withColumn("part", F.spark_partition_id()), "manifest")


def read_files(manifest: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files of the manifest.

    The manifest has one row for each file; the driver adds up their ids to get each file's start.
    """
    spark = manifest.sparkSession
    files = sorted(manifest.select("part", "file", "ids").collect())
    rows, at = [], 0
    for f in files:
        rows.append((f.file, at))
        at += f.ids
    listed = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, start in zip(batch["file"], batch["start"], strict=True):
                with fs.open_input_file(name) as f:
                    reader = FrameReader(f)
                    sizes = reader.index["ids"].astype(np.int64)
                    starts = start + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
                    for lo in range(0, len(sizes), 20_000):
                        part = range(lo, min(lo + 20_000, len(sizes)))
                        keys = pd.array(reader.index["doc_id"][lo : part.stop], "Int64")
                        keys[reader.index["null"][lo : part.stop] == 1] = pd.NA
                        yield pd.DataFrame({key: keys, "start": starts[lo : part.stop], "n_tokens": sizes[lo : part.stop], "ids_crc32": [zlib.crc32(reader.document(n)) for n in part]})

    return listed.mapInPandas(trimmed(run), f"{key} long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, path: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ids): the ids of each document whose key is in `wanted` (key), once for each such document.

    The files that can hold a key follow from the manifest's ends; of these only the index and the frames of wanted
    documents are read. Null and unknown keys have no row; repeated wanted keys count once.
    """
    files = sorted((r.first, r.last, r.file) for r in manifest.where("first is not null").select("first", "last", "file").collect())
    first, last = (np.array([f[i] for f in files], np.int64) for i in (0, 1))
    names = [f[2] for f in files]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k = batch["k"].to_numpy(np.int64)
            lo, hi = np.searchsorted(last, k, "left"), np.searchsorted(first, k, "right")
            n = np.maximum(hi - lo, 0)
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)]) if n.sum() else np.zeros(0, int)
            yield pd.DataFrame({"file": [names[i] for i in at], "k": np.repeat(k, n)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, rows in batch.groupby("file", sort=False):
                with fs.open_input_file(name) as f:
                    reader, out, held = FrameReader(f), [], 0
                    for k in rows["k"]:
                        for n in reader.find(int(k)):
                            out.append((k, reader.document(n).astype("<i8")))
                            held += len(out[-1][1])
                            if held > 1_000_000:
                                yield pd.DataFrame(out, columns=[key, "ids"])
                                out, held = [], 0
                    yield pd.DataFrame(out, columns=[key, "ids"]).astype({key: "int64"})

    asked = wanted.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    found = asked.mapInPandas(trimmed(place), "file string, k long").repartition("file").sortWithinPartitions("file", "k")
    return found.mapInPandas(trimmed(run), f"{key} long, ids array<long>")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents' ids to files and read them back: (key, start, n_tokens, ids_crc32).

    Null texts are empty texts: their ids are the end id alone. Null keys come first; rows with equal keys follow one
    another in the order of their texts' hashes; an empty table writes no file and gives an empty result. A text of any length
    is encoded whole. Other columns are not looked at. path: a folder that all executors reach, as a URI.
    """
    path = path or fresh_dir(docs.sparkSession, "ids")
    if "://" not in path:
        path = "file://" + path
    return read_files(write_files(docs, path, tokenizer, end_id, key, text), path, key)
