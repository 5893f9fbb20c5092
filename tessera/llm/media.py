"""Media columns: AVI files of motion-JPEG frames.

Reading: the RIFF tree is parsed (header lists, stream format, the movi list, the idx1 index), frames are found by the
index or, without one, by walking the movi list; each intra frame is decoded on its own (baseline Huffman JPEG), its
brightness histogram is compared with the frame before, and a cut is set where the difference exceeds a threshold that
adapts to the last differences. Each shot gives one timed clip row.

Storing bytes: a payload is stored without loss in the quantised coefficients of 8 x 8 blocks, the format's unit. A
coefficient of magnitude category 8 has exactly 256 values, and its extra bits are one byte. So a block holds 64
bytes: each is the one symbol of a one-bit Huffman code (run 0, category 8) and the byte itself, 72 bytes a block, with a
restart marker after each block so that the DC prediction stays zero. Any baseline JPEG decoder reads these frames.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_array, key_columns, trimmed

UNIT = 64
SIDE = 8  # blocks a frame in either direction
FPS = 25

#: The zigzag order of JPEG.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

#: The Huffman tables of the JPEG standard, which motion-JPEG frames without tables are coded with: the
#: number of codes of each length, and the first symbols; the other symbols follow in ascending order.
STANDARD = {
    (0, 0): ("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    (0, 1): ("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    (1, 0): (
        "00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d",
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    ),
    (1, 1): (
        "00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77",
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
    ),
}


def standard_tables() -> dict[tuple[int, int], tuple[bytes, bytes]]:
    out = {}
    for (kind, number), (lengths, first) in STANDARD.items():
        symbols = bytes.fromhex(first)
        if kind:
            symbols += bytes(r << 4 | n for r in range(16) for n in range(1, 11) if r << 4 | n not in symbols)
        out[kind, number] = bytes.fromhex(lengths), symbols
    return out


#: The orthonormal DCT basis: pixels = DCT.T @ coefficients @ DCT.
_grid = np.arange(8)
DCT = (np.cos((2 * _grid[None, :] + 1) * _grid[:, None] * np.pi / 16) * np.where(_grid[:, None] == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)


# ---- JPEG -------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_header(width: int, height: int) -> bytes:
    one_bit = bytes([1] + [0] * 15)
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00"),
            _segment(0xC4, b"\x00" + one_bit + b"\x08"),  # DC: category 8
            _segment(0xC4, b"\x10" + one_bit + b"\x08"),  # AC: no zeros before, category 8
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        ]
    )


def encode_frame(payload: np.ndarray, width: int, height: int) -> bytes:
    """A JPEG frame whose blocks hold the payload, 64 bytes each."""
    blocks = payload.reshape(-1, UNIT)
    bits = np.zeros((len(blocks), UNIT, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks, axis=1).reshape(-1, UNIT, 8)
    rows = np.empty((len(blocks), 74), np.uint8)
    rows[:, :72] = np.packbits(bits.reshape(len(blocks), -1), axis=1)
    rows[:, 72] = 0xFF
    rows[:, 73] = 0xD0 + np.arange(len(blocks)) % 8
    stuffed = rows == 0xFF
    stuffed[:, 72] = False
    flat, twice = rows.ravel(), np.flatnonzero(stuffed.ravel())
    scan = np.insert(flat, twice + 1, 0)[:-2]  # no marker after the last block
    return _frame_header(width, height) + scan.tobytes() + b"\xff\xd9"


@dataclass
class Jpeg:
    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # id, horizontal and vertical sampling, quantisation table
    quant: dict[int, np.ndarray]
    huffman: dict[tuple[int, int], tuple[bytes, bytes]]
    restart: int
    scan: list[tuple[int, int, int]]  # component, DC table, AC table
    data: bytes


def parse_jpeg(frame: bytes) -> Jpeg:
    """The headers of a baseline frame; without Huffman tables of its own it has those of the standard."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, huffman, restart, size, parts = 2, {}, standard_tables(), 0, (0, 0), []
    while True:
        marker, length = frame[at + 1], struct.unpack(">H", frame[at + 2 : at + 4])[0]
        body = frame[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else "u1").astype(np.float32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            _, h, w, n = struct.unpack(">BHHB", body[:6])
            size, parts = (w, h), [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = frame.rfind(b"\xff\xd9")
            return Jpeg(*size, parts, quant, huffman, restart, scan, frame[at : end if end >= at else len(frame)])
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline JPEG frames are decoded")


def _is_payload(j: Jpeg) -> bool:
    one_bit = (bytes([1] + [0] * 15), b"\x08")
    return len(j.scan) == 1 and j.restart == 1 and j.huffman.get((0, j.scan[0][1])) == one_bit and j.huffman.get((1, j.scan[0][2])) == one_bit


def _payload_blocks(j: Jpeg) -> np.ndarray:
    """Bytes of each block, where every coefficient is one bit and one byte."""
    data = np.frombuffer(j.data, np.uint8)
    full = np.flatnonzero(data[:-1] == 0xFF)
    after = data[full + 1]
    drop = np.concatenate([full[after == 0] + 1, full[after >= 0xD0], full[after >= 0xD0] + 1])
    rows = np.delete(data, drop).reshape(-1, 72)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), UNIT, 9)
    return np.packbits(bits[:, :, 1:].reshape(len(rows), -1), axis=1)


def _codes(table: tuple[bytes, bytes]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[length, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _entropy_blocks(j: Jpeg) -> dict[int, np.ndarray]:
    """Zigzag coefficients of each component in raster order, by the general Huffman decoder."""
    hmax, vmax = max(c[1] for c in j.components), max(c[2] for c in j.components)
    across, down = -(-j.width // (8 * hmax)), -(-j.height // (8 * vmax))
    of = {c[0]: c for c in j.components}
    single = len(j.scan) == 1
    grid = {}
    for c, _, _ in j.scan:
        _, h, v, _ = of[c]
        grid[c] = (-(-(-(-j.width * h // hmax)) // 8), -(-(-(-j.height * v // vmax)) // 8)) if single else (across * h, down * v)
    out = {c: np.zeros((w * h, 64), np.int32) for c, (w, h) in grid.items()}
    tables = {k: _codes(v) for k, v in j.huffman.items()}
    units = grid[j.scan[0][0]][0] * grid[j.scan[0][0]][1] if single else across * down
    pieces = re.split(rb"\xff[\xd0-\xd7]", j.data) if j.restart else [j.data]
    unit = 0
    for piece in pieces:
        raw = piece.replace(b"\xff\x00", b"\xff")
        bits, left, at = 0, 0, 0
        previous = dict.fromkeys(of, 0)

        def take(n: int) -> int:
            nonlocal bits, left, at
            while left < n:
                bits = (bits << 8) | (raw[at] if at < len(raw) else 0xFF)
                at, left = at + 1, left + 8
            left -= n
            value = bits >> left
            bits &= (1 << left) - 1
            return value

        def symbol(table: dict) -> int:
            code = 0
            for length in range(1, 17):
                code = (code << 1) | take(1)
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("bad Huffman code")

        def signed(n: int) -> int:
            v = take(n) if n else 0
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(j.restart or units, units - unit)):
            for c, dc, ac in j.scan:
                _, h, v, _ = of[c]
                w = grid[c][0]
                places = [unit] if single else [((unit // across) * v + y) * w + (unit % across) * h + x for y in range(v) for x in range(h)]
                for p in places:
                    row = out[c][p]
                    previous[c] += signed(symbol(tables[0, dc]))
                    row[0] = previous[c]
                    k = 1
                    while k < 64:
                        s = symbol(tables[1, ac])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            row[k] = signed(s & 15)
                        k += 1
            unit += 1
    return out


def decode_luma(frame: bytes) -> np.ndarray:
    """The brightness plane of a baseline JPEG frame, as uint8 blocks of 8 x 8 in raster order."""
    j = parse_jpeg(frame)
    first = j.components[0]
    if _is_payload(j):
        raw = _payload_blocks(j).astype(np.int32)
        coefficients = np.where(raw < 128, raw - 255, raw)
    else:
        coefficients = _entropy_blocks(j)[first[0]]
    return _pixels(coefficients, j.quant[first[3]])


def _pixels(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    square = np.empty((len(coefficients), 64), np.float32)
    square[:, ZIGZAG] = coefficients * quant
    pixels = DCT.T @ square.reshape(-1, 8, 8) @ DCT
    return np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)


# ---- AVI --------------------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS, note: bytes = b"") -> bytes:
    """An AVI file with one motion-JPEG stream and an idx1 index; note is kept as a comment."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    image = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", image)))
    index, body, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    info = _list(b"INFO", _chunk(b"ICMT", note)) if note else b""
    return _chunk(b"RIFF", b"AVI " + header + info + _list(b"movi", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    width: int
    height: int
    frame_us: int
    note: bytes
    frames: list[tuple[int, int]]  # start and length in the file


def parse_avi(data: bytes) -> Avi:
    """Parse the RIFF tree; frames by idx1 where it is there and sound, else by walking the movi list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict = {"note": b"", "walk": []}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            body, stop = at + 8, min(at + 8 + size, end)
            if name in (b"LIST", b"RIFF"):
                if data[body : body + 4] == b"movi":
                    found["movi"] = body
                walk(body + 4, stop)
            elif name == b"avih":
                head = struct.unpack("<10I", data[body : body + 40])
                found.update(us=head[0], size=(head[8], head[9]))
            elif name == b"ICMT":
                found["note"] = data[body:stop]
            elif name == b"idx1":
                found["idx1"] = data[body:stop]
            elif name[2:] in (b"dc", b"db") and size:
                found["walk"].append((body, size))
            at = body + size + size % 2

    walk(12, len(data))
    frames = []
    if "idx1" in found and "movi" in found:
        entries = [e for e in struct.iter_unpack("<4sIII", found["idx1"][: len(found["idx1"]) // 16 * 16]) if e[0][2:] in (b"dc", b"db") and e[3]]
        # offsets count from the movi list or from the start of the file
        base = found["movi"] if not entries or data[found["movi"] + entries[0][2] :][:4] == entries[0][0] else 0
        frames = [(base + e[2] + 8, e[3]) for e in entries]
        if any(data[at - 8 : at - 4][2:] not in (b"dc", b"db") or at + n > len(data) for at, n in frames):
            frames = []
    return Avi(*found.get("size", (0, 0)), found.get("us", 40_000), found["note"], frames or found["walk"])


# ---- shots ------------------------------------------------------------------------------------------------------


@dataclass
class Clip:
    clip: int
    start_ms: int
    end_ms: int
    frames: int
    brightness: int


def detect_shots(histograms: np.ndarray, window: int = 8, factor: float = 3.0, floor: float = 0.25) -> list[int]:
    """First frames of the shots. A cut is where the histogram difference (0 to 1) exceeds floor and, against the mean
    and spread of the last `window` differences of the same shot, mean + factor * deviation."""
    cuts, recent = [0] if len(histograms) else [], []
    for i in range(1, len(histograms)):
        a, b = histograms[i - 1], histograms[i]
        d = float(np.abs(a / a.sum() - b / b.sum()).sum() / 2)
        limit = max(floor, np.mean(recent) + factor * np.std(recent)) if recent else floor
        if d > limit:
            cuts.append(i)
            recent = []
        else:
            recent = [*recent[-window + 1 :], d]
    return cuts


def video_clips(data: bytes) -> list[Clip]:
    """The timed clips of an AVI file."""
    avi = parse_avi(data)
    planes = [decode_luma(data[at : at + n]) for at, n in avi.frames]
    return _clips(planes, avi.frame_us)


def _clips(planes: list[np.ndarray], frame_us: int) -> list[Clip]:
    histograms = np.array([np.bincount(p.ravel() >> 3, minlength=32) for p in planes], np.float64).reshape(len(planes), 32)
    starts = detect_shots(histograms)
    if not starts:
        return []
    clips = []
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(planes)], strict=True)):
        total = sum(int(p.sum(dtype=np.int64)) for p in planes[a:b])
        clips.append(Clip(k, a * frame_us // 1000, b * frame_us // 1000, b - a, total // max(1, sum(p.size for p in planes[a:b]))))
    return clips


# ---- payloads ---------------------------------------------------------------------------------------------------


def store_payload(raw: bytes) -> bytes:
    """An AVI file that holds raw, filled with zeros to a positive multiple of 64, without loss."""
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    blocks = size // UNIT
    frames = -(-blocks // SIDE**2)
    side = (min(blocks, SIDE), -(-blocks // (SIDE * frames)))
    each = side[0] * side[1] * UNIT
    data = np.zeros(frames * each, np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    note = f"bytes={len(raw)};payload={size}".encode()
    return write_avi([encode_frame(data[i * each : (i + 1) * each], 8 * side[0], 8 * side[1]) for i in range(frames)], 8 * side[0], 8 * side[1], note=note)


def read_payload(data: bytes) -> tuple[int, bytes, list[Clip]]:
    """(bytes without filling, payload, clips) of a stored payload."""
    avi = parse_avi(data)
    n, size = map(int, re.fullmatch(rb"bytes=(\d+);payload=(\d+)\x00*", avi.note).groups())
    parts, planes = [], []
    for at, length in avi.frames:
        j = parse_jpeg(data[at : at + length])
        raw = _payload_blocks(j)
        parts.append(raw.tobytes())
        signed = raw.astype(np.int32)
        planes.append(_pixels(np.where(signed < 128, signed - 255, signed), j.quant[j.components[0][3]]))
    return n, b"".join(parts)[:size], _clips(planes, avi.frame_us)


#: What reading a damaged file may raise.
DAMAGED = (ValueError, IndexError, KeyError, TypeError, AttributeError, struct.error)


def with_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): each text stored as an AVI file. A null text is an empty one; every row stays. A file takes 1.2 bytes
    a byte of text or so, so texts near 2 GB exceed what a binary value can hold and fail.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                yield pd.DataFrame({key: key_array(part), "media": [store_payload(t.encode()) for t in part["t"]]})

    rows = docs.select(*key_columns(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInPandas(trimmed(run), f"{key} long, media binary")


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read stored payloads back: sizes, checksums, and as `feature` the timed clips.

    A null media value gives nulls. One that is no stored payload, or a damaged one, gives nulls but for its own size
    and checksum, and `error` says why; error is null otherwise.
    """
    schema = f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8
        data = bytes(data)
        try:
            n, payload, clips = read_payload(data)
        except DAMAGED as e:
            return None, None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, f"{type(e).__name__}: {e}"
        feature = f"shots={len(clips)};" + ",".join(f"{c.start_ms}-{c.end_ms}:{c.frames}:{c.brightness}" for c in clips)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
        for batch in batches:
            rows = pd.DataFrame([one(m) for m in batch["media"]], columns=names)
            for c in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes"):
                rows[c] = rows[c].astype("Int64")
            yield rows.assign(**{key: key_array(batch)})[[key, *names]]

    return media.select(*key_columns(key), "media").mapInPandas(trimmed(run), schema)


def clip_rows(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, clip, start_ms, end_ms, frames, brightness, error) of any motion-JPEG AVI files in a binary column `media`.

    Nulls and files without frames have no clips. A damaged file has one row with its error and no clip.
    """
    names = [key, "clip", "start_ms", "end_ms", "frames", "brightness", "error"]

    def rows_of(k: int | None, data: bytes) -> list[tuple]:
        try:
            return [(k, c.clip, c.start_ms, c.end_ms, c.frames, c.brightness, None) for c in video_clips(data)]
        except DAMAGED as e:
            return [(k, None, None, None, None, None, f"{type(e).__name__}: {e}")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for k, m in zip(key_array(batch), batch["media"], strict=True) if m is not None for r in rows_of(k, bytes(m))]
            yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(names[:-1], "Int64"))

    return media.select(*key_columns(key), "media").mapInPandas(trimmed(run), f"{key} long, clip int, start_ms long, end_ms long, frames int, brightness int, error string")
