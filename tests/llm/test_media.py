import hashlib
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import media as md


@pytest.mark.parametrize("raw", [b"", b"x", b"\xff" * 63, b"\xff" * 64, bytes(range(256)) * 40, b"\x00\xff\xd9\xff\xd0" * 3000])
def test_round_trip(raw):
    stored = md.store_payload(raw)
    n, payload, clips = md.read_payload(stored)
    assert n == len(raw) and payload == raw + b"\0" * (max(64, -(-n // 64) * 64) - n)
    assert sum(c.frames for c in clips) == len(md.parse_avi(stored).frames)
    assert struct.unpack("<I", stored[4:8])[0] == len(stored) - 8


def test_general_decoder_agrees():
    stored = md.store_payload(bytes(range(256)) * 20)
    avi = md.parse_avi(stored)
    for at, size in avi.frames:
        j = md.parse_jpeg(stored[at : at + size])
        raw = md._payload_blocks(j).astype(int)
        assert np.array_equal(md._entropy_blocks(j)[1], np.where(raw < 128, raw - 255, raw))
    assert np.allclose(md.DCT @ md.DCT.T, np.eye(8), atol=1e-6)


def grey_frame(level: int, side: int = 16) -> bytes:
    """A flat grey JPEG with ordinary tables: one DC difference, and end-of-block codes."""
    value = round((level - 128) * 8 / 8)
    size = abs(value).bit_length()
    dc = {s: format(s, "04b") for s in range(12)}
    first = dc[size] + (format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else "")
    bits = first + "00" + (dc[0] + "00") * ((side // 8) ** 2 - 1)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    counts = bytes([0, 0, 0, 12] + [0] * 12)
    return b"".join(
        [
            b"\xff\xd8", md._segment(0xDB, b"\x00" + b"\x08" * 64), md._segment(0xC0, struct.pack(">BHHB", 8, side, side, 1) + b"\x01\x11\x00"), md._segment(0xC4, b"\x00" + counts + bytes(range(12))),
            md._segment(0xC4, b"\x10" + bytes([0, 1] + [0] * 14) + b"\x00"), md._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"), scan, b"\xff\xd9",
        ]
    )


def test_shots():
    levels = [40] * 6 + [200] * 5 + [41] * 4
    data = md.write_avi([grey_frame(v) for v in levels], 16, 16)
    clips = md.video_clips(data)
    assert [(c.start_ms, c.end_ms, c.frames) for c in clips] == [(0, 240, 6), (240, 440, 5), (440, 600, 4)]
    assert [abs(c.brightness - v) <= 1 for c, v in zip(clips, (40, 200, 41), strict=True)] == [True] * 3
    cut = data[: data.index(b"idx1")]
    assert md.parse_avi(cut).frames == md.parse_avi(data).frames
    with pytest.raises(ValueError):
        md.parse_avi(b"nothing of the kind")


def test_frames(spark, docs_of, odd, empty):
    rows = [(1, "häm " * 3000), (2, "x"), (3, "x")]
    found = {r.doc_id: r for r in md.media_features(md.with_media(docs_of(rows))).collect()}
    for i, t in rows:
        raw = t.encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert found[2][1:] == found[3][1:]
    odds = md.media_features(md.with_media(odd)).collect()
    assert len(odds) == odd.count() and sum(r.doc_id is None for r in odds) == 1
    assert md.media_features(md.with_media(empty)).count() == 0
    clips = md.clip_rows(spark.createDataFrame([(5, bytearray(md.write_avi([grey_frame(9)], 16, 16))), (6, None)], "doc_id long, media binary")).collect()
    assert [(c.doc_id, c.clip, c.end_ms) for c in clips] == [(5, 0, 40)]


def jvm_pixels(spark, frame):
    """Brightness of a frame by the JVM's own JPEG decoder, an independent one."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(frame))
    raster = image.getRaster()
    w, h = raster.getWidth(), raster.getHeight()
    return np.array(list(raster.getSamples(0, 0, w, h, 0, spark.sparkContext._gateway.new_array(jvm.int, w * h)))).reshape(h, w)


def jvm_frame(spark, pixels):
    """A grey frame by the JVM's own JPEG encoder, which uses the standard tables."""
    jvm = spark._jvm
    h, w = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 10)
    flat = spark.sparkContext._gateway.new_array(jvm.int, w * h)
    for i, v in enumerate(pixels.ravel().tolist()):
        flat[i] = v
    image.getRaster().setSamples(0, 0, w, h, 0, flat)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def without_tables(frame):
    """The frame without its Huffman tables, as ordinary motion-JPEG files have it."""
    at, out = 2, frame[:2]
    while frame[at + 1] != 0xDA:
        end = at + 2 + struct.unpack(">H", frame[at + 2 : at + 4])[0]
        out += b"" if frame[at + 1] == 0xC4 else frame[at:end]
        at = end
    return out + frame[at:]


def squared(blocks, w, h):
    """Blocks in raster order as an image."""
    return blocks.reshape(-1, w // 8, 8, 8).transpose(0, 2, 1, 3).reshape(-1, w)[:h]


def test_frames_against_another_decoder(spark):
    """Pixels and features of stored payloads as an independent decoder sees them."""
    stored = md.store_payload(bytes(range(256)) * 20 + b"\x80\x7f" * 500)
    avi = md.parse_avi(stored)
    planes = []
    for at, size in avi.frames:
        frame = stored[at : at + size]
        theirs = jvm_pixels(spark, frame)
        ours = squared(md.decode_luma(frame), avi.width, avi.height).astype(int)
        assert np.abs(ours - theirs).max() <= 1
        planes.append(theirs)
    clips = md.video_clips(stored)
    assert sum(c.frames for c in clips) == len(planes)
    assert all(abs(c.brightness - np.mean([p.mean() for p in planes[c.start_ms // 40 : c.end_ms // 40]])) <= 1 for c in clips)


def test_frames_without_tables(spark):
    rnd = np.random.default_rng(3)
    pixels = np.clip(np.add.outer(np.arange(24) * 4, np.arange(32) * 3) + rnd.integers(-20, 20, (24, 32)), 0, 255).astype(int)
    frame = jvm_frame(spark, pixels)
    bare = without_tables(frame)
    assert b"\xff\xc4" not in bare
    theirs = jvm_pixels(spark, frame)
    assert np.abs(squared(md.decode_luma(bare), 32, 24).astype(int) - theirs).max() <= 1
    clips = md.video_clips(md.write_avi([bare] * 3, 32, 24))
    assert [(c.start_ms, c.end_ms, c.frames) for c in clips] == [(0, 120, 3)]


def test_damaged_rows(spark):
    """Damaged files give an error in their own row and harm no other."""
    fine = md.store_payload(b"some text")
    cut = fine[: fine.index(b"movi") + 20]
    rows = [(1, fine), (2, b"no avi"), (3, md.write_avi([], 16, 16)), (4, md.write_avi([b"\xff\xd8\xff\xc0 broken"], 16, 16)), (5, None), (6, b""), (7, cut)]
    media = spark.createDataFrame([(i, None if m is None else bytearray(m)) for i, m in rows], "doc_id long, media binary")
    found = {r.doc_id: r for r in md.media_features(media).collect()}
    assert found[1].error is None and found[1].n_bytes == 9
    assert all(found[i].error and found[i].n_bytes is None and found[i].media_bytes == len(m) for i, m in rows if i in (2, 3, 4, 6))
    assert found[5].error is None and found[5].media_bytes is None
    clips = {r.doc_id: r for r in md.clip_rows(media).collect()}
    assert set(clips) - {7} == {1, 2, 4, 6} and clips[1].error is None and all(clips[i].error and clips[i].clip is None for i in (2, 4, 6))
