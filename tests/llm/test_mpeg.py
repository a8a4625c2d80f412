import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from marginalia.llm import mpeg

SCHEMA = "doc_id long, text string, feature string, media int"


def padded(t: bytes) -> bytes:
    return t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))


def check(row, text):
    t = (text or "").encode()
    p = padded(t)
    assert (row.n_bytes, row.payload_bytes) == (len(t), len(p))
    assert row.payload_sha256 == hashlib.sha256(p).hexdigest() and row.tail_crc32 == zlib.crc32(p[-64:])
    media = mpeg.store(p, len(t))
    assert (row.media_bytes, row.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert len(row.frame_offsets) == row.n_frames == -(-len(p) // 937) and row.duration == row.n_frames * 1152 / 48000


def test_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = mpeg.op7_mpeg_audio(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check(r, texts[r.doc_id])


def test_odd_texts(spark):
    odd = [None, "", "x", "y" * 64, "z" * 65, "é" * 40000, "\x00\x01", "a" * 937, "b" * 960, "ÿ" * 3000]
    df = spark.createDataFrame([(i, t, "f", 3) for i, t in enumerate(odd)] * 2, SCHEMA)
    rows = mpeg.media_digest(df).collect()
    assert len(rows) == 2 * len(odd)
    for r in rows:
        check(r, odd[r.doc_id])
    back = {r.doc_id: r for r in mpeg.inspect(mpeg.to_media(df)).collect()}
    assert back[5].crc_good == len(back[5].frame_offsets) + 1 and back[5].vbr_frames == len(back[5].frame_offsets)
    assert mpeg.media_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_round_trip_of_any_bytes():
    rng = random.Random(1)
    for n in [0, 1, 64, 936, 937, 938, 5000, 30000]:
        p = padded(bytes(rng.choices([0xFF, 0xFA, 0xE4, 0xC0, 0, 7], k=n)))
        back, a = mpeg.load(mpeg.store(p, n))
        assert back == p and not a.skipped and not a.crc_bad


def test_tag_marks_in_the_payload():
    """Any place of TAG, ID3 or a frame's head within the last 200 bytes of texts of many lengths."""
    for n in [64, 128, 192, 832, 896, 960, 1024, 1856, 1920, 4096]:
        for mark in (b"TAG", b"ID3\x03\0\0\0\0\0\x7f", b"\xff\xfa\xe4\xc0"):
            for at in range(max(0, n - 200), n - len(mark) + 1):
                p = (b"x" * at + mark).ljust(n, b"x")
                assert mpeg.load(mpeg.store(p, n))[0] == p


def test_text_that_looks_like_a_tag(spark):
    texts = ["x" * 809 + "TAG" + "x" * 84, "TAG", "x" * 61 + "TAG"]
    for r in mpeg.media_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        check(r, texts[r.doc_id])


def test_damage_is_seen():
    p = padded(b"some text " * 900)
    m = bytearray(mpeg.store(p, 9000))
    a = mpeg.parse(bytes(m))
    m[a.frames[2][0] + 8] ^= 1  # in the side information
    assert mpeg.parse(bytes(m)).crc_bad == 1
    with pytest.raises(ValueError):
        mpeg.load(bytes(m))


def test_resync_tags_and_seek():
    p = padded(b"text " * 2000)
    m = mpeg.store(p, 10000)
    whole = mpeg.parse(m)
    cut = whole.frames[3][0]
    junk = b"\xff\xfa\xe4\xc0 not a frame \xff\xfb"
    v1 = b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    a = mpeg.parse(m[:cut] + junk + m[cut:-128] + v1)  # in place of the closing tag
    assert len(a.frames) == len(whole.frames) and a.skipped == len(junk) and a.tags["v1.title"] == "Title"
    assert a.duration == whole.duration == Fraction(1152 * len(whole.frames), 48000)
    assert whole.seek(0) == whole.frames[0][0] and whole.seek(Fraction(1152 * 2, 48000)) == whole.frames[2][0]
    assert whole.seek(99) == whole.frames[-1][0] and mpeg.parse(b"").seek(1) == -1


def test_headers_of_other_kinds():
    h = mpeg.header(bytes.fromhex("fffb9064"))  # 44.1 kHz, 128 kbit/s, joint stereo
    assert (h.layer, h.rate, h.kbits, h.size, h.samples, h.channels, h.protected) == (3, 44100, 128, 417, 1152, 2, False)
    h = mpeg.header(bytes.fromhex("fff38264"))  # MPEG-2
    assert (h.version, h.rate, h.samples) == (2, 22050, 576) and h.size == 72 * 64000 // 22050 + 1
    assert mpeg.header(b"\xff\xff\xff\xff") is None and mpeg.header(b"ab") is None
    layer1 = mpeg.header(bytes.fromhex("fffe40c0"))
    assert (layer1.version, layer1.layer, layer1.kbits, layer1.protected, layer1.size) == (3, 1, 128, True, 12000 * 128 // 44100 * 4)
