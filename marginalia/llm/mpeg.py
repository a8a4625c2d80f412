"""MPEG audio media columns: frame headers, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

parse() reads any MPEG-1/2/2.5 audio of layers I to III: ID3v2 at the front, ID3v1 at the end, a Xing/Info or VBRI frame, and
frames found by resynchronising: a header counts only if the next frame's header, the end, or a tag follows where it says.
Protected frames have their CRC-16 checked (layers I and III; layer II's covers data that depends on its allocation table and
counts as unverified). Durations are exact fractions: samples over sample rate, summed per rate.

store() keeps arbitrary bytes losslessly in a valid stream: Layer III frames at 48 kHz, mono, with CRC, no coded audio (so
they decode to silence) and the bytes as ancillary data. The first frame is a Xing frame with counts and seek table, the ID3v2
tag carries the length and CRC-32 of the payload, and the last frame's bitrate is the least that holds what is left. An ID3v1 tag closes
every stream, so no payload stands where a reader looks for one.

Nulls: a null text is an empty one. Any bytes can be parsed; what isn't a frame is counted as skipped. Empty tables give
empty results; other columns are not read; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, map_docs, table

RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: kbit/s by (MPEG-1?, layer), index 1 to 14.
KBITS = {
    (True, 1): tuple(range(32, 449, 32)),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbits: int
    rate: int
    channels: int
    size: int  # bytes, header included
    samples: int
    side: int  # bytes of Layer III side information


_headers: dict[bytes, Header | None] = {}


def header(h: bytes) -> Header | None:
    """The header that four bytes are, if they are one. Free-format streams aren't supported."""
    if h not in _headers:
        if len(_headers) > 4096:
            _headers.clear()
        _headers[h] = _header(h)
    return _headers[h]


def _header(h: bytes) -> Header | None:
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3)
    bits, freq = h[2] >> 4, h[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or freq == 3 or h[3] & 3 == 2:
        return None
    one, mono, pad = version == 3, h[3] >> 6 == 3, h[2] >> 1 & 1
    kbits, rate = KBITS[one, layer][bits - 1], RATES[version][freq]
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    size = (12000 * kbits // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // rate + pad
    side = 0 if layer != 3 else (17 if mono else 32) if one else (9 if mono else 17)
    return Header(version, layer, not h[1] & 1, kbits, rate, 1 if mono else 2, size, samples, side)


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()
_crcs: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """CRC-16 of polynomial 0x8005 from 0xFFFF, as frames carry it."""
    if data in _crcs:
        return _crcs[data]
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    if len(_crcs) < 4096:
        _crcs[data] = c
    return c


def crc_ok(data: bytes, at: int, h: Header) -> bool | None:
    """Whether a frame's checksum holds; None where it has none or it can't be told."""
    if not h.protected or h.layer == 2:
        return None
    n = h.side if h.layer == 3 else 16 * h.channels  # layer I: 32 four-bit allocations a channel
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + n]) == int.from_bytes(data[at + 4 : at + 6], "big")


@dataclass
class Audio:
    frames: list[tuple[int, Header]] = field(default_factory=list)  # offset, header; a Xing/VBRI frame isn't among them
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)
    skipped: int = 0
    crc_good: int = 0
    crc_bad: int = 0

    @property
    def duration(self) -> Fraction:
        by: dict[int, int] = {}
        for _, h in self.frames:
            by[h.rate] = by.get(h.rate, 0) + h.samples
        return sum((Fraction(n, r) for r, n in by.items()), Fraction(0))

    def seek(self, seconds: Fraction | float) -> int:
        """Offset of the frame that sounds at a time; the last one's beyond the end, -1 without frames."""
        if not self.frames:
            return -1
        starts, t = [], Fraction(0)
        for _, h in self.frames:
            starts.append(t)
            t += Fraction(h.samples, h.rate)
        return self.frames[max(0, bisect_right(starts, Fraction(seconds)) - 1)][0]


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads a leading ID3v2.3/2.4 tag's text frames; its length."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    end = min(len(data), 10 + _synchsafe(data[6:10]))
    at = 10
    if data[5] & 0x40 and at + 4 <= end:
        at += _synchsafe(data[at : at + 4]) if data[3] == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
    while at + 10 <= end and data[at] and data[3] in (3, 4):
        name, n = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
        size = _synchsafe(n) if data[3] == 4 else int.from_bytes(n, "big")
        body = data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            tags[name] = text.rstrip("\0")
        at += 10 + size
    return end + 10 * bool(data[5] & 0x10)


def _id3v1(data: bytes, tags: dict[str, str]) -> int:
    """Reads a closing ID3v1 tag; where the audio ends."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return len(data)
    t = data[-125:]
    for name, a, b in (("title", 0, 30), ("artist", 30, 60), ("album", 60, 90), ("year", 90, 94), ("comment", 94, 124)):
        if v := t[a:b].split(b"\0")[0].decode("latin-1").rstrip():
            tags["v1." + name] = v
    return len(data) - 128


def _vbr(data: bytes, at: int, h: Header) -> dict:
    """The seek table of a first frame that only holds one."""
    x = at + 4 + 2 * h.protected + h.side
    if h.layer == 3 and data[x : x + 4] in (b"Xing", b"Info") and x + 8 <= len(data):
        out, flags, p = {"kind": data[x : x + 4].decode()}, int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[p : p + 4], "big")
                p += 4
        if flags & 4:
            out["toc"] = list(data[p : p + 100])
        return out
    x = at + 36
    if data[x : x + 4] == b"VBRI" and x + 26 <= len(data):
        n_bytes, frames, entries, scale, width, per = struct.unpack(">IIHHHH", data[x + 10 : x + 26])
        toc = [int.from_bytes(data[x + 26 + i * width : x + 26 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": n_bytes, "toc": toc, "frames_per_entry": per}
    return {}


def parse(data: bytes) -> Audio:
    a = Audio()
    at, end = _id3v2(data, a.tags), _id3v1(data, a.tags)
    at, synced, first = min(at, end), False, True
    while at < end:
        h = header(data[at : at + 4])
        # A first header after a gap needs a second one where its frame ends; in a run, a frame needs only to be whole.
        if h and at + h.size <= end and (synced or at + h.size == end or header(data[at + h.size : at + h.size + 4])):
            if first and (vbr := _vbr(data, at, h)):
                a.vbr = vbr
            else:
                a.frames.append((at, h))
            ok = crc_ok(data, at, h)
            a.crc_good, a.crc_bad = a.crc_good + (ok is True), a.crc_bad + (ok is False)
            at, synced, first = at + h.size, True, False
            continue
        synced = False
        nxt = data.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        a.skipped += nxt - at
        at = nxt
    return a


_SIDE = bytes(17)


def _frame_head(index: int) -> bytes:
    """MPEG-1 Layer III, CRC, 48 kHz, mono, no coded audio; index: of the bitrate."""
    h = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 3 << 6))
    return h + crc16(h[2:] + _SIDE).to_bytes(2, "big") + _SIDE


_HEADS = {k: (_frame_head(i + 1), 3 * k) for i, k in enumerate(KBITS[True, 3])}  # 144000 * kbits / 48000 bytes
_LARGE = 320
HEAD = 23
_CLOSING = b"TAG" + b"stored payload".ljust(124, b"\0") + b"\xff"  # title; no genre


def store(payload: bytes, n_bytes: int) -> bytes:
    """A stream that holds payload; n_bytes: of it, without its padding."""
    head, size = _HEADS[_LARGE]
    room = size - HEAD
    body = [head + payload[i : i + room] for i in range(0, len(payload) - room + 1, room)]
    if rest := len(payload) % room:
        h, size_ = next(x for x in _HEADS.values() if x[1] - HEAD >= rest)
        body.append((h + payload[len(payload) - rest :]).ljust(size_, b"\0"))
    audio = b"".join(body)
    xhead, xsize = _HEADS[64]  # 192 bytes: the Xing table needs 116
    total, n = xsize + len(audio), len(body)
    toc = bytes(min(255, (xsize + i * n // 100 * size) * 256 // total) for i in range(100))
    xing = (xhead + b"Xing" + struct.pack(">III", 7, n, total) + toc).ljust(xsize, b"\0")
    texts = b"".join(
        b"TXXX" + struct.pack(">I", len(v) + 1) + b"\0\0\0" + v
        for v in (b"payload_bytes\0%d" % len(payload), b"n_bytes\0%d" % n_bytes, b"payload_crc32\0%08x" % zlib.crc32(payload))
    )
    t = len(texts)
    return b"ID3\x03\0\0" + bytes((t >> 21 & 127, t >> 14 & 127, t >> 7 & 127, t & 127)) + texts + xing + audio + _CLOSING


def load(data: bytes) -> tuple[bytes, Audio]:
    """The payload of a stream by store(), verified against its tag, and what parse() found."""
    a = parse(data)
    n = int(a.tags["payload_bytes"])
    payload = b"".join([data[at + HEAD : at + h.size] for at, h in a.frames])[:n]
    if a.crc_bad or a.skipped or len(payload) != n or zlib.crc32(payload) != int(a.tags["payload_crc32"], 16):
        raise ValueError("the stream doesn't hold what its tag says")
    return payload, a


def feature(a: Audio) -> str:
    """Frames, exact duration, mean bitrate, checks and the offsets of ten seek points."""
    d, n = a.duration, len(a.frames)
    seek = ",".join(str(a.frames[i * n // 10][0]) for i in range(10)) if n else ""
    bits = round(8 * sum(h.size for _, h in a.frames) / d) if d else 0
    return f"frames={n};duration={d.numerator}/{d.denominator};bitrate={bits};crc={a.crc_good}+{a.crc_bad};vbr={a.vbr.get('kind', '')}:{a.vbr.get('frames', '')};skipped={a.skipped};seek={seek}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration double, n_frames long, frame_offsets array<long>"


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as MPEG audio and read back (see DIGEST). frame_offsets: of every frame, the seek index."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in as_bytes(b, text_col):
            padded = text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")
            media = store(padded, len(text))
            back, a = load(media)
            out.append((int(a.tags["n_bytes"]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(a), float(a.duration), len(a.frames), [at for at, _ in a.frames]))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
        cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        return pa.RecordBatch.from_arrays([b.column(0), *cols], names=[x.split()[0] for x in DIGEST.split(", ")])

    return map_docs(docs, [id_col, text_col], each, DIGEST)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media column itself: doc_id, media binary."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        media = [store(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0"), len(t)) for t in as_bytes(b, text_col)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return map_docs(docs, [id_col, text_col], each, "doc_id long, media binary")


INSPECT = "doc_id long, duration_num long, duration_den long, frame_offsets array<long>, frame_samples array<int>, crc_good long, crc_bad long, skipped long, vbr_kind string, vbr_frames long, tags map<string,string>"


def inspect(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """parse() over a column of MPEG bytes from any writer (see INSPECT); null bytes count as none."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data in as_bytes(b, media_col):
            a = parse(data)
            d = a.duration
            out.append((d.numerator, d.denominator, [x for x, _ in a.frames], [h.samples for _, h in a.frames], a.crc_good, a.crc_bad, a.skipped, a.vbr.get("kind"), a.vbr.get("frames"), list(a.tags.items())))
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]
        cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        return pa.RecordBatch.from_arrays([b.column(0), *cols], names=[x.split()[0] for x in INSPECT.split(", ")])

    return map_docs(media, [id_col, media_col], each, INSPECT)


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_digest() of all documents. A null or empty text is 64 bytes of padding; repeated rows give repeated rows; an empty table gives none."""
    return media_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op7_mpeg_audio": op7_mpeg_audio}
SQL: dict[str, str] = {}
