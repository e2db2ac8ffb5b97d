"""Media columns for MPEG audio: bytes carried in, and facts read from, layer III streams.

Writing: a payload travels as the ancillary data of silent MPEG-1 layer III frames (48 kHz, mono,
with checksums), led by an ID3v2 tag that states its length and by a frame with a Xing table. The
frames have a variable bit rate: full frames of 320 kbit/s and a last frame of the smallest rate
that holds the rest.

Reading makes no use of how a stream was written: tags are parsed, sync is searched for and
accepted only where a second header or the end of the stream follows, checksums of layers I and III are
verified and protected frames of layer II counted as unchecked, and
the exact duration (in samples) and frame offsets are collected. After damage the search starts again
at the next byte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow
from .word_pool import slices

UNIT = 64
KEY = b"payload_bytes"

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, Hz, bytes of side information.
RATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
SAMPLE_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
SIDE = {(1, False): 32, (1, True): 17, (2, False): 17, (2, True): 9}


@dataclass(frozen=True)
class Header:
    """One frame header; ``size`` is the whole frame in bytes."""

    version: int
    layer: int
    protected: bool
    rate: int
    sample_rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        return SIDE[(1 if self.version == 3 else 2, self.mono)] if self.layer == 3 else 0


@lru_cache(4096)
def parse_header(raw: bytes) -> Header | None:
    """The header in four bytes, or None. Free-format streams are not supported."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    rate, frequency = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or frequency == 3:
        return None
    kbit = RATES[(1 if version == 3 else 2, layer)][rate]
    hertz, padding, mono = SAMPLE_RATES[version][frequency], raw[2] >> 1 & 1, raw[3] >> 6 == 3
    if layer == 1:
        samples, size = 384, (12000 * kbit // hertz + padding) * 4
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * 1000 * kbit // hertz + padding
    return Header(version, layer, not raw[1] & 1, kbit, hertz, mono, size, samples)


@lru_cache(65536)
def frame_checksum(raw: bytes) -> int:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) over the last two header bytes and the side information or allocation."""
    crc = 0xFFFF
    for byte in raw:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


# --- writing -----------------------------------------------------------------------------

_LEAD = 4 + 2 + 17  # header, checksum, side information of a mono frame


@lru_cache(32)
def _frame_start(rate_index: int) -> tuple[bytes, int]:
    head = bytes([0xFF, 0xFA, rate_index << 4 | 1 << 2, 0xC0])
    crc = frame_checksum(head[2:] + bytes(17))
    return head + struct.pack(">H", crc) + bytes(17), parse_header(head).size


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def write_mpeg(payload: bytes, stated: int) -> bytes:
    """A stream that carries ``payload``; ``stated`` goes into the tag as the length without padding."""
    start, full = _frame_start(14)
    room = full - _LEAD
    n_full, rest = divmod(len(payload), room)
    body = np.zeros((n_full, full), np.uint8)
    body[:, :_LEAD] = np.frombuffer(start, np.uint8)
    body[:, _LEAD:] = np.frombuffer(payload, np.uint8, n_full * room).reshape(n_full, room)
    parts, sizes = [body.tobytes()], [full] * n_full
    if rest:
        index = next(i for i in range(1, 15) if _frame_start(i)[1] - _LEAD >= rest)
        lead, size = _frame_start(index)
        parts.append((lead + payload[n_full * room :]).ljust(size, b"\0"))
        sizes.append(size)
    lead, size = _frame_start(4)  # holds the table
    total = size + sum(sizes)
    offsets = np.concatenate([[0], np.cumsum([size, *sizes])])[:-1]
    toc = bytes(int(offsets[len(offsets) * i // 100] * 256 // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(sizes), total) + toc
    text = b"\0" + KEY + b"\0" + f"{stated} {len(payload)} {hashlib.sha256(payload).hexdigest()}".encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag + (lead + table).ljust(size, b"\0") + b"".join(parts)


# --- reading -----------------------------------------------------------------------------


@dataclass
class Stream:
    """What a reader finds out about a stream."""

    frames: list[int] = field(default_factory=list)  # byte offsets of the audio frames
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table_frames: int | None = None  # as the Xing or VBRI table states
    table_bytes: int | None = None
    toc: bytes = b""  # of a Xing table: a part of the bytes in 256ths for each hundredth of the time
    seek: list[int] = field(default_factory=list)  # of a VBRI table: bytes of each run of frames
    seek_frames: int = 0  # frames of such a run
    delay: int = 0  # samples that an encoder put before and after the sound, as its tag states
    padding: int = 0
    checked: int = 0
    bad_checksums: int = 0
    unchecked: int = 0  # protected frames whose checksum is not verified
    skipped: int = 0  # bytes that belong to no tag and no frame

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def sound(self) -> int:
        """Samples without what the encoder put around them."""
        return max(0, self.samples - self.delay - self.padding)

    @property
    def table_agrees(self) -> bool | None:
        """Whether the table counts the frames that are there; none if there is no such count."""
        return None if self.table_frames is None else self.table_frames == len(self.frames)


def _number(raw: bytes, bits: int) -> int:
    """A big-endian number of which each byte counts that many bits."""
    out = 0
    for b in raw:
        out = out << bits | b & (1 << bits) - 1
    return out


def _id3v2(raw: bytes, at: int, found: dict[str, str]) -> int:
    """Reads a tag at ``at`` into ``found`` and returns where it ends; ``at`` if there is none.

    Unsynchronisation is undone (of the whole tag, or of frames in version 4), an extended header is passed over.
    """
    if raw[at : at + 3] != b"ID3" or len(raw) < at + 10 or any(b > 127 for b in raw[at + 6 : at + 10]):
        return at
    major, flags, size = raw[at + 3], raw[at + 5], _number(raw[at + 6 : at + 10], 7)
    end = at + 10 + size
    tag = raw[at + 10 : end]
    if flags & 0x80 and major < 4:
        tag = tag.replace(b"\xff\0", b"\xff")
    p = 0
    if flags & 0x40 and major >= 3:
        p = 4 + _number(tag[:4], 8) if major == 3 else _number(tag[:4], 7)
    while major >= 3 and p + 10 <= len(tag) and tag[p : p + 4].isalnum():
        length = _number(tag[p + 4 : p + 8], 8 if major == 3 else 7)
        body = tag[p + 10 : p + 10 + length]
        if major == 4 and tag[p + 9] & 1:  # led by the length of the data
            body = body[4:]
        if major == 4 and (tag[p + 9] & 2 or flags & 0x80):
            body = body.replace(b"\xff\0", b"\xff")
        if tag[p : p + 1] == b"T" and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            text = body[1:].decode(coding, "replace").rstrip("\0")
            name = tag[p : p + 4].decode("latin-1")
            if name == "TXXX" and "\0" in text:
                name, text = text.split("\0", 1)
            found[name] = text
        p += 10 + length
    return min(end + (10 if flags & 0x10 else 0), len(raw))


def _table(raw: bytes, at: int, head: Header, out: Stream) -> bool:
    """Whether the frame at ``at`` is a table of a variable bit rate instead of audio."""
    p = at + 4 + (2 if head.protected else 0) + head.side
    if raw[p : p + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(raw[p + 4 : p + 8], "big")
        p += 8
        if flags & 1:
            out.table_frames, p = int.from_bytes(raw[p : p + 4], "big"), p + 4
        if flags & 2:
            out.table_bytes, p = int.from_bytes(raw[p : p + 4], "big"), p + 4
        if flags & 4:
            out.toc, p = raw[p : p + 100], p + 100
        p += 4 if flags & 8 else 0
        if raw[p : p + 4] in (b"LAME", b"Lavc", b"Lavf") and p + 24 <= at + head.size:
            gap = int.from_bytes(raw[p + 21 : p + 24], "big")
            out.delay, out.padding = gap >> 12, gap & 0xFFF
        return True
    p = at + 36
    if raw[p : p + 4] == b"VBRI" and p + 26 <= len(raw):
        out.table_bytes, out.table_frames, entries, scale, width, out.seek_frames = struct.unpack(">IIHHHH", raw[p + 10 : p + 26])
        table = raw[p + 26 : min(p + 26 + entries * width, at + head.size)]
        out.seek = [scale * int.from_bytes(table[i : i + width], "big") for i in range(0, len(table) - width + 1, width)] if width else []
        return True
    return False


def _allocation(mode: int) -> int:
    """Bytes of bit allocation in a layer I frame: four bits for each band and channel, one for both from the joint bound on."""
    kind = mode >> 6
    return 16 if kind == 3 else 16 + 2 * ((mode >> 4 & 3) + 1) if kind == 1 else 32


def read_mpeg(raw: bytes) -> Stream:
    """Tags, tables, frames and checksums of a stream; an empty or foreign one has no frames."""
    out = Stream()
    at, end = 0, len(raw)
    first = True
    while at < end:
        after = _id3v2(raw, at, out.tags)
        if after > at:
            at = after
            continue
        if raw[at : at + 3] == b"TAG" and at == end - 128:  # ID3v1 closes a stream
            out.tags["ID3v1"] = raw[at + 3 : at + 33].decode("latin-1").rstrip("\0 ")
            break
        head = parse_header(raw[at : at + 4])
        size = head.size if head else 0
        good = head is not None and at + size <= end
        if good and at + size < end and raw[at + size : at + size + 3] not in (b"ID3", b"TAG"):
            follows = parse_header(raw[at + size : at + size + 4])
            good = follows is not None and (follows.version, follows.layer, follows.sample_rate) == (head.version, head.layer, head.sample_rate)
        if not good:
            nxt = raw.find(b"\xff", at + 1, end)
            tag = raw.find(b"ID3", at + 1, end if nxt < 0 else nxt)
            nxt = tag if tag >= 0 else nxt
            out.skipped += (end if nxt < 0 else nxt) - at
            at = end if nxt < 0 else nxt
            continue
        if head.protected and head.layer == 2:  # what its checksum covers depends on tables of bits by rate
            out.unchecked += 1
        elif head.protected:
            out.checked += 1
            p = at + 6 + (head.side if head.layer == 3 else _allocation(raw[at + 3]))
            if frame_checksum(raw[at + 2 : at + 4] + raw[at + 6 : p]) != int.from_bytes(raw[at + 4 : at + 6], "big"):
                out.bad_checksums += 1
        if not (first and head.layer == 3 and _table(raw, at, head, out)):
            out.frames.append(at)
            out.headers.append(head)
        first = False
        at += size
    return out


def read_payload(raw: bytes, stream: Stream) -> tuple[bytes, int] | None:
    """The carried payload and its length without padding; none if the stream carries none, or has lost or changed a part of it."""
    stated = stream.tags.get(KEY.decode(), "").split()
    if len(stated) != 3 or not (stated[0].isdigit() and stated[1].isdigit()):
        return None
    parts = [raw[at + 6 + h.side : at + h.size] for at, h in zip(stream.frames, stream.headers, strict=True)]
    payload = b"".join(parts)[: int(stated[1])]
    return (payload, int(stated[0])) if hashlib.sha256(payload).hexdigest() == stated[2] else None


# --- columns -----------------------------------------------------------------------------


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media (a stream that carries the padded UTF-8 text). Null text counts as empty; equal texts give equal
    streams. Ids are passed on, null and repeated ones too; other columns are not read. An empty table gives no rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [write_mpeg(padded(t), len(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.transform(in_arrow, work, f"doc_id {kind}, media binary")


MEDIA_FIELDS = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, samples long, sample_rate int, n_frames int, seek_offsets array<long>, sound long"
)


def from_media(media: DataFrame) -> DataFrame:
    """Facts of each (doc_id, media), all taken from its bytes, whoever wrote them.

    ``samples`` over ``sample_rate`` is the exact duration, ``sound`` is that without an encoder's delay and padding. ``seek_offsets``
    has the byte offset of every frame. ``feature`` sums the stream up: frames, samples, Hz, what a table of a variable bit rate
    states, checksums verified and bad, those not verified, bytes skipped, and a digest of all frame offsets.
    Streams that ``to_media`` did not write, and those whose payload is damaged, have null payload columns. A stream
    without frames, an empty one too, has none and rate 0. A row without media gives nulls. Ids are passed on, null and repeated ones too.
    """

    def facts(raw: bytes | None) -> list:
        if raw is None:
            return [None] * 12
        s = read_mpeg(raw)
        payload, stated = read_payload(raw, s) or (None, None)
        rate = s.headers[0].sample_rate if s.headers else 0
        places = hashlib.sha256(np.array(s.frames, "<u8").tobytes()).hexdigest()[:16]
        feature = f"frames={len(s.frames)};samples={s.samples};hz={rate};table={s.table_frames},{s.table_bytes};crc={s.checked},{s.bad_checksums};unchecked={s.unchecked};skipped={s.skipped};offsets={places}"
        return [
            stated,
            None if payload is None else len(payload),
            None if payload is None else hashlib.sha256(payload).hexdigest(),
            None if payload is None else zlib.crc32(payload[-UNIT:]),
            len(raw),
            hashlib.sha256(raw).hexdigest(),
            feature,
            s.samples,
            rate,
            len(s.frames),
            s.frames,
            s.sound,
        ]

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
    names = [f.split()[0] for f in MEDIA_FIELDS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [facts(m) for m in part.column(1).to_pylist()]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").transform(in_arrow, work, f"doc_id {kind}, {MEDIA_FIELDS}")


#: What a reader must find again of the texts themselves.
ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT *, CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END AS pad FROM t)
SELECT doc_id, n AS n_bytes, n + pad AS payload_bytes, sha256(encode(body || repeat(chr(0), pad))) AS payload_sha256 FROM p
"""
