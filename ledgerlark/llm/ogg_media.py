"""Ogg media columns: write, verify, reassemble, demultiplex, time-stamp.

A payload is stored as unsigned 8-bit mono samples. Blocks of ``PACKET``
samples are dealt in turn to one or two logical streams, each of which opens
with a header packet; the pages of the streams are interleaved by time. The
reader knows nothing of the writer: it finds pages, checks their checksums,
joins packets over page borders by their lacing values, separates the streams
by serial number and takes time stamps from granule positions.

Defined results: null text is the empty text, whose payload is 64 zero bytes;
rows are independent, so repeated rows give repeated results; an empty table
gives an empty table; columns besides the id and the text are ignored. A page
whose checksum fails is counted and its bytes are not used; lost pages show by
the numbers of those that follow or by a stream without its last page. A file
of which any part is missing has null payload columns and says so in
``feature`` and ``intact``; null media is such a file. What a text holds never
matters: "OggS" inside a page is not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes

RATE = 8000
PACKET = 4096
ALIGN = 64
MAGIC = b"\x7fPCM8"
_HEAD = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<5sBIIBB")
_CRC_AT = 22
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """Checksum of an Ogg page (polynomial 0x04c11db7, unreflected, zero start).

    zlib's CRC is the bit-reflected form of the same polynomial, so mirrored
    input bits give a mirrored result.
    """
    reflected = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_MIRROR), "big")


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def _page(flags: int, granule: int, serial: int, number: int, table: bytes, body: bytes) -> bytes:
    raw = bytearray(_HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(table)) + table + body)
    struct.pack_into("<I", raw, _CRC_AT, page_crc(bytes(raw)))
    return bytes(raw)


def _stream_pages(serial: int, ident: bytes, packets: list[bytes]) -> list[tuple[int, bytes]]:
    """(samples begun before the page, page) for one logical stream; packets run on over pages."""
    pages = [(-1, _page(2, 0, serial, 0, lacing(len(ident)), ident))]
    table, body = b"".join(lacing(len(p)) for p in packets), b"".join(packets)
    ends = np.flatnonzero(np.frombuffer(table, np.uint8) < 255)
    samples = np.cumsum([len(p) for p in packets])
    at, done = 0, 0
    for number, k in enumerate(range(0, len(table), 255), 1):
        part = table[k : k + 255]
        size = sum(part)
        complete = int(np.searchsorted(ends, k + len(part)))
        granule = int(samples[complete - 1]) if complete > done else -1
        flags = (1 if k and table[k - 1] == 255 else 0) | (4 if k + 255 >= len(table) else 0)
        begun = int(samples[done - 1]) if done else 0
        pages.append((begun, _page(flags, granule, serial, number, part, body[at : at + size])))
        at, done = at + size, complete
    return pages


def encode(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg file that holds ``payload`` losslessly."""
    blocks = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    n = 2 if len(blocks) > 1 else 1
    pages = []
    for s in range(n):
        ident = _IDENT.pack(MAGIC, 1, rate, packet, s, n)
        for order, (begun, page) in enumerate(_stream_pages(s + 1, ident, blocks[s::n])):
            pages.append((begun, s, order, page))
    return b"".join(p[-1] for p in sorted(pages, key=lambda p: p[:3]))


@dataclass
class Stream:
    serial: int
    ident: bytes = b""
    packets: list[bytes] = field(default_factory=list)
    #: end time in samples of each packet, None where no granule position tells it
    ends: list[int | None] = field(default_factory=list)
    #: number of the page that comes next
    due: int = 0
    lost_pages: int = 0
    #: packets of which a part is gone
    cut_packets: int = 0
    ended: bool = False
    #: the packet that runs on to the next page
    open_: bytearray | None = None

    def drop_open(self) -> None:
        self.cut_packets += self.open_ is not None
        self.open_ = None


@dataclass
class OggFile:
    streams: dict[int, Stream]
    pages: int
    bad_pages: int
    #: pages whose number was seen before
    repeated_pages: int = 0

    @property
    def lost_pages(self) -> int:
        return sum(s.lost_pages for s in self.streams.values())


def parse(media: bytes) -> OggFile:
    """Pages, packets and streams of an Ogg file.

    Page numbers are followed in each stream. After a gap the open packet is
    dropped, and so is what continues a packet whose beginning is gone; a packet
    is never joined over a hole.
    """
    found = OggFile({}, 0, 0)
    at = media.find(b"OggS")
    while at >= 0 and at + _HEAD.size <= len(media):
        _, _, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        body = at + _HEAD.size + n
        table = media[at + _HEAD.size : body]
        end = body + sum(table)
        raw = media[at:end]
        if len(table) < n or end > len(media) or page_crc(raw[:_CRC_AT] + b"\0\0\0\0" + raw[_CRC_AT + 4 :]) != crc:
            found.bad_pages += 1
            at = media.find(b"OggS", at + 4)
            continue
        at = media.find(b"OggS", end)
        found.pages += 1
        s = found.streams.setdefault(serial, Stream(serial))
        ahead = (number - s.due) & 0xFFFFFFFF
        if ahead >> 31:
            found.repeated_pages += 1
            continue
        if ahead or not flags & 1:
            s.drop_open()
        s.lost_pages += ahead
        s.due = (number + 1) & 0xFFFFFFFF
        # a page that continues a packet whose beginning is gone
        lost = bool(flags & 1) and s.open_ is None
        left, s.open_ = s.open_ or bytearray(), None
        first, header = len(s.packets), bool(flags & 2)
        for value in table:
            left += media[body : body + value]
            body += value
            if value < 255:
                if lost:
                    s.cut_packets += 1
                elif header:
                    s.ident = bytes(left)
                else:
                    s.packets.append(bytes(left))
                    s.ends.append(None)
                left, lost, header = bytearray(), False, False
        if table and table[-1] == 255 and not lost:
            s.open_ = left
        if granule >= 0:
            for k in range(len(s.packets) - 1, first - 1, -1):
                s.ends[k] = granule
                granule -= len(s.packets[k])
        s.ended |= bool(flags & 4)
    if 0 <= at and at + _HEAD.size > len(media):
        found.bad_pages += 1  # the file breaks off within a page's head
    for s in found.streams.values():
        s.drop_open()
    return found


def payload_of(ogg: OggFile) -> bytes | None:
    """The stored bytes, packets of the logical streams in the order of their time; None if any part is missing."""
    streams = list(ogg.streams.values())
    if not streams or ogg.bad_pages or any(s.lost_pages or s.cut_packets or not s.ended or len(s.ident) != _IDENT.size or not s.ident.startswith(MAGIC) or None in s.ends for s in streams):
        return None
    heads = {s.serial: _IDENT.unpack(s.ident) for s in streams}
    if any(h[5] != len(streams) for h in heads.values()):
        return None
    return b"".join(p for _, _, p in sorted(((e - len(p), heads[s.serial][4], p) for s in streams for p, e in zip(s.packets, s.ends)), key=lambda x: x[:2]))


def _padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % ALIGN or (0 if raw else ALIGN))


def store_text_as_ogg(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as the samples of an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, 1000):
                made = [_padded(t) for t in part.column(1).to_pylist()]
                media = [encode(p) for _, p in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_bytes long, media binary")


def _feature(ogg: OggFile, payload: bytes | None) -> str:
    if payload is None:
        return f"damaged;streams={len(ogg.streams)};pages={ogg.pages};bad={ogg.bad_pages};lost={ogg.lost_pages};cut={sum(s.cut_packets for s in ogg.streams.values())};packets={sum(len(s.packets) for s in ogg.streams.values())}"
    samples = np.frombuffer(payload, np.uint8)
    centred = samples.astype(np.int32) - 128
    crossings = int(np.count_nonzero(np.diff(centred >= 0)))
    energy = int(np.dot(centred.astype(np.int64), centred))
    told = [e for s in ogg.streams.values() for e in s.ends if e is not None]
    return (
        f"streams={len(ogg.streams)};pages={ogg.pages};bad={ogg.bad_pages};packets={sum(len(s.packets) for s in ogg.streams.values())};"
        f"last_ms={max(told, default=0) * 1000 // RATE};mean={int(samples.sum(dtype=np.int64)) * 1000 // max(1, len(samples))};"
        f"energy={energy // max(1, len(samples))};crossings={crossings}"
    )


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bad_pages long, lost_pages long, intact boolean"


def ogg_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest and signal features of the bytes that are read back from ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                media = value.as_py() or b""
                ogg = parse(media)
                payload = payload_of(ogg)
                read = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]))
                rows.append((*read, len(media), hashlib.sha256(media).hexdigest(), _feature(ogg, payload), ogg.bad_pages, ogg.lost_pages, payload is not None))
            cols = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "bad_pages", "lost_pages", "intact"])

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` long, n_bytes long, {FEATURES}")


def ogg_packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", rate: int = RATE) -> DataFrame:
    """One row per packet of any Ogg column: stream serial, packet number, end time in ms, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for s in parse(value.as_py() or b"").streams.values():
                    rows += [(key, s.serial, k, None if e is None else e * 1000 // rate, p) for k, (p, e) in enumerate(zip(s.packets, s.ends))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()])], names=[id_col, "serial", "packet", "end_ms", "data"])

    return media.select(F.col(f"`{id_col}`").cast("long"), F.col(media_col)).mapInArrow(run, f"`{id_col}` long, serial long, packet int, end_ms long, data binary")
