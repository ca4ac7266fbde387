"""Ogg media columns: pages with checksums, lacing, logical streams and granule timestamps (RFC 3533).

``store_ogg`` writes each text as the 8-bit samples of one logical stream, multiplexed with a second stream of
time marks.  ``read_ogg`` takes any column of Ogg bytes apart again: it verifies each page's checksum, reassembles
packets from lacing values, also over page ends, separates the logical streams and turns granule positions into
seconds.  Files are handled one row at a time inside Arrow batches; a batch is bounded in bytes by Spark.
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

from headway.llm.common import slices

RATE = 8000  # samples a second of the payload stream; a granule is one sample
PACKET = 4000  # samples in a packet: half a second
_HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


def checksum(page: bytes) -> int:
    """The page checksum: polynomial 0x04C11DB7, most significant bit first, from 0, without a final inversion.

    zlib has the same polynomial for mirrored bits, so mirroring the bytes and the result gives the same sum.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def pages_of(serial: int, packets: list[tuple[bytes, int]], *, segments: int = 255) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream; the first packet gets a page of its own, as headers do.

    A page takes up to ``segments`` lacing values; a packet that does not fit goes on in the next page, and a page
    on which no packet ends has granule position -1.
    """
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, flags = bytearray(), [], -1, FIRST

    def flush(last: bool = False) -> None:
        nonlocal lacing, body, granule, flags
        out.append((granule, _page(flags | (LAST if last else 0), granule, serial, len(out), bytes(lacing), b"".join(body))))
        lacing, body, granule, flags = bytearray(), [], -1, 0

    for k, (packet, end) in enumerate(packets):
        at = 0
        while True:
            if len(lacing) == segments:
                flush()
                flags = CONTINUED if at else 0
            room = segments - len(lacing)
            take = min(room, (len(packet) - at) // 255)
            lacing += b"\xff" * take
            body.append(packet[at : at + 255 * take])
            at += 255 * take
            if len(packet) - at < 255 and len(lacing) < segments:
                lacing.append(len(packet) - at)
                body.append(packet[at:])
                break
        granule = end
        if k == 0 and len(packets) > 1:
            flush()
    flush(last=True)
    return out


def write(payload: bytes) -> bytes:
    """One file: the payload as 8-bit samples, and a stream with a mark for each second begun."""
    serial = zlib.crc32(payload)
    samples = [(b"headway-pcm8" + struct.pack("<IB", RATE, 1), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    marks = [(b"headway-mark" + struct.pack("<IQ", 1, len(payload)), 0)]
    marks += [(b"s%d" % s, s) for s in range(1, -(-len(payload) // RATE) + 1)]
    a, b = pages_of(serial, samples), pages_of(serial ^ 0xFFFFFFFF, marks)
    # Both first pages, then by time; pages on which nothing ends stay behind their predecessor.
    timed, time = [], 0.0
    for stream, pages, rate in ((0, a[1:], RATE), (1, b[1:], 1)):
        for n, (granule, page) in enumerate(pages):
            time = granule / rate if granule >= 0 else (time if n else 0.0)
            timed.append((time, stream, n, page))
    return a[0][1] + b[0][1] + b"".join(x[3] for x in sorted(timed, key=lambda x: x[:3]))


@dataclass
class Stream:
    """One logical stream: its packets, and for each the granule position of the page it ends on, -1 where another packet ends there later."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    lost: int = 0  # pages missing by their numbers
    ended: bool = False
    _part: list[bytes] | None = None
    _next: int = 0

    @property
    def rate(self) -> int:
        return struct.unpack_from("<I", self.packets[0], 12)[0] if self.packets and len(self.packets[0]) >= 16 else 0

    def seconds(self) -> list[float]:
        return [g / self.rate if g >= 0 and self.rate else -1.0 for g in self.granules]


def read(data: bytes) -> tuple[dict[int, Stream], int]:
    """(logical streams by serial number, count of damaged pages).

    A page whose checksum does not hold, or that is cut off, is left out, and reading goes on at the next capture
    pattern; a packet of which a page is missing is left out too.
    """
    streams: dict[int, Stream] = {}
    damaged, at = 0, 0
    while (at := data.find(b"OggS", at)) >= 0:
        body = at + 27 + (data[at + 26] if at + 27 <= len(data) else 0)
        lacing = data[at + 27 : body]
        end = body + sum(lacing)
        if at + 27 > len(data) or end > len(data) or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != int.from_bytes(data[at + 22 : at + 26], "little"):
            damaged += 1
            at += 4
            continue
        _, _, flags, granule, serial, number, _, _ = _HEAD.unpack_from(data, at)
        s = streams.setdefault(serial, Stream())
        if number != s._next:
            s.lost += max(1, number - s._next)
            s._part = None
        s._next, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & LAST)
        part = s._part if flags & CONTINUED else []
        s._part, pos, ends = None, body, False
        for n in lacing:
            if part is not None:
                part.append(data[pos : pos + n])
            pos += n
            if n < 255:
                if part is not None:
                    s.packets.append(b"".join(part))
                    s.granules.append(-1)
                    ends = True
                part = []
        if ends:
            s.granules[-1] = granule
        if lacing and lacing[-1] == 255:
            s._part = part
        at = end
    return streams, damaged


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text followed by bytes 0 up to a positive multiple of 64)."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def _features(payload: bytes, streams: dict[int, Stream]) -> str:
    samples = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero(np.signbit(samples[1:]) != np.signbit(samples[:-1])))
    each = sorted((s.rate, len(s.packets), s.pages, max(s.seconds(), default=0.0)) for s in streams.values())
    return f"mean={int(samples.sum())}/{len(samples)};crossings={crossings};" + ";".join(f"stream(rate={r},packets={p},pages={g},end={e:.6f})" for r, p, g, e in each)


def store_ogg(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_bytes, media``: each text stored as an Ogg file.  Null counts as empty; rows stay as many as they are."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            sizes, media = [], []
            for text in b.column(1).to_pylist():
                n, payload = padded(text)
                sizes.append(n)
                media.append(write(payload))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    narrow = df.select(id_col, text_col)
    return narrow.mapInArrow(encode, f"`{id_col}` {narrow.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def read_ogg(df: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col, stream, rate, packet, granule, seconds, data``: every packet of every logical stream of each row.

    ``stream`` is the serial number, ``packet`` its number from 0.  Null, empty and foreign bytes give no rows.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "stream", "rate", "packet", "granule", "seconds", "data"]
        for b in (part for whole in batches for part in slices(whole, 1)):
            for i, media in enumerate(b.column(1).to_pylist()):
                for serial, s in read(media or b"")[0].items():
                    n = len(s.packets)
                    cols = [pa.array([serial] * n, pa.int64()), pa.array([s.rate] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(s.granules, pa.int64()), pa.array([x if x >= 0 else None for x in s.seconds()], pa.float64()), pa.array(s.packets, pa.binary())]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * n, pa.int32())), *cols], names=names)

    narrow = df.select(id_col, media_col)
    return narrow.mapInArrow(decode, f"`{id_col}` {narrow.schema[id_col].dataType.simpleString()}, stream long, rate long, packet long, granule long, seconds double, data binary")


def describe_ogg(df: DataFrame, *, id_col: str = "doc_id", size_col: str = "n_bytes", media_col: str = "media") -> DataFrame:
    """One row per stored file, from the bytes read back: sizes, digests and features of its sample stream.

    ``damaged`` counts pages with a wrong checksum and packets' pages that are missing.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 2)):
            rows = []
            for media in b.column(2).to_pylist():
                media = media or b""
                streams, damaged = read(media)
                sound = next((s for s in streams.values() if s.packets and s.packets[0].startswith(b"headway-pcm8")), Stream())
                payload = b"".join(sound.packets[1:])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), _features(payload, streams), damaged + sum(s.lost for s in streams.values())))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "damaged"])

    narrow = df.select(id_col, size_col, media_col)
    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(decode, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, damaged long")
