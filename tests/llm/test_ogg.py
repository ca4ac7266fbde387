import hashlib
import zlib

import pytest
from headway.llm import ogg


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
            crc &= 0xFFFFFFFF
    return crc


def test_checksum_against_bitwise():
    for data in (b"", b"a", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 254, 255, 256, 510, 4000, 4001, 65_025, 70_000, 300_000])
def test_round_trip(n):
    text = "".join(chr(32 + i * 7 % 90) for i in range(n))
    size, payload = ogg.padded(text)
    streams, damaged = ogg.read(ogg.write(payload))
    sound = next(s for s in streams.values() if s.packets[0].startswith(b"headway-pcm8"))
    assert size == n and len(payload) % 64 == 0 and payload and not damaged
    assert b"".join(sound.packets[1:]) == payload and sound.ended and not sound.lost
    assert max(sound.seconds()) == len(payload) / ogg.RATE
    assert len(streams) == 2


@pytest.mark.parametrize("size", [254, 255, 256, 510, 255 * 255, 255 * 255 + 1, 255 * 255 * 3])
def test_long_packets_go_over_pages(size):
    packets = [(b"h" * 20, 0), (b"x" * size, 5), (b"", 6), (b"y" * 300, 7)]
    data = b"".join(p for _, p in ogg.pages_of(9, packets))
    streams, damaged = ogg.read(data)
    assert streams[9].packets == [p for p, _ in packets] and not damaged
    assert [g for g in streams[9].granules if g >= 0][-1] == 7


def test_damage_is_found_and_skipped():
    data = bytearray(ogg.write(ogg.padded("abc " * 40_000)[1]))
    data[len(data) // 2] ^= 1
    streams, damaged = ogg.read(bytes(data))
    assert damaged >= 1 and sum(s.lost for s in streams.values()) >= 1
    assert ogg.read(b"") == ({}, 0) and ogg.read(b"OggS")[1] == 1 and ogg.read(b"noise" * 99) == ({}, 0)


def test_frames(spark, make_docs):
    rows = [(1, "héllo"), (2, None), (3, ""), (1, "héllo"), (None, "x" * 100_000)]
    out = ogg.describe_ogg(ogg.store_ogg(make_docs(rows).selectExpr("*", "1 as media"))).collect()
    assert len(out) == 5
    for r in out:
        text = {1: "héllo", 2: "", 3: "", None: "x" * 100_000}[r.doc_id]
        n, payload = ogg.padded(text)
        assert (r.n_bytes, r.payload_bytes, r.damaged) == (n, len(payload), 0)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(ogg.write(payload)).hexdigest()
    packets = ogg.read_ogg(ogg.store_ogg(make_docs(rows))).collect()
    assert {p.stream for p in packets if p.doc_id == 2} == {p.stream for p in packets if p.doc_id == 3}
    assert ogg.describe_ogg(ogg.store_ogg(make_docs(rows).filter("false"))).count() == 0
