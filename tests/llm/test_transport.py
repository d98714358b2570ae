"""Transport streams: exact round trips, and what a broken stream reports."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import transport as ts


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3 * ts.UNIT))
def test_round_trip(payload):
    media = ts.mux(payload)
    stream = ts.demux(media)
    assert stream.payload() == payload and len(media) % ts.PACKET == 0
    assert (stream.lost, stream.repeated, stream.corrupt) == (0, 0, 0)


@pytest.mark.parametrize("n", [1, 158, 159, 160, 161, 162, 163, 343, 344, 345, 346, 347, 8191, 8192, 8193, 100_000])
def test_sizes_about_packet_edges(n):
    payload = bytes(i % 251 for i in range(n))
    assert ts.demux(ts.mux(payload)).payload() == payload


def test_tables_stamps_and_random_access():
    stream = ts.demux(ts.mux(b"x" * (ts.UNIT * 5)))
    assert stream.programs == {1: ts.PMT_PID} and stream.kinds == {ts.DATA_PID: ts.PRIVATE_DATA}
    assert [u[1] for u in stream.units] == [k * ts.TICKS for k in range(5)]
    assert [u[2] for u in stream.units] == [True, False, False, False, True]
    for ticks in (0, 1, 2**33 - 1, 123456789):
        assert ts.unstamp(ts.stamp(ticks)) == ticks


def test_faults():
    media = ts.mux(b"abc" * 5000)
    packet = [media[i : i + ts.PACKET] for i in range(0, len(media), ts.PACKET)]
    assert ts.demux(b"".join(packet[:4] + packet[5:])).lost == 1
    again = ts.demux(b"".join(packet[:5] + packet[4:]))
    assert again.repeated == 1 and again.lost == 0 and again.payload() == b"abc" * 5000
    assert ts.demux(b"\0" * 7 + media).payload() == b"abc" * 5000
    assert ts.demux(b"").packets == 0 and ts.demux(media[:100]).packets == 0
    broken = bytearray(media)
    broken[10] ^= 1
    assert ts.demux(bytes(broken)).corrupt >= 1


def test_query(spark):
    text = "é" * 40
    df = spark.createDataFrame([(1, text, 0), (2, text, 1), (3, None, 2), (4, "", 3)], "doc_id long, text string, feature int")
    a, b, c, d = ts.media_features(df).orderBy("doc_id").collect()
    raw = text.encode().ljust(128, b"\0")
    assert a.n_bytes == 80 and a.payload_bytes == 128
    assert a.payload_sha256 == hashlib.sha256(raw).hexdigest() and a.tail_crc32 == zlib.crc32(raw[-64:])
    assert a[2:] == b[2:] and a.media_sha256 == hashlib.sha256(ts.mux(raw)).hexdigest()
    assert c[1:] == d[1:] and c.n_bytes == 0 and c.payload_bytes == 64
    assert [(u.pts, u.random_access, u.start, u.length) for u in a.units] == [(0, True, 0, 128)]
    long = ts.media_features(spark.createDataFrame([(9, "0" * (ts.UNIT * 2 + 5))], "doc_id long, text string")).first()
    assert [(u.pts, u.random_access, u.start, u.length) for u in long.units] == [(k * ts.TICKS, k == 0, k * ts.UNIT, n) for k, n in enumerate((ts.UNIT, ts.UNIT, 64))]
    assert ts.media_features(df.limit(0)).count() == 0
    assert ts.demux(ts.media_column(df).first().media).payload() == raw
