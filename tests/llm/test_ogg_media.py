import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldweave.llm import ogg_media as M


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=300))
@settings(max_examples=50, deadline=None)
def test_checksum_equals_bitwise_definition(data):
    assert M.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [64, 128, 254, 255, 256, 4095, 4096, 4097, 4080, 65025, 65026, 300_000])
def test_round_trip_of_any_length(n):
    payload = bytes((i * 7 + i // 251) % 256 for i in range(n))
    a = M.read_samples(M.write_ogg(payload))
    assert a.samples == payload
    assert a.duration == n / M.RATE
    assert a.starts == [k * M.PACKET / M.RATE for k in range(-(-n // M.PACKET))]


def test_damage_is_found():
    data = M.write_ogg(bytes(range(256)) * 400)
    for at in (0, 5, 30, 70, 5000, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(M.OggError):
            M.read_samples(bytes(bad))
    second = data.index(b"OggS", 1)
    for cut in (data[:-10], data[second:], data[:second] + data[data.index(b"OggS", second + 1) :], data + b"x"):
        with pytest.raises(M.OggError):
            M.read_samples(cut)


def test_column_on_odd_rows(spark):
    texts = {1: "abc", 2: None, 3: "", 4: "x" * 64, 5: "é" * 70_000, 6: "abc"}
    docs = spark.createDataFrame([(k, v, "z") for k, v in texts.items()], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in M.media_features(M.media_column(docs)).collect()}
    for k, v in texts.items():
        raw = (v or "").encode()
        padded = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].error) == (len(raw), len(padded), None)
        assert got[k].payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert got[k].tail_crc32 == zlib.crc32(padded[-64:])
        assert got[k].media_sha256 == hashlib.sha256(M.write_ogg(padded)).hexdigest()
    assert got[1][2:] == got[6][2:] and got[2][1:] == got[3][1:]
    assert M.media_features(M.media_column(docs.limit(0))).collect() == []


def test_damaged_column_gives_reason(spark):
    df = spark.createDataFrame([(1, 3, b"nonsense"), (2, 3, None)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in M.media_features(df).collect()}
    assert got[1].error and got[1].payload_sha256 is None and got[2].error is None and got[2].media_bytes is None
