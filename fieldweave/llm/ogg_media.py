"""Ogg media columns: lossless storage of bytes as 8-bit samples in Ogg pages, and their verified reading.

Writing multiplexes two logical streams. The sample stream carries packets of ``PACKET`` samples; its granule position is
the number of samples ended on a page. The mark stream carries one packet for each page of samples, with the first
sample of that page. Reading verifies every page's checksum and sequence number, reassembles packets from the lacing values
over page borders, separates the streams by serial number and derives times from granule positions.

Defined cases: null or empty text is a payload of 64 zero bytes; a text whose length is a multiple of 64 is not padded
further; damaged bytes (bad capture pattern, checksum, sequence, lacing or an unfinished packet) raise ``OggError`` in
``read_ogg`` and give a row with null values and the reason in ``error`` in ``media_features``; null media gives nulls.
Columns besides doc_id and text are ignored, repeated rows give repeated results.
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

from fieldweave.llm import kernels as K
from fieldweave.llm.workspace import lean

RATE = 8000
PACKET = 4096
UNIT = 64
SAMPLES, MARKS = 0x53414D50, 0x4D41524B
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = (1 << 64) - 1

_HEAD = struct.Struct("<4sBBQIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes are not a whole, undamaged Ogg stream."""


def page_checksum(page: bytes) -> int:
    """CRC of polynomial 0x04C11DB7, most significant bit first, from 0, without a final complement.

    It is the mirror image of the common CRC-32 over mirrored bytes, started so that its own complements cancel.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def write_ogg(payload: bytes, rate: int = RATE) -> bytes:
    """An Ogg file of two streams that holds ``payload`` as 8-bit samples."""
    out = [
        _page(FIRST, 0, SAMPLES, 0, b"\x0c", b"PCM8" + struct.pack("<II", rate, PACKET)),
        _page(FIRST, 0, MARKS, 0, b"\x04", b"MARK"),
    ]
    lacing, ends = bytearray(), []  # of all packets in a row; where packets end among the lacing values
    for at in range(0, len(payload), PACKET):
        n = min(PACKET, len(payload) - at)
        lacing += b"\xff" * (n // 255) + bytes([n % 255])
        ends.append(len(lacing))
    at = done = 0
    number = 1
    open_packet = False
    for lo in range(0, len(lacing), 255):
        part = bytes(lacing[lo : lo + 255])
        size = sum(part)
        before = done
        while done < len(ends) and ends[done] <= lo + len(part):
            done += 1
        last = lo + 255 >= len(lacing)
        granule = min(done * PACKET, len(payload)) if done > before else NO_PACKET_ENDS
        flags = CONTINUED * open_packet | LAST * last
        out.append(_page(flags, granule, SAMPLES, number, part, payload[at : at + size]))
        out.append(_page(LAST * last, min(before * PACKET, len(payload)), MARKS, number, b"\x08", struct.pack("<Q", before * PACKET)))
        open_packet = part[-1] == 255
        at += size
        number += 1
    return b"".join(out)


@dataclass
class Stream:
    """One logical stream: its packets, the granule position after each, and page counts."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    next_number: int = 0
    ended: bool = False
    partial: list[bytes] | None = None


def read_ogg(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number; a packet that does not end its page has the granule position -1."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("a page head is cut")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version != 0:
            raise OggError("no page where one must begin")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("a page is cut")
        page = bytearray(data[at:end])
        page[22:26] = b"\0\0\0\0"
        if page_checksum(bytes(page)) != crc:
            raise OggError("a page's checksum is wrong")
        if (serial in streams) == bool(flags & FIRST):
            raise OggError("a stream begins twice or without its first page")
        s = streams.setdefault(serial, Stream())
        if number != s.next_number or s.ended:
            raise OggError("a page is missing, repeated or after the last")
        if bool(flags & CONTINUED) != (s.partial is not None):
            raise OggError("a packet is continued without its beginning or cut")
        s.next_number, s.ended, s.pages = number + 1, bool(flags & LAST), s.pages + 1
        pos, ended = at + 27 + n, 0
        run, size = s.partial or [], 0
        pending = s.partial is not None
        for value in lacing:
            size += value
            pending = True
            if value < 255:
                run.append(data[pos : pos + size])
                s.packets.append(b"".join(run) if len(run) > 1 else run[0])
                s.granules.append(-1)
                pos, size, run, pending, ended = pos + size, 0, [], False, ended + 1
        if pending:
            run.append(data[pos : pos + size])
        s.partial = run if pending else None
        if (granule == NO_PACKET_ENDS) != (ended == 0):
            raise OggError("a granule position does not fit the packets that end on its page")
        if ended:
            s.granules[-1] = granule
        at = end
    for s in streams.values():
        if s.partial is not None or not s.ended:
            raise OggError("a stream is unfinished")
    return streams


@dataclass
class Audio:
    samples: bytes
    rate: int
    starts: list[float]
    duration: float
    pages: int
    packets: int


def read_samples(data: bytes) -> Audio:
    """The sample stream of a file by ``write_ogg``: samples, the start of each packet in seconds, duration."""
    streams = read_ogg(data)
    s, marks = streams.get(SAMPLES), streams.get(MARKS)
    if s is None or marks is None or s.packets[0][:4] != b"PCM8" or len(s.packets[0]) != 12:
        raise OggError("no stream of samples")
    rate, _ = struct.unpack("<II", s.packets[0][4:])
    packets, granules = s.packets[1:], s.granules[1:]
    ends, total = [0] * len(packets), None
    for k in range(len(packets) - 1, -1, -1):  # from each page's granule position back over its packets
        total = granules[k] if granules[k] >= 0 else total - len(packets[k + 1])
        ends[k] = total
    starts = [(e - len(p)) / rate for e, p in zip(ends, packets, strict=True)]
    if not packets or starts[0] != 0 or any(a != e / rate for a, e in zip(starts[1:], ends[:-1], strict=True)):
        raise OggError("granule positions do not follow the packets")
    known = {0, *ends}
    if any(struct.unpack("<Q", m)[0] not in known for m in marks.packets[1:]):
        raise OggError("a mark points into a packet")
    return Audio(b"".join(packets), rate, starts, ends[-1] / rate, sum(x.pages for x in streams.values()), len(packets))


def _features(a: Audio) -> str:
    """Duration, structure and loudness; integer sums, so equal samples give equal text."""
    x = np.frombuffer(a.samples, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] ^ x[:-1]) < 0).sum())
    return f"duration={a.duration:.6f};pages={a.pages};packets={a.packets};mean={x.mean():.6f};rms={float((x * x).mean()) ** 0.5:.6f};peak={int(abs(x).max())};crossings={crossings}"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in K.slices(batch.column(1)):
            raw = buf.tobytes()
            sizes, media = [], []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                n = b - a
                sizes.append(n)
                media.append(write_ogg(raw[a:b] + bytes(UNIT * max(1, -(-n // UNIT)) - n)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def media_column(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the Ogg file of each text's bytes, zero bytes appended up to a positive multiple of 64."""
    lean(documents)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s", "packet_starts", "error"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.string()]
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            data = batch.column(2)[k].as_py()
            if data is None:
                rows.append((None,) * 9)
                continue
            whole = (len(data), hashlib.sha256(data).hexdigest())
            try:
                a = read_samples(data)
            except OggError as e:
                rows.append((None, None, None, *whole, None, None, None, str(e)))
                continue
            s = a.samples
            rows.append((len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-UNIT:]), *whole, _features(a), a.duration, a.starts, None))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types[2:], strict=True))], names=names)


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes say, read back: payload digests, features, times; ``error`` where they are damaged."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, packet_starts array<double>, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decoded, schema)
