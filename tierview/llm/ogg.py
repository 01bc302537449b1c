"""Ogg as a media column: a muxer, and a demuxer that trusts nothing.

The muxer splits a payload into packets, deals them in turn over logical streams and pages
them with lacing values; the demuxer checks every page's checksum and sequence number,
reassembles packets across pages, separates the streams, derives each packet's time from
granule positions (one granule is one 8-bit sample) and puts the payload together again.

Streams of another kind are demultiplexed too, but have no times, as their granules mean something else.

Defined cases: a null payload is an empty one for ``op7_ogg_media`` and stays null in the
column functions; an empty payload is padded to 64 bytes; broken media give a null payload and the
reason in ``error``, other rows are unaffected; equal payloads give equal media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RATE, PACKET, STREAMS, MAGIC = 8000, 4096, 2, b"PCM8RAW1"
CONTINUED, FIRST, LAST, NO_PACKET_ENDS = 1, 2, 4, 0xFFFFFFFFFFFFFFFF
_HEAD, _IDENT, _IDENT_SIZE = "<4sBBQIIIB", "<8sIHHQ", struct.calcsize("<8sIHHQ")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The media is not a whole, valid Ogg file of this mapping."""


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04c11db7, most significant bit first, start 0): zlib's over mirrored bits."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(_HEAD, b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _pages(packets: list[bytes], serial: int) -> list[tuple[int, bytes]]:
    """(granule, page) of one stream; the first packet, its header, has a page of its own and granule 0."""
    out, number, granule = [], 0, 0
    lacing, body, ends, carried = bytearray(), bytearray(), False, False
    last = len(packets) - 1

    def flush(final: bool, goes_on: bool) -> None:
        nonlocal number, lacing, body, ends, carried
        flags = CONTINUED * carried | FIRST * (number == 0) | LAST * final
        place = granule if ends or final else NO_PACKET_ENDS
        out.append((granule, _page(flags, place, serial, number, bytes(lacing), bytes(body))))
        number, lacing, body, ends, carried = number + 1, bytearray(), bytearray(), False, goes_on

    for i, packet in enumerate(packets):
        sizes = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while sizes:
            if len(lacing) == 255:
                flush(False, at > 0)
            take = sizes[: 255 - len(lacing)]
            n = sum(take)
            lacing += take
            body += packet[at : at + n]
            at, sizes = at + n, sizes[len(take) :]
        ends = True
        granule += len(packet) * (i > 0)
        if i == 0 or i == last:
            flush(i == last, False)
    return out


def mux(payload: bytes, streams: int = STREAMS, packet: int = PACKET, rate: int = RATE) -> bytes:
    parts: list[list[bytes]] = [[struct.pack(_IDENT, MAGIC, rate, k, streams, len(payload))] for k in range(streams)]
    for i, at in enumerate(range(0, len(payload), packet)):
        parts[i % streams].append(payload[at : at + packet])
    paged = [_pages(p, k + 1) for k, p in enumerate(parts)]
    heads = [pages[0][1] for pages in paged]
    rest = sorted(((granule, k, i, page) for k, pages in enumerate(paged) for i, (granule, page) in enumerate(pages[1:])), key=lambda x: x[:3])
    return b"".join(heads + [x[3] for x in rest])


@dataclass
class Stream:
    serial: int
    packets: list[bytes]
    #: Microseconds at which each packet begins; none if the rate isn't known.
    starts_us: list[int]
    pages: int
    granule: int


def demux_streams(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, checksums, sequence, lacing and granules verified."""
    view, at, found, partial, closed, rates = memoryview(media), 0, {}, {}, set(), {}
    while at < len(view):
        if len(view) - at < 27:
            raise OggError("a page header is cut off")
        magic, version, flags, granule, serial, number, crc, n = struct.unpack_from(_HEAD, view, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one should begin")
        lacing = bytes(view[at + 27 : at + 27 + n])
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(view):
            raise OggError("a page is cut off")
        whole = bytes(view[at:end])
        if checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            raise OggError("a page checksum is wrong")
        if serial not in found:
            if not flags & FIRST:
                raise OggError("a stream lacks its first page")
            found[serial] = Stream(serial, [], [], 0, 0)
            partial[serial] = None
        stream = found[serial]
        if serial in closed or number != stream.pages or bool(flags & FIRST) != (number == 0):
            raise OggError("pages are out of order")
        if bool(flags & CONTINUED) != (partial[serial] is not None):
            raise OggError("a packet's continuation is missing")
        stream.pages += 1
        body, held, size, ended = at + 27 + n, partial[serial] or [], 0, 0
        for value in lacing:
            size += value
            if value < 255:
                held.append(bytes(view[body : body + size]))
                body, size = body + size, 0
                packet, held = b"".join(held), []
                if not stream.packets:
                    rates[serial] = struct.unpack(_IDENT, packet)[1] if _ours(packet) else None
                    if rates[serial] == 0:
                        raise OggError("a sample rate is zero")
                else:
                    ended += len(packet)
                if rates[serial]:
                    stream.starts_us.append((stream.granule + ended - len(packet) * bool(stream.packets)) * 1_000_000 // rates[serial])
                stream.packets.append(packet)
        goes_on = bool(lacing) and lacing[-1] == 255
        if size:
            held.append(bytes(view[body : body + size]))
        partial[serial] = held if goes_on else None
        stream.granule += ended
        if rates.get(serial) is None:
            stream.granule = stream.granule if granule == NO_PACKET_ENDS else granule
        elif granule != NO_PACKET_ENDS and granule != stream.granule:
            raise OggError("a granule position doesn't match its packets")
        if flags & LAST:
            closed.add(serial)
        at = end
    if any(x is not None for x in partial.values()) or closed != set(found):
        raise OggError("a stream isn't ended")
    return found


def _ours(packet: bytes) -> bool:
    """Whether a stream's first packet names the mapping of ``mux``."""
    return len(packet) == _IDENT_SIZE and packet[:8] == MAGIC


def demux(media: bytes) -> tuple[bytes, dict[int, Stream]]:
    """The payload that ``mux`` stored, and its streams."""
    streams = demux_streams(media)
    if not streams:
        raise OggError("no stream")
    idents = {}
    for s in streams.values():
        if not s.packets or not _ours(s.packets[0]):
            raise OggError("a stream of another kind")
        idents[struct.unpack(_IDENT, s.packets[0])[2]] = s
    _, _, _, n, total = struct.unpack(_IDENT, next(iter(idents.values())).packets[0])
    if sorted(idents) != list(range(n)):
        raise OggError("a stream is missing")
    parts = [idents[k].packets[1:] for k in range(n)]
    packets = sum(map(len, parts))
    if [len(p) for p in parts] != [(packets - k + n - 1) // n for k in range(n)]:
        raise OggError("a stream has too few packets")
    payload = b"".join(parts[i % n][i // n] for i in range(packets))
    if len(payload) != total:
        raise OggError("the payload's length is wrong")
    return payload, streams


def padded(raw: bytes, unit: int = 64) -> bytes:
    """``raw`` and bytes 0 up to a positive multiple of ``unit``."""
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def feature(payload: bytes, streams: dict[int, Stream]) -> str:
    packets = sum(len(s.packets) - 1 for s in streams.values())
    spans = sorted((s.granule * 1_000_000 // RATE, len(s.packets) - 1) for s in streams.values())
    return f"ogg streams={len(streams)} pages={sum(s.pages for s in streams.values())} packets={packets} end_us={spans[-1][0]} adler={zlib.adler32(payload):08x}"


def with_ogg(df: DataFrame, payload: str, out: str = "media") -> DataFrame:
    """Adds ``out``: the binary column ``payload`` as Ogg media; null stays null."""
    @F.pandas_udf("binary")
    def to_ogg(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else mux(bytes(b)))

    return df.withColumn(out, to_ogg(F.col(payload)))


def with_payload(df: DataFrame, media: str, out: str = "demuxed") -> DataFrame:
    """Adds ``out``: struct(payload, streams, pages, last_us, error) read from the Ogg column ``media``."""
    @F.pandas_udf("payload binary, streams int, pages int, last_us long, error string")
    def from_ogg(x: pd.Series) -> pd.DataFrame:
        rows = []
        for b in x:
            try:
                data, streams = (None, {}) if b is None else demux(bytes(b))
                rows.append((data, len(streams), sum(s.pages for s in streams.values()), max((s.starts_us[-1] for s in streams.values() if s.starts_us), default=None), None))
            except (OggError, struct.error) as e:
                rows.append((None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["payload", "streams", "pages", "last_us", "error"])

    return df.withColumn(out, from_ogg(F.col(media)))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            raw = (text.as_py() or "").encode()
            media = mux(padded(raw))
            payload, streams = demux(media)
            rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, streams)))
        columns = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:])]], schema=_OUT)


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_digests, schema)
