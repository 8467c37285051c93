"""Media columns: sample payloads in Ogg containers, written and read back.

A payload is cut into packets that alternate between two logical streams. Each
stream starts with a header packet on a page of its own; packets are split by
lacing values into segments of 255 bytes, may continue over pages, and each page
has a checksum and the granule position (samples ended so far) of its stream.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessile.llm.common import arrow_rows, stored, table

UNIT = 64
PACKET = 4096
#: Lacing values of a page at most (the format allows 255); long packets continue on the next page.
SEGMENTS = 100
RATE = 8000
STREAMS = 2
HEAD = struct.Struct("<4sBBqIIIB")  # capture, version, flags, granule, serial, sequence, checksum, segments
IDENT = struct.Struct("<8sBBIQ")  # magic, stream, streams, rate, bytes of the stream
MAGIC = b"\x7fSamples"
CONTINUED, FIRST, LAST = 1, 2, 4

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """The format's CRC-32: the usual polynomial, highest bit first, from 0 and not inverted.

    That is zlib's lowest-bit-first CRC of the mirrored bytes, mirrored.
    """
    crc = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def stream_pages(serial: int, packets: list[bytes], rate: int = RATE, index: int = 0, streams: int = 1) -> list[bytes]:
    """Pages of one logical stream: its header packet, then packets of 8-bit samples."""
    ident = IDENT.pack(MAGIC, index, streams, rate, sum(map(len, packets)))
    pages = [page(FIRST | (0 if packets else LAST), 0, serial, 0, bytes([len(ident)]), ident)]
    lacing, ends, done = bytearray(), [], 0
    for p in packets:
        lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        done += len(p)
        ends.append((len(lacing), done))
    body, at, e = b"".join(packets), 0, 0
    for start in range(0, len(lacing), SEGMENTS):
        part = bytes(lacing[start : start + SEGMENTS])
        granule = -1  # no packet ends on this page
        while e < len(ends) and ends[e][0] <= start + len(part):
            granule, e = ends[e][1], e + 1
        flags = (CONTINUED if start and lacing[start - 1] == 255 else 0) | (LAST if start + len(part) == len(lacing) else 0)
        size = sum(part)
        pages.append(page(flags, granule, serial, len(pages), part, body[at : at + size]))
        at += size
    return pages


def write(payload: bytes, streams: int = STREAMS, rate: int = RATE, packet: int = PACKET) -> bytes:
    """One file: packet k goes to stream k modulo streams; the first pages of all streams lead, then pages take turns."""
    cut = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    each = [stream_pages(s + 1, cut[s::streams], rate, s, streams) for s in range(streams)]
    out = [p[0] for p in each]
    for i in range(1, max(map(len, each))):
        out += [p[i] for p in each if i < len(p)]
    return b"".join(out)


@dataclass
class Stream:
    """What was read of one logical stream."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    seconds: list[float] = field(default_factory=list)  # at the end of each packet, where its page tells
    granule: int = 0
    open: bytes = b""
    sequence: int = -1
    ended: bool = False
    index: int = 0
    streams: int = 1
    rate: int = RATE
    size: int = 0


@dataclass
class Read:
    streams: list[Stream]
    pages: int = 0
    bad_pages: int = 0
    lost_packets: int = 0


def read(media: bytes) -> Read:
    """Streams of a file. Pages with wrong checksums are skipped and counted, as are packets that lose a part."""
    streams: dict[int, Stream] = {}
    out, at = Read([]), 0
    while (at := media.find(b"OggS", at)) >= 0 and at + HEAD.size <= len(media):
        _, _, flags, granule, serial, sequence, crc, segments = HEAD.unpack_from(media, at)
        body_at = at + HEAD.size + segments
        lacing = media[at + HEAD.size : body_at]
        end = body_at + sum(lacing)
        if end > len(media) or checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            out.bad_pages += 1
            at += 4
            continue
        out.pages += 1
        s = streams.setdefault(serial, Stream(serial))
        if sequence != s.sequence + 1 or bool(flags & CONTINUED) != bool(s.open):
            out.lost_packets += bool(s.open)
            s.open = b""
        skip = bool(flags & CONTINUED) and not s.open  # the rest of a packet whose start is lost
        s.sequence = sequence
        whole, start = [], body_at
        for value in lacing:
            if value < 255:
                stop = body_at + value
                if not skip:
                    whole.append(s.open + media[start:stop])
                s.open, skip, start = b"", False, stop
            body_at += value
        if start < end and not skip or lacing and lacing[-1] == 255:
            s.open += media[start:end]
        if flags & FIRST and whole:
            magic, s.index, s.streams, s.rate, s.size = IDENT.unpack(whole.pop(0)) if len(whole[0]) == IDENT.size else (b"", 0, 1, RATE, 0)
        if whole:
            s.packets += whole
            # The granule position is that of the last packet that ends on the page; earlier ones lie their samples before it.
            back = np.cumsum([0] + [len(p) for p in whole[:0:-1]])[::-1]
            s.seconds += [float(granule - b) / s.rate for b in back]
            s.granule = granule
        s.ended = bool(flags & LAST)
        at = end
    out.lost_packets += sum(bool(s.open) for s in streams.values())
    out.streams = sorted(streams.values(), key=lambda s: s.index)
    return out


def payload_of(found: Read) -> bytes:
    """Packets of all streams in their turns."""
    longest = max((len(s.packets) for s in found.streams), default=0)
    return b"".join(s.packets[i] for i in range(longest) for s in found.streams if i < len(s.packets))


def features(found: Read, payload: bytes) -> str:
    """Counts, duration from the granule positions, and figures of the samples (8 bit, 128 is silence)."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    signs = x >= 0
    seconds = sum(s.granule / s.rate for s in found.streams)
    ordered = all(a <= b for s in found.streams for a, b in zip(s.seconds, s.seconds[1:], strict=False))
    rms = float(np.sqrt((x * x).mean())) if len(x) else 0.0
    mean = float(x.mean()) if len(x) else 0.0
    return (f"streams={len(found.streams)};pages={found.pages};packets={sum(len(s.packets) for s in found.streams)};bad={found.bad_pages + found.lost_packets};"
        f"seconds={seconds:.6f};ordered={int(ordered)};mean={mean:.6f};rms={rms:.6f};crossings={int(np.count_nonzero(signs[1:] != signs[:-1]))}")  # fmt: skip


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        raw = [len((x or "").encode()) for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.int64()), pa.array([write(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, told = [], []
        for media in batch.column("media").to_pylist():
            found = read(media)
            payloads.append(payload_of(found))
            told.append(features(found, payloads[-1]))
        names = [*batch.schema.names, "payload", "feature"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(told, pa.string())], names)


def packet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            for s in read(media or b"").streams:
                rows += [(doc_id, s.serial, i, t, p) for i, (p, t) in enumerate(zip(s.packets, s.seconds, strict=True))]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "serial", "packet", "seconds", "data"])


def to_media(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, media (the whole file). A null text counts as empty; other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_rows(docs.select("doc_id", "text")).mapInArrow(write_batches, f"doc_id {kind}, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """The rows with what their files hold: payload, feature. Broken pages are left out and counted in the feature."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return arrow_rows(media).mapInArrow(read_batches, f"{fields}, payload binary, feature string")


def packets(media: DataFrame) -> DataFrame:
    """Packets of all files: doc_id, serial, packet, seconds (time at its end), data."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return arrow_rows(media.select("doc_id", "media")).mapInArrow(packet_batches, f"doc_id {kind}, serial long, packet long, seconds double, data binary")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written to the shared folder as a column and read back from there."""
    kept = stored(to_media(table(spark, sf_dir, "documents")), "media")
    return from_media(kept).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
