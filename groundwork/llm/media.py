"""Media columns: texts or other payloads as Ogg files, and their packets, times and features read back.

Writing cuts each logical stream into packets, lays packets into pages by lacing values (runs of 255 and a rest) and
sets each page's checksum and granule position. Reading finds pages, verifies checksums, joins segments to packets
across pages, tells the streams apart by serial number, and derives times from granule positions.

A payload becomes two streams: 8-bit samples (first packet: format, rate, channels), and a comment packet
with the payload's length before padding. Equal payloads give equal files. Defined results: a null text is an
empty one, stored as one block of zeros; a damaged page is left out and counted in bad_pages; a null file reads as
one without pages; other columns and repeated rows pass through.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



RATE = 8000
UNIT = 64
#: Samples in a packet.
PACKET = 4096
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_PAGE = struct.Struct("<4sBBqIIIB")
_FORMAT = struct.Struct(">8sHHIIBBHI")
_READ = "struct<payload: binary, n_bytes: long, streams: int, packets: long, bad_pages: long, seconds: double, times: array<double>, feature: string>"


def checksum(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, starting and ending with no inversion."""
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Stream:
    """Packets of one logical stream, each with the granule position at its end."""

    serial: int
    packets: list[tuple[bytes, int]] = field(default_factory=list)


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
    return head[:22] + checksum(head).to_bytes(4, "little") + head[26:]


def _pages(s: Stream) -> list[bytes]:
    """The pages of a stream: the first packet alone, then as many segments as fit."""
    out: list[bytes] = []
    lacing, body, granule, continued = bytearray(), bytearray(), -1, False

    def close(last: bool = False) -> None:
        nonlocal lacing, body, granule
        kind = _CONTINUED * continued | _FIRST * (not out) | _LAST * last
        out.append(_page(kind, granule, s.serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule = bytearray(), bytearray(), -1

    for i, (packet, end) in enumerate(s.packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            if len(lacing) == 255:
                close()
                continued = at > 0
            room = values[: 255 - len(lacing)]
            size = sum(room)
            lacing += room
            body += packet[at : at + size]
            at, values = at + size, values[len(room) :]
            if not values:
                granule = end
        if i == 0 or i == len(s.packets) - 1:
            close(i == len(s.packets) - 1)
            continued = False
    return out


def mux(streams: list[Stream]) -> bytes:
    """One file: every stream's first page, then the other pages in turn."""
    pages = [_pages(s) for s in streams]
    out = [p[0] for p in pages if p]
    for k in range(1, max([0, *map(len, pages)])):
        out += [p[k] for p in pages if k < len(p)]
    return b"".join(out)


def demux(data: bytes) -> tuple[list[Stream], int]:
    """The streams of a file in order of their first pages, and the number of damaged and missing pages.

    A page that doesn't follow the stream's last one in number ends the packet that was open, and what continues it is left out. A stream without a page that ends it
    misses one at least, so a file that was cut off doesn't read as sound. A packet
    has the granule position of its page if it's the last that ends there, and -1 if others of the page come after it.
    """
    streams: dict[int, Stream] = {}
    partial: dict[int, bytearray] = {}
    follows: dict[int, int] = {}
    ended_streams: set[int] = set()
    bad, missing, at = 0, 0, data.find(b"OggS")
    while at >= 0:
        if at + 27 > len(data):
            bad += 1
            break
        _, version, kind, granule, serial, number, crc, n = _PAGE.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < n or end > len(data) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at = data.find(b"OggS", at + 4)
            continue
        s = streams.setdefault(serial, Stream(serial))
        if number != follows.get(serial, number if kind & _FIRST else 0):
            missing += max(1, number - follows.get(serial, 0))
            partial.pop(serial, None)
        follows[serial] = number + 1
        if kind & _LAST:
            ended_streams.add(serial)
        begun, ended = partial.pop(serial, None) if kind & _CONTINUED else None, len(s.packets)
        skip = bool(kind & _CONTINUED) and begun is None  # its beginning was on a damaged page
        packet, place = begun if begun is not None else bytearray(), at + 27 + n
        for value in lacing:
            packet += data[place : place + value]
            place += value
            if value < 255:
                if not skip:
                    s.packets.append((bytes(packet), -1))
                packet, skip = bytearray(), False
        if len(s.packets) > ended:
            s.packets[-1] = (s.packets[-1][0], granule)
        if n and lacing[-1] == 255 and not skip:
            partial[serial] = packet
        at = data.find(b"OggS", end)
    missing += len(streams.keys() - ended_streams)
    return list(streams.values()), max(bad, missing)  # a damaged page is missing from its stream too, as a gap or as its end


def ends(packets: list[tuple[bytes, int]]) -> list[int]:
    """The granule position at the end of each packet of 8-bit samples: its page's, less the packets of the page that come after it."""
    out, at = [], 0
    for packet, granule in reversed(packets):
        at = granule if granule >= 0 else at
        out.append(at)
        at -= len(packet)
    return out[::-1]


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    return payload + bytes(-len(payload) % unit if payload else unit)


def store(payload: bytes) -> bytes:
    """A payload as an Ogg file of 8-bit samples."""
    samples = pad(payload)
    serial = zlib.crc32(payload)
    sound = Stream(serial, [(_FORMAT.pack(b"PCM     ", 0, 0, 1, RATE, 8, 1, PACKET, 0), 0)])
    sound.packets += [(samples[i : i + PACKET], min(i + PACKET, len(samples))) for i in range(0, len(samples), PACKET)]
    note = Stream(serial ^ 1, [(b"NOTE" + struct.pack("<Q", len(payload)), 0)])
    return mux([sound, note])


def features(samples: np.ndarray) -> str:
    """Level, spread, crossings of the middle, and the share of each quarter of the scale."""
    x = samples.astype(np.int64) - 128
    n = max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    shares = np.bincount(samples >> 6, minlength=4) / n
    return f"mean={x.sum() / n:.6f};rms={(float((x * x).sum()) / n) ** 0.5:.6f};crossings={crossings};quarters=" + ",".join(f"{s:.6f}" for s in shares)


def load(media: bytes) -> dict:
    streams, bad = demux(media)
    sound = next((s for s in streams if s.packets and s.packets[0][0][:8] == b"PCM     "), None)
    note = next((s for s in streams if s.packets and s.packets[0][0][:4] == b"NOTE"), None)
    payload = b"".join(p for p, _ in sound.packets[1:]) if sound else b""
    size = struct.unpack("<Q", note.packets[0][0][4:12])[0] if note else len(payload)
    if streams and (not note or len(payload) != size + (-size % UNIT if size else UNIT)):
        bad = max(bad, 1)  # the note is lost, or tells of more or of less than is there
    rate = _FORMAT.unpack(sound.packets[0][0])[4] if sound else RATE
    times = [g / rate for g in ends(sound.packets[1:])] if sound else []
    return {
        "payload": payload, "n_bytes": size,
        "streams": len(streams), "packets": sum(len(s.packets) for s in streams), "bad_pages": bad,
        "seconds": max([0.0, *times]), "times": times, "feature": features(np.frombuffer(payload, dtype=np.uint8)),
    }


def with_media(df: DataFrame, text: str = "text", name: str = "media") -> DataFrame:
    """df with a binary column of Ogg files that hold the texts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([store((x or "").encode()) for x in column.to_pylist()], type=pa.binary())

    return df.withColumn(name, F.arrow_udf(run, "binary")(F.col(text)))


def read_media(df: DataFrame, media: str = "media", name: str = "read") -> DataFrame:
    """df with a struct of what the Ogg files hold: payload, n_bytes, streams, packets, bad_pages, seconds, times (the end of each packet), feature."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("payload", pa.binary()), ("n_bytes", pa.int64()), ("streams", pa.int32()), ("packets", pa.int64()), ("bad_pages", pa.int64()), ("seconds", pa.float64()), ("times", pa.list_(pa.float64())), ("feature", pa.string())])
        for column in batches:
            yield pa.array([load(x or b"") for x in column.to_pylist()], type=kind)

    return df.withColumn(name, F.arrow_udf(run, _READ)(F.col(media)))


def digests(df: DataFrame, media: str = "media", read: str = "read", unit: int = UNIT) -> DataFrame:
    """Digests of stored and read bytes, as columns beside the others; columns of the same names are replaced."""
    payload = F.col(f"{read}.payload")
    own = "n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature seconds bad_pages".split()
    return df.select(
        *(c for c in df.columns if c not in own),
        F.col(f"{read}.n_bytes").alias("n_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -unit, unit)).alias("tail_crc32"),
        F.octet_length(media).cast("long").alias("media_bytes"),
        F.sha2(F.col(media), 256).alias("media_sha256"),
        F.col(f"{read}.feature").alias("feature"),
        F.col(f"{read}.seconds").alias("seconds"),
        F.col(f"{read}.bad_pages").alias("bad_pages"),
    )
