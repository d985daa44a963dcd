"""Ogg pages: checksums, lacing, logical streams and timestamps.

``mux`` writes logical streams into one physical stream, ``demux`` reads it back: it verifies every page's
checksum, reassembles packets from lacing values (packets may span pages), separates the streams by serial
number and derives each packet's time from granule positions. A damaged page is reported, not used.

``media_column`` stores any text column this way, ``read_column`` reads stored media back with features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the format (RFC 3533).
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
MAX_SEGMENTS = 255

FRAME = 576
RATE = 8000
_HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0, without inversion.

    zlib's CRC runs over mirrored bits; mirroring the bytes before and the sum after gives this one.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    begun: bool = False
    ended: bool = False

    def times(self, rate: int) -> list[float]:
        """Seconds at the end of each packet; -1 granules (no packet ends on the page) carry no time."""
        return [g / rate if g >= 0 else -1.0 for g in self.granules]


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing))
    page = head + lacing + body
    return page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]


def stream_pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of one logical stream; the first packet has a page of its own."""
    pages: list[bytes] = []
    i, offset = 0, 0  # next packet, and how much of it is written
    while i < len(packets) or not pages:
        lacing, body, granule = bytearray(), [], -1
        flags = (CONTINUED if offset else 0) | (0 if pages else FIRST)
        while i < len(packets) and len(lacing) < MAX_SEGMENTS:
            rest = len(packets[i]) - offset
            room = MAX_SEGMENTS - len(lacing)
            whole = rest // 255
            if whole < room:  # its last lacing value, under 255, fits too
                lacing += b"\xff" * whole + bytes([rest - 255 * whole])
                body.append(packets[i][offset:])
                granule, i, offset = granules[i], i + 1, 0
                if not pages:
                    break
            else:
                lacing += b"\xff" * room
                body.append(packets[i][offset : offset + 255 * room])
                offset += 255 * room
        if i >= len(packets):
            flags |= LAST
        pages.append(_page(flags, granule, serial, len(pages), bytes(lacing), b"".join(body)))
    return pages


def mux(streams: list[tuple[int, list[bytes], list[int]]]) -> bytes:
    """First pages of all streams first, then the others in turn."""
    all_pages = [stream_pages(*s) for s in streams]
    out = [p[0] for p in all_pages]
    for k in range(1, max(map(len, all_pages), default=0)):
        out += [p[k] for p in all_pages if k < len(p)]
    return b"".join(out)


def demux(data: bytes) -> tuple[dict[int, Stream], list[str]]:
    """Streams by serial number, and what was wrong."""
    streams: dict[int, Stream] = {}
    partial: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    wrong: list[str] = []
    at = 0
    while at < len(data):
        if data[at : at + 4] != CAPTURE:
            found = data.find(CAPTURE, at + 1)
            wrong.append(f"no page at {at}")
            if found < 0:
                break
            at = found
            continue
        if at + 27 > len(data) or at + 27 + data[at + 26] > len(data):
            wrong.append(f"page at {at} is cut off")
            break
        _, version, flags, granule, serial, number, crc, segments = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        page = data[at:end]
        if version or end > len(data) or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            wrong.append(f"page at {at} has a wrong checksum or is cut off")
            at += 4
            continue
        s = streams.setdefault(serial, Stream(serial))
        s.pages += 1
        s.begun |= bool(flags & FIRST)
        s.ended |= bool(flags & LAST)
        if number != expected.get(serial, 0):
            wrong.append(f"stream {serial}: page {number} instead of {expected.get(serial, 0)}")
            partial.pop(serial, None)
        expected[serial] = number + 1
        parts = partial.pop(serial, []) if flags & CONTINUED else []
        skip = bool(flags & CONTINUED) and not parts  # its beginning is lost
        pos, run, ends = at + 27 + segments, 0, []
        for v in lacing:
            run += v
            if v < 255:
                if not skip:
                    ends.append(len(s.packets))
                    s.packets.append(b"".join([*parts, data[pos : pos + run]]))
                    s.granules.append(-1)
                pos, run, parts, skip = pos + run, 0, [], False
        if run or (lacing and lacing[-1] == 255):
            partial[serial] = [*parts, data[pos : pos + run]]
        if ends and granule >= 0:
            s.granules[ends[-1]] = granule
        at = end
    wrong += [f"stream {k}: a packet is cut off" for k in partial]
    return streams, wrong


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def store(text: bytes) -> bytes:
    """Text as two logical streams: 8-bit samples in packets of 576, and one packet with the text's length."""
    payload = payload_of(text)
    serial = zlib.crc32(payload)
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = b"\x7fPCM8" + struct.pack("<IH", RATE, FRAME)
    return mux([
        (serial, [head, *frames], [0, *range(FRAME, len(payload) + 1, FRAME)]),
        (serial ^ 0xFFFFFFFF, [b"\x7fSIZE", struct.pack("<Q", len(text))], [0, len(payload)]),
    ])


def load(media: bytes) -> dict:
    """The payload and its features, from stored bytes alone; or errors, and a null payload."""
    streams, wrong = demux(media)
    audio = next((s for s in streams.values() if s.packets and len(s.packets[0]) == 11 and s.packets[0][:5] == b"\x7fPCM8"), None)
    size = next((s for s in streams.values() if s.packets and s.packets[0] == b"\x7fSIZE"), None)
    if not wrong and (audio is None or size is None or not all(s.begun and s.ended for s in (audio, size))):
        wrong = ["a stream is missing"]
    if not wrong:
        rate, frame = struct.unpack("<IH", audio.packets[0][5:])
        payload = b"".join(audio.packets[1:])
        if not rate or not payload or len(size.packets) != 2 or len(size.packets[1]) != 8:
            wrong = ["a header or a packet is missing"]
        elif struct.unpack("<Q", size.packets[1])[0] > len(payload):
            wrong = ["samples are missing"]
    if wrong:
        return {"errors": "; ".join(wrong), "payload": None}
    n = struct.unpack("<Q", size.packets[1])[0]
    last = max(audio.times(rate))
    pages = sum(s.pages for s in streams.values())
    packets = sum(len(s.packets) for s in streams.values())
    feature = f"streams={len(streams)};pages={pages};packets={packets};frame={frame};rate={rate};seconds={last:.6f};low={min(payload)};high={max(payload)};mean={sum_bytes(payload) / len(payload):.6f}"
    return {"errors": "", "payload": payload, "n_bytes": n, "feature": feature, "pages": pages, "packets": packets, "seconds": last}


def sum_bytes(data: bytes) -> int:
    import numpy as np

    return int(np.frombuffer(data, np.uint8).sum(dtype=np.int64))


def media_column(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` with a binary column ``out``: the text as Ogg. Null texts are stored as empty ones.

    Other columns pass through; a column of the name ``out`` is replaced.
    """
    df = df.drop(*[c for c in df.columns if c == out and c != text])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` binary"])

    def run(batches):
        for batch in batches:
            i = batch.schema.names.index(text)
            for part in small(batch, i):
                texts = part.column(i).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([store((t or "").encode("utf-8")) for t in texts], pa.binary())], [*part.schema.names, out])

    return df.mapInArrow(run, schema)


def small(batch: pa.RecordBatch, column: int | str):
    from patternfold.llm.blocks import slices

    name = column if isinstance(column, str) else batch.schema.names[column]
    yield from slices(batch, name)


def read_column(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what its stored media hold: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, pages, packets, seconds, errors. Null or damaged media: nulls, and errors says why.
    """
    new = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages", "packets", "seconds", "errors"]
    kinds = ["long", "long", "string", "long", "long", "string", "string", "long", "long", "double", "string"]
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    df = df.drop(*[c for c in df.columns if c in new and c != media])
    others = [f for f in df.schema if f.name != media]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *(f"`{n}` {k}" for n, k in zip(new, kinds))])

    def one(data: bytes | None) -> dict:
        if data is None:
            return {"errors": "null"}
        x = load(data)
        x |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        if (payload := x["payload"]) is not None:
            x |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:])}
        return x

    def run(batches):
        for batch in batches:
            i = batch.schema.names.index(media)
            for part in small(batch, i):
                rows = [one(m) for m in part.column(i).to_pylist()]
                kept = [part.column(k) for k in range(part.num_columns) if k != i]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r.get(n) for r in rows], arrow[k]) for n, k in zip(new, kinds))], [f.name for f in others] + new)

    return df.mapInArrow(run, schema)


def op1_ogg(spark, sf_dir: str) -> DataFrame:
    """Every text of documents stored as Ogg and read back (null texts: empty; repeated rows alike)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = media_column(docs).select("doc_id", "media")
    return read_column(stored)
