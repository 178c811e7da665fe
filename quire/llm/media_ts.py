"""MPEG transport streams as a media column: multiplex payloads, store them, parse them back.

A payload is cut into access units, one packetised elementary packet (PES) each, with a presentation timestamp of the
90 kHz clock. Every RAP_EVERY-th unit is a random-access point: the program association and map tables are repeated before it and its
first transport packet carries the random-access flag and a clock reference. Timestamps and random-access points are stored beside the stream. Reading goes
from the tables: PAT, then PMT, the first undamaged ones; then the elementary stream's packets, whose continuity counters are checked. A packet that is sent
twice counts once; damaged or missing packets are reported.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import materialise, slices, table

PACKET = 188
BODY = PACKET - 4
UNIT_BYTES = 16_384
TICKS = 3_600  # of the 90 kHz clock between units
RAP_EVERY = 8
PMT_PID, STREAM_PID, PRIVATE_DATA, STREAM_ID, PROGRAM = 0x1000, 0x100, 0x06, 0xBD, 1
ALIGN = 64
#: Bytes of text or media that are handled at a time, one row at least.
SLICE = 8_000_000


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


_PAT = b"\x00" + _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = b"\x00" + _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")


def _packet(pid: int, first: bool, counter: int, body: bytes, adaptation: bytes | None = None) -> bytes:
    """One packet; what body leaves free becomes stuffing of the adaptation field."""
    room = BODY - len(body)
    if adaptation is None and room == 0:
        return bytes([0x47, first << 6 | pid >> 8, pid & 255, 0x10 | counter]) + body
    flags = adaptation or b""
    if room == 1:
        field_ = b"\x00"
    else:
        flags = flags or b"\x00"
        field_ = bytes([room - 1]) + flags + b"\xff" * (room - 1 - len(flags))
    return bytes([0x47, first << 6 | pid >> 8, pid & 255, 0x30 | counter]) + field_ + body


def _pts(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 14, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload, which may be empty."""
    out: list[bytes] = []
    tables, counter = 0, 0
    for k, at in enumerate(range(0, max(len(payload), 1), UNIT_BYTES)):
        unit, t, rap = payload[at : at + UNIT_BYTES], k * TICKS & (1 << 33) - 1, k % RAP_EVERY == 0
        if rap:
            out += [_packet(0, True, tables & 15, _PAT + b"\xff" * (BODY - len(_PAT))), _packet(PMT_PID, True, tables & 15, _PMT + b"\xff" * (BODY - len(_PMT)))]
            tables += 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts(t) + unit
        clock = b"\x50" + (t << 15 | 0x7E00).to_bytes(6, "big") if rap else None
        size = min(len(pes), BODY - (1 + len(clock) if clock else 0))
        out.append(_packet(STREAM_PID, True, counter & 15, pes[:size], clock))
        counter += 1
        rest = len(pes) - size
        full = rest // BODY
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
            block[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            block[:, 4:] = np.frombuffer(pes, np.uint8, full * BODY, size).reshape(full, BODY)
            out.append(block.tobytes())
            counter += full
        if rest % BODY:
            out.append(_packet(STREAM_PID, False, counter & 15, pes[size + full * BODY :]))
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds: units as (timestamp, random access, offset in payload, size); faults as text."""

    payload: bytes = b""
    units: list[tuple[int, bool, int, int]] = field(default_factory=list)
    packets: int = 0
    faults: list[str] = field(default_factory=list)


def units_of(size: int) -> list[dict]:
    """Timestamp, random access, offset and size of the access units that a payload of this size is cut into."""
    return [{"pts": k * TICKS & (1 << 33) - 1, "random_access": k % RAP_EVERY == 0, "offset": at, "size": min(UNIT_BYTES, size - at)} for k, at in enumerate(range(0, max(size, 1), UNIT_BYTES))]


def _table(body: bytes, table_id: int, faults: list[str]) -> bytes | None:
    start = 1 + body[0]
    size = int.from_bytes(body[start + 1 : start + 3], "big") & 0xFFF
    section = body[start : start + 3 + size]
    if len(section) < 12 or section[0] != table_id or section_crc(section):
        faults.append(f"table {table_id} is damaged")
        return None
    return section[8:-4]


def demux(data: bytes) -> Stream:
    """Parse a transport stream; never raises on damaged input, the faults say what is missing."""
    s = Stream()
    if len(data) % PACKET:
        s.faults.append("the last packet is cut short")
    a = np.frombuffer(data, np.uint8, len(data) // PACKET * PACKET).reshape(-1, PACKET)
    s.packets = len(a)
    if not len(a):
        return s
    if lost := int((a[:, 0] != 0x47).sum()):
        s.faults.append(f"{lost} packets without a sync byte")
        a = a[a[:, 0] == 0x47]
    pid = (a[:, 1].astype(np.int32) & 31) << 8 | a[:, 2]
    control = a[:, 3] >> 4 & 3
    begin = 4 + np.where(control & 2, 1 + a[:, 4].astype(np.int32), 0)
    has = (control & 1).astype(bool) & (begin < PACKET)

    def first(p: int, table_id: int) -> bytes | None:
        for row in np.flatnonzero((pid == p) & has & ((a[:, 1] & 0x40) > 0)):
            if (found := _table(a[row, begin[row] :].tobytes(), table_id, s.faults)) is not None:
                return found
        return None

    pat = first(0, 0)
    pmt = first(int.from_bytes(pat[2:4], "big") & 0x1FFF, 2) if pat else None
    if not pmt:
        s.faults.append("no program")
        return s
    stream = int.from_bytes(pmt[4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF) :][1:3], "big") & 0x1FFF
    rows = np.flatnonzero((pid == stream) & has)
    twice = np.concatenate([[False], (a[rows[1:], 1:] == a[rows[:-1], 1:]).all(1)]) if len(rows) else np.zeros(0, bool)
    twice[2:] &= ~twice[1:-1]  # a third one is no repetition
    rows = rows[~twice]
    counters = a[rows, 3] & 15
    if gaps := int(((counters[1:].astype(int) - counters[:-1]) % 16 != 1).sum()) if len(rows) else 0:
        s.faults.append(f"{gaps} gaps in continuity")
    own, at = a[rows], begin[rows]
    body = own[np.arange(PACKET)[None, :] >= at[:, None]].tobytes()
    ends = np.cumsum(PACKET - at)
    starts = np.flatnonzero((own[:, 1] & 0x40) > 0)
    access = ((own[:, 3] & 0x20) > 0) & (own[:, 4] > 0) & ((own[:, 5] & 0x40) > 0)
    parts, offset = [], 0
    bounds = [int(ends[i] - (PACKET - at[i])) for i in starts] + [len(body)]
    for i, row in enumerate(starts):
        pes = memoryview(body)[bounds[i] : bounds[i + 1]]
        if len(pes) < 9 or bytes(pes[:3]) != b"\x00\x00\x01":
            s.faults.append("an elementary packet is damaged")
            continue
        head = 9 + pes[8]
        t = (pes[9] & 14) << 29 | pes[10] << 22 | (pes[11] & 254) << 14 | pes[12] << 7 | pes[13] >> 1 if pes[7] & 0x80 and len(pes) >= 14 else -1
        size = int.from_bytes(pes[4:6], "big") + 6 - head
        unit = bytes(pes[head : head + size])
        if len(unit) != size:
            s.faults.append("an elementary packet is cut short")
        s.units.append((t, bool(access[row]), offset, len(unit)))
        parts.append(unit)
        offset += len(unit)
    s.payload = b"".join(parts)
    return s


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with zeros to a positive multiple of ALIGN, and the length before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % ALIGN or (0 if raw else ALIGN)), len(raw)


UNITS = "array<struct<pts:long,random_access:boolean,offset:long,size:long>>"


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary), index (units by timestamp) of every row of docs(doc_id, text); null text is empty, repeated rows are encoded each, other columns are ignored."""
    kind = _arrow_type(UNITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for at, to in slices(lengths, SLICE):
                some = batch.slice(at, to - at)
                pairs = [payload_of(t) for t in some.column("text").to_pylist()]
                index = pa.array([units_of(len(p)) for p, _ in pairs], kind)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([n for _, n in pairs], pa.int64()), pa.array([mux(p) for p, _ in pairs], pa.binary()), index], ["doc_id", "n_bytes", "media", "index"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_bytes long, media binary, index {UNITS}")


def _arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


def decode(media: DataFrame) -> DataFrame:
    """Adds payload, units, faults to media(doc_id, n_bytes, media); damaged streams keep what could be read."""
    kind = _arrow_type(UNITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("media")), 0).to_pylist()
            for at, to in slices(lengths, SLICE):
                some = batch.slice(at, to - at)
                got = [demux(m or b"") for m in some.column("media").to_pylist()]
                units = [[dict(zip(("pts", "random_access", "offset", "size"), u, strict=True)) for u in s.units] for s in got]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array([s.payload for s in got], pa.binary()), pa.array(units, kind), pa.array([s.faults for s in got], pa.list_(pa.string()))],
                    ["doc_id", "n_bytes", "media", "payload", "units", "faults"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, media binary, payload binary, units {UNITS}, faults array<string>")


def digest(decoded: DataFrame) -> DataFrame:
    """The digest columns of decoded streams; the feature is made from what was read back: units, random-access points, last timestamp, faults and a coarse byte histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, n, media, payload, units, faults in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "payload", "units", "faults")), strict=True):
                share = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8) * 1000 // max(len(payload), 1)
                feature = f"units={len(units)};rap={sum(u['random_access'] for u in units)};pts={units[-1]['pts'] if units else -1};faults={len(faults)};bytes={','.join(map(str, share))}"
                row = (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    return decoded.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(encode(table(spark, sf_dir, "documents")), "media")
    return digest(decode(stored))

