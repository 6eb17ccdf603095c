"""Media columns: MPEG transport streams.

Packets of 188 bytes carry program tables (PAT, PMT) and elementary packets (PES) of a private
data stream. Writing cuts a payload into access units with timestamps, of which every
RANDOM_ACCESS-th is a random-access point, with the program tables before it. Reading finds the stream through the program
tables, checks their checksums and all continuity counters, and reassembles the elementary packets; where a packet doesn't begin
with the sync byte, it goes on at the next place from which packets follow each other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the transport stream format.
PACKET, SYNC, PAT_PID = 188, 0x47, 0
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CLOCK = 90_000

NO_PID = 0x1FFF

PMT_PID, DATA_PID, PROGRAM = 0x100, 0x101, 1
UNIT = 2048  # payload bytes of an access unit
UNIT_TICKS = CLOCK // 25
RANDOM_ACCESS = 8


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def mpeg_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + mpeg_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter, 0])
    return head + section + b"\xff" * (PACKET - len(head) - len(section))


_PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
#: The program has no clock of its own: its PCR PID is the null packets', which the format keeps for that.
_PMT = _section(2, PROGRAM, (0xE000 | NO_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
_TABLES = [_table_packet(PAT_PID, _PAT, k) + _table_packet(PMT_PID, _PMT, k) for k in range(16)]


def _timestamp(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, t >> 22 & 255, 1 | (t >> 14) & 0xFE, t >> 7 & 255, 1 | (t << 1) & 0xFE])


def _elementary(unit: bytes, ticks: int) -> bytes:
    return b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(ticks) + unit


def write_stream(payload: bytes) -> bytes:
    """A transport stream with the payload: an elementary packet for each access unit, with the tables before each random-access point."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        pes = _elementary(payload[at : at + UNIT], k * UNIT_TICKS)
        flag = 0x40 if k % RANDOM_ACCESS == 0 else 0x00  # of the adaptation field
        if flag:
            out.append(_TABLES[k // RANDOM_ACCESS & 15])
        done, first = 0, True
        while done < len(pes):
            room = PACKET - 4
            need = 2 if first and flag else 0
            part = pes[done : done + room - need]
            stuff = room - len(part)
            head = bytes([SYNC, (0x40 if first else 0) | DATA_PID >> 8, DATA_PID & 255, (0x30 if stuff else 0x10) | counter])
            field_ = b"" if not stuff else bytes([stuff - 1]) + (bytes([flag if first else 0]) + b"\xff" * (stuff - 2) if stuff > 1 else b"")
            out.append(head + field_ + part)
            done += len(part)
            counter = counter + 1 & 15
            first = False
    return b"".join(out)


@dataclass
class Stream:
    """What reading found. units: (timestamp, random access, payload)."""

    packets: int = 0
    pid: int | None = None
    units: list[tuple[int, bool, bytes]] = field(default_factory=list)
    discontinuities: int = 0
    table_errors: int = 0
    lost_sync: int = 0

    @property
    def payload(self) -> bytes:
        return b"".join(u[2] for u in self.units)


def _section_of(body: bytes) -> bytes | None:
    """The section at a table packet's pointer, None if its checksum is wrong."""
    start = 1 + body[0] if body else 0
    end = start + 3 + (int.from_bytes(body[start + 1 : start + 3], "big") & 0xFFF)
    section = body[start:end]
    return section if len(section) >= 12 and end <= len(body) and mpeg_crc(section) == 0 else None


def _next_sync(data: bytes, at: int) -> int | None:
    """The next place with a sync byte there and, unless the data ends before, a packet later."""
    while (at := data.find(SYNC, at)) >= 0:
        if at + PACKET >= len(data) or data[at + PACKET] == SYNC:
            return at
        at += 1
    return None


def read_stream(data: bytes) -> Stream:
    """Parses a transport stream: the first private data stream of the first program."""
    found = Stream()
    pmt: int | None = None
    last: dict[int, int] = {}  # by PID
    parts: list[bytes] = []
    access = False

    def flush() -> None:
        pes = b"".join(parts)
        parts.clear()
        if len(pes) >= 14 and pes[:4] == bytes([0, 0, 1, PRIVATE_STREAM]):
            end = 6 + int.from_bytes(pes[4:6], "big")
            t = pes[9:14]
            ticks = (t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1
            found.units.append((ticks if pes[7] & 0x80 else -1, access, pes[9 + pes[8] : end]))

    start_at = _next_sync(data, 0)
    found.lost_sync += bool(data) and start_at != 0
    at = len(data) if start_at is None else start_at - PACKET
    while (at := at + PACKET) + PACKET <= len(data):
        if data[at] != SYNC:
            found.lost_sync += 1
            new = _next_sync(data, at + 1)
            if new is None:
                break
            at = new
            if at + PACKET > len(data):
                break
        found.packets += 1
        b1, b3 = data[at + 1], data[at + 3]
        pid, start = (b1 & 0x1F) << 8 | data[at + 2], b1 & 0x40
        body, flags = at + 4, 0
        if b3 & 0x20:
            size = data[at + 4]
            flags = data[at + 5] if size else 0
            body += 1 + size
        if b3 & 0x10 and (pid in (PAT_PID, pmt, found.pid)):
            if pid in last and b3 & 15 != last[pid] + 1 & 15:
                found.discontinuities += 1
            last[pid] = b3 & 15
        if pid in (PAT_PID, pmt) and start:
            section = _section_of(data[body : at + PACKET])
            if section is None:
                found.table_errors += 1
            elif pid == PAT_PID:
                pmt = int.from_bytes(section[10:12], "big") & 0x1FFF
            elif found.pid is None:
                entry, end = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF), len(section) - 4
                while entry + 5 <= end:
                    if section[entry] == PRIVATE_TYPE:
                        found.pid = int.from_bytes(section[entry + 1 : entry + 3], "big") & 0x1FFF
                        break
                    entry += 5 + (int.from_bytes(section[entry + 3 : entry + 5], "big") & 0xFFF)
        elif pid == found.pid and b3 & 0x10:
            if start:
                flush()
                access = bool(flags & 0x40)
            parts.append(data[body : at + PACKET])
    flush()
    return found


def padded(text: bytes) -> bytes:
    """text and bytes 0 up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 or (0 if text else 64))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            text = [(x.as_py() or "").encode() for x in part.column(1)]
            media = [write_stream(padded(t)) for t in text]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in text], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of docs (doc_id, text) as UTF-8, padded, in a transport stream."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _feature(s: Stream, payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    access = [i for i, u in enumerate(s.units) if u[1]]
    times = [u[0] for u in s.units]
    return (
        f"pid={s.pid} packets={s.packets} units={len(s.units)} access={len(access)} first={times[0] if times else -1} last={times[-1] if times else -1} "
        f"gaps={s.discontinuities} table_errors={s.table_errors} lost={s.lost_sync} sum={int(x.sum(dtype=np.int64))} energy={int((x.astype(np.int64) ** 2).sum())}"
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for m in batch.column(2):
            m = m.as_py()
            if m is None:
                rows.append((None,) * 9)
                continue
            s = read_stream(m)
            p = s.payload
            rows.append((
                len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), _feature(s, p),
                [u[0] for u in s.units], [i for i, u in enumerate(s.units) if u[1]], s.discontinuities,
            ))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32())
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access", "discontinuities")
        cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "n_bytes", *names])


def inspected(media: DataFrame) -> DataFrame:
    """What reading back each stream of media (doc_id, n_bytes, media) gives; a null stream gives nulls.

    timestamps: of the access units, in ticks of 90 kHz; random_access: indices of units one can start at.
    A null or empty text is stored as 64 bytes 0. Equal texts give equal streams, digests and features. Null ids
    stay null, rows given twice come out twice, other columns are ignored; no rows in, none out.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<int>, discontinuities int"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, schema)
