"""Operator 1: MPEG transport streams, written, parsed and checked.

A stream carries one program: a program association table, a program map table
and one elementary stream of private data in PES packets with time stamps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import as_bytes, map_texts, stored

#: Fixed values of the transport stream format.
PACKET, SYNC, PAT_PID, NULL_PID, PRIVATE_DATA, PRIVATE_STREAM_1 = 188, 0x47, 0, 0x1FFF, 0x06, 0xBD
CLOCK = 90_000

PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
#: Bytes of payload in a PES packet, ticks between two, and PES packets between random-access points.
UNIT, TICKS, RANDOM_ACCESS_EVERY = 8192, 3003, 4


@lru_cache(maxsize=1)
def crc_table() -> list[int]:
    table = []
    for i in range(256):
        value = i << 24
        for _ in range(8):
            value = (value << 1 ^ (0x04C11DB7 if value & 1 << 31 else 0)) & 0xFFFFFFFF
        table.append(value)
    return table


@lru_cache(maxsize=256)
def section_crc(section: bytes) -> int:
    """The CRC of program tables; 0 over a section with its own CRC."""
    table, value = crc_table(), 0xFFFFFFFF
    for b in section:
        value = (value << 8 ^ table[value >> 24 ^ b]) & 0xFFFFFFFF
    return value


def section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + section_crc(head + body).to_bytes(4, "big")


@lru_cache(maxsize=1)
def tables() -> np.ndarray:
    """The packets of both program tables, continuity counters at 0."""
    pat = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")
    rows = [bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + s for pid, s in ((PAT_PID, pat), (PMT_PID, pmt))]
    return np.frombuffer(b"".join(r.ljust(PACKET, b"\xff") for r in rows), np.uint8).reshape(2, PACKET)


def stamp(ticks: int) -> bytes:
    """A presentation time stamp of 33 bits in its five bytes."""
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """A transport stream that holds payload; the same payload gives the same stream."""
    parts: list[np.ndarray] = []
    counter = 0
    for k, begin in enumerate(range(0, len(payload), UNIT)):
        data = payload[begin : begin + UNIT]
        ticks = k * TICKS
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(ticks) + data
        access = k % RANDOM_ACCESS_EVERY == 0
        if access:
            again = tables().copy()
            again[:, 3] |= k // RANDOM_ACCESS_EVERY & 15
            parts.append(again)
        room = PACKET - 12 if access else PACKET - 4
        n = 1 + max(0, -(-(len(pes) - room) // (PACKET - 4)))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = DATA_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        if access:  # clock reference and random-access mark
            packets[0, 3] |= 0x20
            packets[0, 4:6] = (7, 0x50)
            clock = ticks & (1 << 33) - 1
            packets[0, 6:12] = np.frombuffer((clock << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        raw = np.frombuffer(pes, np.uint8)
        spare = room + (n - 1) * (PACKET - 4) - len(raw)  # stuffing in the last packet
        first = min(room, len(raw))
        if n > 1:
            packets[0, PACKET - room :] = raw[:room]
            full = (n - 2) * (PACKET - 4)
            packets[1 : n - 1, 4:] = raw[room : room + full].reshape(n - 2, PACKET - 4)
            rest = raw[room + full :]
        else:
            rest = raw[:first]
        if n > 1 or spare or not access:
            packets[n - 1, PACKET - len(rest) :] = rest
        else:
            packets[0, 12:] = rest
        if spare:
            if n == 1 and access:
                packets[0, 4] += spare
            else:
                packets[n - 1, 3] |= 0x20
                packets[n - 1, 4] = spare - 1
                if spare > 1:
                    packets[n - 1, 5] = 0
        parts.append(packets)
    return b"".join(p.tobytes() for p in parts)


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    kinds: dict[int, int] = field(default_factory=dict)
    lost: int = 0
    repeated: int = 0
    corrupt: int = 0
    units: list[tuple[int, int | None, bool, bytes]] = field(default_factory=list)  # pid, time stamp, random access, data

    def payload(self) -> bytes:
        return b"".join(u[3] for u in self.units)

    def index(self) -> list[dict]:
        """Time stamp, random-access mark, place in the payload and length of each unit."""
        ends = np.cumsum([len(u[3]) for u in self.units]).tolist()
        return [{"pts": u[1], "random_access": u[2], "start": e - len(u[3]), "length": len(u[3])} for u, e in zip(self.units, ends, strict=True)]

    def feature(self) -> str:
        stamps = [u[1] for u in self.units if u[1] is not None]
        points = [u[1] for u in self.units if u[2]]
        return ";".join(
            [
                "programs=" + ",".join(f"{p}:{pid}" for p, pid in sorted(self.programs.items())),
                "streams=" + ",".join(f"{pid}:{kind}" for pid, kind in sorted(self.kinds.items())),
                f"packets={self.packets}",
                f"continuity_errors={self.lost}",
                f"repeated={self.repeated}",
                f"corrupt={self.corrupt}",
                f"units={len(self.units)}",
                f"pts={min(stamps, default='')}-{max(stamps, default='')}",
                "random_access=" + ",".join("" if p is None else str(p) for p in points),
            ]
        )


def demux(media: bytes) -> Stream:
    """Parse a transport stream.

    Leading bytes before the first sync byte are skipped and a broken last packet
    ignored. Packets marked as damaged or of a table with a wrong CRC count as
    corrupt; a jump of a continuity counter that no discontinuity mark announces
    counts as lost, an exact repetition as repeated and is dropped. An empty
    input is a stream without packets.
    """
    start = next((i for i in range(min(PACKET, len(media))) if all(media[j] == SYNC for j in range(i, min(len(media), i + 3 * PACKET), PACKET))), 0)
    n = (len(media) - start) // PACKET
    out = Stream(packets=n)
    if not n:
        return out
    p = np.frombuffer(media, np.uint8, n * PACKET, start).reshape(n, PACKET)
    good = (p[:, 0] == SYNC) & (p[:, 1] & 0x80 == 0)
    out.corrupt += int(n - good.sum())
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    pid[~good] = NULL_PID
    begins = p[:, 1] & 0x40 != 0
    adapted, loaded = p[:, 3] & 0x20 != 0, p[:, 3] & 0x10 != 0
    size = np.where(adapted, p[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(adapted & (size > 1), p[:, 5], 0)
    body = np.minimum(4 + size, PACKET)

    def sections(which: int) -> list[bytes]:
        found: list[bytes] = []
        for i in np.flatnonzero((pid == which) & loaded):
            raw = p[i, body[i] :].tobytes()
            if begins[i]:
                raw = raw[1 + raw[0] :]
                if len(raw) < 3:
                    continue
                found.append(raw)
            elif found:
                found[-1] += raw
        whole = []
        for s in found:
            s = s[: 3 + (int.from_bytes(s[1:3], "big") & 0xFFF)]
            if section_crc(s):
                out.corrupt += 1
            else:
                whole.append(s)
        return whole

    for s in dict.fromkeys(sections(PAT_PID)):
        for i in range(8, len(s) - 4, 4):
            if number := int.from_bytes(s[i : i + 2], "big"):
                out.programs[number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    for table in dict.fromkeys(out.programs.values()):
        for s in dict.fromkeys(sections(table)):
            i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while i < len(s) - 4:
                out.kinds[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    for which in (PAT_PID, *dict.fromkeys(out.programs.values()), *out.kinds):
        rows = np.flatnonzero((pid == which) & loaded)
        counter = p[rows, 3] & 15
        step = (counter[1:] - counter[:-1]) & 15
        jump = np.flatnonzero(step != 1)
        drop = []
        for j in jump.tolist():
            if step[j] == 0 and (p[rows[j], 4:] == p[rows[j + 1], 4:]).all():
                drop.append(j + 1)
                out.repeated += 1
            elif not flags[rows[j + 1]] & 0x80:
                out.lost += 1
        if which not in out.kinds:
            continue
        rows = np.delete(rows, drop)
        mask = np.arange(PACKET) >= body[rows][:, None]
        raw = p[rows][mask].tobytes()
        ends = np.cumsum(PACKET - body[rows])
        heads = np.flatnonzero(begins[rows])
        starts = np.concatenate([[0], ends])[heads].tolist()
        for k, (i, head) in enumerate(zip(starts, heads.tolist(), strict=True)):
            unit = raw[i : starts[k + 1] if k + 1 < len(starts) else len(raw)]
            if unit[:3] != b"\0\0\1" or len(unit) < 9:
                out.corrupt += 1
                continue
            length = int.from_bytes(unit[4:6], "big")
            unit = unit[: 6 + length] if length else unit
            if length and len(unit) < 6 + length:
                out.corrupt += 1
            when = unstamp(unit[9:14]) if unit[7] & 0x80 else None
            out.units.append((which, when, bool(flags[rows[head]] & 0x40), unit[9 + unit[8] :]))
    return out


def payload_of(text: str) -> bytes:
    """UTF-8 with zeros up to a positive multiple of 64."""
    raw = as_bytes(text)
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


UNITS = "units array<struct<pts:long,random_access:boolean,start:long,length:long>>"


def media_column(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, n_bytes long, sent_sha256 string (of the payload) and each text as a transport stream, ``media`` binary; a null text is empty."""

    def run(texts: list[str]) -> list[list]:
        sent = list(map(payload_of, texts))
        return [[len(as_bytes(t)) for t in texts], [hashlib.sha256(x).hexdigest() for x in sent], list(map(mux, sent))]

    return map_texts(df, run, "n_bytes long, sent_sha256 string, media binary", keep, text)


def media_features(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Store each text as a transport stream, read the stored bytes back, and describe both.

    The streams are a column of a table in the shared folder. Columns: keep,
    n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of what was read
    back), media_bytes, media_sha256, feature, and units: time stamp,
    random-access mark, place in the payload and length of each elementary
    packet. A null text reads as empty: a payload of 64 zeros. Equal texts give
    equal values and repeated rows equal rows; a null doc_id stays null; other
    columns of df are left out. A stream whose payload does not come back, byte
    for byte, fails the task.
    """
    media = stored(media_column(df, keep, text), "media", compression="zstd")
    kept = media.select(*keep).schema
    schema = StructType([*kept.fields, *StructType.fromDDL(f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, {UNITS}").fields])
    arrow = to_arrow_schema(schema)
    first = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, sent, raw in zip(*(batch.column(first + i).to_pylist() for i in range(3)), strict=True):
                stream = demux(raw)
                back = stream.payload()
                digest = hashlib.sha256(back).hexdigest()
                if digest != sent:
                    raise ValueError("a stored transport stream did not give its payload back")
                rows.append((n, len(back), digest, zlib.crc32(back[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), stream.feature(), stream.index()))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(arrow.field(i).type) for i in range(first)] + [pa.array(c, type=arrow.field(first + i).type) for i, c in enumerate(columns)], schema=arrow)

    return media.select(*keep, "n_bytes", "sent_sha256", "media").mapInArrow(run, schema)
