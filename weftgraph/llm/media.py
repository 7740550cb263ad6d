"""Media columns as MPEG transport streams.

A payload is stored as one program with one private data stream: program tables
(PAT and PMT with their CRC), then packetised elementary packets of up to
``UNIT`` bytes, each with a presentation time, cut into transport packets of
188 bytes with continuity counters.  Every ``KEY``th unit is a random-access
point: it carries the flag and a clock reference, and tables come before it.

Reading does the reverse and trusts nothing: sync bytes, table CRCs, counters
and lengths are checked.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 188
UNIT = 4096
KEY = 8
#: Ticks of the 90 kHz clock between units.
TICKS = 3600
PROGRAM, PMT_PID, DATA_PID = 1, 0x1000, 0x0100
#: Fixed values of the standard: private data in elementary packets, and its stream id.
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD


class MediaError(ValueError):
    """The stored bytes aren't a whole transport stream."""


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 0x04C11DB7, most significant bit first, all ones at first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0"))


def _stamp(ticks: int) -> bytes:
    t = ticks % (1 << 33)
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, t >> 14 & 0xFE | 1, t >> 7 & 255, t << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    packets: list[np.ndarray] = []
    counter = 0
    for k, lo in enumerate(range(0, len(payload), UNIT)):
        unit = payload[lo : lo + UNIT]
        key = k % KEY == 0
        if key:
            for table in (_PAT, _PMT):
                table = table.copy()
                table[3] = 0x10 | k // KEY & 15
                packets.append(table[None])
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * TICKS) + unit
        clock = k * TICKS % (1 << 33)
        # adaptation field of the first packet: flag and clock reference at random-access points
        extra = b"\x50" + (clock << 15 | 0x7E00).to_bytes(6, "big") if key else b""
        room = PACKET - 4 - (1 + len(extra) if key else 0)
        n = 1 + max(0, -(-(len(pes) - room) // (PACKET - 4)))
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 255
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | counter + np.arange(n) & 15
        counter = counter + n & 15
        # the free bytes of the last packet are stuffing in its adaptation field
        left = room + (n - 1) * (PACKET - 4) - len(pes)
        start = np.full(n, 4)
        if key:
            start[0] = 5 + len(extra)
        start[-1] += left
        for j in {0, n - 1}:
            if start[j] > 4:
                out[j, 3] |= 0x20
                out[j, 4] = start[j] - 5
                if start[j] > 5:
                    out[j, 5] = 0
                if j == 0 and key:
                    out[0, 5 : 5 + len(extra)] = np.frombuffer(extra, np.uint8)
        body = np.frombuffer(pes, np.uint8)
        out[np.arange(PACKET)[None] >= start[:, None]] = body
        packets.append(out)
    return np.concatenate(packets).tobytes() if packets else b""


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes = b""
    program: int = 0
    pid: int = 0
    kind: int = 0
    packets: int = 0
    breaks: int = 0
    #: of each unit: presentation time, offset into the payload, bytes, random access
    units: list[tuple[int, int, int, bool]] = field(default_factory=list)


def _read_section(packet: np.ndarray) -> bytes:
    at = 4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0)
    raw = packet[at + 1 + int(packet[at]) :].tobytes()
    size = 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
    raw = raw[:size]
    if len(raw) != size or crc32_mpeg(raw[:-4]) != int.from_bytes(raw[-4:], "big"):
        raise MediaError("a program table is damaged")
    return raw


_tables: dict[bytes, bytes] = {}


def _table(packet: np.ndarray) -> bytes:
    """Tables repeat; each is checked once."""
    key = packet[4:].tobytes()
    if key not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[key] = _read_section(packet)
    return _tables[key]


def demux(media: bytes) -> Stream:
    """Read a stream back; :class:`MediaError` unless it is whole."""
    if not media:
        return Stream()
    if len(media) % PACKET:
        raise MediaError("cut within a packet")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise MediaError("sync byte missing")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    s = Stream(packets=len(p))
    pmt_pid = None
    for row in p[(pid == 0) & (p[:, 1] & 0x40 > 0)]:
        raw = _table(row)
        s.program, pmt_pid = int.from_bytes(raw[8:10], "big"), int.from_bytes(raw[10:12], "big") & 0x1FFF
    for row in p[(pid == pmt_pid) & (p[:, 1] & 0x40 > 0)] if pmt_pid is not None else []:
        raw = _table(row)
        at = 12 + (int.from_bytes(raw[10:12], "big") & 0xFFF)
        s.kind, s.pid = raw[at], int.from_bytes(raw[at + 1 : at + 3], "big") & 0x1FFF
    if not s.pid:
        raise MediaError("no program")
    for which in (0, pmt_pid, s.pid):
        cc = p[pid == which, 3] & 15
        s.breaks += int(((cc[1:] - cc[:-1]) & 15 != 1).sum())
    if s.breaks:
        raise MediaError(f"{s.breaks} breaks of continuity")
    d = p[pid == s.pid]
    if (d[:, 3] & 0x10 == 0).any():
        raise MediaError("packet without payload")
    adapted = d[:, 3] & 0x20 > 0
    start = np.where(adapted, 5 + d[:, 4].astype(np.int64), 4)
    access = adapted & (d[:, 4] > 0) & (d[:, 5] & 0x40 > 0)
    body = d[np.arange(PACKET)[None] >= start[:, None]].tobytes()
    size = np.maximum(PACKET - start, 0)
    begins = np.cumsum(size) - size
    firsts = np.flatnonzero(d[:, 1] & 0x40)
    ends = [*begins[firsts[1:]].tolist(), len(body)]
    parts, at = [], 0
    for j, lo, hi in zip(firsts.tolist(), begins[firsts].tolist(), ends, strict=True):
        if body[lo : lo + 4] != b"\0\0\1" + bytes([PRIVATE_STREAM]) or int.from_bytes(body[lo + 4 : lo + 6], "big") != hi - lo - 6:
            raise MediaError("elementary packet damaged")
        b = body[lo + 9 : lo + 14]
        pts = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
        data = body[lo + 9 + body[lo + 8] : hi]
        s.units.append((pts, at, len(data), bool(access[j])))
        parts.append(data)
        at += len(data)
    s.payload = b"".join(parts)
    return s


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def feature(s: Stream) -> str:
    rap = sum(u[3] for u in s.units)
    return f"program={s.program};pid={s.pid};type={s.kind};packets={s.packets};units={len(s.units)};rap={rap};first_pts={s.units[0][0] if s.units else -1};last_pts={s.units[-1][0] if s.units else -1};breaks={s.breaks}"


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with one more column, the text's payload as a transport stream.

    A null text counts as empty; its payload is 64 zero bytes.
    """
    if media in docs.columns:
        raise ValueError(f"there is a column {media} already")

    @F.udf("binary", useArrow=True)
    def to_media(t):
        return mux(padded(t)[1])

    return docs.withColumn(media, to_media(F.col(text)))


def units(stored: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row for each unit: key, unit, pts, offset, n_bytes, random_access.

    A null or empty stream has no units.
    """

    @F.udf("array<struct<pts: long, offset: long, n_bytes: long, random_access: boolean>>", useArrow=True)
    def read(m):
        return demux(m or b"").units

    out = stored.select(F.col(key).alias("key"), F.posexplode(read(F.col(media))).alias("unit", "u"))
    return out.select("key", "unit", "u.*")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text, read it back and describe both.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of
    what was read back), media_bytes, media_sha256 and feature.  Rows stand for
    themselves: null ids, ties and repeated rows change nothing, equal texts
    give equal values, and an empty table gives none.
    """
    kind = dict(docs.select(F.col(doc_id).alias("k")).dtypes)["k"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                n, payload = padded(t.as_py())
                media = mux(payload)
                s = demux(media)
                rows.append((n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
