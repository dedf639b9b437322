"""Media columns as MPEG transport streams (ISO/IEC 13818-1): mux a payload column, then parse the stored streams.

A stream is 188-byte packets: one program association table, one program map table, then the payload as packetized
elementary stream packets of one private stream. Each elementary packet opens an access unit: its first transport packet
carries the random-access flag and a clock reference, its header a timestamp. Multiplexing is a function of the payload.

demux() reads what the standard lets others write: null packets, a repeated packet, packets of an adaptation field alone,
flagged discontinuities, tables over several packets and in several sections and versions, several programs and
elementary streams, elementary packets of unstated length, with one, two or no timestamps, and padding. Of a table the
last version counts; what precedes an elementary stream's first packet start is left out.

Defined results: an empty payload has no elementary packets; a stream that breaks a rule (sync byte, table checksum,
continuity, lengths, marker bits) raises ValueError with what is wrong; a very long stream is held whole, with some two
copies of its bytes.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass

import numpy as np

PACKET, SYNC = 188, 0x47
#: Fixed values of the standard: table and stream identifiers, the stream type and id of private data.
PAT_PID, PMT_PID, ES_PID, PRIVATE_TYPE, PRIVATE_ID = 0x0000, 0x0100, 0x0101, 0x06, 0xBD
#: Bytes of payload in one access unit, and ticks of the 90 kHz clock between two.
UNIT_BYTES, UNIT_TICKS, FIRST_TICKS = 32 * 1024, 3600, 90_000


@functools.cache
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2 of a table section."""
    table, crc = _crc_table(), 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ table[(crc >> 24) ^ b]
    return crc


def _table_packet(pid: int, table_id: int, table_key: int, body: bytes) -> bytes:
    section = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), table_key, 0xC1, 0, 0) + body
    section += struct.pack(">I", section_crc(section))
    packet = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section
    return packet.ljust(PACKET, b"\xff")


@functools.cache
def _tables() -> bytes:
    pat = _table_packet(PAT_PID, 0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _table_packet(PMT_PID, 2, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_TYPE, 0xE000 | ES_PID, 0xF000))
    return pat + pmt


def _timestamp(ticks: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (ticks >> 29) & 0x0E, (ticks >> 14) & 0xFFFE | 1, (ticks << 1) & 0xFFFE | 1)


def _unit(data: bytes, ticks: int, counter: int) -> np.ndarray:
    """The transport packets of one elementary packet; counter: the first one's continuity counter."""
    pes = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_ID, len(data) + 8, 0x84, 0x80, 5) + _timestamp(ticks) + data
    opening = PACKET - 4 - 8
    n = 1 + max(0, -(-(len(pes) - opening) // (PACKET - 4)))
    packets = np.full((n, PACKET), 0xFF, np.uint8)
    packets[:, 0] = SYNC
    packets[:, 1], packets[:, 2] = ES_PID >> 8, ES_PID & 0xFF
    packets[0, 1] |= 0x40
    packets[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
    clock = struct.pack(">IH", ticks >> 1 & 0xFFFFFFFF, (ticks & 1) << 15 | 0x7E00)
    raw = np.frombuffer(pes, np.uint8)
    room = min(opening, len(raw))
    packets[0, 3] |= 0x20
    packets[0, 4], packets[0, 5] = PACKET - 5 - room, 0x50
    packets[0, 6:12] = np.frombuffer(clock, np.uint8)
    packets[0, PACKET - room :] = raw[:room]
    if n > 2:
        packets[1:-1, 4:] = raw[room : room + (n - 2) * (PACKET - 4)].reshape(n - 2, PACKET - 4)
    if n > 1:
        tail = raw[room + (n - 2) * (PACKET - 4) :]
        if gap := PACKET - 4 - len(tail):
            packets[-1, 3] |= 0x20
            packets[-1, 4] = gap - 1
            if gap > 1:
                packets[-1, 5] = 0
        packets[-1, PACKET - len(tail) :] = tail
    return packets


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [_tables()], 0
    for i, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        packets = _unit(payload[at : at + UNIT_BYTES], FIRST_TICKS + i * UNIT_TICKS, counter)
        counter = (counter + len(packets)) & 15
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Unit:
    """One elementary packet: its timestamps (90 kHz, null if none), whether it can be entered at, its first transport
    packet and its payload's bounds in its stream's."""

    pts: int | None
    dts: int | None
    random_access: bool
    start: int
    begin: int
    end: int


@dataclass
class Elementary:
    """One elementary stream: its program, its type, the payload of its packets one after the other."""

    pid: int
    program: int
    kind: int
    payload: bytes
    units: list[Unit]


@dataclass
class Parsed:
    """packets: of all kinds. programs: each one's streams (pid: type). streams: by pid."""

    packets: int
    programs: dict[int, dict[int, int]]
    streams: dict[int, Elementary]

    @property
    def payload(self) -> bytes:
        """The payloads of all streams, by pid."""
        return b"".join(s.payload for _, s in sorted(self.streams.items()))

    @property
    def units(self) -> list[Unit]:
        return [u for _, s in sorted(self.streams.items()) for u in s.units]


# Fixed values of the standard: the pid of null packets; ids of elementary packets without an optional header, and of padding.
NULL_PID, PADDING_ID = 0x1FFF, 0xBE
PLAIN_IDS = frozenset([0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF])


class _Packets:
    """The transport packets of a stream, by column."""

    def __init__(self, stream: bytes) -> None:
        if not stream or len(stream) % PACKET:
            raise ValueError("not whole packets")
        p = self.rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
        if (p[:, 0] != SYNC).any():
            raise ValueError("sync byte lost")
        self.pid = ((p[:, 1] & 0x1F).astype(np.int32) << 8) | p[:, 2]
        real = self.pid != NULL_PID
        if (real & (p[:, 1] >= 0x80)).any():
            raise ValueError("packet marked as damaged")
        control, self.counter = p[:, 3] >> 4 & 3, p[:, 3] & 15
        if (real & (control == 0)).any():
            raise ValueError("neither payload nor adaptation field")
        self.begins = np.where(control & 2, 5 + p[:, 4].astype(np.int32), 4)
        if (real & (self.begins > PACKET - (control & 1))).any():
            raise ValueError("adaptation field runs over")
        self.filled = real & ((control & 1) > 0)
        flags = np.where((control & 2 > 0) & (p[:, 4] > 0), p[:, 5], 0)
        self.breaks, self.random_access = flags & 0x80 > 0, flags & 0x40 > 0

    def of(self, pid: int) -> np.ndarray:
        """Places of a pid's packets with payload, repeated ones left out; their counters must go on one by one."""
        own = np.flatnonzero(self.filled & (self.pid == pid))
        step = np.diff(self.counter[own].astype(np.int8)) & 15
        again = np.flatnonzero((step == 0) & ~self.breaks[own[1:]])
        for i in again.tolist():
            a, b = self.rows[own[i]], self.rows[own[i + 1]]
            if (i and i - 1 in again) or not np.array_equal(a[self.begins[own[i]] :], b[self.begins[own[i + 1]] :]):
                raise ValueError(f"continuity lost on pid {pid}")
        if ((step != 1) & (step != 0) & ~self.breaks[own[1:]]).any():
            raise ValueError(f"continuity lost on pid {pid}")
        return np.delete(own, again + 1)

    def payloads(self, own: np.ndarray) -> tuple[bytes, list[int]]:
        """The payload bytes of packets, one after the other, and where each begins."""
        rows, first = self.rows[own], self.begins[own]
        flat = rows[np.arange(PACKET) >= first[:, None]].tobytes()
        return flat, np.concatenate([[0], np.cumsum(PACKET - first)]).tolist()

    def opens(self, own: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.rows[own, 1] & 0x40)


@functools.lru_cache(maxsize=256)
def _checked(section: bytes) -> bytes:
    if section_crc(section):  # the checksum of all, its own included, is zero
        raise ValueError(f"table {section[0]} is damaged")
    return section


def _sections(packets: _Packets, pid: int) -> list[bytes]:
    """The table sections that a pid carries, in order."""
    own = packets.of(pid)
    flat, edges = packets.payloads(own)
    opens = set(packets.opens(own).tolist())
    out, held = [], None

    def take() -> None:
        nonlocal held
        while held and held[0] != 0xFF and len(held) >= 3:
            size = 3 + (struct.unpack(">H", held[1:3])[0] & 0xFFF)
            if len(held) < size:
                return
            out.append(_checked(held[:size]))
            held = held[size:]

    for i in range(len(own)):
        data = flat[edges[i] : edges[i + 1]]
        if i in opens:
            if 1 + data[0] > len(data):
                raise ValueError(f"table on pid {pid} begins nowhere")
            if held is not None:
                held += data[1 : 1 + data[0]]
                take()
            held = data[1 + data[0] :]
        elif held is not None:
            held += data
        take()
    return out


def _table(sections: list[bytes], table_id: int, what: str) -> dict[int, list[bytes]]:
    """Bodies of a table's sections by its key (program or stream number), of the last version that is in force."""
    found: dict[int, tuple[int, dict[int, bytes]]] = {}
    for s in sections:
        if s[0] != table_id or not s[5] & 1:
            continue
        key, version = struct.unpack(">H", s[3:5])[0], s[5] >> 1 & 31
        if key not in found or found[key][0] != version:
            found[key] = (version, {})
        found[key][1][s[6]] = s[8:-4]
    if not found:
        raise ValueError(f"no {what}")
    return {k: [body for _, body in sorted(parts.items())] for k, (_, parts) in found.items()}


def _ticks(field: bytes) -> int:
    if len(field) < 5 or not field[0] & field[2] & field[4] & 1:
        raise ValueError("timestamp is damaged")
    a, b, c = struct.unpack(">BHH", field[:5])
    return (a >> 1 & 7) << 30 | (b >> 1) << 15 | c >> 1


def _elementary_packet(pes: bytes) -> tuple[int | None, int | None, bytes]:
    """Timestamps and payload."""
    if len(pes) < 6 or pes[:3] != b"\0\0\1":
        raise ValueError("no elementary packet begins where one should")
    size = struct.unpack(">H", pes[4:6])[0]
    if size and size + 6 != len(pes):
        raise ValueError("elementary packet has another length")
    if pes[3] in PLAIN_IDS:
        return None, None, b"" if pes[3] == PADDING_ID else pes[6:]
    if len(pes) < 9 or 9 + pes[8] > len(pes) or pes[6] >> 6 != 2:
        raise ValueError("elementary packet has no header")
    stamps, fields = pes[7] >> 6, pes[9 : 9 + pes[8]]
    if stamps == 1:
        raise ValueError("elementary packet has forbidden flags")
    pts = _ticks(fields) if stamps else None
    return pts, _ticks(fields[5:]) if stamps == 3 else None, pes[9 + pes[8] :]


def _stream(packets: _Packets, pid: int, program: int, kind: int) -> Elementary:
    own = packets.of(pid)
    flat, edges = packets.payloads(own)
    opens = packets.opens(own).tolist()
    bounds = [*(edges[i] for i in opens), len(flat)]
    parts, units, at = [], [], 0
    for i, first in enumerate(opens):
        pts, dts, body = _elementary_packet(flat[bounds[i] : bounds[i + 1]])
        place = int(own[first])
        units.append(Unit(pts, dts, bool(packets.random_access[place]), place, at, at + len(body)))
        parts.append(body)
        at += len(body)
    return Elementary(pid, program, kind, b"".join(parts), units)


def demux(stream: bytes) -> Parsed:
    """Parse a stream: program tables, continuity of each pid, elementary packets with timestamps."""
    packets = _Packets(stream)
    programs: dict[int, dict[int, int]] = {}
    for bodies in _table(_sections(packets, PAT_PID), 0, "program association table").values():
        for body in bodies:
            for at in range(0, len(body) - 3, 4):
                number, pid = struct.unpack(">HH", body[at : at + 4])
                if not number:  # the network's own table
                    continue
                maps = _table(_sections(packets, pid & 0x1FFF), 2, f"map of program {number}")
                if number not in maps:
                    raise ValueError(f"no map of program {number}")
                own = programs.setdefault(number, {})
                for entries in maps[number]:
                    i = 4 + (struct.unpack(">H", entries[2:4])[0] & 0xFFF)
                    while i + 5 <= len(entries):
                        kind, es, info = struct.unpack(">BHH", entries[i : i + 5])
                        own[es & 0x1FFF] = kind
                        i += 5 + (info & 0xFFF)
    streams = {pid: _stream(packets, pid, number, kind) for number, own in programs.items() for pid, kind in own.items()}
    return Parsed(len(packets.rows), programs, streams)
