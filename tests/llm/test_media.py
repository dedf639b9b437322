import hashlib
import zlib

import pytest

from tests.llm.cases import ROWS, no_docs, odd_docs
from twinspan.llm import media, queries, transport_stream as ts


@pytest.mark.parametrize("n", [0, 1, 63, 64, 150, 157, 158, 159, 160, 161, 162, 163, 340, 341, 342, 343, 344, 345, 346, 347, 348, 32767, 32768, 32769, 70000, 200_001])
def test_round_trip(n):
    payload = bytes((i * 31 + n) % 256 for i in range(n))
    stream = ts.mux(payload)
    m = ts.demux(stream)
    assert m.payload == payload and len(stream) == 188 * m.packets
    units = -(-n // ts.UNIT_BYTES)
    assert [u.pts for u in m.units] == [90_000 + 3600 * i for i in range(units)] and all(u.random_access for u in m.units)
    assert m.programs == {1: {ts.ES_PID: ts.PRIVATE_TYPE}}
    for u in m.units:
        packet = stream[188 * u.start : 188 * u.start + 188]
        assert packet[0] == 0x47 and packet[1] & 0x40 and packet[5] & 0x40


def test_timestamps_of_33_bits():
    for ticks in (0, 1, 90_000, 2**15, 2**30, 2**32 + 12345, 2**33 - 1):
        packet = ts._unit(b"x", ticks, 0).tobytes()
        m = ts.demux(ts._tables() + packet)
        assert [(u.pts, u.dts) for u in m.units] == [(ticks, None)]


def test_section_checksum():
    assert ts.section_crc(b"123456789") == 0x0376E6E7  # the check value of CRC-32/MPEG-2


def test_damage_is_noticed():
    stream = bytearray(ts.mux(b"payload " * 5000))
    ts.demux(bytes(stream))

    def changed(at, value):
        other = bytearray(stream)
        other[at] = value
        return bytes(other)

    for bad in (b"", bytes(stream[:-1]), changed(188 * 5, 0), changed(188 * 5 + 3, 0x10 | 9), changed(15, 0x77), changed(188 + 20, 0x77), bytes(stream[: 188 * 6] + stream[188 * 7 :]), bytes(stream[: 188 * 10])):
        with pytest.raises(ValueError):
            ts.demux(bad)


# --- streams that mux() does not write, built here byte by byte


def crc(data):
    """CRC-32/MPEG-2, bit by bit."""
    c = 0xFFFFFFFF
    for b in data:
        for bit in range(8):
            top = c >> 31 ^ b >> 7 - bit & 1
            c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
    return c


def section(table, key, body, version=0, number=0, current=1):
    size = len(body) + 9
    head = bytes([table, 0xB0 | size >> 8, size & 255, key >> 8, key & 255, 0xC0 | version << 1 | current, number, number])
    return head + body + crc(head + body).to_bytes(4, "big")


def pid_bytes(pid, bits=0xE0):
    return bytes([bits | pid >> 8, pid & 255])


def pat(programs, **more):
    return section(0, 7, b"".join(n.to_bytes(2, "big") + pid_bytes(p) for n, p in programs), **more)


def pmt(number, streams, info=b"", **more):
    body = pid_bytes(0x1FFF) + bytes([0xF0 | len(info) >> 8, len(info) & 255]) + info
    for kind, pid, extra in streams:
        body += bytes([kind]) + pid_bytes(pid) + bytes([0xF0, len(extra)]) + extra
    return section(2, number, body, **more)


class Writer:
    def __init__(self):
        self.packets, self.counters = [], {}

    def packet(self, pid, data, start, flags=None, step=1):
        """One packet; data of at most 184 bytes, less two if flags are given. Short data is stuffed."""
        c = self.counters[pid] = (self.counters.get(pid, 15) + step) & 15
        gap = 184 - len(data)
        field = b""
        if flags is not None or gap:
            field = bytes([gap - 1]) + (bytes([flags or 0]) + b"\xff" * (gap - 2) if gap > 1 else b"")
        self.packets.append(bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | c]) + field + data)
        assert len(self.packets[-1]) == 188

    def table(self, pid, data, first=183):
        pieces = [b"\0" + data[:first]] + [data[i : i + 184] for i in range(first, len(data), 184)]
        for i, piece in enumerate(pieces):
            self.packet(pid, piece.ljust(184, b"\xff"), i == 0)

    def unit(self, pid, pes, flags=None, size=184):
        size = size - 2 if flags is not None else size
        pieces = [pes[i : i + size] for i in range(0, len(pes), size)]
        for i, piece in enumerate(pieces):
            self.packet(pid, piece, i == 0, flags if i == 0 else None)

    def null(self):
        self.packets.append(bytes([0x47, 0x1F, 0xFF, 0x10]) + bytes(range(184)))

    def adaptation_only(self, pid):
        self.packets.append(bytes([0x47, pid >> 8, pid & 255, 0x20 | self.counters[pid], 183, 0x10]) + b"\xff" * 182)

    def repeat(self):
        self.packets.append(self.packets[-1])


def stamp(mark, ticks):
    bits = f"{mark:04b}{ticks >> 30:03b}1{ticks >> 15 & 0x7FFF:015b}1{ticks & 0x7FFF:015b}1"
    return int(bits, 2).to_bytes(5, "big")


def pes(stream_id, body, pts=None, dts=None, unbounded=False, stuffing=0):
    fields = b"" if pts is None else stamp(2, pts) if dts is None else stamp(3, pts) + stamp(1, dts)
    rest = bytes([0x80, (0 if pts is None else 0x80 if dts is None else 0xC0), len(fields) + stuffing]) + fields + b"\xff" * stuffing + body
    return b"\0\0\1" + bytes([stream_id]) + (0 if unbounded else len(rest)).to_bytes(2, "big") + rest


def two_programs():
    w = Writer()
    w.null()
    w.table(0, pat([(0, 0x10), (1, 0x20), (2, 0x21)]))
    w.table(0x20, pmt(1, [(0x1B, 0x100, b"\x0a\x04eng\0"), (0x0F, 0x101, b"")], info=bytes(range(200))))  # over two packets
    w.table(0x21, pmt(2, [(6, 0x200, b"")]))
    video, audio, other = bytes(range(256)) * 3, b"sound " * 50, b"x" * 10
    w.unit(0x100, pes(0xE0, video, 90_000, 87_000, unbounded=True), flags=0x40)
    w.null()
    w.unit(0x101, pes(0xC0, audio, 2**33 - 1, stuffing=3))
    w.repeat()
    w.adaptation_only(0x101)
    w.unit(0x101, pes(0xC0, audio[::-1]))
    w.table(0, pat([(0, 0x10), (1, 0x20), (2, 0x21)]))
    w.unit(0x200, b"\0\0\1\xbf" + len(other).to_bytes(2, "big") + other)
    w.unit(0x200, b"\0\0\1\xbe\0\x05" + b"\xff" * 5)
    w.unit(0x100, pes(0xE0, b"second", 93_600, unbounded=True))
    return w, video, audio, other


def test_streams_of_another_writer():
    w, video, audio, other = two_programs()
    m = ts.demux(b"".join(w.packets))
    assert m.packets == len(w.packets) and m.programs == {1: {0x100: 0x1B, 0x101: 0x0F}, 2: {0x200: 6}}
    assert {p: s.payload for p, s in m.streams.items()} == {0x100: video + b"second", 0x101: audio + audio[::-1], 0x200: other}
    assert m.payload == video + b"second" + audio + audio[::-1] + other
    units = {p: [(u.pts, u.dts, u.random_access, u.end - u.begin) for u in s.units] for p, s in m.streams.items()}
    assert units[0x100] == [(90_000, 87_000, True, 768), (93_600, None, False, 6)]
    assert units[0x101] == [(2**33 - 1, None, False, 300), (None, None, False, 300)]
    assert units[0x200] == [(None, None, False, 10), (None, None, False, 0)]
    assert all(w.packets[u.start][1] & 0x40 for u in m.units)


def test_discontinuities_and_versions():
    w = Writer()
    w.table(0, pat([(1, 0x30)]))
    w.table(0, pat([(1, 0x20)], version=1) + pat([(1, 0x31)], version=2, current=0))  # two sections in a packet; one not yet in force
    w.table(0x20, pmt(1, [(6, 0x100, b"")]))
    w.table(0x20, pmt(1, [(6, 0x101, b"")], version=3))
    w.packet(0x101, b"rest of an earlier one", False)
    w.unit(0x101, pes(0xBD, b"one", 1))
    w.packet(0x101, pes(0xBD, b"two", 2), True, flags=0x80, step=7)
    m = ts.demux(b"".join(w.packets))
    assert m.programs == {1: {0x101: 6}} and m.payload == b"onetwo"
    w.packet(0x101, pes(0xBD, b"six", 3), True, step=3)
    with pytest.raises(ValueError, match="continuity"):
        ts.demux(b"".join(w.packets))


def test_more_damage_is_noticed():
    packets = two_programs()[0].packets
    twice = [*packets[:-1], packets[-1], packets[-1], packets[-1]]
    other = bytearray(packets[-1])
    other[-1] ^= 1
    marked = bytearray(packets[-1])
    marked[1] |= 0x80
    neither = bytearray(packets[-1])
    neither[3] &= 0xCF
    for bad in (twice, [*packets, bytes(other)], [*packets[:-1], bytes(marked)], [*packets[:-1], bytes(neither)], packets[:1], packets[:2], packets[:4]):
        with pytest.raises(ValueError):
            ts.demux(b"".join(bad))
    ts.demux(b"".join([*packets, packets[-1]]))  # one repetition is allowed


def test_damage_has_a_row_of_its_own(spark):
    w, *_ = two_programs()
    good, bad = b"".join(w.packets), b"".join(w.packets[:-4])[:-1]
    df = spark.createDataFrame([(1, bytearray(good), "a"), (2, bytearray(bad), "b"), (3, None, "c"), (4, bytearray(b""), "d")], "id int, media binary, _media string")
    out = {r.id: r for r in media.parse_column(df, "media", ["id", "_media"]).collect()}
    assert out[1].error is None and [s.pid for s in out[1].streams] == [0x100, 0x101, 0x200] and len(out[1].units) == 6
    assert out[2].error == out[4].error == "not whole packets" and out[2].payload_bytes is None and out[2].units is None
    assert out[3].error is None and out[3].payload_bytes is None and out[3]._media == "c"


def test_query_on_odd_rows(spark, tmp_path):
    odd_docs(spark, clashing=True).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op9_media_columns(spark, str(tmp_path)).collect()
    want = []
    for i, t, *_ in ROWS:
        body = (t or "").encode()
        payload = body + b"\0" * (max(64, -(-len(body) // 64) * 64) - len(body))
        stored = ts.mux(payload)
        want.append((i, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert sorted((tuple(r)[:7] for r in rows), key=repr) == sorted(want, key=repr)
    assert len({(r.payload_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})


def test_null_media_stays_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"abc"))], "id int, payload binary")
    out = {r.id: r for r in media.parse_column(media.mux_column(df, "payload", ["id"]), "media", ["id"]).collect()}
    assert out[1].payload_bytes is None and out[1].media_sha256 is None and out[2].payload_bytes == 3
    assert media.mux_column(no_docs(spark).withColumn("payload", media.padded_payload()), "payload", ["doc_id"]).count() == 0
