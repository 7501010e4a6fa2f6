"""Media columns as MPEG transport streams: write payloads as streams of 188-byte packets, and read streams back.

A stream starts with a program association table (packet 0) and a program map table (packet 1), both with CRC-32/MPEG-2.
Then every UNIT payload bytes are one access unit in one elementary packet (PES) with a presentation timestamp, cut
into transport packets with continuity counters; adaptation fields pad the last packet, and every KEY_UNITS-th unit
is marked as a random-access point. Reading takes nothing for granted but the packet size: it checks sync bytes,
follows the tables to the elementary stream, checks their checksums and the continuity counters, reassembles elementary packets by
payload-unit starts, and returns the payload with each unit's timestamp, offset and random-access flag.

As the standard has it, a packet that repeats the one before it counts once, packets with a transport error are left
out, packets without payload don't count, and a counter may jump where the discontinuity flag is set. Any other jump is a
continuity error. An elementary packet that has lost a part is left out and counted as damaged; the units around it are read.

Nulls count as empty texts; a payload is never empty, since texts are padded with bytes 255 to a positive multiple of
576. Equal texts give equal streams. Repeated rows get repeated results, a null doc_id passes through, an empty table
gives an empty result, and other columns are not read. A stream without sync bytes or tables raises a ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tokenlm.llm import kernel as K
from tokenlm.llm.frames import arrow_map, pick
from tokenlm.llm.session import tidy, written

PACKET, UNIT, KEY_UNITS = 188, 576, 16
#: A unit lasts 20 ms of the 90 kHz clock; the first is shown after 1 s.
CLOCK_STEP, CLOCK_START = 1800, 90_000
PMT_PID, STREAM_PID, PROGRAM = 0x100, 0x101, 1
#: Private data of ISO/IEC 13818-1: stream type of the map table, and the packets' stream id.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units array<struct<pts: long, offset: long, random_access: boolean>>"
UNITS = pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())])
_HEADER = 14


def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, most significant bit first, all ones at the start, no final change."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """A packet with one section, filled up with bytes 255."""
    section = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    section += struct.pack(">I", crc32_mpeg(section))
    packet = struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section
    return packet.ljust(PACKET, b"\xff")


@functools.lru_cache(1)
def tables() -> bytes:
    programs = struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)
    streams = struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, STREAM_TYPE, 0xE000 | STREAM_PID, 0xF000)
    return _table(0, 0x00, 1, programs) + _table(PMT_PID, 0x02, PROGRAM, streams)


def _timestamps(n: int) -> np.ndarray:
    """Five bytes of timestamp for each of n units."""
    t = (CLOCK_START + CLOCK_STEP * np.arange(n, dtype=np.int64)) % (1 << 33)
    parts = (0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1)
    return np.stack(parts, 1).astype(np.uint8)


def mux(payload: bytes) -> bytes:
    """A transport stream of a payload, of any size but 0."""
    n = -(-len(payload) // UNIT)
    sizes = np.full(n, UNIT)
    sizes[-1] = len(payload) - UNIT * (n - 1)
    out = [tables()]
    counter = 0
    for size, some in ((UNIT, n - 1 + (sizes[-1] == UNIT)), (int(sizes[-1]), int(sizes[-1] != UNIT))):
        if not some:
            continue
        first = 0 if size == UNIT else n - 1
        body = np.frombuffer(payload, np.uint8, size * some, UNIT * first).reshape(some, size)
        pes = np.empty((some, _HEADER + size), np.uint8)
        pes[:, :9] = list(b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, size + 8, 0x84, 0x80, 5))
        pes[:, 9:_HEADER] = _timestamps(n)[first : first + some]
        pes[:, _HEADER:] = body
        # the first packet has an adaptation field of two bytes with the random-access flag, the last one the filling
        room, total = PACKET - 4, _HEADER + size
        count = 1 if total <= room - 2 else 1 + -(-(total - (room - 2)) // room)
        packets = np.full((some, count, PACKET), 255, np.uint8)
        packets[:, :, 0], packets[:, :, 1], packets[:, :, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
        packets[:, 0, 1] |= 0x40
        control = np.full(count, 0x10)
        at = 0
        for k in range(count):
            left = total - at
            field = 2 if k == 0 else 0
            if left < room - field:
                field = room - left
            if field:
                control[k] = 0x30
                packets[:, k, 4] = field - 1
                if field > 1:
                    packets[:, k, 5] = 0
            packets[:, k, 4 + field :] = pes[:, at : at + room - field]
            at += room - field
        packets[(first + np.arange(some)) % KEY_UNITS == 0, 0, 5] = 0x40
        packets[:, :, 3] = control | (counter + np.arange(some * count)).reshape(some, count) % 16
        counter += some * count
        out.append(packets.tobytes())
    return b"".join(out)


class Stream:
    """What demux finds. payload; timestamps, offsets and random (access points) by unit; cc_errors; repeats, packets that repeat
    the one before; damaged, elementary packets left out; streams by pid."""

    payload: bytes
    timestamps: np.ndarray
    offsets: np.ndarray
    random: np.ndarray
    cc_errors: int
    repeats: int
    damaged: int
    streams: dict[int, int]


def _section(packets: bytes, table_id: int) -> bytes:
    """The body of the first section in packets of one pid, checked."""
    rows = np.frombuffer(packets, np.uint8).reshape(-1, PACKET)
    _, start, at, _ = _fields(rows)
    if not start.any():
        raise ValueError("a table is missing")
    data = b"".join(rows[i, at[i] :].tobytes() for i in range(int(np.argmax(start)), len(rows)))
    data = data[1 + data[0] :]
    section = data[: 3 + ((data[1] & 0x0F) << 8 | data[2])]
    if section[0] != table_id or crc32_mpeg(section):
        raise ValueError("a table is damaged")
    return section[8:-4]


@functools.lru_cache(64)
def _maps(packets: bytes) -> tuple[int, ...]:
    """Pids of program maps that an association table names."""
    pairs = struct.iter_unpack(">HH", _section(packets, 0))
    return tuple(pid & 0x1FFF for number, pid in pairs if number)


@functools.lru_cache(64)
def _streams(packets: bytes) -> tuple[tuple[int, int], ...]:
    """Pids and types of elementary streams that a program map names."""
    body, found = _section(packets, 2), []
    i = 4 + (struct.unpack_from(">H", body, 2)[0] & 0x0FFF)
    while i < len(body):
        kind, pid, info = struct.unpack_from(">BHH", body, i)
        found.append((pid & 0x1FFF, kind))
        i += 5 + (info & 0x0FFF)
    return tuple(found)


def _fields(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pid, payload-unit start, where the payload starts, and whether there is one."""
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    control = rows[:, 3] >> 4 & 3
    at = np.where(control & 2, 5 + rows[:, 4].astype(np.int32), 4)
    return pid, rows[:, 1] & 0x40 > 0, np.minimum(at, PACKET), (control & 1 > 0) & (at <= PACKET) & (rows[:, 1] & 0x80 == 0)


def _flags(rows: np.ndarray) -> np.ndarray:
    """The adaptation fields' flags; 0 without such a field."""
    return np.where((rows[:, 3] & 0x20 > 0) & (rows[:, 4] > 0), rows[:, 5], 0)


def _in_order(rows: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Which packets of one pid count, how many repeat the one before, and the errors of the others' counters."""
    repeat = np.zeros(len(rows), bool)
    if len(rows) > 1:
        same = (rows[1:, 3] & 15) == (rows[:-1, 3] & 15)
        repeat[1:][same] = (rows[1:][same] == rows[:-1][same]).all(1)
    counter = rows[~repeat, 3].astype(np.int64) & 15
    jump = (np.diff(counter) - 1) % 16 != 0
    return ~repeat, int(repeat.sum()), int((jump & (_flags(rows[~repeat])[1:] & 0x80 == 0)).sum())


def demux(media: bytes) -> Stream:
    if len(media) % PACKET or not media:
        raise ValueError("not a whole number of packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != 0x47).any():
        raise ValueError("a packet without its sync byte")
    pid, start, at, full = _fields(rows)
    out = Stream()
    out.streams = dict(x for k in _maps(rows[(pid == 0) & full].tobytes()) for x in _streams(rows[(pid == k) & full].tobytes()))
    if not out.streams:
        raise ValueError("no elementary stream")
    mine = np.flatnonzero((pid == next(iter(out.streams))) & full)
    use, out.repeats, out.cc_errors = _in_order(rows[mine])
    mine = mine[use]
    begun = int(np.argmax(start[mine])) if start[mine].any() else len(mine)
    mine, lead = mine[begun:], begun > 0
    rows, at, start = rows[mine], at[mine], start[mine]
    data = rows[np.arange(PACKET) >= at[:, None]]
    ends = np.cumsum(PACKET - at)
    first = (ends - (PACKET - at))[start]
    padded = np.append(data, np.zeros(_HEADER, np.uint8))
    length = (padded[first + 4].astype(np.int64) << 8 | padded[first + 5]) + 6
    head = padded[first + 8].astype(np.int64) + 9
    stops = np.append(first[1:], len(data))
    coded = (padded[first] == 0) & (padded[first + 1] == 0) & (padded[first + 2] == 1) & (padded[first + 7] & 0x80 > 0)
    good = coded & (first + length == stops) & (head >= _HEADER) & (head <= length)
    out.damaged = int((~good).sum()) + lead
    flags = _flags(rows[start])[good]
    edges = np.zeros(len(data) + 1, np.int32)
    np.add.at(edges, (first + head)[good], 1)
    np.add.at(edges, stops[good], -1)
    out.payload = data[np.cumsum(edges[:-1]) > 0].tobytes()
    first, length, head = first[good], length[good], head[good]
    b = [padded[first + 9 + i].astype(np.int64) for i in range(5)]
    out.timestamps = (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1
    out.offsets = np.cumsum(length - head) - (length - head)
    out.random = flags & 0x40 > 0
    return out


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\xff")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every text's payload as a transport stream."""

    def make(part: pa.RecordBatch) -> dict:
        texts = [t.encode() for t in K.text_list(part.column(1))]
        return {"doc_id": part.column(0), "n_bytes": [len(t) for t in texts], "media": pa.array([mux(payload_of(t)) for t in texts], pa.binary())}

    return arrow_map(pick(docs, "doc_id", "text"), "doc_id long, n_bytes long, media binary", make)


def stored_media(docs: DataFrame) -> DataFrame:
    """The streams of all texts as a column of a table in the shared folder."""
    return written(store(docs), "media")


def units(stored: DataFrame) -> DataFrame:
    """One row per access unit: doc_id, unit, pts, offset in the payload, and whether reading can start there."""

    def run(batches):
        for batch in batches:
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = demux(m)
                n = len(s.offsets)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i] * n, pa.int64()), "unit": pa.array(np.arange(n)), "pts": pa.array(s.timestamps), "offset": pa.array(s.offsets.astype(np.int64)), "random_access": pa.array(s.random)})

    return pick(stored, "doc_id", "media").mapInArrow(tidy(run), "doc_id long, unit long, pts long, offset long, random_access boolean")


def describe(stored: DataFrame) -> DataFrame:
    """One row per stored stream: digests of what is read back from it, what its tables and packets say, and its units."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out: dict = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            found = []
            for m in batch.column(2):
                media = m.as_buffer()
                s = demux(media)
                found.append(s)
                out["payload_bytes"].append(len(s.payload))
                out["payload_sha256"].append(hashlib.sha256(s.payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(s.payload[-32:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(hashlib.sha256(media).hexdigest())
                pid, kind = next(iter(s.streams.items()))
                shown = f"{s.timestamps[0]}-{s.timestamps[-1]}" if len(s.timestamps) else "-"
                out["feature"].append(f"pid={pid};type={kind};packets={len(media) // PACKET};units={len(s.offsets)};cc_errors={s.cc_errors};repeats={s.repeats};damaged={s.damaged};pts={shown};random_access={int(s.random.sum())}")
            whole = lambda name, none: np.concatenate([getattr(s, name) for s in found] or [np.zeros(0, none)])
            units = pa.StructArray.from_arrays([pa.array(whole("timestamps", np.int64)), pa.array(whole("offsets", np.int64)), pa.array(whole("random", bool))], fields=list(UNITS))
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(s.offsets) for s in found])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out.values()), pa.ListArray.from_arrays(cuts, units)], ["doc_id", "n_bytes", *out, "units"])

    return pick(stored, "doc_id", "n_bytes", "media").mapInArrow(tidy(run), SCHEMA)
