"""MPEG transport streams as a media column.

``to_transport_stream`` stores a payload of 8-bit samples as one program with one elementary
stream: program tables, elementary packets with timestamps, and random-access points that carry a
clock reference.  ``read_transport_stream`` parses the program tables, checks the continuity
counters, reassembles the elementary packets and reports timestamps and random-access points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, public_id

# Fixed values of the format.
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 1, 0x06, 0xBD
CLOCK, SAMPLE_RATE = 90_000, 8_000
#: Samples per elementary packet, and elementary packets per random-access point.
UNIT, POINT_EVERY = 64 * 192, 4
#: A payload is padded with spaces to a positive multiple of this.
ALIGN = 192

READ = (
    "payload binary, programs int, stream_type int, packets long, continuity_errors long, "
    "units array<struct<pts:long,packet:long,offset:long,size:long,random_access:boolean>>, feature string, error string"
)


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of program tables (not reflected, polynomial 04C11DB7)."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    """A packet with one program table; the continuity counter is left 0."""
    section += crc32_mpeg(section).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8).copy()


def _section(table: int, number: int, body: bytes) -> bytes:
    size = 5 + len(body) + 4
    return bytes([table, 0xB0 | size >> 8, size & 0xFF]) + number.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body


_PAT = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _pts(value: int) -> bytes:
    v = value & ((1 << 33) - 1)
    return bytes([0x21 | (v >> 30) << 1, v >> 22 & 0xFF, 0x01 | (v >> 15 & 0x7F) << 1, v >> 7 & 0xFF, 0x01 | (v & 0x7F) << 1])


def mux(payload: bytes) -> bytes:
    """The transport stream that holds ``payload``."""
    out, counter = [], {PAT_PID: 0, PMT_PID: 0, ES_PID: 0}
    for number, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], at * CLOCK // SAMPLE_RATE
        point = number % POINT_EVERY == 0
        if point:
            for pid, table in ((PAT_PID, _PAT), (PMT_PID, _PMT)):
                packet = table.copy()
                packet[3] |= counter[pid] % 16
                counter[pid] += 1
                out.append(packet[None])
        pes = np.frombuffer(b"\x00\x00\x01" + bytes([STREAM_ID]) + (8 + len(unit)).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(pts) + unit, np.uint8)
        field = 0
        if point:  # adaptation field: random access and clock reference
            field = 8
        first = min(len(pes), PACKET - 4 - field)
        full, rest = divmod(len(pes) - first, PACKET - 4)
        n = 1 + full + (rest > 0)
        block = np.full((n, PACKET), 0xFF, np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        block[0, 1] |= 0x40
        block[:, 3] = 0x10 | (counter[ES_PID] + np.arange(n)) % 16
        counter[ES_PID] += n
        if point:
            block[0, 3] |= 0x20
            block[0, 4 : 4 + 8] = [PACKET - 5 - first, 0x50, *(((pts << 15) | 0x7E00).to_bytes(6, "big"))]
        elif first < PACKET - 4:
            _stuff(block[0], first)
        block[0, PACKET - first :] = pes[:first]
        block[1 : 1 + full, 4:] = pes[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
        if rest:
            _stuff(block[-1], rest)
            block[-1, PACKET - rest :] = pes[len(pes) - rest :]
        out.append(block)
    return np.concatenate(out).tobytes() if out else b""


def _stuff(packet: np.ndarray, rest: int) -> None:
    """Fill a packet of ``rest`` payload bytes with an adaptation field."""
    size = PACKET - 5 - rest
    packet[3] |= 0x20
    packet[4] = size
    if size:
        packet[5] = 0


def _section_of(packet: np.ndarray) -> bytes:
    at = 4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0)
    at += 1 + int(packet[at])
    size = (int(packet[at + 1]) & 0x0F) << 8 | int(packet[at + 2])
    section = packet[at : at + 3 + size].tobytes()
    if section not in _CHECKED:
        if crc32_mpeg(section):
            raise ValueError("a program table fails its checksum")
        if len(_CHECKED) < 4096:
            _CHECKED.add(section)
    return section


_CHECKED: set[bytes] = set()


def _own(packets: np.ndarray, pid: np.ndarray, wanted: int) -> tuple[np.ndarray, int]:
    """Indexes of a stream's packets without repeats of the packet before (which the format allows), and how
    many continuity counters are not the next."""
    index = np.flatnonzero(pid == wanted)
    own = packets[index]
    has_payload = own[:, 3] & 0x10 != 0
    counter, bearing = own[has_payload, 3].astype(np.int16) & 0x0F, own[has_payload]
    step = np.diff(counter) % 16
    again = np.zeros(len(counter), bool)
    again[1:] = (step == 0) & (bearing[1:] == bearing[:-1]).all(1)
    keep = np.ones(len(index), bool)
    keep[np.flatnonzero(has_payload)[again]] = False
    return index[keep], int((np.diff(counter[~again]) % 16 != 1).sum())


def demux(data: bytes) -> dict:
    """Payload, tables, continuity errors (of tables and streams) and units of a transport stream.

    All program tables are read; where they change, streams of earlier ones count too."""
    packets = np.frombuffer(data, np.uint8)
    if len(packets) % PACKET or (packets[::PACKET] != SYNC).any():
        raise ValueError("not a transport stream of 188-byte packets")
    packets = packets.reshape(-1, PACKET)
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]

    def sections(wanted: int) -> tuple[list[bytes], int]:
        index, wrong = _own(packets, pid, wanted)
        different = {packets[i, 4:].tobytes(): i for i in index[::-1].tolist()}
        return [_section_of(packets[i]) for i in sorted(different.values())], wrong

    programs: dict[int, int] = {}
    tables, errors = sections(PAT_PID)
    for section in tables:
        for at in range(8, len(section) - 4, 4):
            number, table = int.from_bytes(section[at : at + 2], "big"), int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF
            if number:  # 0 names the network table
                programs[number] = table
    streams: dict[int, int] = {}
    for pmt in dict.fromkeys(programs.values()):
        tables, wrong = sections(pmt)
        errors += wrong
        for section in tables:
            at = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
            while at < len(section) - 4:
                streams[int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF] = section[at]
                at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0x0FFF)
    units, payload = [], []
    for es in streams:
        index, wrong = _own(packets, pid, es)
        errors += wrong
        own = packets[index]
        has_field, has_payload = own[:, 3] & 0x20 != 0, own[:, 3] & 0x10 != 0
        begin = np.where(has_payload, np.where(has_field, 5 + own[:, 4].astype(np.int32), 4), PACKET)
        if (begin > PACKET).any():
            raise ValueError("an adaptation field is longer than its packet")
        field = np.where(has_field & (own[:, 4] > 0), own[:, 5], 0)
        content = own[np.arange(PACKET) >= begin[:, None]]
        to = np.cumsum(PACKET - begin)
        starts = np.flatnonzero(own[:, 1] & 0x40)
        cuts = np.append(to[starts] - (PACKET - begin[starts]), len(content))
        offset = 0
        for k, packet in enumerate(starts.tolist()):
            pes = content[cuts[k] : cuts[k + 1]]
            if len(pes) < 9 or pes[:3].tobytes() != b"\x00\x00\x01":
                raise ValueError("an elementary packet does not begin with its code")
            head, pts = 9 + int(pes[8]), None
            if pes[7] & 0x80:
                p = [int(x) for x in pes[9:14]]
                pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
            size = int.from_bytes(pes[4:6].tobytes(), "big") - (head - 6)
            body = pes[head : head + size]
            units.append({"pts": pts, "packet": int(index[packet]), "offset": offset, "size": len(body), "random_access": bool(field[packet] & 0x40)})
            payload.append(body)
            offset += len(body)
    samples = np.concatenate(payload) if payload else np.zeros(0, np.uint8)
    return {"payload": samples, "programs": len(programs), "stream_type": next(iter(streams.values()), None), "packets": len(packets), "continuity_errors": errors, "units": units}


def feature_of(found: dict) -> str:
    """Sample statistics and stream structure, as text: mean, deviation, crossings of the mean,
    units, random-access points, last timestamp."""
    x = found["payload"].astype(np.int64)
    mean = x.mean() if len(x) else 0.0
    above = x > mean
    points = sum(u["random_access"] for u in found["units"])
    last = next((u["pts"] for u in reversed(found["units"]) if u["pts"] is not None), 0)
    return f"mean={mean:.4f};deviation={x.std() if len(x) else 0:.4f};crossings={int((above[1:] != above[:-1]).sum())};units={len(found['units'])};points={points};last_pts={last}"


def to_transport_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (binary) of every whole text as UTF-8, padded with spaces.

    A null or empty text is 192 spaces; equal texts have equal streams; a null id stays null and
    repeated rows stay; an empty table gives no rows.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part[1]]
                media = [mux(x.ljust(max(ALIGN, -(-len(x) // ALIGN) * ALIGN))) for x in raw]
                yield pa.RecordBatch.from_arrays([part[0], pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["_id", "n_bytes", "media"])

    rows = ids_and_text(docs, id_col, text_col)
    return rows.mapInArrow(store, "_id long, n_bytes long, media binary").select(public_id(), "n_bytes", "media")


def _read(data: bytes | None) -> dict:
    """The columns of ``READ``; all but ``error`` are null for a stream that can't be read."""
    try:
        if data is None:
            raise ValueError("no media")
        found = demux(data)
    except (ValueError, IndexError) as wrong:
        return {"error": str(wrong) or type(wrong).__name__}
    return {**found, "feature": feature_of(found), "payload": found["payload"].tobytes(), "error": None}


def read_transport_stream(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media and what is read back from media: see ``READ``.

    Media that is null, or no whole transport stream with sound tables, gives nulls and an ``error``; lost
    packets are counted in ``continuity_errors``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [_read(x) for x in part["media"].to_pylist()]
                kinds = {
                    "payload": pa.binary(), "programs": pa.int32(), "stream_type": pa.int32(), "packets": pa.int64(), "continuity_errors": pa.int64(),
                    "units": pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("random_access", pa.bool_())])), "feature": pa.string(), "error": pa.string(),
                }
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f.get(k) for f in found], kind) for k, kind in kinds.items())], names=[*part.schema.names, *kinds])

    return stored.select(F.col(id_col).alias("doc_id"), "n_bytes", "media").mapInArrow(read, f"doc_id long, n_bytes long, media binary, {READ}")
