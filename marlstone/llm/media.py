"""Media columns: MPEG transport streams.

A payload becomes one elementary stream of 8-bit samples. It is cut into access units; each is a packetised elementary
stream (PES) packet with a presentation time stamp, carried in 188-byte transport packets with continuity counters. A
program association and a program map table stand before every random-access unit. Reading parses the tables, checks
the counters, reassembles the packets and lists time stamps and random-access points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marlstone.llm.common import as_bytes, each_batch, pick, text_slices

#: Fixed values of the transport stream format.
SYNC, PACKET, PAT_PID, NULL_PID, CLOCK = 0x47, 188, 0x0000, 0x1FFF, 90_000
PAT_TABLE, PMT_TABLE, PRIVATE_STREAM, PRIVATE_TYPE, PES_HEADER = 0x00, 0x02, 0xBD, 0x06, 14
#: This writer's choices: program and PIDs, samples a second, samples of an access unit, units from one
#: random-access point to the next.
PROGRAM, PMT_PID, STREAM_PID, RATE, UNIT, GROUP = 1, 0x1000, 0x0100, 8000, 8192, 8


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        out.append(crc)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of table sections: not reflected, starting from all ones."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ byte]
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


_PAT = _section(PAT_TABLE, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section(PMT_TABLE, PROGRAM, struct.pack(">HH", 0xE000 | STREAM_PID, 0xF000) + struct.pack(">BHH", PRIVATE_TYPE, 0xE000 | STREAM_PID, 0xF000))


def _stamp(pts: int) -> bytes:
    return bytes((0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1))


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | counter & 15) + b"\x00" + section).ljust(PACKET, b"\xff")


def write_stream(payload: bytes) -> bytes:
    """The transport stream of a payload of 8-bit samples."""
    out, tables, counter = [], 0, 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        entry = unit % GROUP == 0
        if entry:
            out += [_table_packet(PAT_PID, tables, _PAT), _table_packet(PMT_PID, tables, _PMT)]
            tables += 1
        samples = payload[at : at + UNIT]
        data = struct.pack(">3sBHBBB", b"\x00\x00\x01", PRIVATE_STREAM, len(samples) + 8, 0x80, 0x80, 5) + _stamp(at * CLOCK // RATE & (1 << 33) - 1) + samples
        place, size = 0, len(data)
        while place < size:
            first = place == 0
            field = b"\x40" if first and entry else b""  # random access indicator
            space = PACKET - 4 - (len(field) + 1 if field else 0)
            left = size - place
            if left < space:
                gap = PACKET - 4 - left - 1  # what the adaptation field holds after its length
                field = b"" if gap == 0 else (field or b"\x00").ljust(gap, b"\xff")
                adaptation, space = bytes((len(field),)) + field, left
            else:
                adaptation = bytes((len(field),)) + field if field else b""
            out.append(struct.pack(">BHB", SYNC, (0x4000 if first else 0) | STREAM_PID, (0x30 if adaptation else 0x10) | counter) + adaptation + data[place : place + space])
            counter = counter + 1 & 15
            place += space
    return b"".join(out)


def _sections(data: bytes) -> bytes | None:
    """A table section without its pointer, if its check sum is right."""
    section = data[1 + data[0] :]
    length = 3 + (struct.unpack(">H", section[1:3])[0] & 0x0FFF)
    section = section[:length]
    return section if len(section) == length and section_crc(section) == 0 else None


def read_stream(stream: bytes) -> dict:
    """Demultiplex a transport stream.

    Returns payload, packets, programs (program -> PID of its map), streams (PID -> type), pes (packets that were
    reassembled), stamps (their time stamps), entries ((time stamp, transport packet) of every random-access point),
    counter_errors (lost or repeated packets), broken (bytes without a sync byte, bad sections, bad PES packets).
    """
    programs: dict[int, int] = {}
    streams: dict[int, int] = {}
    last: dict[int, int] = {}
    units: dict[int, list] = {}
    payload, stamps, entries = [], [], []
    errors = broken = packets = pes = 0
    maps: set[int] = set()

    def close(pid: int) -> None:
        nonlocal broken, pes
        parts, index, entry = units.pop(pid)
        data = b"".join(parts)
        if len(data) < 9 or data[:3] != b"\x00\x00\x01" or len(data) < 9 + data[8]:
            broken += 1
            return
        length = struct.unpack(">H", data[4:6])[0]
        if length and length + 6 != len(data):
            broken += 1
            return
        stamp = None
        if data[7] & 0x80:
            p = data[9:14]
            stamp = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1
        pes += 1
        stamps.append(stamp)
        if entry:
            entries.append((stamp, index))
        payload.append(data[9 + data[8] :])

    for at in range(0, len(stream) - PACKET + 1, PACKET):
        sync, head, flags = struct.unpack_from(">BHB", stream, at)
        if sync != SYNC:
            broken += 1
            continue
        index, packets, pid, body, entry = packets, packets + 1, head & 0x1FFF, at + 4, False
        if pid == NULL_PID:
            continue
        if flags & 0x20:
            length = stream[body]
            entry = length > 0 and bool(stream[body + 1] & 0x40)
            body += 1 + length
        if not flags & 0x10:
            continue
        counter = flags & 15
        if pid in last and counter != (last[pid] + 1) & 15:
            errors += 1
        last[pid] = counter
        data = stream[body : at + PACKET]
        if pid == PAT_PID or pid in maps:
            section = _sections(data) if head & 0x4000 and data else None
            if section is None:
                broken += 1
            elif section[0] == PAT_TABLE and pid == PAT_PID:
                for i in range(8, len(section) - 4, 4):
                    number, target = struct.unpack(">HH", section[i : i + 4])
                    programs[number] = target & 0x1FFF
                maps = {p for n, p in programs.items() if n}
            elif section[0] == PMT_TABLE:
                i = 12 + (struct.unpack(">H", section[10:12])[0] & 0x0FFF)
                while i + 5 <= len(section) - 4:
                    kind, target, info = struct.unpack(">BHH", section[i : i + 5])
                    streams[target & 0x1FFF] = kind
                    i += 5 + (info & 0x0FFF)
        elif pid in streams:
            if head & 0x4000:
                if pid in units:
                    close(pid)
                units[pid] = [[data], index, entry]
            elif pid in units:
                units[pid][0].append(data)
    for pid in list(units):
        close(pid)
    broken += len(stream) % PACKET > 0
    return {"payload": b"".join(payload), "packets": packets, "programs": programs, "streams": streams, "pes": pes, "stamps": stamps, "entries": entries, "counter_errors": errors, "broken": broken}


def padded(text: bytes | None, block: int = 64) -> bytes:
    """A text with zero bytes up to a positive multiple of `block`."""
    text = text or b""
    return text.ljust(max(block, -(-len(text) // block) * block), b"\x00")


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store every text as a transport stream: doc_id, n_bytes, media, stamps, entries (time stamp and packet).

    Null text counts as empty. Repeated rows are stored each; other columns are ignored.
    """
    source = pick(docs, doc_id=id_col, text=text_col)
    point = T.StructType([T.StructField("stamp", T.LongType()), T.StructField("packet", T.IntegerType())])
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("stamps", T.ArrayType(T.LongType())), T.StructField("entries", T.ArrayType(point))])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = as_bytes(batch.column(1))
            media = [write_stream(padded(t)) for t in texts]
            stamps, entries = [], []
            for stream in media:
                found = read_stream(stream)
                stamps.append(found["stamps"])
                entries.append([{"stamp": s, "packet": p} for s, p in found["entries"]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(stamps, pa.list_(pa.int64())), pa.array(entries, pa.list_(pa.struct([("stamp", pa.int64()), ("packet", pa.int32())])))], names=[f.name for f in schema])

    each_batch(source, store, schema).write.option("compression", "zstd").parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Read stored streams back and demultiplex them.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes,
    media_sha256, feature (counts of packets, PES packets and random-access points, last time stamp, errors).
    """
    table = spark.read.parquet(path).select("doc_id", "n_bytes", "media")
    schema = T.StructType([table.schema["doc_id"], T.StructField("n_bytes", T.LongType()), *(T.StructField(n, t()) for n, t in (("payload_bytes", T.LongType), ("payload_sha256", T.StringType), ("tail_crc32", T.LongType), ("media_bytes", T.LongType), ("media_sha256", T.StringType), ("feature", T.StringType)))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column=2):
            columns: list[list] = [[] for _ in range(6)]
            for stream in as_bytes(batch.column(2)):
                found = read_stream(stream)
                data = found["payload"]
                feature = f"programs={len(found['programs'])};streams={len(found['streams'])};packets={found['packets']};pes={found['pes']};entries={len(found['entries'])};last_pts={found['stamps'][-1] if found['stamps'] else -1};counter_errors={found['counter_errors']};broken={found['broken']}"
                for column, value in zip(columns, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in columns)], names=[f.name for f in schema])

    return each_batch(table, load, schema)


def transport_streams(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts of docs at path and return what read_media finds there; an empty table gives no row."""
    write_media(docs, path, id_col, text_col)
    return read_media(docs.sparkSession, path)
