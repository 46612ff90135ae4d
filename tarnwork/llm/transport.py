"""Media columns as MPEG transport streams.

``pack`` stores a payload of bytes as a transport stream with one program: a
program association table, a program map table and one elementary stream of
private data, cut into access units. Each unit is one packet of the elementary
stream with a presentation timestamp, and starts on a transport packet that is
marked as a random-access point and carries a clock reference. ``unpack``
reads any transport stream: tables over several packets and sections, several
programs and elementary streams, repeated packets and packets without
payload, flagged discontinuities, units without a length, units damaged on the
way. It parses the tables, checks every continuity counter, reassembles the
elementary packets and keeps their timestamps with the random-access points.

Rows are independent, batches are of bounded rows, and nothing is kept between
them; a lost executor costs the rerun of its tasks.

Defined cases: a null text counts as empty; an empty payload cannot arise, as
padding makes at least one block; equal texts give equal streams (no id goes
into a stream); repeated rows give repeated results; an empty table gives an
empty result; other columns are not read. Media that is null, has no packets or
no tables gives a row with the reason in ``error``; damage inside a stream is
counted, and only whole units count as payload.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, NULL_PID = 0x0000, 0x0100, 0x0101, 0x1FFF
PROGRAM, STREAM_ID, STREAM_TYPE = 1, 0xBD, 0x06
CRC_POLYNOMIAL = 0x04C11DB7
CLOCK = 90_000
# Ours: padding block, payload bytes and clock ticks of an access unit.
BLOCK, PAD = 192, b" "
UNIT_BYTES, UNIT_TICKS = 64 * BLOCK, 3_600


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ CRC_POLYNOMIAL if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(section: bytes) -> int:
    c = 0xFFFFFFFF
    for b in section:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, table_id_extension: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF]) + table_id_extension.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of BLOCK."""
    return data + PAD * (BLOCK - len(data) if len(data) < BLOCK else -len(data) % BLOCK)


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def pack(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [TABLES], 0
    for n, start in enumerate(range(0, len(payload), UNIT_BYTES)):
        pts = n * UNIT_TICKS & 0x1FFFFFFFF
        unit = payload[start : start + UNIT_BYTES]
        pes = b"".join((b"\x00\x00\x01", bytes([STREAM_ID]), (len(unit) + 8).to_bytes(2, "big"), b"\x84\x80\x05", _timestamp(pts), unit))
        at, end, first = 0, len(pes), True
        while at < end:
            # the adaptation field: flags and clock on the first packet, and whatever fills up the last
            fixed = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big") if first else b""
            room = PACKET - 4 - (1 + len(fixed) if first else 0)
            take = min(room, end - at)
            spare = room - take
            if first:
                field = bytes([len(fixed) + spare]) + fixed + b"\xff" * spare
            elif spare:
                field = b"\x00" if spare == 1 else bytes([spare - 1, 0]) + b"\xff" * (spare - 2)
            else:
                field = b""
            out.append(bytes([SYNC, (0x40 if first else 0) | DATA_PID >> 8, DATA_PID & 0xFF, (0x30 if field else 0x10) | counter]))
            out.append(field)
            out.append(pes[at : at + take])
            counter, at, first = (counter + 1) & 15, at + take, False
    return b"".join(out)


#: Stream ids whose packets have no header beyond the length, and the one of packets that are padding (ISO/IEC 13818-1).
PLAIN_IDS, PADDING_ID = frozenset((0xBC, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)), 0xBE
LENGTH_AT, NO_TIME = 6, -1


class Elementary(NamedTuple):
    """One elementary stream: whole units only; timestamps and decode_timestamps per unit (NO_TIME where there is none)."""

    program: int
    pid: int
    stream_type: int
    payload: bytes
    timestamps: list[int]
    decode_timestamps: list[int]
    random_access: list[int]
    continuity_errors: int
    repeated_packets: int
    broken_units: int


class Stream(NamedTuple):
    packets: int
    lost_packets: int
    streams: list[Elementary]


def _synchronised(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Whole packets from the first place that packets can start at, and which of them are sound."""
    for start in range(min(PACKET, len(stream))):
        if stream[start] == SYNC and all(stream[i] == SYNC for i in range(start, min(len(stream), start + 5 * PACKET), PACKET)):
            n = (len(stream) - start) // PACKET
            if n:
                packets = np.frombuffer(stream, dtype=np.uint8, count=n * PACKET, offset=start).reshape(n, PACKET)
                # in step, no transport error, not scrambled
                return packets, (packets[:, 0] == SYNC) & (packets[:, 1] & 0x80 == 0) & (packets[:, 3] & 0xC0 == 0)
    raise ValueError("no packets")


@functools.lru_cache(maxsize=256)
def _sound(section: bytes) -> bool:
    return len(section) >= 12 and section_crc(section) == 0 and section[5] & 1 == 1


def _sections(packets: np.ndarray, table_id: int) -> Iterator[bytes]:
    """The sound sections of a table, over as many packets as each takes."""
    held: bytes | None = None
    for packet in packets:
        data = packet.tobytes()
        if not data[3] & 0x10:
            continue
        data, starts = data[5 + data[4] if data[3] & 0x20 else 4 :], data[1] & 0x40
        if not data:
            continue
        pieces = [data]
        if starts:
            pieces = [data[1 : 1 + data[0]], data[1 + data[0] :]]
        for i, piece in enumerate(pieces):
            if starts and i == 1:
                held = b""
            if held is None:
                continue
            held += piece
            while len(held) >= 3 and held[0] != 0xFF and len(held) >= (length := 3 + ((held[1] & 0x0F) << 8 | held[2])):
                section, held = held[:length], held[length:]
                if section[0] == table_id and _sound(section):
                    yield section
            if held[:1] == b"\xff":
                held = None


def _tables(packets: np.ndarray, pid: np.ndarray) -> list[tuple[int, int, int]]:
    """Program, stream type and pid of each elementary stream, in the order of the tables."""
    maps: dict[int, int] = {}
    for section in _sections(packets[pid == PAT_PID], 0x00):
        for i in range(8, len(section) - 7, 4):
            program = section[i] << 8 | section[i + 1]
            if program:
                maps[program] = (section[i + 2] & 0x1F) << 8 | section[i + 3]
    if not maps:
        raise ValueError("no program association table")
    found: dict[tuple[int, int], int] = {}
    for map_pid in dict.fromkeys(maps.values()):
        for section in _sections(packets[pid == map_pid], 0x02):
            program = section[3] << 8 | section[4]
            at = 12 + ((section[10] & 0x0F) << 8 | section[11])
            while at + 5 <= len(section) - 4 and maps.get(program) == map_pid:
                found[program, (section[at + 1] & 0x1F) << 8 | section[at + 2]] = section[at]
                at += 5 + ((section[at + 3] & 0x0F) << 8 | section[at + 4])
    if not found:
        raise ValueError("no program map table")
    order = list(maps)
    return sorted(((program, kind, p) for (program, p), kind in found.items()), key=lambda x: order.index(x[0]))


def _time(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def _elementary(packets: np.ndarray, rows: np.ndarray, program: int, stream_type: int, pid: int) -> Elementary:
    """The elementary stream of the packets at rows."""
    own = packets[rows]
    has_field = own[:, 3] & 0x20 > 0
    flags = np.where(has_field & (own[:, 4] > 0), own[:, 5], 0)
    random_access = rows[flags & 0x40 > 0].tolist()
    jumps = np.cumsum(flags & 0x80 > 0)
    carries = np.flatnonzero(own[:, 3] & 0x10 > 0)
    own, jumps = own[carries], jumps[carries]
    counters = own[:, 3] & 15
    steps = np.diff(counters.astype(np.int16)) & 15
    # a packet may be sent twice, once, as it is
    again = np.concatenate(([False], (steps == 0) & (own[1:] == own[:-1]).all(axis=1))) if len(own) else np.zeros(0, dtype=bool)
    again[1:] &= ~again[:-1]
    wrong = (steps != 1) & ~again[1:] & (jumps[1:] == jumps[:-1])
    own = own[~again]
    begins = np.minimum(np.where(own[:, 3] & 0x20 > 0, 5 + own[:, 4].astype(np.int32), 4), PACKET)
    starts = own[:, 1] & 0x40 > 0

    # contents of the packets in order; where units begin in them
    content = own[np.arange(PACKET)[None, :] >= begins[:, None]].tobytes()
    ends = np.cumsum(PACKET - begins)
    unit_at = (ends - (PACKET - begins))[starts].tolist()
    parts, times, decode_times, broken = [], [], [], 0
    for i, j in itertools.pairwise([*unit_at, len(content)]):
        pes = content[i:j]
        if pes[:3] != b"\x00\x00\x01" or len(pes) < LENGTH_AT + 3:
            broken += 1
            continue
        length = pes[4] << 8 | pes[5]
        if pes[3] == PADDING_ID:
            continue
        # length 0: as far as the next unit
        if length + LENGTH_AT > len(pes):
            broken += 1
            continue
        pes = pes[: length + LENGTH_AT] if length else pes
        if pes[3] in PLAIN_IDS:
            parts.append(pes[LENGTH_AT:])
            times.append(NO_TIME)
            decode_times.append(NO_TIME)
            continue
        has = pes[7] >> 6
        if 9 + pes[8] > len(pes) or pes[8] < (5 if has == 2 else 10 if has == 3 else 0):
            broken += 1
            continue
        times.append(_time(pes[9:14]) if has & 2 else NO_TIME)
        decode_times.append(_time(pes[14:19]) if has == 3 else NO_TIME)
        parts.append(pes[9 + pes[8] :])
    return Elementary(program, pid, stream_type, b"".join(parts), times, decode_times, random_access, int(wrong.sum()), int(again.sum()), broken)


def unpack(stream: bytes) -> Stream:
    """All elementary streams of a transport stream, by its program tables; ValueError where there are no packets or tables."""
    packets, sound = _synchronised(stream)
    pid = np.where(sound, (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2], NULL_PID)
    found = [_elementary(packets, np.flatnonzero(pid == p), program, kind, p) for program, kind, p in _tables(packets, pid)]
    return Stream(len(packets), int((~sound).sum()), found)


def feature(stream: Stream) -> str:
    """What the stream and the samples of its first elementary stream look like, as key=value pairs."""
    e = stream.streams[0]
    counts = np.bincount(np.frombuffer(e.payload, dtype=np.uint8), minlength=256)
    n = max(len(e.payload), 1)
    mean = float(counts @ np.arange(256)) / n
    shares = counts[counts > 0] / n
    entropy = float(-(shares * np.log2(shares)).sum()) + 0.0
    last = max(e.timestamps, default=0) / CLOCK
    return (
        f"packets={stream.packets};units={len(e.timestamps)};random_access={len(e.random_access)};program={e.program};"
        f"type={e.stream_type};continuity_errors={e.continuity_errors};last_s={last:.4f};mean={mean:.4f};entropy={entropy:.4f}"
    )


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), media (its transport stream) from (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t.as_py() or "").encode() for t in batch.column(1)]
            media = [pack(pad(d)) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _read(media: bytes | None) -> tuple[Stream | None, str | None]:
    """The stream, or why there is none: a bad value is a row like others, not the end of the job."""
    try:
        return unpack(media or b""), None
    except ValueError as e:
        return None, str(e)


def read_media(media: DataFrame) -> DataFrame:
    """The elementary streams of any transport streams (doc_id, media), a row each.

    doc_id, program, pid, stream_type, payload, timestamps and decode_timestamps
    (of 90 kHz, -1 where a unit has none), random_access (numbers of transport
    packets), continuity_errors, repeated_packets, broken_units, error. Media
    without packets or tables is one row with an error and nothing else.
    """
    schema = (
        "doc_id long, program int, pid int, stream_type int, payload binary, timestamps array<long>, decode_timestamps array<long>, random_access array<long>, "
        "continuity_errors long, repeated_packets long, broken_units long, error string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), *((n, pa.int32()) for n in ("program", "pid", "stream_type")), ("payload", pa.binary()), *((n, pa.list_(pa.int64())) for n in ("timestamps", "decode_timestamps", "random_access")), *((n, pa.int64()) for n in ("continuity_errors", "repeated_packets", "broken_units")), ("error", pa.string())])
        for batch in batches:
            out = []
            for doc_id, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream, error = _read(m.as_py())
                out += [{"doc_id": doc_id, **e._asdict()} for e in stream.streams] if stream else [{"doc_id": doc_id, "error": error}]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, schema)


def describe_media(media: DataFrame) -> DataFrame:
    """Digests, features, timestamps and random-access points of what write_media stored, from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {
            "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
            "timestamps": pa.list_(pa.int64()), "random_access": pa.list_(pa.int64()), "error": pa.string(),
        }
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            for m in batch.column(2):
                stored = m.as_py() or b""
                s, error = _read(stored)
                row = dict.fromkeys(kinds) | {"media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "error": error}
                if s is not None:
                    e = s.streams[0]
                    row |= {"payload_bytes": len(e.payload), "payload_sha256": hashlib.sha256(e.payload).hexdigest(), "tail_crc32": zlib.crc32(e.payload[-16:]), "feature": feature(s), "timestamps": e.timestamps, "random_access": e.random_access}
                for k, v in row.items():
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, kinds[k]) for k, v in out.items())], ["doc_id", "n_bytes", *out])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every text of documents as a transport stream, read back."""
    from .common import table

    return describe_media(write_media(table(spark, sf_dir, "documents")))
