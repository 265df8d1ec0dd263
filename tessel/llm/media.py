"""MPEG transport streams in a media column: multiplex, parse, check and reassemble."""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import raw_texts

# Fixed values of ISO/IEC 13818-1 and of this profile.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID = 0, 0x1000, 0x0100
PRIVATE_PES, PRIVATE_STREAM_1, REGISTRATION = 0x06, 0xBD, 0x05
CLOCK = 90_000
RATE = 8_000  # samples a second
FRAME = 64  # samples; 720 ticks of the clock
UNIT = 8_192  # samples in a PES packet
FORMAT = b"TSL8"

_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1 ^ 0x04C11DB7 if _c >> 31 else _c << 1) & 0xFFFFFFFF
    _CRC.append(_c)


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ x]
    return c


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def stamp(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, 0x01 | ticks >> 14 & 0xFE, ticks >> 7 & 0xFF, 0x01 | ticks << 1 & 0xFE])


def padded(raw: bytes | None) -> bytes:
    """The samples of a text: its bytes, then zeros up to a positive multiple of 64."""
    raw = raw or b""
    return raw + bytes(FRAME - len(raw) if not raw else -len(raw) % FRAME)


def multiplex(samples: bytes, n_bytes: int) -> bytes:
    """One program with one private elementary stream. The PMT's registration descriptor holds the unpadded length.

    Each PES packet of up to UNIT samples carries a PTS and begins with a random-access point and a clock reference.
    """
    pat = section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))
    info = bytes([REGISTRATION, 12]) + FORMAT + n_bytes.to_bytes(8, "big")
    pmt = section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    out = [(bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + table).ljust(PACKET, b"\xff") for pid, table in ((PAT_PID, pat), (PMT_PID, pmt))]
    plain = [bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x10 | cc]) for cc in range(16)]
    cc = 0
    for at in range(0, len(samples), UNIT):
        part = samples[at : at + UNIT]
        pts = at // FRAME * (CLOCK * FRAME // RATE) & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(part) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(pts) + part
        # random-access indicator and PCR (33 bits of base, 6 reserved, 9 of extension)
        field_ = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 5 - len(field_)
        field_ += b"\xff" * max(0, room - len(pes))
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, 0x30 | cc, len(field_)]) + field_ + pes[:room])
        cc = cc + 1 & 15
        for k in range(room, len(pes), PACKET - 4):
            rest = pes[k : k + PACKET - 4]
            short = PACKET - 4 - len(rest)
            if short:
                stuffing = bytes([short - 1]) + (b"\x00" + b"\xff" * (short - 2) if short > 1 else b"")
                out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x30 | cc]) + stuffing + rest)
            else:
                out.append(plain[cc] + rest)
            cc = cc + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """An elementary stream: its bytes, the PTS of each PES packet that has one, offsets of random-access points."""

    pid: int
    kind: int = 0
    data: bytearray = field(default_factory=bytearray)
    pes: int = 0
    pts: list[tuple[int, int]] = field(default_factory=list)  # (offset in data, ticks)
    random_access: list[int] = field(default_factory=list)
    clock: list[int] = field(default_factory=list)  # bases of the clock references


@dataclass
class Program:
    streams: dict[int, Stream] = field(default_factory=dict)
    n_bytes: int | None = None
    packets: int = 0
    continuity_errors: int = 0
    damaged: int = 0  # packets without sync byte, tables whose checksum fails, broken PES headers


def _read_table(out: Program, tables: set[int], pid: int, table: bytes) -> None:
    """A whole section of the association table or of a program table. Lengths that point beyond it are damage."""
    if len(table) < 12 or crc32_mpeg(table):
        out.damaged += 1
        return
    last = len(table) - 4
    if pid == PAT_PID and table[0] == 0:
        tables |= {(table[k + 2] & 0x1F) << 8 | table[k + 3] for k in range(8, last - 3, 4) if table[k] or table[k + 1]}
    elif pid != PAT_PID and table[0] == 2:
        end = 12 + ((table[10] & 0x0F) << 8 | table[11])
        if end > last:
            out.damaged += 1
            return
        for k, tag, size in _descriptors(table, 12, end):
            if tag == REGISTRATION and size >= 12 and table[k : k + 4] == FORMAT:
                out.n_bytes = int.from_bytes(table[k + 4 : k + 12], "big")
        while end + 5 <= last:
            es = (table[end + 1] & 0x1F) << 8 | table[end + 2]
            out.streams.setdefault(es, Stream(es, table[end]))
            end += 5 + ((table[end + 3] & 0x0F) << 8 | table[end + 4])
        if end != last:
            out.damaged += 1


def _descriptors(table: bytes, at: int, end: int):
    while at + 2 <= end and at + 2 + table[at + 1] <= end:
        yield at + 2, table[at], table[at + 1]
        at += 2 + table[at + 1]


def demultiplex(media: bytes | None) -> Program:
    """Parse a transport stream. Damage is counted, never raised; null or empty media is an empty program.

    Tables are put together from as many packets as they take, several of them one after another too.
    """
    out = Program()
    if not media:
        return out
    tables: set[int] = set()
    counters: dict[int, int] = {}
    waiting: dict[int, list] = {}
    sections: dict[int, bytes] = {}

    def close(pid: int) -> None:
        pes = b"".join(waiting.pop(pid, ()))
        stream = out.streams[pid]
        if not pes:
            return
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            out.damaged += 1
            return
        if pes[7] & 0x80 and len(pes) >= 14:
            x = pes[9:14]
            stream.pts.append((len(stream.data), (x[0] >> 1 & 7) << 30 | x[1] << 22 | (x[2] >> 1) << 15 | x[3] << 7 | x[4] >> 1))
        length = int.from_bytes(pes[4:6], "big")
        if length and length + 6 != len(pes):
            out.damaged += 1
        stream.data += pes[9 + pes[8] : length + 6 if length else None]
        stream.pes += 1

    def collect(pid: int, part: bytes, start: int) -> None:
        """Add a packet's part of a table; where a section starts, the first byte says how much still belongs to the one before."""
        if start:
            own = part[1 + part[0] :] if part else b""
            if pid in sections and drain(pid, part[1 : 1 + part[0]] if part else b""):
                out.damaged += 1
            sections[pid] = b""
            drain(pid, own)
        elif pid in sections:
            drain(pid, part)

    def drain(pid: int, more: bytes) -> bytes:
        """Read all whole sections; what is left of one stays, fill bytes do not."""
        held = sections[pid] + more
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) < size:
                break
            _read_table(out, tables, pid, held[:size])
            held = held[size:]
        sections[pid] = b"" if held[:1] == b"\xff" else held
        return sections[pid]

    for p in range(0, len(media), PACKET):
        packet = media[p : p + PACKET]
        out.packets += 1
        if len(packet) < PACKET or packet[0] != SYNC or packet[1] & 0x80:
            out.damaged += 1
            continue
        pid, flags, start, access, clock = (packet[1] & 0x1F) << 8 | packet[2], packet[3], packet[1] & 0x40, False, None
        at = 4
        if flags & 0x20:
            at = 5 + packet[4]
            access = bool(packet[4] and packet[5] & 0x40)
            if packet[4] >= 7 and packet[5] & 0x10:
                clock = int.from_bytes(packet[6:12], "big") >> 15
        if not flags & 0x10:
            continue
        last, now = counters.get(pid), flags & 15
        if last is not None:
            if now == last:  # a repeated packet
                continue
            if now != last + 1 & 15 and not (flags & 0x20 and packet[4] and packet[5] & 0x80):
                out.continuity_errors += 1
        counters[pid] = now
        stream = out.streams.get(pid)
        if stream is not None:
            if clock is not None:
                stream.clock.append(clock)
            if start:
                close(pid)
                waiting[pid] = []
                if access:
                    stream.random_access.append(len(stream.data))
            if pid in waiting:
                waiting[pid].append(packet[at:])
        elif pid == PAT_PID or pid in tables:
            collect(pid, packet[at:], start)
    for pid in list(waiting):
        close(pid)
    out.damaged += sum(map(bool, sections.values()))
    return out


def features(program: Program) -> str:
    """Facts of the first stream: structure, times and the level of its samples."""
    if not program.streams:
        return f"packets={program.packets};streams=0;damaged={program.damaged}"
    s = next(iter(program.streams.values()))
    x = np.frombuffer(bytes(s.data), np.uint8)
    mean = f"{x.mean():.6f}" if len(x) else "nan"
    step = f"{np.abs(np.diff(x.astype(np.int16))).mean():.6f}" if len(x) > 1 else "nan"
    times = f"{s.pts[0][1]}-{s.pts[-1][1]}" if s.pts else "none"
    clock = f"{s.clock[0]}-{s.clock[-1]}" if s.clock else "none"
    return (
        f"packets={program.packets};streams={len(program.streams)};pid={s.pid};type={s.kind};pes={s.pes};pts={times};clock={clock};"
        f"random_access={len(s.random_access)};continuity_errors={program.continuity_errors};damaged={program.damaged};mean={mean};step={step}"
    )


#: Bytes of media in a record batch that goes from one process to another.
BATCH_BYTES = 8 << 20


def _batches(rows, schema):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, bytearray)))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): the text of each row as a transport stream. A null text is stored as an empty one; every row gives one row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            schema = pa.schema([pa.field("id", batch.schema.field(0).type), pa.field("media", pa.binary())])
            yield from _batches(((i, multiplex(padded(t), len(t or b""))) for i, t in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)))), schema)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def decode_media(frame: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Read a media column back: one row per row, with times and random-access points of its first stream.

    Columns: the id, payload (bytes of the stream), n_bytes (unpadded length that the program table
    states, else null), pts and pts_offset, random_access (offsets), continuity_errors, damaged,
    media_bytes, media_sha256, feature. Null or damaged media gives a row with an empty or partial payload.
    """
    kind = frame.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            schema = pa.schema([
                ("id", batch.schema.field(0).type), ("payload", pa.binary()), ("n_bytes", pa.int64()), ("pts", pa.list_(pa.int64())), ("pts_offset", pa.list_(pa.int64())),
                ("random_access", pa.list_(pa.int64())), ("continuity_errors", pa.int64()), ("damaged", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
            ])

            def rows():
                for i, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                    media = media.as_py() or b""
                    program = demultiplex(media)
                    s = next(iter(program.streams.values()), Stream(0))
                    yield (i, bytes(s.data), program.n_bytes, [t for _, t in s.pts], [o for o, _ in s.pts], s.random_access, program.continuity_errors, program.damaged, len(media), hashlib.sha256(media).hexdigest(), features(program))

            yield from _batches(rows(), schema)

    return frame.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(
        run, f"id {kind}, payload binary, n_bytes long, pts array<long>, pts_offset array<long>, random_access array<long>, continuity_errors long, damaged long, media_bytes long, media_sha256 string, feature string"
    ).withColumnRenamed("id", id_col)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as media, read the stored bytes back, and digest what was read.

    Every row gives one row; null and empty texts are 64 zero samples. Equal texts give equal values.
    """
    read = decode_media(encode_media(docs, id_col, text_col), id_col)
    return read.select(
        id_col, "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -FRAME, FRAME)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "pts", "pts_offset", "random_access", "continuity_errors",
    )
