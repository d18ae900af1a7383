"""The container of binary logs: headers, record walks, carving, repair and writing, over bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

# ---- Fixed values ----
FILE_MAGIC, CHUNK_MAGIC, RECORD_MAGIC = b"ElfFile\x00", b"ElfChnk\x00", b"\x2a\x2a\x00\x00"
HEADER_BLOCK, CHUNK, RECORDS_AT = 4096, 65536, 512
LEAST_RECORD, MOST_RECORD = 28, 65536
# ---- End of fixed values ----


@dataclass(frozen=True)
class FileHeader:
    first_chunk: int
    last_chunk: int
    next_record_id: int
    minor: int
    major: int
    chunk_count: int
    flags: int
    checksum: int
    computed: int

    @classmethod
    def parse(cls, b: bytes) -> "FileHeader | None":
        if len(b) < 128 or b[:8] != FILE_MAGIC:
            return None
        first, last, following = struct.unpack_from("<QQQ", b, 8)
        minor, major = struct.unpack_from("<HH", b, 0x24)
        flags, checksum = struct.unpack_from("<II", b, 0x78)
        return cls(first, last, following, minor, major, struct.unpack_from("<H", b, 0x2A)[0], flags, checksum, zlib.crc32(b[:0x78]))


@dataclass(frozen=True)
class ChunkHeader:
    first_number: int
    last_number: int
    first_id: int
    last_id: int
    last_data: int
    free_at: int
    records_checksum: int
    guid: bytes
    checksum: int
    computed: int

    @classmethod
    def parse(cls, b: bytes) -> "ChunkHeader | None":
        if len(b) < 0x7C or b[:8] != CHUNK_MAGIC:
            return None
        numbers = struct.unpack_from("<QQQQ", b, 8)
        last_data, free_at, records = struct.unpack_from("<III", b, 0x2C)
        if last_data > CHUNK or free_at > CHUNK:
            return None
        return cls(*numbers, last_data, free_at, records, b[96:112], struct.unpack_from("<I", b, 0x78)[0], zlib.crc32(b[:0x78]))

    def records_ok(self, chunk: bytes) -> bool:
        """True too where the extent of the records isn't plausible, so nothing can be said."""
        return not RECORDS_AT <= self.free_at <= CHUNK or zlib.crc32(chunk[RECORDS_AT : self.free_at]) == self.records_checksum


@dataclass(frozen=True)
class Record:
    """offset is within the buffer walked; how: live, carved, size_mismatch or free."""

    offset: int
    size: int
    record_id: int
    filetime: int
    payload: bytes
    how: str


def plausible_payload(p: bytes) -> bool:
    """Whether bytes may be a binary XML fragment: its header, and no long run of zeros at the start."""
    return len(p) >= 4 and p[0] == 0x0F and p[1] == 0x01 and b"\x00" * 16 not in p[:32]


def _record(b: bytes, at: int, how: str) -> Record | None:
    if b[at : at + 4] != RECORD_MAGIC or at + 24 > len(b):
        return None
    size, record_id, filetime = struct.unpack_from("<IQQ", b, at + 4)
    if not LEAST_RECORD <= size <= MOST_RECORD or at + size > len(b):
        return None
    return Record(at, size, record_id, filetime, b[at + 24 : at + size - 4], how)


def _copy_ok(b: bytes, r: Record) -> bool:
    return struct.unpack_from("<I", b, r.offset + r.size - 4)[0] == r.size


def walk(chunk: bytes, start: int = RECORDS_AT, end: int | None = None) -> Iterator[Record]:
    """Records one after the other; 8 bytes on where there is none. A wrong copy of the size is reported."""
    end, at = len(chunk) if end is None else end, start
    while at + 24 <= end:
        r = _record(chunk[:end], at, "live")
        if r is None:
            nxt = chunk.find(RECORD_MAGIC, at + 1, end)
            # Records are aligned to 8 bytes from the start.
            at = end if nxt < 0 else at + max(8, (nxt - at) // 8 * 8)
            continue
        yield r if _copy_ok(chunk, r) else Record(r.offset, r.size, r.record_id, r.filetime, r.payload, "size_mismatch")
        at += r.size


def walk_hard(chunk: bytes, start: int = RECORDS_AT) -> Iterator[Record]:
    """Records of a damaged chunk at any multiple of 4, if both sizes agree and the payload is plausible."""
    at = start
    while (at := chunk.find(RECORD_MAGIC, at)) >= 0:
        r = _record(chunk, at, "carved") if (at - start) % 4 == 0 else None
        if r is not None and _copy_ok(chunk, r) and plausible_payload(r.payload):
            yield r
            at += r.size
        else:
            at += 1


def walk_free(chunk: bytes, free_at: int) -> Iterator[Record]:
    """Records left in the unused end of a chunk, at any byte; probable where the sizes disagree."""
    at = free_at
    while (at := chunk.find(RECORD_MAGIC, at)) >= 0:
        r = _record(chunk, at, "free")
        if r is None:
            at += 1
            continue
        yield r if _copy_ok(chunk, r) and plausible_payload(r.payload) else Record(r.offset, r.size, r.record_id, r.filetime, r.payload, "free_probable")
        at += r.size


def records_of(chunk: bytes, free: bool = False) -> tuple[ChunkHeader | None, str, list[Record]]:
    """Header, state (valid, header_corrupt, truncated) and records of what stands at a chunk's magic."""
    header = ChunkHeader.parse(chunk)
    if len(chunk) < CHUNK:
        return header, "truncated", list(walk(chunk))
    if header is None or header.checksum != header.computed:
        return header, "header_corrupt", list(walk_hard(chunk))
    found = list(walk(chunk))
    if free:
        live_end = max([r.offset + r.size for r in found if r.offset < header.free_at], default=RECORDS_AT)
        found = [r for r in found if r.offset < header.free_at] + list(walk_free(chunk, max(live_end, header.free_at)))
    return header, "valid", found


def find_chunks(blob: bytes) -> Iterator[int]:
    """Offsets, multiples of 8, at which a chunk's magic stands; after a whole chunk the search goes on behind it."""
    at = 0
    while (at := blob.find(CHUNK_MAGIC, at)) >= 0:
        if at % 8:
            at += 1
            continue
        yield at
        at += CHUNK if at + CHUNK <= len(blob) else 8


def nested_record(chunk: bytes, r: Record) -> int | None:
    """Where, inside a record's body, another record begins: the mark of a record that was cut out."""
    at = chunk.find(RECORD_MAGIC, r.offset + 24, r.offset + r.size - 4)
    while at >= 0:
        if at + 8 <= len(chunk) and LEAST_RECORD <= struct.unpack_from("<I", chunk, at + 4)[0] <= MOST_RECORD:
            return at
        at = chunk.find(RECORD_MAGIC, at + 1, r.offset + r.size - 4)
    return None


def scan_memory(buffer: bytes, at: int = 0) -> Iterator[Record]:
    """Records at any byte of a memory image; how tells whether binary XML follows."""
    while (at := buffer.find(RECORD_MAGIC, at)) >= 0:
        r = _record(buffer, at, "memory")
        if r is None:
            at += 1
            continue
        yield Record(r.offset, r.size, r.record_id, r.filetime, r.payload, "memory" if r.payload[:1] == b"\x0f" else "memory_unsure")
        at += r.size


def record_bytes(record_id: int, filetime: int, payload: bytes) -> bytes:
    size = 28 + len(payload)
    return RECORD_MAGIC + struct.pack("<IQQ", size, record_id, filetime) + payload + struct.pack("<I", size)


def pack_chunks(records: Iterable[tuple[int, int, bytes]]) -> Iterator[list[bytes]]:
    """Records put one after the other into chunks, in order."""
    chunk, used = [], 0
    for record_id, filetime, payload in records:
        raw = record_bytes(record_id, filetime, payload)
        if len(raw) > CHUNK - RECORDS_AT:
            raise ValueError(f"record {record_id} doesn't fit into a chunk")
        if used + len(raw) > CHUNK - RECORDS_AT:
            yield chunk
            chunk, used = [], 0
        chunk.append(raw)
        used += len(raw)
    if chunk:
        yield chunk


def chunk_bytes(records: list[bytes], first_number: int, guid: bytes = b"\x00" * 16) -> bytes:
    body = b"".join(records)
    ids = [struct.unpack_from("<Q", r, 8)[0] for r in records]
    free_at = RECORDS_AT + len(body)
    head = bytearray(RECORDS_AT)
    head[:8] = CHUNK_MAGIC
    struct.pack_into("<QQQQIIII", head, 8, first_number, first_number + len(records) - 1, ids[0], ids[-1], 128, free_at - len(records[-1]), free_at, zlib.crc32(body))
    head[96:112] = guid
    struct.pack_into("<I", head, 0x78, zlib.crc32(bytes(head[:0x78])))
    return (bytes(head) + body).ljust(CHUNK, b"\x00")


def file_header(chunks: int, next_record_id: int, flags: int = 0) -> bytes:
    head = bytearray(HEADER_BLOCK)
    head[:8] = FILE_MAGIC
    struct.pack_into("<QQQIHHHH", head, 8, 0, max(0, chunks - 1), next_record_id, 128, 1, 3, HEADER_BLOCK, chunks)
    struct.pack_into("<I", head, 0x78, flags)
    struct.pack_into("<I", head, 0x7C, zlib.crc32(bytes(head[:0x78])))
    return bytes(head)


def write_log(records: Iterable[tuple[int, int, bytes]], guid: bytes = b"\x00" * 16) -> bytes:
    """A whole log of (record id, FILETIME, payload); record numbers run on from chunk to chunk."""
    chunks, number, top = [], 1, 0
    for packed in pack_chunks(records):
        chunks.append(chunk_bytes(packed, number, guid))
        number += len(packed)
        top = max(top, *(struct.unpack_from("<Q", r, 8)[0] for r in packed))
    return file_header(len(chunks), top + 1) + b"".join(chunks)


def repair(log: bytes) -> tuple[bytes, int, int, bool]:
    """The log with right checksums: bytes, chunks looked at, chunks and header mended. Contents stay."""
    out, looked, mended, header = bytearray(log), 0, 0, False
    if out[:8] == FILE_MAGIC and len(out) >= 128:
        right = struct.pack("<I", zlib.crc32(bytes(out[:0x78])))
        header, out[0x7C:0x80] = out[0x7C:0x80] != right, right
    for at in range(HEADER_BLOCK, len(out) - CHUNK + 1, CHUNK):
        if out[at : at + 8] != CHUNK_MAGIC:
            continue
        looked += 1
        before = bytes(out[at : at + 128])
        free_at = struct.unpack_from("<I", out, at + 0x30)[0]
        if RECORDS_AT <= free_at <= CHUNK:
            struct.pack_into("<I", out, at + 0x34, zlib.crc32(bytes(out[at + RECORDS_AT : at + free_at])))
        struct.pack_into("<I", out, at + 0x78, zlib.crc32(bytes(out[at : at + 0x78])))
        mended += before != bytes(out[at : at + 128])
    return bytes(out), looked, mended, header


def ntfs_partition(mbr: bytes) -> int | None:
    """First sector of the first NTFS-like partition in a master boot record."""
    if len(mbr) < 512 or mbr[510:512] != b"\x55\xaa":
        return None
    for i in range(4):
        entry = mbr[446 + 16 * i : 462 + 16 * i]
        if entry[4] in (0x07, 0x17, 0x27):
            return struct.unpack_from("<I", entry, 8)[0]
    return None
