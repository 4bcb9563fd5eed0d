"""ZIP packages as archives use them: members stored as they are, found through the central directory.

The reader takes any seekable file and reads the end, the directory (ZIP64 too)
and one local header a member, never the members.  The writer needs a stream
only: sizes and checksums follow each member.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

LOCAL, CENTRAL, DESCRIPTOR, END, END64, LOCATOR = (b"PK" + x for x in (b"\x03\x04", b"\x01\x02", b"\x07\x08", b"\x05\x06", b"\x06\x06", b"\x06\x07"))
#: Fields that say "look into the ZIP64 part".
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
PIECE = 1 << 20
END_BYTES = 22


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored_size: int
    header: int


def tail(f: BinaryIO, length: int) -> tuple[int, bytes]:
    """Where the end record lies, and its 22 bytes; comments that hold its signature do not mislead."""
    start = max(length - END_BYTES - FULL16, 0)
    f.seek(start)
    data = f.read(length - start)
    at = data.rfind(END)
    while at >= 0:
        if at + END_BYTES <= len(data) and at + END_BYTES + struct.unpack_from("<H", data, at + 20)[0] == len(data):
            return start + at, data[at : at + END_BYTES]
        at = data.rfind(END, 0, at)
    raise ValueError("no end of a ZIP directory")


def directory(f: BinaryIO, length: int) -> tuple[int, int, int, int]:
    """Where the directory begins, its bytes, its members, and by how much the offsets in it are shifted (bytes before the package)."""
    at, end = tail(f, length)
    disk, first_disk, here, members, size, offset = struct.unpack_from("<HHHHII", end, 4)
    finish = at
    if at >= 20 and (FULL16 in (disk, here, members) or FULL32 in (size, offset)):
        f.seek(at - 20)
        locator = f.read(20)
        if locator[:4] == LOCATOR:
            finish = struct.unpack_from("<Q", locator, 8)[0]
            finish, record = find_end64(f, finish, at - 20)
            disk, first_disk, here, members, size, offset = struct.unpack_from("<IIQQQQ", record, 16)
    if disk or first_disk or here != members:
        raise ValueError("a ZIP package over several disks")
    start = finish - size
    if start < 0:
        raise ValueError("a ZIP directory longer than its file")
    return start, size, members, start - offset


def find_end64(f: BinaryIO, said: int, locator: int) -> tuple[int, bytes]:
    """The ZIP64 end record, where the locator says or, with bytes before the package, right before the locator."""
    for at in (said, locator - 56):
        f.seek(max(at, 0))
        record = f.read(56)
        if len(record) == 56 and record[:4] == END64:
            return at, record
    raise ValueError("no ZIP64 end record")


def members(f: BinaryIO, length: int) -> Iterator[Member]:
    """All members, the directory read piece by piece."""
    at, size, count, shift = directory(f, length)
    end, held = at + size, b""
    for _ in range(count):
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            f.seek(at)
            more = f.read(min(PIECE, end - at))
            if not more:
                raise ValueError("a ZIP directory that ends too soon")
            held, at = held + more, at + len(more)
        if held[:4] != CENTRAL:
            raise ValueError("no member where the ZIP directory should have one")
        flags, method = struct.unpack_from("<HH", held, 8)
        stored, plain, name_length, extra_length, note, disk = struct.unpack_from("<IIHHHH", held, 20)
        header = struct.unpack_from("<I", held, 42)[0]
        name = held[46 : 46 + name_length]
        plain, stored, header = wide(held[46 + name_length : 46 + name_length + extra_length], plain, stored, header)
        held = held[46 + name_length + extra_length + note :]
        if flags & 1:
            raise ValueError("an encrypted member")
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, plain, stored, header + shift)


def wide(extra: bytes, *fields: int) -> list[int]:
    """Sizes and offset, from the ZIP64 extra field where a field is full; it holds only those, in this order."""
    out, at = list(fields), 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, place = extra[at + 4 : at + 4 + size], 0
            for i, field in enumerate(fields):
                if field == FULL32:
                    out[i] = struct.unpack_from("<Q", body, place)[0]
                    place += 8
        at += 4 + size
    return out


def content_start(f: BinaryIO, member: Member) -> int:
    """Where the member's bytes begin; the local header has name and extra lengths of its own."""
    f.seek(max(member.header, 0))
    head = f.read(30)
    if member.header < 0 or len(head) < 30 or head[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


class StoredWriter:
    """Members stored one after the other in a stream; ``full`` is the number from which fields go to the ZIP64 part."""

    def __init__(self, out: BinaryIO, full: int = FULL32):
        self.out, self.full, self.at, self.done = out, full, 0, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.header, self.crc, self.size = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)  # sizes are 8 bytes long and follow the member
        self.put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x808, 0, 0, 0x21, 0, FULL32, FULL32, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> None:
        self.put(data)
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)

    def end(self) -> None:
        self.put(DESCRIPTOR + struct.pack("<IQQ", self.crc, self.size, self.size))
        self.done.append((self.name, self.crc, self.size, self.header))

    def close(self) -> None:
        start = self.at
        for name, crc, size, header in self.done:
            wide_size, wide_header = size >= self.full, header >= self.full
            values = [size, size] * wide_size + [header] * wide_header
            extra = struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if values else b""
            sizes = FULL32 if wide_size else size
            self.put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x808, 0, 0, 0x21, crc, sizes, sizes, len(name), len(extra), 0, 0, 0, 0, FULL32 if wide_header else header) + name + extra)
        size, count = self.at - start, len(self.done)
        if max(start, size) >= self.full or count >= min(self.full, FULL16):
            end64 = self.at
            self.put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start))
            self.put(LOCATOR + struct.pack("<IQI", 0, end64, 1))
            count, size, start = FULL16, FULL32, FULL32
        self.put(END + struct.pack("<HHHHIIH", 0, 0, count, count, size, start, 0))
