"""ZIP packages with stored members: writing, and locating members by range reads.

``directory`` reads the end record (and its ZIP64 form), then the central
directory, with three small range reads; members are located without reading or
extracting anything else.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
# Signatures and record layouts of the ZIP format
LOCAL_HEADER, CENTRAL_HEADER, END_RECORD = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
ZIP64_END, ZIP64_LOCATOR = b"PK\x06\x06", b"PK\x06\x07"
LOCAL_LAYOUT, CENTRAL_LAYOUT, END_LAYOUT = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"
ZIP64_END_LAYOUT, ZIP64_LOCATOR_LAYOUT = "<4sQ2H2I4Q", "<4sIQI"
STORED, UTF8_NAMES, VERSION_ZIP64 = 0, 0x800, 45
#: 1980-01-01, so that equal contents give equal packages
DOS_DATE = 0x21


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    crc: int
    header_offset: int


def package(members: list[tuple[str, list[bytes]]]) -> bytes:
    """A ZIP package of stored members, with ZIP64 sizes and end records throughout."""
    out: list[bytes] = []
    central: list[bytes] = []
    at = 0
    for name, chunks in members:
        raw, size, crc = name.encode(), sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        extra = struct.pack("<HHQQ", 1, 16, size, size)
        head = struct.pack(LOCAL_LAYOUT, LOCAL_HEADER, VERSION_ZIP64, UTF8_NAMES, STORED, 0, DOS_DATE, crc, MAX32, MAX32, len(raw), len(extra)) + raw + extra
        wide = struct.pack("<HHQQQ", 1, 24, size, size, at)
        central.append(
            struct.pack(CENTRAL_LAYOUT, CENTRAL_HEADER, VERSION_ZIP64, VERSION_ZIP64, UTF8_NAMES, STORED, 0, DOS_DATE, crc, MAX32, MAX32, len(raw), len(wide), 0, 0, 0, 0, MAX32)
            + raw + wide
        )
        out += [head, *chunks]
        at += len(head) + size
    listing = b"".join(central)
    n = len(central)
    end64 = struct.pack(ZIP64_END_LAYOUT, ZIP64_END, 44, VERSION_ZIP64, VERSION_ZIP64, 0, 0, n, n, len(listing), at)
    locator = struct.pack(ZIP64_LOCATOR_LAYOUT, ZIP64_LOCATOR, 0, at + len(listing), 1)
    end = struct.pack(END_LAYOUT, END_RECORD, 0, 0, MAX16, MAX16, MAX32, MAX32, 0)
    return b"".join([*out, listing, end64, locator, end])


def directory(file, size: int) -> list[Member]:
    """Members of the package in ``file`` (an object with ``read_at(nbytes, offset)``)."""
    tail_at = max(0, size - (struct.calcsize(END_LAYOUT) + MAX16 + struct.calcsize(ZIP64_LOCATOR_LAYOUT)))
    tail = file.read_at(size - tail_at, tail_at)
    i = tail.rfind(END_RECORD)
    if i < 0:
        raise ValueError("no end record: not a ZIP package")
    _, _, _, _, count, length, start, _ = struct.unpack_from(END_LAYOUT, tail, i)
    if MAX16 == count or MAX32 in (length, start):
        j = i - struct.calcsize(ZIP64_LOCATOR_LAYOUT)
        if j >= 0 and tail[j : j + 4] == ZIP64_LOCATOR:
            end64_at = struct.unpack_from(ZIP64_LOCATOR_LAYOUT, tail, j)[2]
            record = file.read_at(struct.calcsize(ZIP64_END_LAYOUT), end64_at)
            if record[:4] != ZIP64_END:
                raise ValueError("the ZIP64 locator points at no ZIP64 end record")
            *_, count, length, start = struct.unpack(ZIP64_END_LAYOUT, record)
    listing = file.read_at(length, start)
    found, at, head = [], 0, struct.calcsize(CENTRAL_LAYOUT)
    for _ in range(count):
        (sig, _, _, _, method, _, _, crc, packed, plain, n, m, k, _, _, _, offset) = struct.unpack_from(CENTRAL_LAYOUT, listing, at)
        if sig != CENTRAL_HEADER:
            raise ValueError("damaged central directory")
        name = listing[at + head : at + head + n].decode()
        extra = listing[at + head + n : at + head + n + m]
        e = 0
        while e + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: the fields that are at their maximum, in this order
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                plain = wide.pop(0) if plain == MAX32 else plain
                packed = wide.pop(0) if packed == MAX32 else packed
                offset = wide.pop(0) if offset == MAX32 else offset
            e += 4 + length
        found.append(Member(name, method, packed if method == STORED else plain, crc, offset))
        at += head + n + m + k
    return found


def data_offset(file, member: Member) -> int:
    """Where the bytes of a member begin (its local header has lengths of its own)."""
    head = file.read_at(struct.calcsize(LOCAL_LAYOUT), member.header_offset)
    if head[:4] != LOCAL_HEADER:
        raise ValueError(f"no local header for {member.name}")
    *_, n, m = struct.unpack(LOCAL_LAYOUT, head)
    return member.header_offset + len(head) + n + m
