"""Zip archives as streams of members: written in pieces, and read along their directory, without a list of all members."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from tempfile import SpooledTemporaryFile

#: Bytes of an archive that are given out at once, and bytes of a directory that stay in memory.
PIECE, HELD = 1_000_000, 8_000_000
#: A new member's time in DOS form, 20 s past midnight: its first byte is a line break, where pieces may be cut.
_TIME, _DATE = 0x000A, 0x0021
_BIG, _UTF8 = 0xFFFFFFFF, 0x800


def packed(members: Iterable[tuple[str, str | None]]) -> Iterator[bytes]:
    """An archive of (name, text) as lines: with a line break after each piece, the last one too, they are the file.

    The last line break is the archive's comment.  A null text is empty.
    """
    out, at, count = bytearray(), 0, 0
    with SpooledTemporaryFile(max_size=HELD) as directory:
        for name, text in members:
            key, data = name.encode(), (text or "").encode()
            body = zlib.compress(data, wbits=-15)
            about = struct.pack("<5H3I2H", 20, _UTF8, 8, _TIME, _DATE, zlib.crc32(data), len(body), len(data), len(key), 0)
            far = struct.pack("<2HQ", 1, 8, at) if at >= _BIG else b""
            directory.write(b"PK\1\2" + struct.pack("<H", 3 << 8 | 45) + about[:-2] + struct.pack("<4H2I", len(far), 0, 0, 0, 0o600 << 16, min(at, _BIG)) + key + far)
            out += b"PK\3\4" + about + key + body
            at += 4 + len(about) + len(key) + len(body)
            count += 1
            yield from _cut(out)
        size = directory.tell()
        directory.seek(0)
        while block := directory.read(PIECE):
            out += block
            yield from _cut(out)
    if count >= 0xFFFF or max(size, at) >= _BIG:
        out += b"PK\6\6" + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, count, count, size, at) + b"PK\6\7" + struct.pack("<IQI", 0, at + size, 1)
    out += b"PK\5\6" + struct.pack("<4H2IH", 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, _BIG), min(at, _BIG), 1)
    yield bytes(out)


def _cut(out: bytearray) -> Iterator[bytes]:
    if len(out) >= PIECE and (end := out.rfind(b"\n")) >= 0:
        yield bytes(out[:end])
        del out[: end + 1]


def unpacked(content) -> Iterator[tuple[str, str]]:
    """Name and text of every member of an archive (a buffer), in the order of its directory."""
    view = memoryview(content)
    end = _end(view)
    count, size, start = struct.unpack_from("<H2I", view, end + 10)
    if end >= 20 and bytes(view[end - 20 : end - 16]) == b"PK\6\7":
        end -= 76
        if bytes(view[end : end + 4]) != b"PK\6\6":
            end = struct.unpack_from("<Q", view, end + 64)[0]
        count, size, start = struct.unpack_from("<3Q", view, end + 32)
    before = end - size - start  # bytes that were put before the archive
    at, whole = start + before, None
    for _ in range(count):
        if bytes(view[at : at + 4]) != b"PK\1\2":
            raise zipfile.BadZipFile("bad directory")
        flags, method, _, _, crc, packed_size, full, n, extra, comment = struct.unpack_from("<4H3I3H", view, at + 8)
        place = struct.unpack_from("<I", view, at + 42)[0]
        name = bytes(view[at + 46 : at + 46 + n]).decode("utf-8" if flags & _UTF8 else "cp437")
        full, packed_size, place = _wide(view[at + 46 + n : at + 46 + n + extra], [full, packed_size, place])
        at += 46 + n + extra + comment
        if method in (0, 8) and not flags & 1:
            local = place + before
            low = local + 30 + sum(struct.unpack_from("<2H", view, local + 26))
            body = view[low : low + packed_size]
            data = zlib.decompress(body, wbits=-15) if method else bytes(body)
            if zlib.crc32(data) != crc:
                raise zipfile.BadZipFile(f"bad CRC-32 of {name}")
        else:  # other ways of packing
            if whole is None:
                whole = zipfile.ZipFile(io.BytesIO(view))
                infos = {i.header_offset: i for i in whole.infolist()}
            data = whole.read(infos[place + before])
        yield name, data.decode()


def _end(view: memoryview) -> int:
    """Place of the last record of an archive; a comment may follow it."""
    tail = bytes(view[-65557:])
    at = tail.rfind(b"PK\5\6")
    if at < 0 or at + 22 > len(tail):
        raise zipfile.BadZipFile("no end record")
    return len(view) - len(tail) + at


def _wide(extra: memoryview, numbers: list[int]) -> list[int]:
    """Size, packed size and place, from the 64-bit field where they don't fit."""
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<2H", extra)
        if kind == 1:
            rest = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
            return [next(rest) if x == _BIG else x for x in numbers]
        extra = extra[4 + n :]
    return numbers
