"""Managed resources of PE files: the runtime header, wrapped containers, and their entries as rows."""

from __future__ import annotations

from collections.abc import Iterator

from binweave.formats.pe import Pe
from binweave.formats.reader import FormatError, View

CLR_HEADER_SCHEMA = "size bigint, major int, minor int, flags bigint, entry_point bigint, pos int, range_name string, address bigint, length bigint"
CLR_RESOURCE_SCHEMA = "container_idx int, pos int, name string, name_hash bigint, offset bigint, type_code int, type_name string, data binary"

#: The address ranges of the header in their order, and the type codes of entries.
RANGES = ("metadata", "resources", "strong_name", "code_manager", "vtable_fixups", "export_jumps", "native_header")
TYPES = {0: "Null", 1: "String", 2: "Boolean", 3: "Char", 4: "Byte", 5: "SByte", 6: "Int16", 7: "UInt16", 8: "Int32", 9: "UInt32", 10: "Int64", 11: "UInt64", 12: "Single", 13: "Double", 14: "Decimal", 15: "DateTime", 16: "TimeSpan", 32: "ByteArray", 33: "Stream"}
MAGIC = 0xBEEFCACE


def varint(v: View, at: int) -> tuple[int, int]:
    """Seven bits per byte, low bits first, at most five bytes; a last byte of zero after others is not the shortest form."""
    value = 0
    for i in range(5):
        b = v.u8(at + i)
        value |= (b & 0x7F) << 7 * i
        if not b & 0x80:
            if i and not b:
                raise FormatError("number is not in its shortest form")
            return value, at + i + 1
    raise FormatError("number of over five bytes")


def prefixed(v: View, at: int) -> tuple[bytes, int]:
    size, at = varint(v, at)
    return v.take(at, size), at + size


def _header(p: Pe) -> tuple[int, View]:
    if len(p.directories) < 15 or not p.directories[14][0]:
        raise FormatError("no managed header")
    address, size = p.directories[14]
    return size, View(p.view.take(p.need(address), min(size, 72)))


def clr_header(data: bytes) -> Iterator[tuple]:
    p = Pe(data)
    _, h = _header(p)
    size, major, minor = h.unpack(0, "IHH")
    flags, entry = h.unpack(16, "II")
    places = [8, 24, 32, 40, 48, 56, 64]
    for i, (name, at) in enumerate(zip(RANGES, places)):
        yield size, major, minor, flags, entry, i, name, *h.unpack(at, "II")


def containers(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Wrapped containers, each after its length and padded to four bytes; empty ones are skipped but counted."""
    p = Pe(data)
    _, h = _header(p)
    address, size = h.unpack(24, "II")
    if not address:
        return
    v, at, k = View(p.view.take(p.need(address), size)), 0, 0
    while at + 4 <= len(v):
        n = v.u32(at)
        if n:
            yield k, v.take(at + 4, n)
        at += 4 + -(-n // 4) * 4
        k += 1


def entries(raw: bytes) -> Iterator[tuple]:
    """(pos, name, hash, offset, type code, type name, data) of one container; the length of an entry ends at the next offset."""
    v = View(raw)
    magic, version, skip = v.unpack(0, "III")
    if magic != MAGIC:
        raise FormatError("no resource container magic")
    at = 12 + skip
    version, count, kinds = v.unpack(at, "III")
    at += 12
    if count > len(v) or kinds > len(v):
        raise FormatError("more entries than bytes")
    custom = []
    for _ in range(kinds):
        name, at = prefixed(v, at)
        custom.append(name.decode("utf-8", "replace"))
    at = -(-at // 8) * 8
    hashes, at = v.unpack(at, f"{count}I"), at + 4 * count
    places, at = v.unpack(at, f"{count}I"), at + 4 * count
    start, base = v.u32(at), at + 4
    rows = []
    for k in range(count):
        name, after = prefixed(v, base + places[k])
        try:
            text = name.decode("utf-16-le")
        except UnicodeDecodeError:
            raise FormatError("name is not valid UTF-16") from None
        rows.append([k, text, hashes[k], v.u32(after)])
    order = sorted({r[3] for r in rows})
    end = dict(zip(order, [*order[1:], len(v) - start]))
    for k, text, own, offset in rows:
        code, after = varint(v, start + offset)
        if code in TYPES:
            kind = TYPES[code]
        elif code >= 64:
            kind = custom[code - 64] if code - 64 < len(custom) else f"custom {code - 64}"
        else:
            raise FormatError(f"unknown type code {code}")
        yield k, text, own, offset, code, kind, v.take(after, start + end[offset] - after)


def clr_resources(data: bytes) -> Iterator[tuple]:
    for k, raw in containers(data):
        for row in entries(raw):
            yield (k, *row)
