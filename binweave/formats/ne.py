"""NE executables: header, entry bundles, name tables, segments with relocations, and resources, as rows."""

from __future__ import annotations

from collections.abc import Iterator

from binweave.formats.pe import new_header
from binweave.formats.reader import FormatError, View

NE_HEADER_SCHEMA = (
    "linker_major int, linker_minor int, crc bigint, flags int, auto_data_segment int, heap_size int, stack_size int, initial_ip int, initial_cs int, "
    "initial_sp int, initial_ss int, segment_count int, module_count int, shift int, resource_count int, target_os int, other_flags int, expected_version int"
)
ENTRY_SCHEMA = "bundle_idx int, entry_idx int, kind string, flags int, segment int, offset int, bundle_size int"
NAME_SCHEMA = "table_kind string, pos int, name binary, ordinal int"
SEGMENT_SCHEMA = "segment_idx int, file_offset bigint, length int, flags int, min_alloc int"
RELOCATION_SCHEMA = "segment_idx int, source_type int, flags int, chain_offset int, target_kind string, target_segment int, target_offset int, module_index int, import_ordinal int, name_offset int, fixup_type int"
NE_RESOURCE_SCHEMA = "type_num int, type_name binary, res_num int, res_name binary, offset_units int, length_units int, flags int, data binary"


class Ne:
    """Fields of the NE header; the tables are read on demand, so names cost no segment or resource bytes."""

    def __init__(self, data: bytes):
        v = self.view = View(data)
        at = self.at = new_header(v)
        if v.take(at, 2) != b"NE":
            raise FormatError("no NE magic")
        (self.linker_major, self.linker_minor, self.entry_at, self.entry_size, self.crc, self.flags, self.data_segment, self.heap, self.stack, self.ip, self.cs, self.sp, self.ss, self.segment_count, self.module_count, self.nonresident_size, self.segments_at, self.resources_at, self.resident_at, self.modules_at, self.imports_at, self.nonresident_at, self.movable, self.shift, self.resource_count, self.os, self.other) = v.unpack(at + 2, "BBHHIHHHHHHHHHHHHHHHHIHHHBB")
        self.version = v.u16(at + 62)


def ne_header(data: bytes) -> Iterator[tuple]:
    n = Ne(data)
    yield n.linker_major, n.linker_minor, n.crc, n.flags, n.data_segment, n.heap, n.stack, n.ip, n.cs, n.sp, n.ss, n.segment_count, n.module_count, n.shift, n.resource_count, n.os, n.other, n.version


def ne_entries(data: bytes) -> Iterator[tuple]:
    """Entries of every bundle; an unused bundle is one row of kind 'unused' with its size, so that ordinals can be counted."""
    n = Ne(data)
    at, end, bundle = n.at + n.entry_at, n.at + n.entry_at + n.entry_size, 0
    while at < end:
        size, segment = n.view.unpack(at, "BB") if n.view.u8(at) else (0, 0)
        if not size:
            return
        at += 2
        if not segment:
            yield bundle, 0, "unused", None, None, None, size
        for i in range(size if segment else 0):
            if segment == 0xFF:
                flags, _, own, offset = n.view.unpack(at, "BHBH")
                yield bundle, i, "moveable", flags, own, offset, size
                at += 6
            else:
                flags, offset = n.view.unpack(at, "BH")
                yield bundle, i, "fixed", flags, segment, offset, size
                at += 3
        bundle += 1


def ne_names(data: bytes) -> Iterator[tuple]:
    """Resident, then non-resident names; the non-resident table is also bounded by its size in the header."""
    n = Ne(data)

    def names(kind: str, at: int, end: int) -> Iterator[tuple]:
        pos = 0
        while at < end and n.view.u8(at):
            name = n.view.pascal(at)
            yield kind, pos, name, n.view.u16(at + 1 + len(name))
            at += 3 + len(name)
            pos += 1

    yield from names("resident", n.at + n.resident_at, len(n.view))
    if n.nonresident_size:
        yield from names("nonresident", n.nonresident_at, min(len(n.view), n.nonresident_at + n.nonresident_size))


EXPORT_ROW_SCHEMA = "bundle_idx int, entry_idx int, step int, flags int, ordinal bigint, rank int, name binary"


def ne_export_rows(data: bytes) -> list[tuple]:
    """Entries and names of a file in one pass, all or nothing: entries advance the ordinal by their step; names have their
    ordinal and a rank that grows through both tables."""
    rows = [(b, e, size if kind == "unused" else 1, flags or 0, None, None, None) for b, e, kind, flags, _, _, size in ne_entries(data)]
    return rows + [(None, None, 0, 0, ordinal, i, name) for i, (_, _, name, ordinal) in enumerate(ne_names(data))]


def _segments(n: Ne) -> list[tuple[int, int, int, int]]:
    rows = [n.view.unpack(n.at + n.segments_at + 8 * i, "HHHH") for i in range(n.segment_count)]
    return [(sector << n.shift, length or (0x10000 if sector else 0), flags, alloc or 0x10000) for sector, length, flags, alloc in rows]


def ne_segments(data: bytes) -> Iterator[tuple]:
    yield from ((i + 1, *s) for i, s in enumerate(_segments(Ne(data))))


def ne_relocations(data: bytes) -> Iterator[tuple]:
    n = Ne(data)
    for i, (at, length, flags, _) in enumerate(_segments(n)):
        if not flags & 0x0100 or not at:
            continue
        for k in range(n.view.u16(at + length)):
            source, kind, chain, a, b = n.view.unpack(at + length + 2 + 8 * k, "BBHHH")
            row = [i + 1, source & 0x0F, kind & ~3, chain, None, None, None, None, None, None, None]
            target = kind & 3
            if target == 0:
                row[4:7] = ["internal_moveable", None, b] if a & 0xFF == 0xFF else ["internal_fixed", a & 0xFF, b]
            elif target == 1:
                row[4], row[7], row[8] = "import_ordinal", a, b
            elif target == 2:
                row[4], row[7], row[9] = "import_name", a, b
            else:
                row[4], row[10] = "os_fixup", a
            yield tuple(row)


def ne_import_modules(data: bytes) -> Iterator[tuple]:
    """(kind, idx, offset, name): module references (1-based index to a name offset), and the imported names by offset."""
    n = Ne(data)
    base = n.at + n.imports_at
    for i in range(n.module_count):
        yield "module", i + 1, n.view.u16(n.at + n.modules_at + 2 * i), None
    at, end = base, n.at + n.entry_at
    while at < end:
        name = n.view.pascal(at)
        yield "name", None, at - base, name
        at += 1 + len(name)


def ne_resources(data: bytes) -> Iterator[tuple]:
    n = Ne(data)
    if n.resources_at == n.resident_at:
        return
    base = n.at + n.resources_at
    shift, at = n.view.u16(base), base + 2
    if shift > 16:
        raise FormatError("resource shift over 16")

    def key(value: int) -> tuple[int | None, bytes | None]:
        return (value, None) if value & 0x8000 else (None, n.view.pascal(base + value))

    while kind := n.view.u16(at):
        count = n.view.u16(at + 2)
        at += 8
        for _ in range(count):
            offset, length, flags, name = n.view.unpack(at, "HHHH")
            start, size = offset << shift, length << shift
            yield *key(kind), *key(name), offset, length, flags, n.view.data[start : start + size] if start + size <= len(n.view) else None
            at += 12
