"""MZ and PE executables: headers, sections, export tables and the resource tree, as rows.

Parsers yield raw rows; joins, interval look-ups and window logic over them are in operators.exports and operators.sections.
"""

from __future__ import annotations

from collections.abc import Iterator

from binweave.formats.reader import FormatError, View, utf8

MZ_SCHEMA = (
    "last_page_bytes int, pages int, relocation_count int, header_paragraphs int, min_alloc int, max_alloc int, initial_ss int, initial_sp int, "
    "checksum int, initial_ip int, initial_cs int, relocation_offset int, overlay int, new_header_offset bigint, relocations array<struct<offset:int,segment:int>>"
)


def mz_header(data: bytes) -> Iterator[tuple]:
    v = View(data)
    if v.take(0, 2) != b"MZ":
        raise FormatError("no MZ magic")
    f = v.unpack(2, "13H")
    count, at = f[2], f[11]
    rel = [v.unpack(at + 4 * i, "HH") for i in range(count)] if count else []
    new = v.u32(60) if len(v) >= 64 else None
    yield (*f, new, [{"offset": o, "segment": s} for o, s in rel])


def new_header(v: View) -> int:
    """Place of the PE or NE header; the file must be an MZ file of at least 64 bytes."""
    if v.take(0, 2) != b"MZ":
        raise FormatError("no MZ magic")
    return v.unpack(60, "I")[0]


class Pe:
    """Headers, data directories and sections of a PE file."""

    def __init__(self, data: bytes):
        v = self.view = View(data)
        at = new_header(v)
        if v.take(at, 4) != b"PE\0\0":
            raise FormatError("no PE magic")
        self.machine, count, self.stamp, self.symbols_at, self.symbol_count, size, self.characteristics = v.unpack(at + 4, "HHIIIHH")
        self.section_count = count
        self.optional_at, self.optional_size = at + 24, size
        self.directories: list[tuple[int, int]] = []
        self.optional: dict[str, int | None] = {}
        if size >= 24:
            self._optional(View(v.take(at + 24, size)))
        self.sections = [self._section(at + 24 + size + 40 * i) for i in range(count)]

    def _optional(self, o: View) -> None:
        names = ("magic", "linker_major", "linker_minor", "code_size", "initialized_size", "uninitialized_size", "entry_point", "code_base")
        self.optional = dict(zip(names, o.unpack(0, "HBBIIIII")))
        magic = self.optional["magic"]
        if magic not in (0x10B, 0x20B):
            return
        wide = magic == 0x20B
        self.optional["data_base"] = None if wide else o.u32(24)
        windows = ("image_base", "section_alignment", "file_alignment", "os_major", "os_minor", "image_major", "image_minor", "subsystem_major", "subsystem_minor", "reserved", "image_size", "headers_size", "checksum", "subsystem", "dll_characteristics", "stack_reserve", "stack_commit", "heap_reserve", "heap_commit", "loader_flags", "directory_count")
        layout = ("Q" if wide else "I") + "II6HIIIIHH" + ("4Q" if wide else "4I") + "II"
        fixed = 112 if wide else 96
        if len(o) < fixed:
            return
        self.optional.update(zip(windows, o.unpack(24 if wide else 28, layout)))
        n = min(self.optional["directory_count"], (len(o) - fixed) // 8)
        self.directories = [o.unpack(fixed + 8 * i, "II") for i in range(n)]

    def _section(self, at: int) -> tuple:
        name = self.view.take(at, 8)
        return (name, *self.view.unpack(at + 8, "IIIIIIHHI"))

    def place(self, rva: int) -> int | None:
        """File offset of an address: the first section, in table order, that holds it in its raw data."""
        for _, virtual, va, raw, at, *_ in self.sections:
            if va <= rva < va + max(virtual, raw if not virtual else 0):
                return at + rva - va if rva - va < raw else None
        return None

    def need(self, rva: int) -> int:
        if (at := self.place(rva)) is None:
            raise FormatError(f"address {rva:#x} is in no section")
        return at


#: The fields of the optional header that pe_header reports, in order.
OPTIONAL = ("magic", "linker_major", "linker_minor", "code_size", "initialized_size", "uninitialized_size", "entry_point", "code_base", "data_base", "image_base", "section_alignment", "file_alignment", "os_major", "os_minor", "image_major", "image_minor", "subsystem_major", "subsystem_minor", "image_size", "headers_size", "checksum", "subsystem", "dll_characteristics", "stack_reserve", "stack_commit", "heap_reserve", "heap_commit", "loader_flags", "directory_count")
PE_HEADER_SCHEMA = "machine int, section_count int, time_date_stamp bigint, symbols_offset bigint, symbol_count bigint, characteristics int, " + ", ".join(f"{n} decimal(20,0)" for n in OPTIONAL)
DIRECTORY_SCHEMA = "idx int, address bigint, size bigint"
SECTION_SCHEMA = "pos int, name binary, virtual_size bigint, virtual_address bigint, raw_size bigint, raw_ptr bigint, reloc_ptr bigint, line_ptr bigint, reloc_count int, line_count int, characteristics bigint"
EXPORT_ADDRESS_SCHEMA = "ordinal bigint, kind string, code_rva bigint, target string"
EXPORT_NAME_SCHEMA = "pos int, name string, ordinal bigint"
RESOURCE_SCHEMA = "res_path array<struct<id:bigint,name:string>>, data_rva bigint, size bigint, codepage bigint, reserved bigint, data binary"


def pe_header(data: bytes) -> Iterator[tuple]:
    from decimal import Decimal

    p = Pe(data)
    own = [None if p.optional.get(n) is None else Decimal(p.optional[n]) for n in OPTIONAL]
    yield (p.machine, p.section_count, p.stamp, p.symbols_at, p.symbol_count, p.characteristics, *own)


def pe_directories(data: bytes) -> Iterator[tuple]:
    yield from ((i, a, s) for i, (a, s) in enumerate(Pe(data).directories))


def pe_sections(data: bytes) -> Iterator[tuple]:
    yield from ((i, *s) for i, s in enumerate(Pe(data).sections))


def _export_directory(p: Pe) -> tuple[int, int, tuple] | None:
    """Address and size of the export directory and its fields; None where the slot is zero."""
    if not p.directories:
        raise FormatError("no export slot")
    address, size = p.directories[0]
    if not address:
        return None
    return address, size, p.view.unpack(p.need(address), "IIHHIIIIIII")


def pe_export_addresses(data: bytes) -> Iterator[tuple]:
    """Every slot of the address table that is in use: code, or a forwarder where it points into the directory itself."""
    p = Pe(data)
    if (d := _export_directory(p)) is None:
        return
    address, size, f = d
    base, count, table = f[5], f[6], f[8]
    if count * 4 > len(p.view):
        raise FormatError("more addresses than bytes")
    at = p.need(table) if count else 0
    for i in range(count):
        rva = p.view.u32(at + 4 * i)
        if not rva:
            continue
        if address <= rva < address + size:
            yield base + i, "forwarder", None, utf8(p.view.zstr(p.need(rva)))
        else:
            yield base + i, "code", rva, None


def pe_export_names(data: bytes) -> Iterator[tuple]:
    """Names and the ordinals at the same position."""
    p = Pe(data)
    if (d := _export_directory(p)) is None:
        return
    f = d[2]
    base, count, names, ordinals = f[5], f[7], f[9], f[10]
    if count * 4 > len(p.view):
        raise FormatError("more names than bytes")
    if not count:
        return
    at, by = p.need(names), p.need(ordinals)
    for i in range(count):
        yield i, utf8(p.view.zstr(p.need(p.view.u32(at + 4 * i)))), base + p.view.u16(by + 2 * i)


EXPORT_ROW_SCHEMA = "ordinal bigint, is_address boolean, name string"


def pe_export_rows(data: bytes) -> list[tuple]:
    """Both tables of a file in one pass, all or nothing: its addresses, and its names, where the last entry of a name holds."""
    last = {name: ordinal for _, name, ordinal in pe_export_names(data)}
    return [(o, True, None) for o, *_ in pe_export_addresses(data)] + [(o, False, n) for n, o in last.items()]


def pe_resources(data: bytes, max_depth: int = 16) -> Iterator[tuple]:
    """The leaves of the resource tree with their path of ids and names. Repeated keys and cycles are errors."""
    p = Pe(data)
    if len(p.directories) < 3 or not p.directories[2][0]:
        return
    root = p.need(p.directories[2][0])
    v = p.view

    def walk(at: int, path: list[dict], above: frozenset[int]) -> Iterator[tuple]:
        if at in above or len(path) > max_depth:
            raise FormatError("cycle in the resource tree")
        named, numbered = v.unpack(at + 12, "HH")
        seen = set()
        for i in range(named + numbered):
            key, to = v.unpack(at + 16 + 8 * i, "II")
            if i < named and not key >> 31:
                raise FormatError("named resource without a name")
            own = {"id": None, "name": v.utf16_pascal(root + (key & 0x7FFFFFFF))} if key >> 31 else {"id": key, "name": None}
            if (k := (own["id"], own["name"])) in seen:
                raise FormatError("repeated resource key")
            seen.add(k)
            if to >> 31:
                yield from walk(root + (to & 0x7FFFFFFF), [*path, own], above | {at})
            else:
                rva, size, codepage, reserved = v.unpack(root + to, "IIII")
                place = p.place(rva)
                held = v.data[place : place + size] if place is not None and place + size <= len(v) else None
                yield [*path, own], rva, size, codepage, reserved, held

    yield from walk(root, [], frozenset())
