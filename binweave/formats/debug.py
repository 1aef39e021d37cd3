"""Separate debug files and the CodeView tables in them, as rows.

Symbols and types of many kinds share one table each: common fields are columns, the rest is JSON text that parse_json turns
into a VARIANT. Layouts are data (names and struct codes), read by one loop.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from binweave.formats.reader import FormatError, View

DBG_HEADER_SCHEMA = "flags int, machine int, characteristics int, time_date_stamp bigint, checksum bigint, image_base bigint, image_size bigint, section_count bigint, exported_names_size bigint, debug_directory_size bigint, section_alignment bigint, exported_names array<string>"
DBG_DIRECTORY_SCHEMA = "pos int, characteristics bigint, time_date_stamp bigint, major int, minor int, kind bigint, size bigint, va bigint, raw_ptr bigint"
SUBSECTION_SCHEMA = "pos int, type int, type_name string, module_index int, offset bigint, size bigint, data binary"
SYMBOL_SCHEMA = "pos int, kind_code int, kind string, segment int, offset bigint, value_type int, name string, payload string"
TYPE_SCHEMA = "type_index int, leaf_code int, leaf string, payload string"
LINE_SCHEMA = "file_name string, segment_index int, offset bigint, line int"
MODULE_SCHEMA = "overlay int, library_index int, style string, name string, pos int, segment int, offset bigint, size bigint"
SEGMENT_SCHEMA = "pos int, logical boolean, flags int, overlay int, group_index int, frame int, name_at int, class_at int, offset bigint, size bigint"
FILE_INDEX_SCHEMA = "module_pos int, file_pos int, name string"
LIBRARY_SCHEMA = "pos int, name string"
#: Kind of the debug directory that holds CodeView data.
CODEVIEW = 2

#: Subsection types.
SUBSECTIONS = {0x120: "Module", 0x121: "Types", 0x122: "PublicSymbolsLegacy", 0x123: "PublicSymbols", 0x124: "Symbols", 0x125: "AlignSymbols", 0x126: "SourceLineSegment", 0x127: "SourceLineModule", 0x128: "Libraries", 0x129: "GlobalSymbols", 0x12A: "GlobalPublicSymbols", 0x12B: "GlobalTypes", 0x12C: "MakePCode", 0x12D: "SegmentMap", 0x12E: "SegmentNames", 0x12F: "PreCompiledMap", 0x133: "FileIndex", 0x134: "StaticSymbols"}


def _dbg(v: View) -> tuple:
    if v.u16(0) != 0x4944:
        raise FormatError("no debug file magic")
    return v.unpack(2, "3H10I")


def dbg_header(data: bytes) -> Iterator[tuple]:
    v = View(data)
    f = _dbg(v)
    at, size = 48 + 40 * f[7], f[8]
    names = [n.decode("latin-1") for n in v.take(at, size).split(b"\0") if n]
    yield (*f[:11], names)


def dbg_sections(data: bytes) -> Iterator[tuple]:
    v = View(data)
    for i in range(_dbg(v)[7]):
        yield (i, v.take(48 + 40 * i, 8), *v.unpack(56 + 40 * i, "IIIIIIHHI"))


def dbg_directories(data: bytes) -> Iterator[tuple]:
    v = View(data)
    f = _dbg(v)
    at = 48 + 40 * f[7] + f[8]
    for i in range(f[9] // 28):
        yield (i, *v.unpack(at + 28 * i, "IIHHIIII"))


def _codeview(data: bytes) -> View:
    """The CodeView block of a debug file: that of its first directory of this kind; or the data itself."""
    if data[:2] == b"NB":
        return View(data)
    for _, _, _, _, _, kind, size, _, at in dbg_directories(data):
        if kind == CODEVIEW:
            return View(View(data).take(at, size))
    raise FormatError("no CodeView directory")


def cv_subsections(data: bytes) -> Iterator[tuple]:
    v = _codeview(data)
    if v.take(0, 2) != b"NB":
        raise FormatError("no CodeView signature")
    at = v.u32(4)
    head, each, count, _, _ = v.unpack(at, "HHIII")
    if (head, each) != (16, 12):
        raise FormatError("unknown directory layout")
    for i in range(count):
        kind, module, offset, size = v.unpack(at + 16 + 12 * i, "HHII")
        yield i, kind, SUBSECTIONS.get(kind), module, offset, size, v.take(offset, size)


#: Numeric leaves: code to struct layout.
_NUMBERS = {0x8000: "b", 0x8001: "h", 0x8002: "H", 0x8003: "i", 0x8004: "I", 0x8005: "f", 0x8006: "d", 0x8009: "q", 0x800A: "Q", 0x800C: "2f", 0x800D: "2d"}
_RAW_NUMBERS = {0x8007: 10, 0x8008: 16, 0x800B: 6, 0x800E: 20, 0x800F: 32}


def numeric(v: View, at: int) -> tuple[object, int]:
    """Value and next place of a numeric leaf. Formats without a native type are kept as hexadecimal text."""
    tag = v.u16(at)
    if tag < 0x8000:
        return tag, at + 2
    if tag in _NUMBERS:
        got = v.unpack(at + 2, _NUMBERS[tag])
        return (got[0] if len(got) == 1 else list(got)), at + 2 + struct.calcsize("<" + _NUMBERS[tag])
    if tag in _RAW_NUMBERS:
        return v.take(at + 2, _RAW_NUMBERS[tag]).hex(), at + 2 + _RAW_NUMBERS[tag]
    if tag == 0x8010:
        size = v.u16(at + 2)
        return v.take(at + 4, size).decode("latin-1"), at + 4 + size
    raise FormatError(f"unknown numeric leaf {tag:#x}")


#: Fields of the bit field of compile flags, with their lowest bit and width.
_COMPILED = (("language", 0, 8), ("p_code", 8, 1), ("float_precision", 9, 2), ("float_package", 11, 2), ("ambient_data", 13, 3), ("ambient_code", 16, 3), ("mode_32", 19, 1), ("reserved", 20, 4))
_PROC = "parent:I end:I next:I length:I debug_start:I debug_end:I"
#: Symbol kinds: code to (name, layout). o is an offset of the symbol's width; n a Pascal name; * the rest; v a numeric leaf;
#: r registers after a count; c the bit field of three bytes that says how a module was compiled.
_SYMBOLS = {
    0x01: ("CompileFlags", "machine:B flags:c version:n"), 0x02: ("RegisterVariable", "value_type:H register:H name:n tracking:*"), 0x03: ("Constant", "value_type:H value:v name:n"),
    0x04: ("UserDefinedType", "value_type:H name:n"), 0x05: ("StartSearch", "symbol_offset:I segment:H"), 0x06: ("End", ""), 0x07: ("Skip", "data:*"), 0x08: ("CodeViewReserved", "data:*"),
    0x09: ("ObjectName", "signature:I name:n"), 0x0A: ("EndArguments", ""), 0x0B: ("MicrofocusCobolUDT", "value_type:H name:n"), 0x0C: ("ManyRegisters", "value_type:H registers:r name:n"),
    0x0D: ("ReturnDescription", "flags:H style:B data:*"), 0x0E: ("EntryThisPointer", "data:*"),
    0x400: ("ProcedureReference", "checksum:I offset:I module:H"), 0x401: ("DataReference", "checksum:I offset:I module:H"), 0x402: ("PageAlignment", "data:*"),
}
_MIPS = "parent:I end:I next:I length:I debug_start:I debug_end:I int_mask:I float_mask:I int_offset:I float_offset:I offset:I segment:H value_type:H return_register:B frame_register:B name:n"
_SYMBOLS |= {0x300: ("LocalMipsProcedure", _MIPS), 0x301: ("GlobalMipsProcedure", _MIPS), 0x20D: ("LocalThreadData", "offset:I segment:H value_type:H name:n"), 0x20E: ("GlobalThreadData", "offset:I segment:H value_type:H name:n")}
_BOTH_WIDTHS = (
    ("BpRelative", "offset:o value_type:H name:n"), ("LocalData", "offset:o segment:H value_type:H name:n"), ("GlobalData", "offset:o segment:H value_type:H name:n"), ("PublicData", "offset:o segment:H value_type:H name:n"),
    ("LocalProcedure", "parent:I end:I next:I length:o debug_start:o debug_end:o offset:o segment:H value_type:H flags:B name:n"), ("GlobalProcedure", "parent:I end:I next:I length:o debug_start:o debug_end:o offset:o segment:H value_type:H flags:B name:n"),
    ("Thunk", "parent:I end:I next:I offset:o segment:H length:H thunk_type:B name:n variant:*"), ("Block", "parent:I end:I length:o offset:o segment:H name:n"), ("With", "parent:I end:I length:o offset:o segment:H name:n"),
    ("Label", "offset:o segment:H flags:B name:n"), ("ChangeExecutionModel", "offset:o segment:H model:H variant:*"), ("VirtualFunctionTablePath", "offset:o segment:H root:H path:H"), ("RegisterRelativeOffset", "offset:o register:H value_type:H name:n"),
)
for _i, (_name, _layout) in enumerate(_BOTH_WIDTHS):
    _SYMBOLS[0x100 + _i] = (f"{_name}16", _layout.replace(":o", ":H"))
    _SYMBOLS[0x200 + _i] = (f"{_name}32", _layout.replace(":o", ":I"))


def _fields(v: View, at: int, layout: str) -> tuple[dict, int]:
    out: dict[str, object] = {}
    for part in layout.split():
        name, code = part.split(":")
        if code == "n":
            raw = v.pascal(at)
            out[name], at = raw.decode("latin-1"), at + 1 + len(raw)
        elif code == "*":
            out[name], at = v.data[at:].hex(), len(v)
        elif code == "v":
            out[name], at = numeric(v, at)
        elif code == "c":
            bits, at = int.from_bytes(v.take(at, 3), "little"), at + 3
            for part_name, low, width in _COMPILED:
                out[part_name] = bits >> low & (1 << width) - 1
        elif code == "r":
            count = v.u8(at)
            out[name], at = list(v.take(at + 1, count)), at + 1 + count
        else:
            out[name], at = v.unpack(at, code)[0], at + struct.calcsize("<" + code)
    return out, at


def symbols(data: bytes, start: int = 0) -> Iterator[tuple]:
    """Symbol records from a place to the end; a record of an unknown kind is kept whole."""
    v, at, pos = View(data), start, 0
    while at + 2 <= len(v):
        size = v.u16(at)
        if size < 2:
            raise FormatError("symbol record too short")
        body = View(v.take(at + 4, size - 2))
        code = v.u16(at + 2)
        name, layout = _SYMBOLS.get(code, ("Other", "data:*"))
        f, _ = _fields(body, 0, layout)
        yield pos, code, name, f.pop("segment", None), f.pop("offset", None), f.pop("value_type", None), f.pop("name", None), json.dumps(f, sort_keys=True)
        at += 2 + size
        pos += 1


def cv_symbols(data: bytes) -> Iterator[tuple]:
    """Symbols of every subsection that holds them, numbered through."""
    n = 0
    for _, kind, _, _, _, _, body in cv_subsections(data):
        if kind in (0x124, 0x125):
            if View(body).u32(0) != 1:
                raise FormatError("unknown symbol signature")
            rows = symbols(body, 4)
        elif kind in (0x129, 0x12A, 0x134):
            size = View(body).u32(4)
            rows = symbols(View(body).take(16, size))
        else:
            continue
        for row in rows:
            yield (n, *row[1:])
            n += 1


SYMBOL_HASH_SCHEMA = "pos int, type_name string, symbol_hash_function int, address_hash_function int, symbols_size bigint, symbol_hash_table binary, address_hash_table binary"


def cv_symbol_hashes(data: bytes) -> Iterator[tuple]:
    """The hash tables of the subsections of global, public and static symbols."""
    for pos, kind, name, _, _, _, body in cv_subsections(data):
        if kind in (0x129, 0x12A, 0x134):
            v = View(body)
            by_name, by_address, size, names, addresses = v.unpack(0, "HHIII")
            yield pos, name, by_name, by_address, size, v.take(16 + size, names), v.take(16 + size + names, addresses)


#: Type leaves: code to (name, layout). t repeats 16-bit type indices after a count.
_TYPES = {
    0x01: ("Modifier", "attributes:H base_type:H"), 0x03: ("Array", "element_type:H index_type:H length:v name:n"),
    0x04: ("Class", "count:H field_list:H properties:H derived:H vtable_shape:H length:v name:n"), 0x05: ("Structure", "count:H field_list:H properties:H derived:H vtable_shape:H length:v name:n"),
    0x06: ("Union", "count:H field_list:H properties:H length:v name:n"), 0x07: ("Enum", "count:H base_type:H field_list:H properties:H name:n"),
    0x08: ("Procedure", "return_type:H convention:B reserved:B count:H arguments:H"), 0x09: ("MemberFunction", "return_type:H class_type:H this_type:H convention:B reserved:B count:H arguments:H adjust:I"),
    0x0D: ("VirtualFunctionTableShape", "descriptors:d"), 0x201: ("ArgumentList", "types:t"), 0x205: ("DerivedClasses", "types:t"), 0x206: ("BitField", "length:B position:B base_type:H"),
    0x207: ("MethodList", "methods:m"), 0x400: ("RealBaseClass", "base_type:H attributes:H offset:v"), 0x403: ("EnumerationNameAndValue", "attributes:H value:v name:n"),
    0x405: ("DataMember", "member_type:H attributes:H offset:v name:n"), 0x406: ("DataMember", "member_type:H attributes:H offset:v name:n"), 0x407: ("StaticDataMember", "member_type:H attributes:H name:n"),
    0x408: ("Method", "count:H method_list:H name:n"), 0x409: ("NestedTypeDefinition", "member_type:H name:n"), 0x40A: ("VirtualFunctionTablePointer", "member_type:H"), 0x40C: ("OneMethod", "attributes:H member_type:H table_offset:i name:n"),
}


def _introduces(attributes: int) -> bool:
    """Whether a method opens a slot of the virtual function table."""
    return attributes >> 2 & 7 in (4, 6)


def is_virtual(attributes: int) -> bool:
    return attributes >> 2 & 7 in (1, 4, 5, 6)


def _pointer_variant(v: View, at: int, kind: int, mode: int) -> dict:
    """What follows a pointer leaf: the base of a based pointer, or the class of a pointer to a member."""
    if mode in (2, 3):
        class_type, form = v.unpack(at, "HH")
        return {"class_type": class_type, "member_format": form}
    if mode > 3:
        return {}
    if kind == 3:
        return {"base_segment": v.u16(at)}
    if kind == 8:
        return {"based_on_type": v.u16(at), "based_on_name": v.pascal(at + 2).decode("latin-1")}
    if kind in (6, 7):
        _, code, name, segment, offset, value_type, own, payload = next(symbols(v.data, at))
        return {"base_symbol": {"kind_code": code, "kind": name, "segment": segment, "offset": offset, "value_type": value_type, "name": own, **json.loads(payload)}}
    return {}


def _leaf(v: View, at: int) -> tuple[int, str, dict, int]:
    code = v.u16(at)
    at += 2
    if code == 0x02:
        attributes, base = v.unpack(at, "HH")
        flags = {n: bool(attributes >> b & 1) for b, n in ((8, "flat_32"), (9, "volatile"), (10, "const"), (11, "unaligned"))}
        f = {"attributes": attributes, "base_type": base, "kind": attributes & 31, "mode": attributes >> 5 & 7, **flags}
        return code, "Pointer", f | _pointer_variant(v, at + 4, f["kind"], f["mode"]), len(v)
    if code in (0x204, 0x404):
        members = []
        while at < len(v):
            if (pad := v.u8(at)) > 0xF0:
                at += pad & 0x0F
                continue
            sub, name, f, at = _leaf(v, at)
            members.append({"leaf_code": sub, "leaf": name, **f})
        return code, "FieldList", {"members": members}, at
    if code not in _TYPES:
        return code, "Other", {"data": v.data[at:].hex()}, len(v)
    name, layout = _TYPES[code]
    out: dict[str, object] = {}
    for part in layout.split():
        key, kind = part.split(":")
        if kind == "t":
            count = v.u16(at)
            out[key], at = list(v.unpack(at + 2, f"{count}H")), at + 2 + 2 * count
        elif kind == "d":
            count = v.u16(at)
            raw = v.take(at + 2, (count + 1) // 2)
            out[key], at = [x for b in raw for x in (b >> 4, b & 15)][:count], at + 2 + len(raw)
        elif kind == "i":
            opens = _introduces(out["attributes"])
            out[key], at = (v.u32(at), at + 4) if opens else (None, at)
        elif kind == "m":
            rows = []
            while at + 4 <= len(v) and v.u8(at) <= 0xF0:
                attributes, own = v.unpack(at, "HH")
                at += 4
                table = None
                if _introduces(attributes):
                    table, at = v.u32(at), at + 4
                rows.append({"attributes": attributes, "member_type": own, "table_offset": table})
            out[key] = rows
        else:
            got, at = _fields(v, at, part)
            out |= got
    return code, name, out, at


def cv_types(data: bytes) -> Iterator[tuple]:
    """Leaves of the global type table with their indices, which start at 0x1000."""
    for _, kind, _, _, _, _, body in cv_subsections(data):
        if kind != 0x12B:
            continue
        v = View(body)
        count = v.u32(4)
        base = 8 + 4 * count
        for i in range(count):
            at = base + v.u32(8 + 4 * i)
            record = View(v.take(at + 2, v.u16(at)))
            code, name, f, _ = _leaf(record, 0)
            yield 0x1000 + i, code, name, json.dumps(f, sort_keys=True)


def cv_lines(data: bytes) -> Iterator[tuple]:
    for _, kind, _, _, _, _, body in cv_subsections(data):
        if kind != 0x127:
            continue
        v = View(body)
        files = v.u16(0)
        for i in range(files):
            at = v.u32(4 + 4 * i)
            segments = v.u16(at)
            places = [v.u32(at + 4 + 4 * k) for k in range(segments)]
            name = v.pascal(at + 4 + 12 * segments).decode("latin-1")
            for place in places:
                index, count = v.unpack(place, "HH")
                for k in range(count):
                    yield name, index, v.u32(place + 4 + 4 * k), v.u16(place + 4 + 4 * count + 2 * k)


def cv_modules(data: bytes) -> Iterator[tuple]:
    """A row per segment of a module; a module without segments gives one row with nulls."""
    for _, kind, _, _, _, _, body in cv_subsections(data):
        if kind != 0x120:
            continue
        v = View(body)
        overlay, library, count, style = v.unpack(0, "HHHH")
        name = v.pascal(8 + 12 * count).decode("latin-1")
        if not count:
            yield overlay, library, style.to_bytes(2, "little").decode("latin-1"), name, None, None, None, None
        for i in range(count):
            segment, _, offset, size = v.unpack(8 + 12 * i, "HHII")
            yield overlay, library, style.to_bytes(2, "little").decode("latin-1"), name, i, segment, offset, size


def cv_segment_map(data: bytes) -> Iterator[tuple]:
    for _, kind, _, _, _, _, body in cv_subsections(data):
        if kind == 0x12D:
            v = View(body)
            total, logical = v.unpack(0, "HH")
            for i in range(total):
                flags, overlay, group, frame, name, cls, offset, size = v.unpack(4 + 20 * i, "6HII")
                yield i, i < logical, flags, overlay, group, frame, name, cls, offset, size


def cv_file_index(data: bytes) -> Iterator[tuple]:
    for _, kind, _, _, _, _, body in cv_subsections(data):
        if kind == 0x133:
            v = View(body)
            modules, names = v.unpack(0, "HH")
            starts, counts = v.unpack(4, f"{modules}H"), v.unpack(4 + 2 * modules, f"{modules}H")
            at = 4 + 4 * modules
            base = at + 4 * names
            offsets = v.unpack(at, f"{names}I")
            for m in range(modules):
                for k in range(counts[m]):
                    yield m, k, v.pascal(base + offsets[starts[m] + k]).decode("latin-1")


def cv_libraries(data: bytes) -> Iterator[tuple]:
    for _, kind, _, _, _, _, body in cv_subsections(data):
        if kind == 0x128:
            v, at, pos = View(body), 0, 0
            while at < len(v):
                name = v.pascal(at)
                yield pos, name.decode("latin-1")
                at += 1 + len(name)
                pos += 1
