"""Deterministic encoders for fixtures: rows to the bytes of each format. They are written from the formats' layouts, apart from
the parsers, and use no clock and no randomness."""

from __future__ import annotations

import struct
import zlib

P = struct.pack


def mz(new_at: int = 64, relocation_at: int = 0x40) -> bytes:
    return (b"MZ" + P("<11H", 0, 1, 0, 4, 0, 0xFFFF, 0, 0xB8, 0, 0, 0) + P("<H", relocation_at)).ljust(60, b"\0") + P("<I", new_at)


def pe_file(sections: list[tuple[bytes, int, bytes, int]], directories: dict[int, tuple[int, int]] | None = None, machine: int = 0x14C, stamp: int = 0, wide: bool = False) -> bytes:
    """sections: (name, address, bytes, virtual size)."""
    count = 16
    fixed = 112 if wide else 96
    optional = P("<HBBIIIII", 0x20B if wide else 0x10B, 6, 0, 0x200, 0, 0, 0x1000, 0x1000)
    optional += P("<Q", 0x180000000) if wide else P("<II", 0, 0x10000000)
    optional += P("<II6HIIIIHH", 0x1000, 0x200, 4, 0, 0, 0, 4, 0, 0, 0x10000, 0x400, 0, 2, 0)
    optional += P("<4Q" if wide else "<4I", 0x100000, 0x1000, 0x100000, 0x1000) + P("<II", 0, count)
    assert len(optional) == fixed
    for i in range(count):
        optional += P("<II", *(directories or {}).get(i, (0, 0)))
    head = mz() + b"PE\0\0" + P("<HHIIIHH", machine, len(sections), stamp, 0, 0, len(optional), 0x2102) + optional
    at = -(-(len(head) + 40 * len(sections)) // 512) * 512
    table, body = b"", b""
    for name, address, raw, virtual in sections:
        padded = raw + bytes(-len(raw) % 512)
        table += name.ljust(8, b"\0")[:8] + P("<IIIIIIHHI", virtual, address, len(padded), at + len(body), 0, 0, 0, 0, 0x40000040)
        body += padded
    return (head + table).ljust(at, b"\0") + body


def export_section(exports: list[tuple[int, str | None, str | None]], address: int = 0x1000, base: int = 1, module: str = "M.DLL") -> tuple[bytes, int]:
    """exports: (ordinal, name, forwarder). Returns the section and the size of the directory."""
    top = max((o for o, _, _ in exports), default=base - 1)
    slots = top - base + 1
    names = sorted((n.encode(), o) for o, n, _ in exports if n is not None)
    at = 40
    addresses_at, at = at, at + 4 * slots
    names_at, at = at, at + 4 * len(names)
    ordinals_at, at = at, at + 2 * len(names)
    strings = bytearray()

    def put(text: bytes) -> int:
        place = address + at + len(strings)
        strings.extend(text + b"\0")
        return place

    module_at = put(module.encode())
    table = [0] * slots
    for o, _, forward in exports:
        table[o - base] = put(forward.encode()) if forward is not None else 0x100000 + 16 * o
    name_places = [put(n) for n, _ in names]
    body = P("<IIHHIIIIIII", 0, 0, 0, 0, module_at, base, slots, len(names), address + addresses_at, address + names_at, address + ordinals_at)
    body += P(f"<{slots}I", *table) + P(f"<{len(names)}I", *name_places) + P(f"<{len(names)}H", *[o - base for _, o in names]) + bytes(strings)
    return body, len(body)


def pe_dll(exports: list[tuple[int, str | None, str | None]], **options) -> bytes:
    body, size = export_section(exports)
    return pe_file([(b".edata", 0x1000, body, len(body))], {0: (0x1000, size)}, **options)


def resource_section(leaves: list[tuple[int, int, int, bytes]], address: int = 0x2000) -> bytes:
    """leaves: (type, id, language, data), as a tree of three levels."""
    tree: dict = {}
    for t, i, lang, data in leaves:
        tree.setdefault(t, {}).setdefault(i, {})[lang] = data
    tables, datas = bytearray(), []

    def directory(node: dict) -> int:
        at = len(tables)
        tables.extend(P("<IIHHHH", 0, 0, 0, 0, 0, len(node)) + bytes(8 * len(node)))
        for k, (key, child) in enumerate(sorted(node.items())):
            if isinstance(child, dict):
                to = directory(child) | 0x80000000
            else:
                to = len(tables)
                tables.extend(bytes(16))
                datas.append((to, child))
            tables[at + 16 + 8 * k : at + 24 + 8 * k] = P("<II", key, to)
        return at

    directory(tree)
    out = bytearray(tables)
    for to, data in datas:
        out[to : to + 16] = P("<IIII", address + len(out), len(data), 1252, 0)
        out += data + bytes(-len(data) % 4)
    return bytes(out)


def pe_with_resources(leaves: list[tuple[int, int, int, bytes]]) -> bytes:
    body = resource_section(leaves)
    return pe_file([(b".rsrc", 0x2000, body, len(body))], {2: (0x2000, len(body))})


def ne_dll(bundles: list[tuple[int, list[tuple[int, int]]]], resident: list[tuple[bytes, int]], nonresident: list[tuple[bytes, int]] = (), resources: list[tuple[int, int, int, bytes]] = (), segments: list[tuple[bytes, bytes]] = (), modules: list[bytes] = (), imports: list[bytes] = ()) -> bytes:
    """bundles: (segment: 0 unused, 255 moveable; entries (flags, offset), of an unused one their number); resources: (type,
    id, flags, data); segments: (data, relocation records of 8 bytes)."""
    entries = b""
    for segment, rows in bundles:
        entries += P("<BB", len(rows), segment)
        for flags, offset in rows if segment else ():
            entries += P("<BHBH", flags, 0x3FCD, 1, offset) if segment == 255 else P("<BH", flags, offset)
    entries += b"\0"
    names = lambda rows: b"".join(bytes([len(n)]) + n + P("<H", o) for n, o in rows) + b"\0"
    shift, head = 4, 64
    imported, places = b"\0", {}
    for n in [*modules, *imports]:
        places[n] = len(imported)
        imported += bytes([len(n)]) + n
    segments_at = head
    resources_at = segments_at + 8 * len(segments)
    groups: dict[int, list] = {}
    for t, i, flags, data in resources:
        groups.setdefault(t, []).append((i, flags, data))
    table_size = (2 + sum(8 + 12 * len(g) for g in groups.values()) + 2) if groups else 0
    resident_at = resources_at + table_size
    modules_at = resident_at + len(names(resident))
    imports_at = modules_at + 2 * len(modules)
    entries_at = imports_at + len(imported)
    other = names(nonresident)
    nonresident_at = 64 + entries_at + len(entries)
    data_at = -(-(nonresident_at + len(other)) // 16) * 16
    body, seg_table, res_table = bytearray(), b"", b""
    for raw, relocations in segments:
        seg_table += P("<HHHH", (data_at + len(body)) >> shift, len(raw), 0x0100 if relocations else 0, len(raw))
        body += raw + ((P("<H", len(relocations) // 8) + relocations) if relocations else b"")
        body += bytes(-len(body) % 16)
    if groups:
        res_table = P("<H", shift)
        for t, rows in groups.items():
            res_table += P("<HHI", t | 0x8000, len(rows), 0)
            for i, flags, data in rows:
                padded = data + bytes(-len(data) % 16)
                res_table += P("<HHHHI", (data_at + len(body)) >> shift, len(padded) >> shift, flags, i | 0x8000, 0)
                body += padded
        res_table += b"\0\0"
    header = b"NE" + P("<BBHHIHHHHHHHHHHHHHHHHIHHHBB", 5, 1, entries_at, len(entries), 0, 0x8000, 1, 0, 0, 0, 0, 0, 0, len(segments), len(modules), len(other), segments_at, resources_at if groups else resident_at, resident_at, modules_at, imports_at, nonresident_at, 0, shift, 0, 2, 0)
    header = header.ljust(62, b"\0") + P("<H", 0x30A)
    refs = b"".join(P("<H", places[m]) for m in modules)
    out = mz() + header + seg_table + res_table + names(resident) + refs + imported + entries + other
    return out.ljust(data_at, b"\0") + bytes(body)


def lzss(data: bytes, start: int, extra: int = 3) -> bytes:
    """Greedy matches in a window of spaces."""
    out = bytearray()
    seen: dict[bytes, int] = {}
    i = 0
    while i < len(data):
        flag_at = len(out)
        out.append(0)
        for bit in range(8):
            if i >= len(data):
                break
            key = data[i : i + 3]
            n, place = 0, seen.get(key)
            if len(key) == 3 and place is not None and i - place < 4000:
                while n < 15 + extra and i + n < len(data) and data[place + n] == data[i + n] and place + n < i:
                    n += 1
            if n >= max(extra, 1) and n >= 3:
                pos = (start + place) % 4096
                out += bytes([pos & 0xFF, (pos >> 4 & 0xF0) | (n - extra)])
            else:
                n = 1
                out[flag_at] |= 1 << bit
                out.append(data[i])
            for k in range(i, i + n):
                seen[data[k : k + 3]] = k
            i += n
    return bytes(out)


def szdd(data: bytes) -> bytes:
    return bytes.fromhex("535A444488F02733") + b"A_" + P("<I", len(data)) + lzss(data, 4096 - 16)


def sz(data: bytes) -> bytes:
    return bytes.fromhex("535A2088F02733D1") + P("<I", len(data)) + lzss(data, 4096 - 18)


class _BitWriter:
    def __init__(self):
        self.bits: list[str] = []

    def put(self, value: int, n: int) -> None:
        self.bits.append(f"{value:0{n}b}")

    def done(self) -> bytes:
        bits = "".join(self.bits)
        bits += "0" * (-len(bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big")


def lzh_literals(data: bytes) -> bytes:
    """LZH with fixed tables and runs of literals only."""
    w = _BitWriter()
    for _ in range(6):
        w.put(0, 4)
    for i in range(0, len(data), 32):
        run = data[i : i + 32]
        w.put(0, 4)
        w.put(len(run) - 1, 5)
        for b in run:
            w.put(b, 8)
        # After a run that is not full a match must follow, so the last one ends the stream.
    return w.done()


def mszip_blocks(data: bytes) -> list[tuple[bytes, int]]:
    """(block, plain size) with the window carried over."""
    out = []
    for i in range(0, len(data), 32768) or [0]:
        c = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=data[max(0, i - 32768) : i]) if i else zlib.compressobj(9, zlib.DEFLATED, -15)
        part = data[i : i + 32768]
        out.append((b"CK" + c.compress(part) + c.flush(), len(part)))
    return out


def kwaj(data: bytes, method: int) -> bytes:
    if method == 0:
        body = data
    elif method == 1:
        body = bytes(b ^ 0xFF for b in data)
    elif method == 2:
        body = lzss(data, 4096 - 18)
    elif method == 3:
        body = lzh_literals(data)
    else:
        body = b"".join(P("<H", len(b)) + b for b, _ in mszip_blocks(data)) + b"\0\0"
    return bytes.fromhex("4B57414A88F027D1") + P("<HHH", method, 14, 0) + body


def lzx_stored(data: bytes) -> list[tuple[bytes, int]]:
    """LZX frames of uncompressed blocks."""
    out = []
    for i in range(0, len(data), 32768) or [0]:
        part = data[i : i + 32768]
        n = len(part)
        bits = ([0] if not i else []) + [0, 1, 1] + [n >> k & 1 for k in range(23, -1, -1)]
        bits += [0] * (-len(bits) % 16 or 16)
        words = b"".join(P("<H", sum(b << 15 - k for k, b in enumerate(bits[j : j + 16]))) for j in range(0, len(bits), 16))
        out.append((words + P("<III", 1, 1, 1) + part + (b"\0" if n & 1 else b""), n))
    return out


def cab(files: list[tuple[str, bytes]], method: int = 0, reserve: tuple[int, int, int] | None = None, date: int = 0x2A81, time: int = 0x13D5, spanned: bool = False) -> bytes:
    """One folder with all files; method 0 stored, 1 MS-ZIP, 3 LZX without compression."""
    data = b"".join(d for _, d in files)
    if method == 0:
        blocks = [(data[i : i + 32768], len(data[i : i + 32768])) for i in range(0, len(data), 32768)]
    else:
        blocks = mszip_blocks(data) if method == 1 else lzx_stored(data)
    code = method | (15 << 8 if method == 3 else 0)
    h, f, b = reserve or (0, 0, 0)
    head = 36 + (4 + h if reserve else 0)
    rows, offset = b"", 0
    for name, d in files:
        raw, attributes = name.encode("utf-8"), 0x20 | (0 if name.isascii() else 0x80)
        rows += P("<IIHHHH", len(d), offset, 0xFFFD if spanned else 0, date, time, attributes) + raw + b"\0"
        offset += len(d)
    files_at = head + 8 + f
    data_at = files_at + len(rows)
    packed = b"".join(P("<IHH", 0, len(x), n) + bytes(b) + x for x, n in blocks)
    out = b"MSCF" + P("<IIIIIBBHHHHH", 0, data_at + len(packed), 0, files_at, 0, 3, 1, 1, len(files), 4 if reserve else 0, 1, 0)
    if reserve:
        out += P("<HBB", h, f, b) + bytes(h)
    return out + P("<IHH", data_at, len(blocks), code) + bytes(f) + rows + packed


def fat(files: list[tuple[str, bytes]], bits: int = 12, fragmented: bool = False, deleted: bool = True) -> bytes:
    """Files in the root or in one level of folders ('DIR/NAME.EXT'), one sector per cluster."""
    sector = 512
    clusters = {12: 2000, 16: 6000, 32: 66000}[bits]
    table: dict[int, int] = {}
    bodies: dict[int, bytes] = {}
    step = 2 if fragmented else 1
    cursor = 2

    def store(data: bytes) -> int:
        nonlocal cursor
        if not data:
            return 0
        chain = []
        for i in range(0, len(data), sector):
            chain.append(cursor)
            bodies[cursor] = data[i : i + sector]
            cursor += step
        for a, b in zip(chain, [*chain[1:], {12: 0xFFF, 16: 0xFFFF, 32: 0x0FFFFFFF}[bits]]):
            table[a] = b
        return chain[0]

    def entry(name: str, attributes: int, first: int, size: int) -> bytes:
        stem, _, ext = name.partition(".")
        return stem.encode("latin-1").ljust(8)[:8] + ext.encode("latin-1").ljust(3)[:3] + P("<BBBHHHHHHHI", attributes, 0, 0, 0x13D5, 0x2A81, 0, first >> 16, 0x13D5, 0x2A81, first & 0xFFFF, size)

    folders: dict[str, bytes] = {}
    root = entry("LABEL", 8, 0, 0) + (b"\xe5" + entry("XGONE.TXT", 0x20, 0, 9)[1:] if deleted else b"")
    for path, data in files:
        folder, _, name = path.rpartition("/")
        row = entry(name, 0x20, store(data), len(data))
        if folder:
            folders[folder] = folders.get(folder, b"") + row
        else:
            root += row
    for name, rows in folders.items():
        root += entry(name, 0x10, store(entry(".", 0x10, 0, 0) + rows), 0)
    roots = 0 if bits == 32 else max(16, -(-len(root) // 512) * 16)
    root_cluster = store(root) if bits == 32 else 0
    fat_bytes = (clusters + 2) * bits // 8 + 2
    fat_sectors = -(-fat_bytes // sector)
    reserved = 32 if bits == 32 else 1
    meta = reserved + fat_sectors + roots * 32 // sector
    total = clusters if bits != 32 else clusters
    raw = bytearray(fat_sectors * sector)
    for k, v in {0: {12: 0xFF8, 16: 0xFFF8, 32: 0x0FFFFFF8}[bits], 1: {12: 0xFFF, 16: 0xFFFF, 32: 0x0FFFFFFF}[bits], **table}.items():
        if bits == 12:
            at = k * 3 // 2
            pair = raw[at] | raw[at + 1] << 8
            pair = (pair & 0xF | v << 4) if k & 1 else (pair & 0xF000 | v)
            raw[at : at + 2] = P("<H", pair)
        else:
            raw[k * bits // 8 : (k + 1) * bits // 8] = v.to_bytes(bits // 8, "little")
    small = total if total < 65536 else 0
    boot = b"\xeb\x3c\x90MSDOS5.0" + P("<HBHBHHBHHHII", sector, 1, reserved, 1, roots, small, 0xF8, 0 if bits == 32 else fat_sectors, 32, 2, 0, 0 if small else total)
    if bits == 32:
        boot += P("<IHHI", fat_sectors, 0, 0, root_cluster)
        boot = boot.ljust(71, b"\0") + b"SYNTHETIC  "
    else:
        boot = boot.ljust(43, b"\0") + b"SYNTHETIC  "
    out = boot.ljust(reserved * sector, b"\0") + bytes(raw) + (b"" if bits == 32 else root.ljust(roots * 32, b"\0"))
    last = max(bodies, default=1)
    return out + b"".join(bodies.get(c, b"").ljust(sector, b"\0") for c in range(2, last + 1))


def iso(files: list[tuple[str, bytes]], sierra: bool = False) -> bytes:
    """Files in the root or one level of folders, blocks of 2048 bytes."""
    block = 2048
    shift = 8 if sierra else 0
    pad = lambda b: b + bytes(-len(b) % block)

    def record(extent: int, size: int, folder: bool, name: bytes) -> bytes:
        stamp = bytes([101, 4, 1, 2, 30, 42]) + (bytes([0]) + bytes([2 if folder else 0]) if not sierra else bytes([2 if folder else 0]) + b"\0")
        stamp = stamp if not sierra else bytes([101, 4, 1, 2, 30, 42, 2 if folder else 0, 0])
        r = P("<I", extent) + P(">I", extent) + P("<I", size) + P(">I", size) + stamp + b"\0\0" + P("<H", 1) + P(">H", 1) + bytes([len(name)]) + name
        r = b"\0\0" + r
        r += b"\0" * (len(r) & 1)
        return bytes([len(r)]) + r[1:]

    tree: dict[str, list[tuple[str, bytes]]] = {"": []}
    for path, data in files:
        folder, _, name = path.rpartition("/")
        tree.setdefault(folder, []).append((name, data))

    def listing_size(rows: list[bytes]) -> bytes:
        out = b""
        for r in rows:
            if len(out) % block + len(r) > block:
                out = pad(out)
            out += r
        return pad(out)

    order = ["", *[f for f in tree if f]]
    sizes = {}
    for f in order:
        names = [n.encode("latin-1") + b";1" for n, _ in tree[f]] + ([x.encode("latin-1") for x in order[1:]] if not f else [])
        sizes[f] = len(listing_size([record(0, 0, True, b"\0"), record(0, 0, True, b"\1"), *[record(0, 0, False, n) for n in names]]))
    at, place = 20, {}
    for f in order:
        place[f] = at
        at += sizes[f] // block
    bodies, where = b"", {}
    for f in order:
        for n, d in tree[f]:
            where[f, n] = at + len(bodies) // block
            bodies += pad(d)
    listings = b""
    for f in order:
        rows = [record(place[f], sizes[f], True, b"\0"), record(place[""], sizes[""], True, b"\1")]
        rows += [record(where[f, n], len(d), False, n.encode("latin-1") + b";1") for n, d in tree[f]]
        rows += [record(place[x], sizes[x], True, x.encode("latin-1")) for x in order[1:]] if not f else []
        listings += listing_size(rows)
    both = lambda n: P("<I", n) + P(">I", n)
    d = bytearray(block)
    if sierra:
        d[0:8] = both(16)
        d[9:14] = b"CDROM"
    else:
        d[1:6] = b"CD001"
    d[shift] = 1
    d[6 + shift] = 1
    d[8 + shift : 40 + shift] = b"SYNTH".ljust(32)
    d[40 + shift : 72 + shift] = b"VOLUME".ljust(32)
    d[80 + shift : 88 + shift] = both(at + len(bodies) // block)
    d[128 + shift : 132 + shift] = P("<H", block) + P(">H", block)
    root = record(place[""], sizes[""], True, b"\0")
    root_at = shift + (172 if sierra else 156)
    d[root_at : root_at + len(root)] = root
    end = bytearray(block)
    end[shift], end[1 + shift : 6 + shift] = 255, b"CDROM" if sierra else b"CD001"
    return bytes(16 * block) + bytes(d) + bytes(end) + bytes(2 * block) + listings + bodies


def codeview(subsections: list[tuple[int, int, bytes]]) -> bytes:
    """subsections: (type, module, data)."""
    body, rows, at = b"", b"", 8
    for kind, module, data in subsections:
        rows += P("<HHII", kind, module, at, len(data))
        body += data
        at += len(data)
    return b"NB09" + P("<I", at) + body + P("<HHIII", 16, 12, len(subsections), 0, 0) + rows


def pascal(text: str) -> bytes:
    raw = text.encode("latin-1")
    return bytes([len(raw)]) + raw


def symbol(code: int, body: bytes) -> bytes:
    return P("<HH", len(body) + 2, code) + body


def dbg(block: bytes, exported: list[str] = (), stamp: int = 0) -> bytes:
    """A debug file without sections and with one directory, of kind CodeView."""
    names = b"".join(n.encode("latin-1") + b"\0" for n in exported)
    head = P("<HHHH10I", 0x4944, 0, 0x14C, 0x2102, stamp, 0, 0x10000000, 0x10000, 0, len(names), 28, 0x1000, 0, 0)
    at = len(head) + len(names) + 28
    return head + names + P("<IIHHIIII", 0, stamp, 0, 0, 2, len(block), 0, at) + block


def line_module(files: list[tuple[str, list[tuple[int, list[tuple[int, int]]]]]]) -> bytes:
    """files: (name, [(segment, [(offset, line)])])."""
    head = P("<HH", len(files), 0)
    at = 4 + 4 * len(files)
    places, body = [], b""
    for name, segments in files:
        places.append(at + len(body))
        own = 4 + 12 * len(segments) + 1 + len(name)
        starts, lines = [], b""
        for index, rows in segments:
            starts.append(places[-1] + own + len(lines))
            lines += P("<HH", index, len(rows)) + b"".join(P("<I", o) for o, _ in rows) + b"".join(P("<H", n) for _, n in rows)
        body += P("<HH", len(segments), 0) + b"".join(P("<I", s) for s in starts) + bytes(8 * len(segments)) + pascal(name) + lines
    return head + b"".join(P("<I", p) for p in places) + body


def global_types(leaves: list[bytes]) -> bytes:
    records, offsets, at = b"", b"", 0
    for leaf in leaves:
        offsets += P("<I", at)
        records += P("<H", len(leaf)) + leaf
        at += 2 + len(leaf)
    return P("<II", 1, len(leaves)) + offsets + records


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def clr_container(entries: list[tuple[str, int, bytes]]) -> bytes:
    """entries: (name, type code, data)."""
    names, places, data, offsets = b"", [], b"", []
    for name, code, raw in entries:
        places.append(len(names))
        offsets.append(len(data))
        text = name.encode("utf-16-le")
        names += _varint(len(text)) + text + P("<I", len(data))
        data += _varint(code) + raw
    head = P("<III", 0xBEEFCACE, 1, 0) + P("<III", 2, len(entries), 0)
    head += bytes(-len(head) % 8)
    hashes = b"".join(P("<I", 1000 + i) for i in range(len(entries)))
    start = len(head) + 8 * len(entries) + 4 + len(names)
    return head + hashes + b"".join(P("<I", p) for p in places) + P("<I", start) + names + data


def clr_pe(raws: list[bytes]) -> bytes:
    """A PE file whose managed header points to wrapped containers."""
    wrapped = b"".join(P("<I", len(r)) + r + bytes(-len(r) % 4) for r in raws)
    header = P("<IHHII", 72, 2, 5, 0x3000 + 1024, 16) + P("<II", 1, 0) + P("<II", 0x3000 + 72, len(wrapped)) + bytes(40)
    body = header + wrapped
    return pe_file([(b".text", 0x3000, body, len(body))], {14: (0x3000, 72)})


def icon_group(rows: list[tuple[int, int, int, int]]) -> bytes:
    """rows: (width, height, bits, id)."""
    return P("<HHH", 0, 1, len(rows)) + b"".join(P("<BBBBHHIH", w, h, 0, 0, 1, bits, w * h, i) for w, h, bits, i in rows)


def icon1(width: int, height: int, and_plane: bytes, xor_plane: bytes) -> bytes:
    return b"\1\0" + P("<6H", 0, 0, width, height, len(and_plane) // height if height else 0, 0) + and_plane + xor_plane


def bitmap24(width: int, height: int, pixels: bytes) -> bytes:
    """pixels: RGB, top row first."""
    rows = [pixels[3 * width * y : 3 * width * (y + 1)] for y in range(height)]
    flip = lambda r: b"".join(r[i : i + 3][::-1] for i in range(0, len(r), 3))
    body = b"".join(flip(r) + bytes(-3 * width % 4) for r in reversed(rows))
    return P("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def font2(glyphs: list[tuple[int, bytes]], height: int, first: int = 32, face: str = "Face", copyright_: str = "Copyright") -> bytes:
    """glyphs: (width, row-major rows of whole bytes)."""
    table_at = 118
    at = table_at + 4 * (len(glyphs) + 1)
    table, body = b"", b""
    for width, rows in glyphs:
        n = -(-width // 8)
        table += P("<HH", width, at + len(body))
        body += b"".join(rows[y * n + x : y * n + x + 1] for x in range(n) for y in range(height))
    table += P("<HH", 0, at + len(body))
    face_at = at + len(body)
    head = P("<HI", 0x200, face_at + len(face) + 1) + copyright_.encode("latin-1").ljust(60, b"\0")[:60]
    head += P("<7H3BHBHHBHHBBBBHIIII", 0, 10, 96, 96, height - 2, 0, 0, 0, 0, 0, 400, 0, 0, height, 0x20, 8, 8, first, first + len(glyphs) - 1, 0, 0, 0, 0, face_at, 0, at)
    return head.ljust(table_at, b"\0") + table + body + face.encode("latin-1") + b"\0"
