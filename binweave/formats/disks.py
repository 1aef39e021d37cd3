"""FAT disk images, ISO 9660 and High Sierra discs, and cabinets: headers, directories and members, as rows.

The *_files parsers read directories only; the *_extract parsers yield the bytes of the wanted members. Every folder of a
cabinet is decompressed once, whatever the number of its members. Chains and directories are guarded against cycles.
"""

from __future__ import annotations

from collections.abc import Iterator

from binweave.codecs.compressed import mszip_block
from binweave.codecs.lzx import Lzx
from binweave.formats.reader import FormatError, View

MAX_DEPTH = 64

FAT_HEADER_SCHEMA = "variant int, bytes_per_sector int, sectors_per_cluster int, reserved_sectors int, fat_count int, root_entries int, total_sectors bigint, media int, sectors_per_fat bigint, sectors_per_track int, heads int, hidden_sectors bigint, label string"
FAT_ENTRY_SCHEMA = "cluster bigint, kind string, next bigint"
FAT_FILE_SCHEMA = "file_path string, attributes int, first_cluster bigint, size bigint, created_time int, created_date int, modified_time int, modified_date int"
MEMBER_SCHEMA = "file_path string, data binary"
MEMBER_OR_ERROR_SCHEMA = "file_path string, data binary, member_error string"
ISO_FILE_SCHEMA = "file_path string, offset bigint, size bigint"
VOLUME_SCHEMA = "high_sierra boolean, kind int, version int, system_id string, volume_id string, space_size bigint, block_size int, path_table_size bigint, root_location bigint, root_size bigint, volume_set_id string, publisher_id string, preparer_id string, application_id string, created string, modified string"
CAB_FILE_SCHEMA = "pos int, file_path string, folder_index int, offset bigint, size bigint, date int, time int, attributes int, method string"
CAB_BLOCK_SCHEMA = "folder_index int, pos int, checksum bigint, compressed int, uncompressed int, data_offset bigint"


def _extracted(members: Iterator[tuple], errors: bool) -> Iterator[tuple]:
    """Of (name, data, error) all rows with errors=True; else the sound members, and after the last of them the first error."""
    failed = None
    for name, data, error in members:
        if errors:
            yield name, data, error
        elif error is None:
            yield name, data
        else:
            failed = failed or f"{name}: {error}"
    if failed:
        raise FormatError(failed)


class Fat:
    def __init__(self, data: bytes):
        v = self.view = View(data)
        if not (v.u8(0) == 0xEB and v.u8(2) == 0x90 or v.u8(0) == 0xE9):
            raise FormatError("no boot jump")
        self.sector, self.per_cluster, self.reserved, self.fats, self.roots, small, self.media, size, self.track, self.heads, self.hidden, large = v.unpack(11, "HBHBHHBHHHII")
        if not self.sector or not self.per_cluster or self.sector & (self.sector - 1):
            raise FormatError("no sector or cluster size")
        self.sectors = small or large
        self.fat_size = size or v.u32(36)
        clusters = self.sectors // self.per_cluster
        self.bits = 12 if clusters < 4087 else 16 if clusters < 65526 else 32
        self.fat_at = self.reserved * self.sector
        self.root_at = self.fat_at + self.fats * self.fat_size * self.sector
        self.data_at = self.root_at + -(-self.roots * 32 // self.sector) * self.sector
        self.cluster_size = self.sector * self.per_cluster
        self.table = v.take(self.fat_at, min(self.fat_size * self.sector, max(len(v) - self.fat_at, 0)))

    def entry(self, k: int) -> int:
        t = View(self.table)
        if self.bits == 12:
            pair = t.u16(k * 3 // 2)
            return pair >> 4 if k & 1 else pair & 0xFFF
        return t.u16(2 * k) if self.bits == 16 else t.u32(4 * k) & 0x0FFFFFFF

    def kind(self, value: int) -> str:
        top = {12: 0xFFF, 16: 0xFFFF, 32: 0x0FFFFFFF}[self.bits]
        if value == 0:
            return "empty"
        return "sentinel" if value >= top - 7 else "bad" if value == top - 8 else "chain"

    def chain(self, first: int) -> list[int]:
        """Clusters from the first up to the end mark; an empty entry ends the chain, a bad one is an error."""
        out, seen = [], set()
        while first >= 2:
            if first in seen:
                raise FormatError("cycle of clusters")
            seen.add(first)
            out.append(first)
            following = self.entry(first)
            kind = self.kind(following)
            if kind == "bad":
                raise FormatError("bad cluster in a chain")
            if kind != "chain":
                break
            first = following
        return out

    def bytes_of(self, first: int) -> bytes:
        return b"".join(self.view.take(self.data_at + (c - 2) * self.cluster_size, self.cluster_size) for c in self.chain(first))

    def root(self) -> bytes:
        return self.bytes_of(self.view.u32(44)) if self.bits == 32 else self.view.take(self.root_at, self.roots * 32)

    def files(self, listing: bytes, path: str = "", above: frozenset[int] = frozenset(), errors: bool = False) -> Iterator[tuple]:
        """Rows of FAT_FILE_SCHEMA. With errors=True a folder that cannot be read gives (path, error) and the rest goes on."""
        for at in range(0, len(listing) - 31, 32):
            raw = listing[at : at + 32]
            if not raw[0]:
                return
            attributes = raw[11]
            if raw[0] == 0xE5 or attributes & 0x08 or raw[:1] == b".":
                continue
            v = View(raw)
            stem, ext = (b"\xe5" + raw[1:8] if raw[0] == 5 else raw[:8]).decode("latin-1").rstrip(" "), raw[8:11].decode("latin-1").rstrip(" ")
            name = f"{path}{stem}.{ext}" if ext else f"{path}{stem}"
            first = v.u16(20) << 16 | v.u16(26) if self.bits == 32 else v.u16(26)
            if attributes & 0x10:
                try:
                    if first in above or len(above) > MAX_DEPTH:
                        raise FormatError("cycle of folders")
                    inner = self.bytes_of(first)
                except FormatError as e:
                    if not errors:
                        raise
                    yield f"{name}/", str(e)
                    continue
                yield from self.files(inner, f"{name}/", above | {first}, errors)
            else:
                yield name, attributes, first, v.u32(28), v.u16(14), v.u16(16), v.u16(22), v.u16(24)


def fat_header(data: bytes) -> Iterator[tuple]:
    f = Fat(data)
    label = f.view.take(71 if f.bits == 32 else 43, 11).decode("latin-1").rstrip(" \0")
    yield f.bits, f.sector, f.per_cluster, f.reserved, f.fats, f.roots, f.sectors, f.media, f.fat_size, f.track, f.heads, f.hidden, label


def fat_entries(data: bytes) -> Iterator[tuple]:
    f = Fat(data)
    n = min(len(f.table) * 8 // f.bits, max(f.sectors - f.data_at // f.sector, 0) // f.per_cluster + 2)
    for k in range(n):
        value = f.entry(k)
        kind = "media" if k == 0 else "sentinel" if k == 1 else f.kind(value)
        yield k, kind, value if kind == "chain" else None


def fat_files(data: bytes) -> Iterator[tuple]:
    f = Fat(data)
    yield from f.files(f.root())


def fat_extract(wanted: frozenset[str] | None = None, padded: bool = False, errors: bool = False):
    """Members cut to their size; padded keeps the rest of the last cluster. errors: see _extracted."""

    def members(data: bytes) -> Iterator[tuple]:
        f = Fat(data)
        for name, *rest in f.files(f.root(), errors=True):
            if len(rest) == 1:
                yield name, None, rest[0]
            elif wanted is None or name in wanted:
                try:
                    raw = f.bytes_of(rest[1]) if rest[1] else b""
                except FormatError as e:
                    yield name, None, str(e)
                else:
                    yield name, raw if padded else raw[: rest[2]], None

    return lambda data: _extracted(members(data), errors)


class Disc:
    """The first descriptor at sector 16; High Sierra discs have their fields eight bytes later."""

    def __init__(self, data: bytes):
        v = self.view = View(data)
        base = 0x8000
        if v.take(base + 1, 5) == b"CD001":
            self.sierra, shift = False, 0
        elif v.take(base + 9, 5) == b"CDROM":
            self.sierra, shift = True, 8
        else:
            raise FormatError("no disc descriptor")
        self.base, self.at = base, base + shift
        self.kind, self.version = v.u8(self.at), v.u8(self.at + 6)
        self.block = v.u16(self.at + 128)
        self.root_record = self.at + (172 if self.sierra else 156)
        if not self.block:
            raise FormatError("no block size")

    def text(self, at: int, size: int) -> str:
        return self.view.take(self.at + at, size).decode("latin-1").rstrip(" \0")

    def files(self, errors: bool = False) -> Iterator[tuple]:
        """Rows of ISO_FILE_SCHEMA. With errors=True a folder that cannot be read gives (path, error) and the rest goes on."""
        v = self.view
        stack, seen = [("", v.u32(self.root_record + 2), v.u32(self.root_record + 10), 0)], set()
        while stack:
            path, extent, size, depth = stack.pop()
            try:
                if extent in seen or depth > MAX_DEPTH:
                    raise FormatError("cycle of folders")
                seen.add(extent)
                at, end = extent * self.block, extent * self.block + size
                while at < end:
                    length = v.u8(at)
                    if not length:
                        at = (at // self.block + 1) * self.block
                        continue
                    flags, name = v.u8(at + (24 if self.sierra else 25)), v.take(at + 33, v.u8(at + 32))
                    if name not in (b"\0", b"\1"):
                        own = path + name.decode("latin-1")
                        place, count = v.u32(at + 2), v.u32(at + 10)
                        if flags & 2:
                            stack.append((f"{own}/", place, count, depth + 1))
                        else:
                            yield own, place * self.block, count
                    at += length
            except FormatError as e:
                if not errors:
                    raise
                yield path, str(e)


def iso_volume(data: bytes) -> Iterator[tuple]:
    d = Disc(data)
    v, s = d.view, d.sierra
    size, table, texts, stamps = d.at + 80, d.at + 132, 214 if s else 190, (d.at + (782 if s else 813))
    width = 16 if s else 17
    names = [d.text(texts + 128 * i, 128) for i in range(4)]
    yield s, d.kind, d.version, d.text(8, 32), d.text(40, 32), v.u32(size), d.block, v.u32(table), v.u32(d.root_record + 2), v.u32(d.root_record + 10), *names, v.take(stamps, 16).decode("latin-1"), v.take(stamps + width, 16).decode("latin-1")


def iso_files(data: bytes) -> Iterator[tuple]:
    yield from Disc(data).files()


DIRECTORY_RECORD_SCHEMA = "pos int, extent bigint, size bigint, recorded binary, flags int, unit_size int, gap_size int, sequence int, name binary, system_use binary, extended_length int"
PARTITION_SCHEMA = "pos int, version int, system_id string, partition_id string, location bigint, size bigint"
EXTENDED_SCHEMA = "owner int, group_id int, permissions int, created string, modified string, expires string, effective string, record_format int, record_attributes int, record_length int, system_id string, version int, escape_length int, application_length int"


def iso_records(extent: int | None = None):
    """Raw directory records of the root folder, or of the folder at an extent."""

    def run(data: bytes) -> Iterator[tuple]:
        d = Disc(data)
        v = d.view
        start = v.u32(d.root_record + 2) if extent is None else extent
        at, pos = start * d.block, 0
        # The first record of a folder is its own, with the size of all.
        end = at + v.u32(at + 10)
        while at < end:
            length = v.u8(at)
            if not length:
                at = (at // d.block + 1) * d.block
                continue
            flags_at = at + (24 if d.sierra else 25)
            size = v.u8(at + 32)
            rest = at + 33 + size + (1 - size % 2)
            yield pos, v.u32(at + 2), v.u32(at + 10), v.take(at + 18, 6 if d.sierra else 7), v.u8(flags_at), v.u8(at + 26), v.u8(at + 27), v.u16(at + 28), v.take(at + 33, size), v.take(rest, max(at + length - rest, 0)), v.u8(at + 1)
            at += length
            pos += 1

    return run


def iso_partitions(data: bytes) -> Iterator[tuple]:
    """Partition descriptors among the descriptors from sector 16 up to the end mark, or the end of the data."""
    d = Disc(data)
    shift = 8 if d.sierra else 0
    for pos in range((len(d.view) - d.base) // 2048):
        at = d.base + 2048 * pos + shift
        kind = d.view.u8(at)
        if kind == 255:
            return
        if kind == 3:
            text = lambda a, n: d.view.take(a, n).decode("latin-1").rstrip(" \0")
            yield pos, d.view.u8(at + 6), text(at + 8, 32), text(at + 40, 32), d.view.u32(at + 72), d.view.u32(at + 80)


def iso_extended_attributes(block: int):
    """The extended attribute record at a block, as the directory record of its file places it before the file's data."""

    def run(data: bytes) -> Iterator[tuple]:
        d = Disc(data)
        v, at = d.view, block * d.block
        width = 16 if d.sierra else 17
        stamps = [v.take(at + 10 + width * i, 16).decode("latin-1") for i in range(4)]
        after = at + 10 + 4 * width
        form, attributes = v.unpack(after, "BB")
        yield v.u16(at), v.u16(at + 4), View(v.data, ">").u16(at + 8), *stamps, form, attributes, v.u16(after + 2), v.take(after + 6, 32).decode("latin-1").rstrip(" \0"), v.u8(after + 102), v.u8(after + 103), v.u16(after + 168)

    return run


def iso_path_table(big_endian: bool = False):
    """Rows (pos, name, extent, parent) of the path table in one of its byte orders."""

    def run(data: bytes) -> Iterator[tuple]:
        d = Disc(data)
        size = d.view.u32(d.at + 132)
        place = View(data, ">").u32(d.at + (152 if d.sierra else 148)) if big_endian else d.view.u32(d.at + (140 if d.sierra else 140))
        v, at, pos = View(data, ">" if big_endian else "<"), place * d.block, 1
        end = at + size
        while at < end:
            if d.sierra:
                extent, _, length, parent = v.unpack(at, "IBBH")
            else:
                length, _, extent, parent = v.unpack(at, "BBIH")
            if not length:
                return
            yield pos, v.take(at + 8, length).decode("latin-1"), extent, parent
            at += 8 + length + (length & 1)
            pos += 1

    return run


PATH_TABLE_SCHEMA = "pos int, name string, extent bigint, parent int"


def iso_extract(wanted: frozenset[str] | None = None, errors: bool = False):
    """Members by path. errors: see _extracted."""

    def members(data: bytes) -> Iterator[tuple]:
        d = Disc(data)
        for name, *rest in d.files(errors=True):
            if len(rest) == 1:
                yield name, None, rest[0]
            elif wanted is None or name in wanted:
                try:
                    yield name, d.view.take(*rest), None
                except FormatError as e:
                    yield name, None, str(e)

    return lambda data: _extracted(members(data), errors)


#: Compression methods by the low four bits of their code.
METHODS = {0: "none", 1: "mszip", 2: "quantum", 3: "lzx"}
SPANNED = (0xFFFD, 0xFFFE, 0xFFFF)


class Cab:
    def __init__(self, data: bytes):
        v = self.view = View(data)
        if v.take(0, 4) != b"MSCF":
            raise FormatError("no cabinet magic")
        self.files_at, = v.unpack(16, "I")
        folders, files, flags = v.unpack(26, "HHH")
        at, self.folder_extra, self.block_extra = 36, 0, 0
        if flags & 4:
            header, self.folder_extra, self.block_extra = v.unpack(36, "HBB")
            at = 40 + header
        for bit in (1, 2):
            for _ in range(2 if flags & bit else 0):
                at += len(v.zstr(at)) + 1
        self.folders = []
        for _ in range(folders):
            self.folders.append(v.unpack(at, "IHH"))
            at += 8 + self.folder_extra
        self.files, at = [], self.files_at
        for pos in range(files):
            size, offset, folder, date, time, attributes = v.unpack(at, "IIHHHH")
            raw = v.zstr(at + 16)
            try:
                name = raw.decode("utf-8" if attributes & 0x80 else "latin-1")
            except UnicodeDecodeError:
                raise FormatError("member name is not valid UTF-8") from None
            code = self.folders[folder][2] if folder < len(self.folders) else None
            self.files.append((pos, name, folder, offset, size, date, time, attributes, None if code is None else METHODS.get(code & 15, f"other({code & 15})")))
            at += 17 + len(raw)

    def blocks(self, folder: int) -> Iterator[tuple]:
        at, count, _ = self.folders[folder]
        for pos in range(count):
            checksum, packed, plain = self.view.unpack(at, "IHH")
            yield folder, pos, checksum, packed, plain, at + 8 + self.block_extra
            at += 8 + self.block_extra + packed

    def folder_bytes(self, folder: int, upto: int) -> tuple[bytes, str | None]:
        """The folder's bytes, at least up to a place, and the error that ended them before; blocks behind are not decoded."""
        out = bytearray()
        try:
            code = self.folders[folder][2]
            method = code & 15
            lzx = Lzx(code >> 8 & 31) if method == 3 else None
            for _, _, _, packed, plain, at in self.blocks(folder):
                if len(out) >= upto:
                    break
                raw = self.view.take(at, packed)
                if method == 0:
                    out += raw
                elif method == 1:
                    out += mszip_block(raw, bytes(out[-32768:]))
                elif lzx is not None:
                    out += lzx.frame(raw, plain)
                else:
                    raise FormatError(f"compression method {METHODS.get(method, method)} is not supported")
        except Exception as e:  # noqa: BLE001 - members before the bad block are sound
            return bytes(out), str(e) or type(e).__name__
        return bytes(out), None


def cab_files(data: bytes) -> Iterator[tuple]:
    yield from Cab(data).files


def cab_blocks(data: bytes) -> Iterator[tuple]:
    c = Cab(data)
    for k in range(len(c.folders)):
        yield from c.blocks(k)


def cab_extract(wanted: frozenset[str] | None = None, errors: bool = False):
    """Members by name; of equal names the last holds. A member that spans cabinets is an error. errors: see _extracted."""

    def members(data: bytes) -> Iterator[tuple]:
        c = Cab(data)
        last = {f[1]: f for f in c.files if wanted is None or f[1] in wanted}
        by_folder: dict[int, list] = {}
        for f in last.values():
            if f[2] in SPANNED:
                yield f[1], None, "member spans cabinets"
            elif f[2] >= len(c.folders):
                yield f[1], None, "no such folder"
            else:
                by_folder.setdefault(f[2], []).append(f)
        for folder, files in sorted(by_folder.items()):
            held, error = c.folder_bytes(folder, max(f[3] + f[4] for f in files))
            for f in files:
                if f[3] + f[4] > len(held) or error and not f[4] and not held:
                    yield f[1], None, error or "folder is too short"
                else:
                    yield f[1], held[f[3] : f[3] + f[4]], None

    return lambda data: _extracted(members(data), errors)
