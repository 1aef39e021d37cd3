"""Parsers against encoders written apart from them, external vectors, hand-made bytes, and truncation at every length."""

import json
import random
import struct
import zlib

import numpy as np
import pytest

from binweave.codecs import compressed
from binweave.codecs.bits import Bits, PrefixCode, canonical_codes
from binweave.codecs.lzx import Lzx
from binweave.formats import clr, debug, disks, ne, pe, pictures, synth
from binweave.formats.reader import FormatError, View
from binweave.sources.files import cbor

R = random.Random(11)
TEXT = b"".join(R.choice([b"the ", b"quick ", b"brown ", b"fox\n", bytes([R.randrange(256)])]) for _ in range(9000))
SIZES = [b"", b"a", b"abc" * 50, b" " * 700, TEXT, TEXT * 3]

PES = synth.pe_dll([(1, "Alpha", None), (3, None, None), (4, "Beta", "OTHER.Gamma"), (7, "Zed", None), (7, "Yak", None)])
NES = synth.ne_dll(
    [(1, [(1, 16), (0, 32)]), (0, [(0, 0)] * 3), (255, [(1, 48)])], [(b"MOD", 0), (b"First", 1), (b"\xff\xfe", 6)], [(b"Description", 0), (b"Sixth", 6)],
    [(3, 7, 0x30, b"icon"), (8, 1, 0x10, b"font" * 9)], [(b"code" * 5, struct.pack("<BBHHH", 3, 1, 0, 1, 44) + struct.pack("<BBHHH", 3, 2, 4, 2, 13) + struct.pack("<BBHHH", 2, 0, 8, 0xFF, 5) + struct.pack("<BBHHH", 5, 3, 9, 1, 0))], [b"KERNEL", b"USER"], [b"Imported"],
)
FILES = [("A.TXT", b"hello"), ("EMPTY", b""), ("SUB/B.BIN", TEXT[:3000]), ("SUB/C", b"x" * 513)]
TYPES = synth.global_types([struct.pack("<HHH", 1, 1, 0x74), struct.pack("<HH", 0x201, 2) + struct.pack("<HH", 0x1000, 0x74), struct.pack("<H", 0x204) + struct.pack("<HHHH", 0x406, 0x74, 3, 8) + synth.pascal("m") + b"\xf2\xf1" + struct.pack("<HHHH", 0x40C, 3 | 4 << 2, 0x1001, 12) + struct.pack("<H", 0) + synth.pascal("v")])
SYMBOLS = struct.pack("<I", 1) + synth.symbol(0x203, struct.pack("<IHH", 4096, 2, 0x74) + synth.pascal("public")) + synth.symbol(3, struct.pack("<HHi", 0x74, 0x8003, -5) + synth.pascal("five")) + synth.symbol(0x999, b"raw") + synth.symbol(0x205, struct.pack("<9IHHB", 0, 0, 0, 10, 1, 9, 64, 1, 0, 0, 0, 0)[:28] + struct.pack("<HHB", 1, 2, 3) + synth.pascal("proc"))
DBG = synth.dbg(synth.codeview([(0x125, 1, SYMBOLS), (0x12B, 0, TYPES), (0x127, 1, synth.line_module([("a.c", [(1, [(0, 10), (8, 11)]), (2, [(4, 99)])])])), (0x128, 0, synth.pascal("L1") + synth.pascal("Lib2"))]), ["_a", "_b"], 77)
CLR = synth.clr_pe([b"", synth.clr_container([("n1", 1, b"one"), ("größe", 33, b"\0\1\2"), ("custom", 32, b"")])])
BITMAP = synth.bitmap24(3, 2, bytes(range(18)))
FONT = synth.font2([(9, bytes(range(8))), (3, bytes([1, 2, 3, 4]))], 4)

IMAGES = {
    "pe": (PES, [pe.mz_header, pe.pe_header, pe.pe_sections, pe.pe_directories, pe.pe_export_addresses, pe.pe_export_names, pe.pe_resources]),
    "resources": (synth.pe_with_resources([(3, 1, 1033, b"abc"), (14, 2, 0, b"")]), [pe.pe_resources]),
    "ne": (NES, [ne.ne_header, ne.ne_entries, ne.ne_names, ne.ne_segments, ne.ne_relocations, ne.ne_import_modules, ne.ne_resources]),
    "fat": (synth.fat(FILES, 12), [disks.fat_header, disks.fat_entries, disks.fat_files, disks.fat_extract()]),
    "iso": (synth.iso(FILES), [disks.iso_volume, disks.iso_files, disks.iso_extract(), disks.iso_path_table(), disks.iso_records(), disks.iso_partitions, disks.iso_extended_attributes(20)]),
    "cab": (synth.cab([(n, d) for n, d in FILES], 1), [disks.cab_files, disks.cab_blocks, disks.cab_extract()]),
    "dbg": (DBG, [debug.dbg_header, debug.dbg_sections, debug.dbg_directories, debug.cv_subsections, debug.cv_symbols, debug.cv_types, debug.cv_lines, debug.cv_modules, debug.cv_segment_map, debug.cv_file_index, debug.cv_libraries]),
    "clr": (CLR, [clr.clr_header, clr.clr_resources]),
    "pictures": (BITMAP, [pictures.bitmap(), pictures.bitmap(icon=True)]),
    "icon": (synth.icon1(8, 2, b"\xf0\x0f", b"\xaa\x55"), [pictures.icon1]),
    "font": (FONT, [pictures.font_header, pictures.font_glyphs]),
    "group": (synth.icon_group([(16, 16, 4, 1), (32, 32, 8, 2)]), [pictures.icon_group]),
}


@pytest.mark.parametrize("name", IMAGES)
def test_truncation_gives_rows_or_an_error(name):
    image, parsers = IMAGES[name]
    places = range(len(image)) if len(image) < 6000 else sorted({*range(0, 1200), *R.sample(range(len(image)), 300)})
    for run in parsers:
        for n in places:
            try:
                list(run(image[:n]))
            except FormatError:
                pass


@pytest.mark.parametrize("name", IMAGES)
def test_damaged_bytes_do_not_hang(name):
    image, parsers = IMAGES[name]
    for seed in range(60):
        r = random.Random(seed)
        bad = bytearray(image)
        for _ in range(r.randint(1, 6)):
            bad[r.randrange(min(len(bad), 1500))] = r.randrange(256)
        for run in parsers:
            try:
                for i, _ in enumerate(run(bytes(bad))):
                    if i > 50_000:
                        break
            except Exception as e:  # noqa: BLE001
                assert isinstance(e, (FormatError, ValueError, MemoryError, OverflowError, IndexError)), e


def test_pe_exports():
    assert list(pe.pe_export_addresses(PES)) == [(1, "code", 0x100010, None), (3, "code", 0x100030, None), (4, "forwarder", None, "OTHER.Gamma"), (7, "code", 0x100070, None)]
    assert [r[1:] for r in pe.pe_export_names(PES)] == [("Alpha", 1), ("Beta", 4), ("Yak", 7), ("Zed", 7)]
    assert list(pe.pe_export_names(synth.pe_file([(b".t", 0x1000, b"x", 1)]))) == []


def test_pe_fields_at_fixed_places():
    v = View(PES)
    assert PES[v.u32(60) :][:4] == b"PE\0\0" and next(iter(pe.pe_header(PES)))[:3] == (0x14C, 1, 0)
    wide = next(iter(pe.pe_header(synth.pe_file([(b".t", 0x1000, b"x", 1)], wide=True))))
    assert int(wide[6]) == 0x20B and int(wide[15]) == 0x180000000


def test_ne_tables():
    assert [(r[0], r[2], r[3], r[6]) for r in ne.ne_entries(NES)] == [(0, "fixed", 1, 2), (0, "fixed", 0, 2), (1, "unused", None, 3), (2, "moveable", 1, 1)]
    assert list(ne.ne_names(NES)) == [("resident", 0, b"MOD", 0), ("resident", 1, b"First", 1), ("resident", 2, b"\xff\xfe", 6), ("nonresident", 0, b"Description", 0), ("nonresident", 1, b"Sixth", 6)]
    assert [r[4:] for r in ne.ne_relocations(NES)] == [("import_ordinal", None, None, 1, 44, None, None), ("import_name", None, None, 2, None, 13, None), ("internal_moveable", None, 5, None, None, None, None), ("os_fixup", None, None, None, None, None, 1)]
    assert [(r[0] - 0x8000, r[2] - 0x8000, r[7].rstrip(b"\0")) for r in ne.ne_resources(NES)] == [(3, 7, b"icon"), (8, 1, b"font" * 9)]


@pytest.mark.parametrize("data", SIZES, ids=len)
def test_codecs(data):
    assert compressed.expand(synth.szdd(data)) == data
    assert compressed.expand(synth.sz(data)) == data
    for m in range(5):
        assert compressed.expand(synth.kwaj(data, m)) == data, m
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    assert compressed.inflate(c.compress(data) + c.flush()) == data
    decoder, out = Lzx(15), b""
    for frame, n in synth.lzx_stored(data):
        out += decoder.frame(frame, n)
    assert out == data


def test_lzss_against_hand_made_bytes():
    # Literals A and B, then a match of three from where they stand in the window.
    raw = bytes.fromhex("535A444488F02733") + b"A_" + struct.pack("<I", 5) + bytes([0b011]) + b"AB" + bytes([0xF0, 0xF0])
    assert compressed.szdd(raw) == b"ABABA"
    spaces = bytes.fromhex("535A444488F02733") + b"A_" + struct.pack("<I", 4) + bytes([0]) + bytes([0, 1])
    assert compressed.szdd(spaces) == b"    "


def test_lzx_verbatim_block():
    """One verbatim block made by hand: literal a, then a match of the repeated offset 1."""
    bits = []

    def put(v, n):
        bits.extend(v >> k & 1 for k in range(n - 1, -1, -1))

    put(0, 1)
    put(1, 3)
    put(0, 8), put(6, 16)

    def tree(lengths, low, high):
        # Pre-code: symbols 0, 16 (17 - 1), 17 and 18 with two bits each.
        pre = [0] * 20
        for s in (0, 16, 17, 18):
            pre[s] = 2
        for n in pre:
            put(n, 4)
        code = {0: 0, 16: 1, 17: 2, 18: 3}
        at = low
        while at < high:
            run = 0
            while at + run < high and not lengths[at + run]:
                run += 1
            if run >= 20:
                n = min(run, 51)
                put(code[18], 2), put(n - 20, 5)
                at += n
            elif run >= 4:
                n = min(run, 19)
                put(code[17], 2), put(n - 4, 4)
                at += n
            elif not lengths[at]:
                put(code[0], 2)
                at += 1
            else:
                assert lengths[at] == 1
                put(code[16], 2)
                at += 1

    main = [0] * (256 + 8 * 30)
    main[ord("a")] = main[256 + 3] = 1  # slot 0, length 5
    tree(main, 0, 256)
    tree(main, 256, len(main))
    tree([0] * 249, 0, 249)
    put(0, 1), put(1, 1)
    bits += [0] * (-len(bits) % 16)
    raw = b"".join(struct.pack("<H", sum(b << 15 - k for k, b in enumerate(bits[j : j + 16]))) for j in range(0, len(bits), 16))
    assert Lzx(15).frame(raw, 6) == b"aaaaaa"


def test_canonical_codes():
    assert canonical_codes([2, 1, 3, 3]) == {1: (0, 1), 0: (2, 2), 2: (6, 3), 3: (7, 3)}
    code = PrefixCode({"A": (3, 2), "B": (0, 1), "C": (5, 3), "D": (4, 3)})
    assert [code.read(Bits(b"\xd8\x00", msb=True)) for _ in range(1)] == ["A"]
    with pytest.raises(FormatError):
        PrefixCode.canonical([1, 2])


def test_lzh_over_the_limit_is_an_error(monkeypatch):
    raw = synth.kwaj(b"x" * 1000, 3)
    monkeypatch.setattr(compressed, "MAX_OUTPUT", 1000)
    assert compressed.kwaj(raw) == b"x" * 1000
    monkeypatch.setattr(compressed, "MAX_OUTPUT", 900)
    with pytest.raises(FormatError, match="too long"):
        compressed.kwaj(raw)


def test_compat_offset_of_kwaj():
    # A method byte, then two bytes big-endian; so a usual file whose data begin at 14 reads the same both ways.
    assert compressed.kwaj(bytes.fromhex("4B57414A88F027D1") + b"\0" + struct.pack(">H", 16) + bytes(5) + b"data", compat=True) == b"data"
    for method in (0, 1, 3):
        assert compressed.kwaj(synth.kwaj(b"some data", method), compat=True) == compressed.kwaj(synth.kwaj(b"some data", method)) == b"some data"
    with pytest.raises(FormatError, match="past the end"):
        compressed.kwaj(synth.kwaj(b"", 0)[:11] + b"\xff" * 3)


@pytest.mark.parametrize("bits", [12, 16, 32])
def test_fat(bits):
    image = synth.fat(FILES, bits, fragmented=bits != 32)
    assert next(iter(disks.fat_header(image)))[0] == bits
    assert sorted(disks.fat_extract()(image)) == sorted(FILES)
    assert len(list(disks.fat_extract(frozenset(["A.TXT"]), padded=True)(image))[0][1]) == 512


def test_fat_cycle_is_an_error():
    image = bytearray(synth.fat([("A.TXT", b"x" * 1500)], 12))
    image[512 + 3 : 512 + 6] = bytes([0x03, 0x20, 0x00])
    with pytest.raises(FormatError):
        list(disks.fat_extract()(bytes(image)))


@pytest.mark.parametrize("sierra", [False, True])
def test_discs(sierra):
    many = [*FILES, *[(f"F{i}.DAT", bytes([i]) * i) for i in range(90)]]
    assert sorted(disks.iso_extract()(synth.iso(many, sierra))) == sorted((f"{n};1", d) for n, d in many)
    assert next(iter(disks.iso_volume(synth.iso(FILES, sierra))))[:5] == (sierra, 1, 1, "SYNTH", "VOLUME")


@pytest.mark.parametrize("sierra", [False, True])
def test_disc_records(sierra):
    image = synth.iso(FILES, sierra)
    rows = list(disks.iso_records()(image))
    assert [r[8] for r in rows] == [b"\0", b"\1", b"A.TXT;1", b"EMPTY;1", b"SUB"] and rows[2][2] == 5 and rows[4][4] & 2
    sub = list(disks.iso_records(rows[4][1])(image))
    assert [r[8] for r in sub[2:]] == [b"B.BIN;1", b"C;1"]
    assert list(disks.iso_partitions(image)) == []
    shift = 8 if sierra else 0
    descriptor = bytearray(2048)
    descriptor[shift], descriptor[shift + 6] = 3, 1
    descriptor[shift + 8 : shift + 40], descriptor[shift + 40 : shift + 72] = b"SYS".ljust(32), b"PART".ljust(32)
    descriptor[shift + 72 : shift + 76], descriptor[shift + 80 : shift + 84] = struct.pack("<I", 9), struct.pack("<I", 4)
    changed = image[:0x8800] + bytes(descriptor) + image[0x8800 : 0x9000] + image[0x9800:]
    assert list(disks.iso_partitions(changed)) == [(1, 1, "SYS", "PART", 9, 4)]


def test_extended_attributes():
    image = bytearray(synth.iso(FILES) + bytes(2048))
    record = struct.pack("<H", 7) + struct.pack(">H", 7) + struct.pack("<H", 8) + struct.pack(">H", 8) + struct.pack(">H", 0x0011)
    record += b"".join(f"200104010230420{i}".encode() + b"\0" for i in range(4)) + bytes([1, 2]) + struct.pack("<H", 80) + struct.pack(">H", 80) + b"SYS".ljust(32)
    image[-2048 : -2048 + len(record)] = record
    block = len(image) // 2048 - 1
    assert list(disks.iso_extended_attributes(block)(bytes(image)))[0][:8] == (7, 8, 0x11, "2001040102304200", "2001040102304201", "2001040102304202", "2001040102304203", 1)


@pytest.mark.parametrize("method", [0, 1, 3])
def test_cabinets(method):
    files = [("a\\b.txt", b"one"), ("größe.txt", TEXT * 2), ("empty", b""), ("a\\b.txt", b"two")]
    image = synth.cab(files, method, (5, 3, 2))
    assert dict(disks.cab_extract()(image)) == {"a\\b.txt": b"two", "größe.txt": TEXT * 2, "empty": b""}
    assert list(disks.cab_extract(frozenset(["empty"]))(image)) == [("empty", b"")]
    assert sum(b[4] for b in disks.cab_blocks(image)) == sum(len(d) for _, d in files)


def test_spanned_and_unknown_cabinets():
    with pytest.raises(FormatError, match="spans"):
        list(disks.cab_extract()(synth.cab([("a", b"1")], spanned=True)))
    image = bytearray(synth.cab([("a", b"1")]))
    image[42] = 2
    with pytest.raises(FormatError, match="quantum"):
        list(disks.cab_extract()(bytes(image)))


def test_debug_tables():
    assert list(debug.dbg_header(DBG))[0][-1] == ["_a", "_b"]
    rows = list(debug.cv_symbols(DBG))
    assert [(r[2], r[4], r[6]) for r in rows] == [("PublicData32", 4096, "public"), ("Constant", None, "five"), ("Other", None, None), ("GlobalProcedure32", 64, "proc")]
    assert json.loads(rows[1][7])["value"] == -5
    types = {r[0]: (r[2], json.loads(r[3])) for r in debug.cv_types(DBG)}
    assert types[0x1001] == ("ArgumentList", {"types": [0x1000, 0x74]})
    members = types[0x1002][1]["members"]
    assert [m["leaf"] for m in members] == ["DataMember", "OneMethod"] and members[0]["offset"] == 8 and members[1]["name"] == "v"
    assert list(debug.cv_lines(DBG)) == [("a.c", 1, 0, 10), ("a.c", 1, 8, 11), ("a.c", 2, 4, 99)]
    assert [n for _, n in debug.cv_libraries(DBG)] == ["L1", "Lib2"]


def test_numeric_leaves():
    for raw, value in ((b"\x05\x00", 5), (b"\x00\x80\xff", -1), (b"\x02\x80\xff\xff", 65535), (b"\x06\x80" + struct.pack("<d", 1.5), 1.5), (b"\x10\x80\x02\x00ab", "ab"), (b"\x0a\x80" + b"\xff" * 8, 2**64 - 1)):
        assert debug.numeric(View(raw), 0) == (value, len(raw))
    with pytest.raises(FormatError):
        debug.numeric(View(b"\x20\x80"), 0)


def test_managed_resources():
    assert [(r[0], r[2], r[6], r[7]) for r in clr.clr_resources(CLR)] == [(1, "n1", "String", b"one"), (1, "größe", "Stream", b"\0\1\2"), (1, "custom", "ByteArray", b"")]
    assert [r[6] for r in clr.clr_header(CLR)][1] == "resources"
    assert clr.varint(View(b"\x80\x01"), 0) == (128, 2)
    with pytest.raises(FormatError):
        clr.varint(View(b"\x80\x00"), 0)


def unpng(raw):
    at, out, head = 8, b"", None
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        out += body if kind == b"IDAT" else b""
        at += 12 + n
    return head, zlib.decompress(out)


def test_pictures():
    w, h, bits, _, rgba = next(iter(pictures.bitmap()(BITMAP)))
    want = b"".join(bytes(range(3 * i, 3 * i + 3)) + b"\xff" for i in range(6))
    assert (w, h, bits, rgba) == (3, 2, 24, want)
    head, rows = unpng(pictures.rgba_png(rgba, 3, 2))
    assert head[:4] == (3, 2, 8, 6) and rows == b"\0" + want[:12] + b"\0" + want[12:]
    kind, w, h, a, x = next(iter(pictures.icon1(synth.icon1(8, 2, b"\xf0\x0f", b"\xaa\x55"))))
    assert pictures.ascii_art(a, x, w, h).splitlines()[:4] == ["+--------+", "|@@@@    |", "|    @@@@|", "+--------+"]
    assert pictures.sixel(b"\xf0\x0f", 8, 2) == "\x1bPq@@@@AAAA\x1b\\"
    head, rows = unpng(pictures.icon1_png(a, x, w, h))
    assert head[:4] == (8, 2, 2, 3) and rows[1:3] == bytes([0b00000000, 0b10011001])


def test_paletted_icon_with_mask():
    head = struct.pack("<IiiHHIIiiII", 40, 2, 4, 1, 1, 0, 0, 0, 0, 0, 0) + bytes([1, 2, 3, 0, 4, 5, 6, 0])
    raw = head + b"\x40\0\0\0" + b"\x80\0\0\0" + b"\x80\0\0\0" + b"\0\0\0\0"
    rgba = np.frombuffer(next(iter(pictures.bitmap(icon=True)(raw)))[4], dtype=np.uint8).reshape(2, 2, 4)
    assert rgba[0].tolist() == [[6, 5, 4, 255], [3, 2, 1, 255]] and rgba[1].tolist() == [[3, 2, 1, 0], [6, 5, 4, 255]]


def test_fonts():
    assert list(pictures.font_glyphs(FONT)) == [(32, 9, bytes(range(8))), (33, 3, bytes([1, 2, 3, 4]))]
    bdf = pictures.to_bdf(FONT)
    assert "CHARS 2\n" in bdf and "ENCODING 33\n" in bdf and "BITMAP\n0001\n0203\n" in bdf and bdf.endswith("ENDFONT\n")
    assert "char 32\nwidth 9\n000000000\n" in pictures.to_fd(FONT)


def test_cbor():
    assert cbor({"a": [1, -1, 300, None, True, b"\1", 1.5]}).hex() == "a161618701201" + "9012cf6f54101fb3ff8000000000000"
