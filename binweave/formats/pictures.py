"""Icons, bitmaps and bitmap fonts: parsers, and their text and PNG forms."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from binweave.formats.reader import FormatError, View

ICON_GROUP_SCHEMA = "group_type int, pos int, width int, height int, color_count int, planes int, bit_count int, byte_count bigint, id int"
ICON1_SCHEMA = "variant string, width int, height int, and_plane binary, xor_plane binary"
BITMAP_SCHEMA = "width int, height int, bit_count int, colors int, rgba binary"
FONT_SCHEMA = (
    "version int, size bigint, copyright string, font_type int, point_size int, vertical_dpi int, horizontal_dpi int, ascent int, internal_leading int, external_leading int, italic int, underline int, strike_out int, "
    "weight int, char_set int, pixel_width int, pixel_height int, family int, average_width int, max_width int, first_char int, last_char int, default_char int, break_char int, device_name string, face_name string"
)
GLYPH_SCHEMA = "char_code int, width int, bitmap binary"


def icon_group(data: bytes) -> Iterator[tuple]:
    v = View(data)
    _, kind, count = v.unpack(0, "HHH")
    for i in range(count):
        w, h, colors, _, planes, bits, size, own = v.unpack(6 + 14 * i, "BBBBHHIH")
        yield kind, i, w, h, colors, planes, bits, size, own


def icon1(data: bytes) -> Iterator[tuple]:
    """Icons of the first format: device independent, device dependent, or both; two planes of one bit per pixel."""
    v = View(data)
    kind = v.u8(1)
    names = {0: "independent", 1: "dependent", 2: "both"}
    if v.u8(0) != 1 or kind not in names:
        raise FormatError("no icon of the first format")
    at = 2
    for name in ("independent", "dependent") if kind == 2 else (names[kind],):
        _, _, width, height, stride, _ = v.unpack(at, "6H")
        size = stride * height
        yield name, width, height, v.take(at + 12, size), v.take(at + 12 + size, size)
        at += 12 + 2 * size


def planes_to_bits(plane: bytes, width: int, height: int) -> np.ndarray:
    """Rows of bits, most significant first; padding at the end of rows is cut."""
    stride = len(plane) // height if height else 0
    return np.unpackbits(np.frombuffer(plane, dtype=np.uint8)[: stride * height].reshape(height, stride), axis=1)[:, :width]


def ascii_art(and_plane: bytes, xor_plane: bytes, width: int, height: int) -> str:
    """Both planes in frames, @ for a set bit."""
    out = []
    for plane in (and_plane, xor_plane):
        edge = f"+{'-' * width}+"
        out += [edge, *("|" + "".join("@" if b else " " for b in row) + "|" for row in planes_to_bits(plane, width, height)), edge]
    return "\n".join(out) + "\n"


def sixel(plane: bytes, width: int, height: int) -> str:
    """A plane as sixels: bands of six rows, each column one character."""
    bits = planes_to_bits(plane, width, height)
    bands = []
    for top in range(0, height, 6):
        band = bits[top : top + 6]
        value = (band.astype(int) << np.arange(len(band))[:, None]).sum(axis=0)
        bands.append("".join(chr(63 + v) for v in value))
    return "\x1bPq" + "$-".join(bands) + "\x1b\\"


def png(width: int, height: int, rows: bytes, depth: int, color: int, palette: bytes = b"", clear: bytes = b"") -> bytes:
    """A PNG file of packed rows without filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    stride = len(rows) // height if height else 0
    packed = b"".join(b"\0" + rows[i * stride : (i + 1) * stride] for i in range(height))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0))
    if palette:
        out += chunk(b"PLTE", palette)
    if clear:
        out += chunk(b"tRNS", clear)
    return out + chunk(b"IDAT", zlib.compress(packed, 9)) + chunk(b"IEND", b"")


def icon1_png(and_plane: bytes, xor_plane: bytes, width: int, height: int) -> bytes:
    """Two bits per pixel, indexed: 0 clear, 1 black, 2 white."""
    clear, white = planes_to_bits(and_plane, width, height), planes_to_bits(xor_plane, width, height)
    index = np.where(clear == 1, 0, np.where(white == 1, 2, 1)).astype(np.uint8)
    two = np.stack([index >> 1, index & 1], axis=2).reshape(height, 2 * width)
    return png(width, height, np.packbits(two, axis=1).tobytes(), 2, 3, b"\0\0\0\0\0\0\xff\xff\xff", b"\0")


def rgba_png(rgba: bytes, width: int, height: int) -> bytes:
    return png(width, height, rgba, 8, 6)


def bitmap(icon: bool = False):
    """Uncompressed device-independent bitmaps to RGBA, top row first. An icon holds a one-bit mask below its image, which makes
    pixels clear; its stated height counts both."""

    def run(data: bytes) -> Iterator[tuple]:
        v = View(data)
        size, width, tall, _, bits, method = v.unpack(0, "IiiHHI")
        used = v.u32(32)
        if size != 40 or method not in (0,) or bits not in (1, 4, 8, 16, 24, 32):
            raise FormatError("not an uncompressed bitmap with the usual header")
        height = abs(tall) // 2 if icon else abs(tall)
        if width <= 0 or width * height > 1 << 26:
            raise FormatError("bitmap too large")
        colors = (used or 1 << bits) if bits <= 8 else used
        at = 40 + 4 * colors
        palette = np.frombuffer(v.take(40, 4 * colors), dtype=np.uint8).reshape(-1, 4)[:, 2::-1] if colors else np.zeros((0, 3), dtype=np.uint8)
        stride = (width * bits + 31) // 32 * 4
        rows = np.frombuffer(v.take(at, stride * height), dtype=np.uint8).reshape(height, stride)
        out = np.full((height, width, 4), 255, dtype=np.uint8)
        if bits <= 8:
            each = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
            index = (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2)[:, :width]
            if index.size and index.max() >= len(palette):
                raise FormatError("colour outside the palette")
            out[:, :, :3] = palette[index]
        elif bits == 16:
            px = rows[:, : 2 * width].copy().view("<u2").astype(np.uint32)
            for k, shift in enumerate((10, 5, 0)):
                out[:, :, k] = (px >> shift & 31) * 255 // 31
        else:
            px = rows[:, : width * bits // 8].reshape(height, width, bits // 8)
            out[:, :, :3] = px[:, :, 2::-1]
        if icon:
            mask_stride = (width + 31) // 32 * 4
            mask = np.frombuffer(v.take(at + stride * height, mask_stride * height), dtype=np.uint8).reshape(height, mask_stride)
            out[:, :, 3] = np.where(np.unpackbits(mask, axis=1)[:, :width] == 1, 0, 255)
        if tall > 0:
            out = out[::-1]
        yield width, height, bits, colors, out.tobytes()

    return run


class Font:
    """A font resource of version 1, 2 or 3."""

    def __init__(self, data: bytes):
        v = self.view = View(data)
        self.version, self.size = v.unpack(0, "HI")
        if self.version not in (0x100, 0x200, 0x300):
            raise FormatError("unknown font version")
        self.copyright = v.take(6, 60).split(b"\0")[0].decode("latin-1")
        f = v.unpack(66, "7H3BHBHHBHHBBBBHIIII")
        (self.kind, self.points, self.vertical, self.horizontal, self.ascent, self.leading, self.external, self.italic, self.underline, self.strike, self.weight, self.char_set, self.width, self.height, self.family, self.average, self.widest, self.first, self.last, self.default, self.breaks, self.stride, self.device_at, self.face_at, self.bits_at, self.bits_offset) = f
        if self.last < self.first:
            raise FormatError("no characters")

    def text(self, at: int) -> str | None:
        return self.view.zstr(at).decode("latin-1") if at else None

    def glyphs(self) -> Iterator[tuple[int, int, bytes]]:
        """(code, width, rows): columns of bytes are turned into rows of bits, left-aligned."""
        v, count = self.view, self.last - self.first + 1
        if self.version == 0x100:
            fixed = self.width
            table = [v.u16(117 + 2 * i) for i in range(count + 1)] if not fixed else [fixed * i for i in range(count + 1)]
            strip = np.unpackbits(np.frombuffer(v.take(self.bits_offset, self.stride * self.height), dtype=np.uint8).reshape(self.height, self.stride), axis=1)
            for i in range(count):
                own = strip[:, table[i] : table[i + 1]]
                yield self.first + i, table[i + 1] - table[i], np.packbits(own, axis=1).tobytes()
            return
        start, step, layout = (118, 4, "HH") if self.version == 0x200 else (148, 6, "HI")
        for i in range(count):
            width, at = v.unpack(start + step * i, layout)
            columns = -(-width // 8)
            raw = np.frombuffer(v.take(at, columns * self.height), dtype=np.uint8).reshape(columns, self.height)
            yield self.first + i, width, raw.T.tobytes()


def font_header(data: bytes) -> Iterator[tuple]:
    f = Font(data)
    yield (f.version, f.size, f.copyright, f.kind, f.points, f.vertical, f.horizontal, f.ascent, f.leading, f.external, f.italic, f.underline, f.strike, f.weight, f.char_set, f.width, f.height, f.family >> 4, f.average, f.widest, f.first, f.last, f.default, f.breaks, f.text(f.device_at), f.text(f.face_at))


def font_glyphs(data: bytes) -> Iterator[tuple]:
    yield from Font(data).glyphs()


def _rows(bitmap_: bytes, height: int) -> list[bytes]:
    n = len(bitmap_) // height if height else 0
    return [bitmap_[i * n : (i + 1) * n] for i in range(height)]


def to_bdf(data: bytes) -> str:
    """The font in the BDF text format."""
    f = Font(data)
    glyphs = list(f.glyphs())
    widest = max((w for _, w, _ in glyphs), default=0)
    face = f.text(f.face_at) or ""
    descent = f.height - f.ascent
    out = ["STARTFONT 2.1", f"FONT {face}", f"SIZE {f.points} {f.horizontal} {f.vertical}", f"FONTBOUNDINGBOX {widest} {f.height} 0 {-descent}"]
    props = [f'COPYRIGHT "{f.copyright}"', f"FONT_ASCENT {f.ascent}", f"FONT_DESCENT {descent}", f"DEFAULT_CHAR {f.first + f.default}"]
    out += [f"STARTPROPERTIES {len(props)}", *props, "ENDPROPERTIES", f"CHARS {len(glyphs)}"]
    for code, width, rows in glyphs:
        scaled = 72000 * width // (f.horizontal or 72)
        out += [f"STARTCHAR char{code}", f"ENCODING {code}", f"SWIDTH {scaled} 0", f"DWIDTH {width} 0", f"BBX {width} {f.height} 0 {-descent}", "BITMAP", *(r.hex().upper() for r in _rows(rows, f.height)), "ENDCHAR"]
    return "\n".join([*out, "ENDFONT", ""])


def to_fd(data: bytes) -> str:
    """The font in the FD text format of glyphs drawn with digits."""
    f = Font(data)
    yes = lambda b: "yes" if b else "no"
    out = [f"facename {f.text(f.face_at) or ''}", f"copyright {f.copyright}", "", f"height {f.height}", f"ascent {f.ascent}", f"pointsize {f.points}", f"italic {yes(f.italic)}", f"underline {yes(f.underline)}", f"strikeout {yes(f.strike)}", f"weight {f.weight}", f"charset {f.char_set}", ""]
    for code, width, rows in f.glyphs():
        out += [f"char {code}", f"width {width}"]
        out += ["".join(str(b) for b in np.unpackbits(np.frombuffer(r, dtype=np.uint8))[:width]) for r in _rows(rows, f.height)]
        out.append("")
    return "\n".join(out)
