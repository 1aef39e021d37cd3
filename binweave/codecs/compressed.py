"""Single-file compression formats: SZDD, SZ, KWAJ and raw DEFLATE. Each function maps bytes to bytes.

Output is bounded by MAX_OUTPUT, so a hostile file cannot fill a task's memory.
"""

from __future__ import annotations

import zlib

from binweave.codecs.bits import Bits, OutOfData, PrefixCode, Window
from binweave.formats.reader import FormatError, View

#: The first eight bytes of each format.
SZDD, SZ, KWAJ = bytes.fromhex("535A444488F02733"), bytes.fromhex("535A2088F02733D1"), bytes.fromhex("4B57414A88F027D1")
MAX_OUTPUT = 1 << 30


def _lzss(data: bytes, size: int | None, start: int, extra: int = 3) -> bytes:
    """Flag bytes, least bit first: 1 is a literal, 0 a match of 12 bits of place and 4 of length."""
    window, at, end = Window(4096, 0x20, start), 0, len(data)
    limit = MAX_OUTPUT if size is None else size
    held = window.buffer
    while at < end and len(window) < limit:
        flags = data[at]
        at += 1
        if flags == 0xFF and at + 8 <= end:
            held += data[at : at + 8]
            at += 8
            continue
        for i in range(8):
            if flags >> i & 1:
                held += data[at : at + 1]
                at += 1
            elif at + 1 < end:
                window.copy_from(data[at] | (data[at + 1] & 0xF0) << 4, (data[at + 1] & 0x0F) + extra)
                at += 2
            else:
                at = end
            if at >= end:
                break
    if len(window) > MAX_OUTPUT:
        raise FormatError("output too long")
    return window.done()[:limit]


def szdd(data: bytes) -> bytes:
    v = View(data)
    if data[:8] != SZDD:
        raise FormatError("no SZDD magic")
    if v.u8(8) != 0x41:
        raise FormatError("unknown SZDD mode")
    return _lzss(data[14:], v.u32(10), 4096 - 16)


def sz(data: bytes) -> bytes:
    if data[:8] != SZ:
        raise FormatError("no SZ magic")
    return _lzss(data[12:], View(data).u32(8), 4096 - 18)


def _lzh_lengths(bits: Bits, kind: int, count: int) -> list[int]:
    """Code lengths of one table: fixed, runs, differences, or plain."""
    if kind == 0:
        return [count.bit_length() - 1] * count
    if kind == 3:
        return [bits.read(4) for _ in range(count)]
    lengths = [bits.read(4)]
    while len(lengths) < count:
        if kind == 1:
            if not bits.read(1):
                lengths.append(lengths[-1])
            elif not bits.read(1):
                lengths.append(lengths[-1] + 1)
            else:
                lengths.append(bits.read(4))
        else:
            step = bits.read(2)
            lengths.append(bits.read(4) if step == 3 else lengths[-1] + step - 1)
    return lengths


def _lzh(data: bytes) -> bytes:
    bits, window = Bits(data, msb=True), Window(4096, 0x20)
    kinds = [bits.read(4) for _ in range(5)]
    bits.read(4)
    if any(k > 3 for k in kinds):
        raise FormatError("unknown table encoding")
    match, match2, runs, places, literals = (PrefixCode.canonical(_lzh_lengths(bits, k, n), partial=True) for k, n in zip(kinds, (16, 16, 32, 64, 256)))
    after_literals = False
    try:
        while True:
            if len(window) > MAX_OUTPUT:
                raise FormatError("output too long")
            n = (match2 if after_literals else match).read(bits)
            if n:
                window.copy_back((places.read(bits) << 6 | bits.read(6)) or window.size, n + 2)
                after_literals = False
            else:
                count = runs.read(bits) + 1
                for _ in range(count):
                    window.buffer.append(literals.read(bits))
                after_literals = count != 32
    except OutOfData:
        pass
    return window.done()


def kwaj(data: bytes, compat: bool = False) -> bytes:
    """Method 0 plain, 1 inverted, 2 LZSS, 3 LZH, 4 MS-ZIP blocks. compat reads a method of one byte and then the data offset
    big-endian, starts the window of method 2 at its first place, counts its match lengths without the usual 3, and has no
    method 4."""
    v = View(data)
    if data[:8] != KWAJ:
        raise FormatError("no KWAJ magic")
    method, offset = (v.u8(8), View(data, ">").u16(9)) if compat else v.unpack(8, "HH")
    if offset < (11 if compat else 14):
        raise FormatError("data inside the header")
    if offset > len(data):
        raise FormatError("data past the end")
    body = data[offset:]
    if method == 0:
        return body
    if method == 1:
        return bytes(b ^ 0xFF for b in body)
    if method == 2:
        return _lzss(body, None, 0, 0) if compat else _lzss(body, None, 4096 - 18)
    if method == 3:
        return _lzh(body)
    if method == 4 and not compat:
        out, window, at, inner = bytearray(), b"", 0, View(body)
        while at + 2 <= len(body) and (size := inner.u16(at)) > 2:
            block = mszip_block(inner.take(at + 2, size), window)
            out += block
            if len(out) > MAX_OUTPUT:
                raise FormatError("output too long")
            window = (window + block)[-32768:]
            at += 2 + size
        return bytes(out)
    raise FormatError(f"unknown KWAJ method {method}")


def expand(data: bytes) -> bytes:
    """Any of the single-file formats, by its magic bytes."""
    for magic, run in ((KWAJ, kwaj), (SZDD, szdd), (SZ, sz)):
        if data[:8] == magic:
            return run(data)
    raise FormatError("unknown compression")


def inflate(data: bytes, window: bytes = b"", limit: int = MAX_OUTPUT) -> bytes:
    """A raw DEFLATE stream; window holds up to 32 KiB that matches may refer to."""
    try:
        d = zlib.decompressobj(-15, zdict=window) if window else zlib.decompressobj(-15)
        out = d.decompress(data, limit)
    except zlib.error as e:
        raise FormatError(str(e)) from None
    if not d.eof:
        raise FormatError("output too long" if d.unconsumed_tail else "stream has no end")
    return out


def mszip_block(block: bytes, window: bytes) -> bytes:
    if block[:2] != b"CK":
        raise FormatError("no CK at the start of a block")
    return inflate(block[2:], window, 32768 + 1)
