"""Bit reading, prefix codes and the sliding window, shared by the decompressors."""

from __future__ import annotations

from binweave.formats.reader import FormatError


class OutOfData(FormatError):
    """The input ended inside a code."""


class Bits:
    """Bits of a buffer, most or least significant first, through an integer that holds the next ones."""

    def __init__(self, data: bytes, msb: bool, unit: int = 1):
        self.data, self.msb, self.unit = data, msb, unit
        self.at, self.held, self.count = 0, 0, 0

    def _fill(self) -> None:
        raw = self.data[self.at : self.at + self.unit]
        if not raw:
            raise OutOfData("end of data")
        value, width = int.from_bytes(raw, "little"), 8 * len(raw)
        self.at += self.unit
        if self.msb:
            self.held = (self.held << width) | value
        else:
            self.held |= value << self.count
        self.count += width

    def read(self, n: int) -> int:
        while self.count < n:
            self._fill()
        self.count -= n
        if self.msb:
            out = self.held >> self.count
            self.held &= (1 << self.count) - 1
        else:
            out = self.held & ((1 << n) - 1)
            self.held >>= n
        return out

    def peek(self, n: int) -> tuple[int, int]:
        """The next n bits, first bit highest, and how many of them there are; missing ones are 0."""
        while self.count < n and self.at < len(self.data):
            self._fill()
        have = min(n, self.count)
        if self.msb:
            return self.held >> self.count - have << n - have, have
        return sum((self.held >> i & 1) << n - 1 - i for i in range(have)), have

    def align(self) -> None:
        """Drops the rest of the current unit."""
        drop = self.count % (8 * self.unit)
        self.read(drop)

    def raw(self, n: int) -> bytes:
        """Whole bytes from an aligned place."""
        out = bytearray()
        while self.count and len(out) < n:
            out.append(self.read(8))
        take = self.data[self.at : self.at + n - len(out)]
        self.at += len(take)
        out += take
        if len(out) < n:
            raise OutOfData("end of data")
        return bytes(out)


def canonical_codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length): codes count up by length, then symbol. Zero lengths have no code."""
    codes, code, before = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - before
        codes[symbol] = (code, length)
        code, before = code + 1, length
    return codes


class PrefixCode:
    """A prefix code, checked to be prefix-free, and complete unless partial is allowed."""

    def __init__(self, codes: dict[int, tuple[int, int]], partial: bool = False):
        space = sum(1 << (64 - n) for _, n in codes.values())
        if space > 1 << 64 or (space < 1 << 64 and not partial and len(codes) != 1):
            raise FormatError("prefix code is not complete")
        if len({(n, c) for c, n in codes.values()}) != len(codes):
            raise FormatError("equal codes")
        self.longest = max((n for _, n in codes.values()), default=0)
        # Every value of the longest width leads to the symbol whose code it begins with.
        self.table: dict[int, tuple[int, int]] = {}
        for s, (c, n) in codes.items():
            for low in range(1 << self.longest - n):
                self.table[c << self.longest - n | low] = (s, n)

    @classmethod
    def canonical(cls, lengths: list[int], partial: bool = False) -> PrefixCode:
        return cls(canonical_codes(lengths), partial)

    def read(self, bits: Bits) -> int:
        value, have = bits.peek(self.longest)
        symbol, n = self.table.get(value, (None, 0))
        if n > have or (symbol is None and have < self.longest):
            raise OutOfData("end of data")
        if symbol is None:
            raise FormatError("no such code")
        bits.read(n)
        return symbol


class Window:
    """The latest bytes as the end of a buffer that starts with a filled ring; copies may overlap what they write."""

    def __init__(self, size: int, fill: int, start: int = 0):
        self.size, self.start, self.buffer = size, start, bytearray([fill]) * size

    def __len__(self) -> int:
        return len(self.buffer) - self.size

    def copy_from(self, place: int, length: int) -> None:
        """From an absolute place of the ring."""
        here = (self.start + len(self)) % self.size
        self.copy_back((here - place) % self.size or self.size, length)

    def copy_back(self, distance: int, length: int) -> None:
        at = len(self.buffer) - distance
        part = self.buffer[at : at + length]
        while len(part) < length:
            part += part[: length - len(part)]
        self.buffer += part

    def done(self) -> bytes:
        return bytes(self.buffer[self.size :])
