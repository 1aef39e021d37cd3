"""LZX as cabinets use it: 16-bit units, verbatim, aligned and uncompressed blocks, repeated offsets, and the translation of
relative calls in the output."""

from __future__ import annotations

from binweave.codecs.bits import Bits
from binweave.formats.reader import FormatError

FRAME = 32768


class _Code:
    """A canonical code read by its lengths; codes may be partial or empty."""

    def __init__(self, lengths: list[int]):
        self.first: dict[int, tuple[int, int]] = {}
        order = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.symbols = [s for _, s in order]
        code = place = 0
        before = 0
        for n, _ in order:
            code <<= n - before
            if n not in self.first:
                self.first[n] = (code, place)
            code, place, before = code + 1, place + 1, n
        self.counts = {n: sum(1 for x, _ in order if x == n) for n in self.first}
        self.longest = before

    def read(self, bits: Bits) -> int:
        code = 0
        for n in range(1, self.longest + 1):
            code = code << 1 | bits.read(1)
            if n in self.first:
                low, place = self.first[n]
                if low <= code < low + self.counts[n]:
                    return self.symbols[place + code - low]
        raise FormatError("no such code")


def _slots(window_bits: int) -> tuple[list[int], list[int]]:
    """Base and number of extra bits of each position slot; the number of slots depends on the window."""
    base, extra, at = [], [], 0
    while at < 1 << window_bits:
        n = 0 if len(base) < 4 else min((len(base) - 2) // 2, 17)
        base.append(at)
        extra.append(n)
        at += 1 << n
    return base, extra


class Lzx:
    """A decoder whose window and codes carry over from frame to frame."""

    def __init__(self, window_bits: int):
        if not 15 <= window_bits <= 21:
            raise FormatError("window out of range")
        self.window_bits = window_bits
        self.base, self.extra = _slots(window_bits)
        self.window = bytearray()
        self.recent = [1, 1, 1]
        self.main_lengths, self.length_lengths = [0] * (256 + 8 * len(self.base)), [0] * 249
        self.kind = self.left = 0
        self.translated: int | None = None
        self.started = False
        self.done = 0

    def _deltas(self, bits: Bits, lengths: list[int], low: int, high: int) -> None:
        code, at = _Code([bits.read(4) for _ in range(20)]), low
        while at < high:
            s = code.read(bits)
            if s == 17 or s == 18:
                n = bits.read(4) + 4 if s == 17 else bits.read(5) + 20
                fill = [0] * n
            elif s == 19:
                n, value = bits.read(1) + 4, code.read(bits)
                fill = [(lengths[at] - value) % 17] * n
            else:
                fill = [(lengths[at] - s) % 17]
            if at + len(fill) > high:
                fill = fill[: high - at]
            lengths[at : at + len(fill)] = fill
            at += len(fill)

    def _block(self, bits: Bits) -> None:
        self.kind, self.left = bits.read(3), bits.read(16) << 8 | bits.read(8)
        self.odd = self.left & 1
        if self.kind == 2:
            self.aligned = _Code([bits.read(3) for _ in range(8)])
        if self.kind in (1, 2):
            self._deltas(bits, self.main_lengths, 0, 256)
            self._deltas(bits, self.main_lengths, 256, len(self.main_lengths))
            self.main = _Code(self.main_lengths)
            self._deltas(bits, self.length_lengths, 0, 249)
            self.lengths = _Code(self.length_lengths)
        elif self.kind == 3:
            bits.read(bits.count % 16 or 16)
            raw = bits.raw(12)
            self.recent = [int.from_bytes(raw[i : i + 4], "little") for i in (0, 4, 8)]
        else:
            raise FormatError("unknown block kind")

    def frame(self, data: bytes, size: int) -> bytes:
        """One frame of `size` bytes, at most 32 KiB."""
        bits = Bits(data, msb=True, unit=2)
        if not self.started:
            self.translated = (bits.read(16) << 16 | bits.read(16)) if bits.read(1) else None
            self.started = True
        out, end = self.window, len(self.window) + size
        while len(out) < end:
            if not self.left:
                self._block(bits)
            if self.kind == 3:
                n = min(self.left, end - len(out))
                out += bits.raw(n)
                self.left -= n
                if not self.left and self.odd and bits.at < len(data):
                    bits.at += 1
                continue
            s = self.main.read(bits)
            if s < 256:
                out.append(s)
                self.left -= 1
                continue
            slot, n = (s - 256) >> 3, (s - 256 & 7) + 2
            if n == 9:
                n += self.lengths.read(bits)
            if slot < 3:
                offset = self.recent[slot]
                self.recent[slot] = self.recent[0]
                self.recent[0] = offset
            else:
                k = self.extra[slot]
                if self.kind == 2 and k >= 3:
                    more = (bits.read(k - 3) << 3) + self.aligned.read(bits)
                else:
                    more = bits.read(k)
                offset = self.base[slot] + more - 2
                self.recent = [offset, *self.recent[:2]]
            if offset > len(out) or n > self.left or offset < 1:
                raise FormatError("match outside the window")
            for _ in range(n):
                out.append(out[-offset])
            self.left -= n
        got = bytes(out[-size:]) if size else b""
        self.done += size
        if len(out) > 2 << self.window_bits:
            del out[: len(out) - (1 << self.window_bits)]
        return self._calls(got, self.done - size) if self.translated else got

    def _calls(self, frame: bytes, start: int) -> bytes:
        """Absolute call targets back to relative ones; only in the first gigabyte, and not in the last ten bytes."""
        if start >= 0x40000000 or len(frame) <= 10:
            return frame
        out, at, size = bytearray(frame), 0, self.translated
        while (at := out.find(0xE8, at)) >= 0 and at < len(frame) - 10:
            here = start + at
            target = int.from_bytes(out[at + 1 : at + 5], "little", signed=True)
            if -here <= target < size:
                target = target - here if target >= 0 else target + size
                out[at + 1 : at + 5] = (target & 0xFFFFFFFF).to_bytes(4, "little")
            at += 5
        return bytes(out)
