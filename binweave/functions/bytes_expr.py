"""Column expressions over binary columns: fixed-width integers, strings, magic bytes and flag sets. All stay in the JVM.

Places count from 0. Reads past the end give null, as do reads of null.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _at(at: Column | int) -> Column:
    return F.lit(at) if isinstance(at, int) else at


def byte_at(data: Column | str, at: Column | int) -> Column:
    """One unsigned byte as bigint; null past the end."""
    return F.conv(F.hex(F.substring(_col(data), _at(at) + 1, F.lit(1))), 16, 10).cast("bigint")


def _uint(data: Column | str, at: Column | int, width: int, little: bool) -> Column:
    places = range(width) if little else range(width - 1, -1, -1)
    kind = "decimal(20,0)" if width == 8 else "bigint"
    parts = [byte_at(data, _at(at) + i).cast(kind) * F.lit(256**k).cast(kind) for k, i in enumerate(places)]
    return reduce(lambda a, b: a + b, parts).cast(kind)


def u16_le(data: Column | str, at: Column | int) -> Column:
    return _uint(data, at, 2, True)


def u32_le(data: Column | str, at: Column | int) -> Column:
    return _uint(data, at, 4, True)


def u64_le(data: Column | str, at: Column | int) -> Column:
    """decimal(20,0)."""
    return _uint(data, at, 8, True)


def u16_be(data: Column | str, at: Column | int) -> Column:
    return _uint(data, at, 2, False)


def u32_be(data: Column | str, at: Column | int) -> Column:
    return _uint(data, at, 4, False)


def u64_be(data: Column | str, at: Column | int) -> Column:
    """decimal(20,0)."""
    return _uint(data, at, 8, False)


def has_magic(data: Column | str, magic: bytes, at: int = 0) -> Column:
    """Whether the bytes at a place are the magic ones; false past the end."""
    return F.coalesce(F.hex(F.substring(_col(data), at + 1, len(magic))) == F.lit(magic.hex().upper()), F.lit(False))


def c_string(data: Column | str, at: Column | int, strict: bool = True) -> Column:
    """UTF-8 text up to a NUL. Strict: null without a NUL; otherwise the rest counts. Null if not valid UTF-8."""
    digits = F.hex(F.substring(_col(data), _at(at) + 1, F.length(_col(data))))
    # Bytes are pairs of digits; a NUL is a pair 00 at an even place.
    body = F.regexp_extract(digits, "^((?:(?!00)..)*)", 1)
    ended = F.length(digits) > F.length(body)
    return F.when(ended | F.lit(not strict), F.try_validate_utf8(F.unhex(body).cast("string")))


def pascal_string(data: Column | str, at: Column | int) -> Column:
    """Bytes after a length byte; null if they pass the end."""
    size = byte_at(data, at)
    raw = F.substring(_col(data), _at(at) + 2, size.cast("int"))
    return F.when(F.length(raw) == size, raw)


def utf16_pascal_string(data: Column | str, at: Column | int) -> Column:
    """UTF-16 text after a count of its units; null if it passes the end."""
    units = u16_le(data, at)
    raw = F.substring(_col(data), _at(at) + 3, (units * 2).cast("int"))
    return F.when(F.length(raw) == units * 2, F.decode(raw, "UTF-16LE"))


def latin1(data: Column | str) -> Column:
    """Each byte as the character of its number."""
    return F.decode(_col(data), "ISO-8859-1")


def utf8(data: Column | str) -> Column:
    """Text, or null if the bytes are not valid UTF-8."""
    return F.try_validate_utf8(_col(data).cast("string"))


def has_flags(bits: Column | str, flags: int) -> Column:
    """Whether all flags are set."""
    return _col(bits).bitwiseAND(flags) == flags


def flag_names(bits: Column | str, table: dict[int, str]) -> Column:
    """The names of the flags that are set, in the order of the table. Unknown bits have no name."""
    return F.filter(F.array(*[F.when(has_flags(bits, b), F.lit(n)) for b, n in table.items()]), lambda x: x.isNotNull())


def enum_name(code: Column | str, table: dict[int, str], other: bool = False) -> Column:
    """The name of a code; null, or Other(n), if it has none."""
    c = _col(code)
    name = reduce(lambda a, kv: a.when(c == kv[0], kv[1]), list(table.items())[1:], F.when(c == next(iter(table)), next(iter(table.values()))))
    return name.otherwise(F.when(c.isNotNull(), F.concat(F.lit("Other("), c.cast("string"), F.lit(")")))) if other else name


def align_up(value: Column | str, step: Column | int) -> Column:
    """The next multiple of step."""
    v, m = _col(value), _at(step)
    return F.floor((v + m - 1) / m).cast("bigint") * m


def scale_5_to_8(value: Column | str) -> Column:
    """A 5-bit colour channel as 8 bits."""
    return F.floor(_col(value) * 255 / 31).cast("bigint")


def afm_width(pixels: Column | str, pixel_width: Column | str) -> Column:
    """Character width in thousandths of a point at the font's resolution; 72 where it is zero."""
    w = _col(pixel_width)
    return F.floor(_col(pixels) * 72000 / F.when(w == 0, 72).otherwise(w)).cast("bigint")


def float_bits(value: Column | str) -> Column:
    """The bit pattern of a double as bigint: equal for equal patterns only, so NaN equals itself and -0 differs from 0."""

    @F.pandas_udf("bigint")
    def bits(x: pd.Series) -> pd.Series:
        return pd.Series(x.to_numpy(dtype="float64").view("int64")).where(x.notna(), None).astype("Int64")

    return bits(_col(value))
