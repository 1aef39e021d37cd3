"""Packed and digit timestamps of file systems as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from binweave.functions.bytes_expr import byte_at


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bits(word: Column, shift: int, mask: int) -> Column:
    return F.shiftright(word, shift).bitwiseAND(mask)


def dos_date_parts(word: Column | str) -> tuple[Column, Column, Column]:
    """Year, month and day of a packed date; not checked for being a date."""
    w = _col(word).cast("int")
    return _bits(w, 9, 127) + 1980, _bits(w, 5, 15), _bits(w, 0, 31)


def dos_time_parts(word: Column | str) -> tuple[Column, Column, Column]:
    """Hour, minute and (even) second of a packed time."""
    w = _col(word).cast("int")
    return _bits(w, 11, 31), _bits(w, 5, 63), _bits(w, 0, 31) * 2


def dos_timestamp(date: Column | str, time: Column | str) -> Column:
    """timestamp_ntz, or null where the words are no date and time."""
    hour, minute, second = dos_time_parts(time)
    return F.try_make_timestamp_ntz(*dos_date_parts(date), hour, minute, second.cast("decimal(16,6)"))


def pack_dos_date(ts: Column | str) -> Column:
    t = _col(ts)
    return ((F.year(t) - 1980) * 512 + F.month(t) * 32 + F.dayofmonth(t)).cast("int")


def pack_dos_time(ts: Column | str) -> Column:
    t = _col(ts)
    return (F.hour(t) * 2048 + F.minute(t) * 32 + F.floor(F.second(t) / 2)).cast("int")


def iso_digit_timestamp(digits: Column | str, quarter_hours: Column | str | None = None) -> Column:
    """YYYYMMDDhhmmsscc as text, with an offset in quarters of an hour east of UTC, to UTC; null where all digits are zero."""
    d = _col(digits)
    part = lambda a, n: F.substring(d, a, n).try_cast("int")
    seconds = part(13, 2).cast("decimal(16,6)") + part(15, 2).cast("decimal(16,6)") / 100
    local = F.try_make_timestamp_ntz(part(1, 4), part(5, 2), part(7, 2), part(9, 2), part(11, 2), seconds.cast("decimal(16,6)"))
    local = F.when(~d.rlike("^0+$"), local)
    return local if quarter_hours is None else local - F.make_dt_interval(mins=_col(quarter_hours).cast("int") * 15)


def iso_binary_timestamp(data: Column | str, at: int = 0, offset: bool = True) -> Column:
    """Seven bytes (six without an offset): years since 1900, month, day, hour, minute, second, quarters of an hour."""
    b = [byte_at(data, at + i).cast("int") for i in range(7)]
    local = F.try_make_timestamp_ntz(b[0] + 1900, b[1], b[2], b[3], b[4], b[5].cast("decimal(16,6)"))
    signed = F.when(b[6] > 127, b[6] - 256).otherwise(b[6])
    return local - F.make_dt_interval(mins=signed * 15) if offset else local
