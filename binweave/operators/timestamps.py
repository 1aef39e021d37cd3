"""Mixed timestamp notations, precisions and zones to one UTC second, or to null where they do not denote exactly one.

Each text is reduced in the JVM to a shape mask of the same length (digits 9, capitals A, other letters a); a mask is matched
once to a parser, a set of field positions, and cached by the worker. All rows of one mask are then converted together with
numpy, through zone tables of one named release (functions.zones).

Conventions: integers count seconds (up to 10 digits) or milliseconds (11 to 13) from 1970 or 100 ns from 1601 (18); 0 and
4294967295 are unset; hexadecimal integers are seconds. With packed=True, integers of up to 5 digits and hexadecimal ones are
packed DOS words instead. Undivided digits of 6, 8 or 14 places are hhmmss, yyyymmdd, or both. Dotted dates are day first,
slashed ones month first. Two-digit years from 80 are 19yy, others 20yy. Missing seconds are 00, fractions are dropped.
A zone abbreviation is one of the row's own zone. Without zone or offset the text is local time in the row's zone.

Null, empty, unknown or impossible values, dates without a time, local times that the zone skipped or passed twice, and local
times without a known zone give null. Padding with white space or NULs is dropped first. A text of any length is judged by its
mask, once fractions and runs of blanks, the only parts without a bound, are shortened; what is longer than MAX_LENGTH then is no
timestamp, because no parser reads a mask of that length.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binweave.functions import zones as Z

#: English month abbreviations as the tools print them.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

MAX_LENGTH, _PADDING = 64, " \t\n\v\f\r\0"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FROM, _TO = _DIGITS + _UPPER + _LOWER, "9" * 10 + "A" * 26 + "a" * 26
_UNSET, _EPOCH_1601 = (0, 4294967295), 116444736000000000

_YEAR, _MONTH_NAME, _DAY_NAME = r"(?P<y>9999|99)", r"(?P<mon>[Aa]{3})", r"[Aa]{3}"
_DATES = (
    r"(?P<y>9999)-(?P<m>99?)-(?P<d>99?)",
    rf"(?P<d>99?)\.(?P<m>99?)\.{_YEAR}",
    rf"(?P<m>99?)/(?P<d>99?)/{_YEAR}",
    rf"(?:{_DAY_NAME},? )?(?P<d>99?)[- ]{_MONTH_NAME}[- ]{_YEAR}",
)
_CLOCK = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,]9+)?)?(?: ?(?P<half>[Aa]{2})(?![Aa]))?"
_ZONE = r"(?: ?(?P<sign>[+-])(?P<oh>99):?(?P<om>99)?| ?(?P<z>[Aa])| (?P<abbr>[A]{3,5}))?"
_STAMPS = [re.compile(x) for x in (*(rf"{d}(?:(?P<t>A)|[ ,]+){_CLOCK}{_ZONE}" for d in _DATES), rf"{_DAY_NAME} {_MONTH_NAME} +(?P<d>99?) {_CLOCK} (?P<y>9999){_ZONE}", rf"(?P<y>9999)(?P<m>99)(?P<d>99)(?:(?P<t>A)(?P<H>99)(?P<M>99)(?P<S>99)?{_ZONE}|(?P<H2>99)(?P<M2>99)(?P<S2>99))")]
_DATE_ONLY = [re.compile(x) for x in (*_DATES, r"(?P<y>9999)(?P<m>99)(?P<d>99)")]
_TIME_ONLY = [re.compile(x) for x in (_CLOCK + _ZONE, r"(?P<H>99)(?P<M>99)(?P<S>99)")]


def shape(text: Column) -> Column:
    """The shape mask; hexadecimal numbers, whose letters are digits, have X (0x1F) or H (1Fh) and their length as masks."""
    return (
        F.when(text.rlike("^0[xX][0-9A-Fa-f]{1,16}$"), F.concat(F.lit("X"), F.length(text)))
        .when(text.rlike("^[0-9][0-9A-Fa-f]{0,15}[hH]$"), F.concat(F.lit("H"), F.length(text)))
        .otherwise(F.translate(text, _FROM, _TO))
    )


@lru_cache(maxsize=4096)
def _spans(mask: str, kind: str) -> dict[str, tuple[int, int]] | None:
    """Field positions of a mask, or None if no parser of this kind reads it."""
    for pattern in {"stamp": _STAMPS, "date": _DATE_ONLY, "time": _TIME_ONLY}[kind]:
        if m := pattern.fullmatch(mask):
            return {k.rstrip("2"): m.span(k) for k in m.groupdict() if m.group(k) is not None}
    return None


class _Fixed:
    """Texts of one mask as a matrix of code points, from which fields are cut as columns."""

    def __init__(self, texts: list[str], spans: dict[str, tuple[int, int]]):
        self.spans = spans
        self.points = np.array(texts).view(np.uint32).reshape(len(texts), -1)
        self.ok = np.ones(len(texts), dtype=bool)

    def number(self, field: str, default: int = 0) -> np.ndarray:
        if field not in self.spans:
            return np.full(len(self.points), default, dtype=np.int64)
        a, b = self.spans[field]
        return (self.points[:, a:b].astype(np.int64) - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))

    def letters(self, field: str) -> np.ndarray:
        a, b = self.spans[field]
        return np.ascontiguousarray(self.points[:, a:b]).view(f"<U{b - a}").reshape(-1)

    def day(self) -> np.ndarray:
        """Days from 1970."""
        y, d = self.number("y"), self.number("d")
        if self.spans["y"][1] - self.spans["y"][0] == 2:
            y = np.where(y >= 80, 1900 + y, 2000 + y)
        if "mon" in self.spans:
            names, back = np.unique(self.letters("mon"), return_inverse=True)
            m = np.array([MONTHS.index(n.lower()) + 1 if n.lower() in MONTHS else 0 for n in names])[back]
        else:
            m = self.number("m")
        days, ok = _civil(y, m, d)
        self.ok &= ok
        return days

    def clock(self) -> np.ndarray:
        """Seconds of the day."""
        h, m, s = self.number("H"), self.number("M"), self.number("S")
        if "half" in self.spans:
            half = np.char.upper(self.letters("half"))
            self.ok &= ((half == "AM") | (half == "PM")) & (1 <= h) & (h <= 12)
            h = h % 12 + np.where(half == "PM", 12, 0)
        if "t" in self.spans:
            self.ok &= np.char.upper(self.letters("t")) == "T"
        self.ok &= (h < 24) & (m < 60) & (s < 60)
        return (h * 60 + m) * 60 + s

    def utc(self, local: np.ndarray, zone: np.ndarray, tables: dict[str, Z.Zone]) -> np.ndarray:
        out = np.full(len(local), np.nan)
        if "oh" in self.spans:
            h, m = self.number("oh"), self.number("om")
            self.ok &= (h < 24) & (m < 60)
            return np.where(self.ok, local - np.where(self.letters("sign") == "-", -1, 1) * (h * 60 + m) * 60, np.nan)
        if "z" in self.spans:
            return np.where(self.ok & (np.char.upper(self.letters("z")) == "Z"), local, np.nan)
        named = self.letters("abbr") if "abbr" in self.spans else None
        keys = pd.Series(zone).where(pd.Series(zone).notna(), "")
        if named is not None:
            keys = keys + "\t" + pd.Series(named.astype(object))
        for key, at in keys.groupby(keys).indices.items():
            name, _, abbr = key.partition("\t")
            at = at[self.ok[at]]
            if name in tables and len(at):
                out[at] = Z.to_utc(local[at], tables[name], abbr or None)
        return out


def _civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = (1 <= m) & (m <= 12) & (d >= 1) & (y >= 1)
    month = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = month.astype("M8[M]").astype("M8[D]").astype(np.int64)
    ok &= d <= (month + 1).astype("M8[M]").astype("M8[D]").astype(np.int64) - first
    return first + d - 1, ok


def _integers(texts: list[str], mask: str) -> np.ndarray:
    """The numbers of texts of one mask, all of the same length, digit column by digit column."""
    points = np.array(texts).view(np.uint32).reshape(len(texts), -1).astype(np.uint64)
    points = points[:, 2:] if mask[0] == "X" else points[:, :-1] if mask[0] == "H" else points
    base = np.uint64(16 if mask[0] in "XH" else 10)
    digits = np.where(points <= 57, points - np.uint64(48), (points | np.uint64(32)) - np.uint64(87))
    out = np.zeros(len(texts), dtype=np.uint64)
    for k in range(digits.shape[1]):
        out = out * base + digits[:, k]
    return out


def _dos_day(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    small = np.where(words <= 0xFFFF, words, 0).astype(np.int64)
    return _civil(1980 + (small >> 9), (small >> 5) & 15, small & 31)


def _dos_clock(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    small = np.where(words <= 0xFFFF, words, 0xFFFF).astype(np.int64)
    h, m, s = small >> 11, (small >> 5) & 63, 2 * (small & 31)
    return (h * 60 + m) * 60 + s, (h < 24) & (m < 60) & (s < 60)


def _is_word(mask: str) -> bool:
    return mask[0] in "XH" or bool(re.fullmatch("9{1,5}", mask))


def _one_text(texts: list[str], mask: str, zone: np.ndarray, tables: dict[str, Z.Zone], packed: bool) -> np.ndarray:
    none = np.full(len(texts), np.nan)
    if spans := _spans(mask, "stamp"):
        part = _Fixed(texts, spans)
        local = part.day() * 86400 + part.clock()
        out = part.utc(local, zone, tables)
        return np.where(part.ok, out, np.nan)
    decimal = bool(re.fullmatch("9{1,13}|9{18}", mask)) and len(mask) not in (6, 8)
    if packed or not (decimal or mask[0] in "XH"):
        return none
    values = _integers(texts, mask)
    unset = np.isin(values, np.array(_UNSET, dtype=np.uint64))
    if decimal and len(mask) == 18:
        seconds = ((values.astype(np.int64) - _EPOCH_1601) // 10**7).astype(np.float64)
    elif decimal and len(mask) > 10:
        seconds = (values // np.uint64(1000)).astype(np.float64)
    else:
        seconds = np.where(values < 1 << 40, values.astype(np.float64), np.nan)
    return np.where(unset, np.nan, seconds)


def _two_texts(dates: list[str], times: list[str], mask: str, clock_mask: str, zone: np.ndarray, tables: dict[str, Z.Zone]) -> np.ndarray:
    none = np.full(len(dates), np.nan)
    if _is_word(mask):
        day, ok = _dos_day(_integers(dates, mask))
    elif spans := _spans(mask, "date"):
        part = _Fixed(dates, spans)
        day, ok = part.day(), part.ok
    else:
        return none
    if _is_word(clock_mask):
        clock, fine = _dos_clock(_integers(times, clock_mask))
        part = _Fixed(times, {})
    elif spans := _spans(clock_mask, "time"):
        part = _Fixed(times, spans)
        clock = part.clock()
        fine = part.ok
    else:
        return none
    part.ok = ok & fine
    return np.where(part.ok, part.utc(day * 86400 + clock, zone, tables), np.nan)


def convert(frame: pd.DataFrame, tables: dict[str, Z.Zone], packed: bool) -> pd.Series:
    """UTC seconds of the columns a, a_mask, b, b_mask (None: a holds all), zone; nulls where not determined."""
    out = pd.Series(pd.NA, index=frame.index, dtype="Int64")
    masks = frame["a_mask"].fillna("") + "\t" + frame["b_mask"].fillna("")
    for key, at in masks.groupby(masks).indices.items():
        mask, _, clock_mask = key.partition("\t")
        if not mask:
            continue
        zone, a = frame["zone"].to_numpy()[at], frame["a"].to_numpy()[at].tolist()
        if not clock_mask or _spans(mask, "stamp"):
            got = _one_text(a, mask, zone, tables, packed)
        else:
            got = _two_texts(a, frame["b"].to_numpy()[at].tolist(), mask, clock_mask, zone, tables)
        known = ~np.isnan(got)
        out.iloc[at[known]] = got[known].astype(np.int64)
    return out


def utc_seconds(df: DataFrame, text: Column, time: Column | None, zone: Column, out: str = "utc_second", packed: bool = False, keep: bool = True) -> DataFrame:
    """df with a bigint column `out`: the UTC second that text (and time, a separate clock text) denotes, or null.

    keep=False leaves out rows without one. Prefer it to a filter on `out`: that would be pushed below the conversion, which
    then runs twice.

    Any other columns are kept as they are, also those that clash with names used inside; a column named `out` is replaced.
    A full stamp in text is taken alone, whatever time says.
    """
    tables = df.sparkSession.sparkContext.broadcast(Z.zone_tables(sorted(Z._known())))

    @F.pandas_udf("bigint")
    def seconds(a: pd.Series, a_mask: pd.Series, b: pd.Series, b_mask: pd.Series, where: pd.Series) -> pd.Series:
        frame = pd.DataFrame({"a": a, "a_mask": a_mask, "b": b, "b_mask": b_mask, "zone": where})
        return convert(frame, tables.value, packed)

    def short(c: Column | None) -> Column:
        if c is None:
            return F.lit(None).cast("string")
        c = F.btrim(c.cast("string"), F.lit(_PADDING))
        plain = F.regexp_replace(F.regexp_replace(c, "([.,][0-9]{9})[0-9]+", "$1"), "[ ,]{3,}", "  ")
        c = F.when(F.length(c) <= MAX_LENGTH, c).otherwise(plain)
        return F.when((F.length(c) > 0) & (F.length(c) <= MAX_LENGTH), c)

    a, b = short(text), short(time)
    done = df.withColumn(out, seconds(a, shape(a), b, shape(b), zone.cast("string")))
    return done if keep else done.withColumn(out, F.explode(F.array_compact(F.array(F.col(out)))))
