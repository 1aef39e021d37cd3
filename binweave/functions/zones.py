"""Zone transition tables: for every IANA zone its UTC offsets by interval, read once on the driver from a named tzdata release.

Transitions and the lasting rule after them come from the same bytes. Rules are followed for one calendar cycle of 400 years,
which repeats exactly, so years up to 9999 are converted alike. The tables are bounded by the zone database (about 600 zones, at
most about 1,000 intervals each), never by the data. They are shipped
to the workers as arrays, so every task converts with the same release whatever its node has installed.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from datetime import date
from functools import lru_cache
from importlib import resources
from zoneinfo import TZPATH, available_timezones

import numpy as np

FAR_PAST, FAR_FUTURE = -(2**61), 2**61
#: Seconds of a calendar cycle of 400 years, after which every lasting rule repeats.
CYCLE = 146_097 * 86_400


@dataclass(frozen=True)
class Zone:
    """Interval i holds from starts[i] to starts[i + 1] (UTC seconds): offset east of UTC in seconds, and its abbreviation. From
    `end` on, the intervals of the calendar cycle before it repeat."""

    starts: np.ndarray
    offsets: np.ndarray
    names: tuple[str, ...]
    end: int = FAR_FUTURE


def _raw(zone: str) -> bytes | None:
    try:
        return resources.files("tzdata").joinpath("zoneinfo", *zone.split("/")).read_bytes()
    except (ModuleNotFoundError, FileNotFoundError, IsADirectoryError, OSError):
        pass
    for root in TZPATH:
        try:
            with open(f"{root}/{zone}", "rb") as f:
                return f.read()
        except OSError:
            continue
    return None


def _parse(raw: bytes) -> tuple[list[int], list[tuple[int, str]], tuple[int, str]]:
    """Transitions, the (offset, abbreviation) each begins, and what holds before the first (TZif version 2 or later)."""

    def header(at: int) -> tuple[int, ...]:
        if raw[at : at + 4] != b"TZif":
            raise ValueError("no TZif data")
        return struct.unpack(">6l", raw[at + 20 : at + 44])

    isut, isstd, leap, times, types, chars = header(0)
    at = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut
    isut, isstd, leap, times, types, chars = header(at)
    at += 44
    when = struct.unpack(f">{times}q", raw[at : at + 8 * times])
    idx = raw[at + 8 * times : at + 9 * times]
    at += 9 * times
    kinds = [struct.unpack(">lbB", raw[at + 6 * i : at + 6 * i + 6]) for i in range(types)]
    text = raw[at + 6 * types : at + 6 * types + chars]
    named = [(off, text[i : text.index(b"\0", i)].decode("ascii")) for off, _, i in kinds]
    first = next((named[i] for i in range(types) if not kinds[i][1]), named[0])
    return list(when), [named[i] for i in idx], first


_RULE = re.compile(r"(<[^>]+>|[A-Za-z]{3,})([-+]?[\d:]+)(?:(<[^>]+>|[A-Za-z]{3,})([-+]?[\d:]+)?(?:,([^,]+),([^,]+))?)?")


def _clock(text: str) -> int:
    """Seconds of [+-]h[:m[:s]]."""
    sign = -1 if text[0] == "-" else 1
    parts = [int(x) for x in text.lstrip("+-").split(":")]
    return sign * sum(x * 60 ** (2 - i) for i, x in enumerate(parts))


def _rule_day(rule: str, year: int) -> int:
    """Days from 1970 of the day that a rule names: Mm.w.d, Jn or n."""
    first = (date(year, 1, 1) - date(1970, 1, 1)).days
    if rule[0] == "J":
        n = int(rule[1:])
        leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        return first + n - 1 + (leap and n >= 60)
    if rule[0] != "M":
        return first + int(rule)
    month, week, weekday = (int(x) for x in rule[1:].split("."))
    start = (date(year, month, 1) - date(1970, 1, 1)).days
    # Day 0 of 1970 was a Thursday, weekday 4 where Sunday is 0.
    day = start + (weekday - (start + 4)) % 7 + 7 * (week - 1)
    following = (date(year + month // 12, month % 12 + 1, 1) - date(1970, 1, 1)).days
    return day if day < following else day - 7


@lru_cache(maxsize=1024)
def _by_rule(rule: str, after: int) -> tuple[tuple[int, int, str], ...]:
    """Transitions later than `after`, for one calendar cycle, by the closing rule that the file of a zone itself states."""
    m = _RULE.fullmatch(rule)
    if m is None or not m[5]:
        return ()
    names = [x.strip("<>") for x in (m[1], m[3])]
    standard = -_clock(m[2])
    summer = -_clock(m[4]) if m[4] else standard + 3600
    year, out = 1970 + after // 31_556_952 - 1, []
    for y in range(year, year + 403):
        for rule_text, before, offset, name in ((m[5], standard, summer, names[1]), (m[6], summer, standard, names[0])):
            day, _, clock = rule_text.partition("/")
            out.append((_rule_day(day, y) * 86_400 + (_clock(clock) if clock else 7200) - before, offset, name))
    out.sort()
    # Standard and summer time that meet at one moment are one lasting offset: the zone never changes.
    return tuple((t, o, n) for i, (t, o, n) in enumerate(out) if after < t <= after + CYCLE and (i + 1 == len(out) or out[i + 1][0] > t))


@lru_cache(maxsize=1024)
def zone_table(zone: str) -> Zone | None:
    """The intervals of one zone; None if the release has no such zone."""
    if not zone or zone not in _known() or (raw := _raw(zone)) is None:
        return None
    when, held, first = _parse(raw)
    rows = [(FAR_PAST, *first), *((t, *h) for t, h in zip(when, held))]
    last = when[-1] if when else 0
    lasting = _by_rule(raw.rstrip(b"\n").rpartition(b"\n")[2].decode("ascii"), last)
    rows += lasting
    end = last + CYCLE if lasting else FAR_FUTURE
    return Zone(np.array([r[0] for r in rows] + [FAR_FUTURE], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64), tuple(r[2] for r in rows), end)


@lru_cache(maxsize=1)
def _known() -> frozenset[str]:
    return frozenset(available_timezones())


def release() -> str:
    """The release of the zone database in use, for example '2026f'."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ModuleNotFoundError:
        for root in TZPATH:
            try:
                with open(f"{root}/tzdata.zi") as f:
                    return f.readline().split()[-1]
            except OSError:
                continue
    return "unknown"


def zone_tables(zones: list[str]) -> dict[str, Zone]:
    return {z: t for z in zones if (t := zone_table(z)) is not None}


def to_utc(local: np.ndarray, zone: Zone, abbreviation: str | None = None) -> np.ndarray:
    """Local seconds to UTC seconds as float64 (exact below 2**53), NaN where the local time is skipped, or passed twice.

    With an abbreviation, the interval of that name decides; if none of that name holds then, its latest offset is taken,
    and a name the zone never used gives NaN.
    """
    starts, offsets = zone.starts, zone.offsets
    # Later times are converted in the last calendar cycle of the table, where weekdays and leap years are the same.
    cycles = np.maximum(-(-(local - (zone.end - 7 * 86400)) // CYCLE), 0) if zone.end < FAR_FUTURE else np.zeros(len(local), dtype=np.int64)
    local = local - cycles * CYCLE
    found, hits = np.full(len(local), np.nan), np.zeros(len(local), dtype=np.int64)
    first = np.searchsorted(starts, local - 2 * 86400, side="right") - 1
    last = np.searchsorted(starts, local + 2 * 86400, side="right") - 1
    named = None if abbreviation is None else np.array([n == abbreviation for n in zone.names])
    if named is not None and not named.any():
        return found
    for step in range(int((last - first).max()) + 1 if len(local) else 0):
        i = np.minimum(first + step, len(offsets) - 1)
        u = local - offsets[i]
        ok = (first + step <= last) & (starts[i] <= u) & (u < starts[i + 1])
        if named is not None:
            ok &= named[i]
        found = np.where(ok, u, found)
        hits += ok
    if named is not None:
        return np.where(hits > 0, found, local - offsets[np.flatnonzero(named)[-1]]) + cycles * CYCLE
    return np.where(hits == 1, found, np.nan) + cycles * CYCLE
