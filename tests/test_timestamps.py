import io
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from binweave.functions import zones as Z
from binweave.operators.timestamps import utc_seconds


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp())


ONE = [
    ("947266802", None, 947266802),
    ("0x3144F617", None, 0x3144F617),
    ("3195F426h", None, 0x3195F426),
    ("982770590240", None, 982770590),
    ("126000168218210952", None, (126000168218210952 - 116444736000000000) // 10**7),
    ("0", None, None), ("4294967295", None, None), ("0xFFFFFFFF", None, None), ("0x00000000", None, None),
    ("2003-13-04T10:00:00", "UTC", None), ("2000-01-15 25:10:00", "UTC", None), ("31.04.1999 08:15", "UTC", None),
    ("10.7.1997 01:32", "UTC", utc(1997, 7, 10, 1, 32)),
    ("09/12/1998 1:09:54 AM", "UTC", utc(1998, 9, 12, 1, 9, 54)),
    ("09/12/1998 12:09:54 AM", "UTC", utc(1998, 9, 12, 0, 9, 54)),
    ("09/12/1998 12:09:54 PM", "UTC", utc(1998, 9, 12, 12, 9, 54)),
    ("09/12/1998 13:09:54 PM", "UTC", None),
    ("Fri Apr  8 17:34:47 2005", "America/New_York", utc(2005, 4, 8, 21, 34, 47)),
    ("Fri, 01 Dec 2000 01:19:05 +0100", None, utc(2000, 12, 1, 0, 19, 5)),
    ("1996-08-09T02:49:26.402", "Europe/Berlin", utc(1996, 8, 9, 0, 49, 26)),
    ("2007-07-05T17:49:13.0-0400", None, utc(2007, 7, 5, 21, 49, 13)),
    ("1996-02-09T15:05:40Z", None, utc(1996, 2, 9, 15, 5, 40)),
    ("19960303T023053Z", None, utc(1996, 3, 3, 2, 30, 53)),
    ("19960225034640", "UTC", utc(1996, 2, 25, 3, 46, 40)),
    ("19960225", "UTC", None), ("034640", "UTC", None),
    ("2012-11-24 16:19:47 CET", "Europe/Berlin", utc(2012, 11, 24, 15, 19, 47)),
    ("2003-10-26 02:30:00 CEST", "Europe/Berlin", utc(2003, 10, 26, 0, 30)),
    ("2003-10-26 02:30:00 CET", "Europe/Berlin", utc(2003, 10, 26, 1, 30)),
    ("2003-10-26 02:30:00", "Europe/Berlin", None), ("2003-03-30 02:30:00", "Europe/Berlin", None),
    ("2003-10-26 02:30:00", None, None), ("2003-10-26 02:30:00", "No/Where", None),
    ("2012-11-24 16:19:47 PST", "Europe/Berlin", None),
    ("2105-07-01 12:00:00", "Europe/Berlin", utc(2105, 7, 1, 10)), ("2105-03-29 02:30:00", "Europe/Berlin", None),
    ("\t2005-01-02 03:04:05 \0\0", "UTC", utc(2005, 1, 2, 3, 4, 5)), ("1996-08-09T02:49:26." + "4" * 90, "UTC", utc(1996, 8, 9, 2, 49, 26)), ("2005-01-02 03:04:05" + " " * 90, "UTC", utc(2005, 1, 2, 3, 4, 5)),
    ("2005-01-02 03:04:05", "Asia/Kolkata", utc(2005, 1, 1, 21, 34, 5)),
    ("", "UTC", None), ("   ", "UTC", None), ("not set", "UTC", None), ("x" * 500, "UTC", None), (None, "UTC", None), ("é9", "UTC", None),
]
TWO = [
    ("10881", "5077", "UTC", utc(2001, 4, 1, 2, 30, 42)),
    ("0x2A81", "0x13D5", "UTC", utc(2001, 4, 1, 2, 30, 42)),
    ("15.07.97", "09:24:16", "UTC", utc(1997, 7, 15, 9, 24, 16)),
    ("15.07.79", "09:24", "UTC", utc(2079, 7, 15, 9, 24)),
    ("01-Apr-1996", "1:02:03 pm", "UTC", utc(1996, 4, 1, 13, 2, 3)),
    ("33-Jan-1998", "1:02:03 pm", "UTC", None), ("13/25/2004", "01:02", "UTC", None), ("00.00.80", "01:02", "UTC", None),
    ("19960201", "015216", "Asia/Tokyo", utc(1996, 1, 31, 16, 52, 16)),
    ("19960201", "0", "UTC", utc(1996, 2, 1)),
    ("1996-02-01", "09:24:16+01:00", None, utc(1996, 2, 1, 8, 24, 16)),
    ("1996-02-01", "09:24:16Z", None, utc(1996, 2, 1, 9, 24, 16)),
    ("1996-02-01", "24:61:00", "UTC", None), ("1996-02-01", "64000", "UTC", None), ("65535", "0", "UTC", None), ("0", "0", "UTC", None),
    ("1996-02-01", None, "UTC", None), (None, "01:02", "UTC", None), ("1996-02-01", "--", "UTC", None), ("99999", "0", "UTC", None),
    ("1996-02-05T13:48:32", None, "UTC", utc(1996, 2, 5, 13, 48, 32)),
    ("1996-02-05T13:48:32+01:00", None, None, utc(1996, 2, 5, 12, 48, 32)),
    ("947266802", None, "UTC", None),
]


def test_one_text(spark):
    df = spark.createDataFrame([(i, t, z, "kept") for i, (t, z, _) in enumerate(ONE)], "i int, t string, z string, a string")
    got = {r.i: r.utc_second for r in utc_seconds(df, F.col("t"), None, F.col("z")).collect()}
    assert [(t, z, got[i]) for i, (t, z, _) in enumerate(ONE)] == ONE


def test_two_texts(spark):
    df = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(TWO)], "i int, d string, c string, z string")
    got = {r.i: r.utc_second for r in utc_seconds(df, F.col("d"), F.col("c"), F.col("z"), packed=True).collect()}
    assert [(*x[:3], got[i]) for i, x in enumerate(TWO)] == TWO


def test_columns_that_clash_and_no_rows(spark):
    df = spark.createDataFrame([("1", "0x2A81", 9)], "a_mask string, a string, utc_second int")
    out = utc_seconds(df, F.col("a"), None, F.lit(None).cast("string"))
    assert out.columns == df.columns and out.first().utc_second == 0x2A81 and out.first().a_mask == "1"
    assert utc_seconds(df.limit(0), F.col("a"), None, F.lit("UTC")).collect() == []


def same_release(zone):
    """The standard library's reading of the very bytes that the tables are read from."""
    return ZoneInfo.from_file(io.BytesIO(Z._raw(zone)), key=zone)


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Africa/Cairo", "America/Nuuk", "Asia/Gaza", "Africa/Casablanca", "Asia/Tokyo"])
def test_rules_hold_in_all_years(zone):
    table, info = Z.zone_table(zone), same_release(zone)
    for year in (2037, 2099, 2100, 2105, 2400, 2438, 2500, 3200, 9998):
        for month, day in ((1, 15), (2, 28), (4, 20), (7, 1), (10, 15), (12, 31)):
            local = datetime(year, month, day, 12)
            want = int((local.replace(tzinfo=info) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds())
            seconds = int((local - datetime(1970, 1, 1)).total_seconds())
            assert Z.to_utc(np.array([seconds]), table)[0] == want, (year, month)


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Europe/Dublin", "America/Sao_Paulo"])
def test_zone_tables_agree_with_the_standard_library(zone):
    table, info = Z.zone_table(zone), same_release(zone)
    for u in np.random.default_rng(1).integers(-(10**9), 4 * 10**9, 1500).tolist():
        i = np.searchsorted(table.starts, u, side="right") - 1
        d = datetime.fromtimestamp(u, timezone.utc).astimezone(info)
        assert (int(d.utcoffset().total_seconds()), d.tzname()) == (table.offsets[i], table.names[i])
