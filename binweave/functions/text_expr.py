"""Column expressions for the text forms of names and bytes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def escape_name(name: Column | str) -> Column:
    """Backslash, carriage return, line feed and tab as two characters each. The backslash comes first."""
    out = _col(name)
    for a, b in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape_name(name: Column | str) -> Column:
    """The inverse of escape_name; an unknown escape keeps its character."""
    plain = F.transform(
        F.regexp_extract_all(_col(name), F.lit("(?s)(\\\\.|[^\\\\]+|\\\\)"), 1),
        lambda p: F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\t", "\t").when(p.startswith("\\") & (F.length(p) > 1), F.substring(p, 2, 1)).otherwise(p),
    )
    return F.array_join(plain, "")


def _pairs(data: Column | str) -> Column:
    return F.regexp_extract_all(F.hex(_col(data)), F.lit("(..)"), 1)


def display_bytes(data: Column | str) -> Column:
    """b"..." with printable ASCII as it is, the usual escapes, and \\xHH for all other bytes."""

    def one(p: Column) -> Column:
        code = F.conv(p, 16, 10).cast("int")
        named = F.when(p == "00", "\\0").when(p == "09", "\\t").when(p == "0A", "\\n").when(p == "0D", "\\r").when(p == "22", '\\"').when(p == "5C", "\\\\")
        return named.otherwise(F.when(code.between(0x20, 0x7E), F.char(code)).otherwise(F.concat(F.lit("\\x"), p)))

    return F.concat(F.lit('b"'), F.array_join(F.transform(_pairs(data), one), ""), F.lit('"'))


def hex_bytes(data: Column | str) -> Column:
    """[0x01, 0xAB]."""
    return F.concat(F.lit("["), F.array_join(F.transform(_pairs(data), lambda p: F.concat(F.lit("0x"), p)), ", "), F.lit("]"))


def base_name(path: Column | str) -> Column:
    """The last piece after a slash or backslash."""
    return F.element_at(F.split(_col(path), "[/\\\\]"), -1)


def remove_prefix(text: Column | str, prefix: str) -> Column:
    """The text without the prefix; null where it does not start with it."""
    t = _col(text)
    return F.when(t.startswith(prefix), F.substring(t, F.lit(len(prefix) + 1), F.length(t)))


def join_parts(glue: str, parts: Column | str) -> Column:
    """Array elements as text, joined."""
    return F.array_join(F.transform(_col(parts), lambda x: x.cast("string")), glue)


def yes_no(flag: Column | str) -> Column:
    return F.when(_col(flag), "yes").otherwise("no")


def resource_file_name(prefix: Column | str, number: Column | str, name: Column | str, ext: str) -> Column:
    """prefix + i{number} or s{name, one character per byte}, and the extension."""
    own = F.when(_col(number).isNotNull(), F.concat(F.lit("i"), _col(number).cast("string"))).otherwise(F.concat(F.lit("s"), F.decode(_col(name), "ISO-8859-1")))
    return F.concat(_col(prefix), own, F.lit(f".{ext}"))
