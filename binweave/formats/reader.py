"""Bounds-checked reads from a byte buffer, and the Spark side that turns parsers into tables."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FormatError(ValueError):
    """The bytes are not a valid file of the format."""


class View:
    """Little-endian (or big-endian) reads at absolute places; reads past the end raise FormatError."""

    __slots__ = ("data", "order")

    def __init__(self, data: bytes, order: str = "<"):
        self.data, self.order = bytes(data), order

    def __len__(self) -> int:
        return len(self.data)

    def unpack(self, at: int, layout: str) -> tuple:
        layout = self.order + layout
        try:
            if at < 0:
                raise FormatError(f"negative offset {at}")
            return struct.unpack_from(layout, self.data, at)
        except struct.error:
            raise FormatError(f"{struct.calcsize(layout)} bytes at {at} pass the end at {len(self.data)}") from None

    def u8(self, at: int) -> int:
        return self.unpack(at, "B")[0]

    def u16(self, at: int) -> int:
        return self.unpack(at, "H")[0]

    def u32(self, at: int) -> int:
        return self.unpack(at, "I")[0]

    def u64(self, at: int) -> int:
        return self.unpack(at, "Q")[0]

    def i16(self, at: int) -> int:
        return self.unpack(at, "h")[0]

    def i32(self, at: int) -> int:
        return self.unpack(at, "i")[0]

    def take(self, at: int, size: int) -> bytes:
        if at < 0 or size < 0 or at + size > len(self.data):
            raise FormatError(f"{size} bytes at {at} pass the end at {len(self.data)}")
        return self.data[at : at + size]

    def zstr(self, at: int) -> bytes:
        """Bytes up to a NUL, which must be there."""
        if at < 0 or at >= len(self.data) or (end := self.data.find(b"\0", at)) < 0:
            raise FormatError(f"no end of the string at {at}")
        return self.data[at:end]

    def pascal(self, at: int) -> bytes:
        """Bytes after a length byte."""
        return self.take(at + 1, self.u8(at))

    def utf16_pascal(self, at: int) -> str:
        """UTF-16 text after a count of its units."""
        try:
            return self.take(at + 2, 2 * self.u16(at)).decode("utf-16-le")
        except UnicodeDecodeError:
            raise FormatError("lone surrogate") from None


def utf8(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        raise FormatError("not valid UTF-8") from None


def error_text(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


Parser = Callable[[bytes], Iterable[tuple]]


def parse(df: DataFrame, parser: Parser, schema: str | T.StructType, keys: tuple[str, ...] = ("path",), content: str = "content") -> DataFrame:
    """One row per tuple that parser yields for a content, with the key columns of its file and a column error.

    A content that cannot be parsed gives the rows read so far and one row with nulls and the error; it never fails the task.
    A null content gives an error row. Filter before, so that only wanted contents are shipped to Python.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    key_fields = [df.schema[k] for k in keys]
    out = T.StructType([*key_fields, *[T.StructField(f.name, f.dataType, True) for f in fields], T.StructField("error", T.StringType(), True)])
    names, width = out.names, len(fields)
    heavy = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.BinaryType)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows: list[tuple] = []
            size = 0
            for *own, data in frame[[*keys, content]].itertuples(index=False, name=None):
                try:
                    if data is None:
                        raise FormatError("no content")
                    for row in parser(bytes(data)):
                        rows.append((*own, *row, None))
                        size += sum(len(row[i]) for i in heavy if row[i] is not None)
                        if len(rows) >= 20_000 or size >= 1 << 26:
                            yield pd.DataFrame(rows, columns=names, dtype=object)
                            rows, size = [], 0
                except Exception as e:  # noqa: BLE001 - hostile input must not fail the task
                    rows.append((*own, *[None] * width, error_text(e)))
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return df.select(*keys, F.col(content)).mapInPandas(run, out)
