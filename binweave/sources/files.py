"""Sources and sinks: directories of binaries, the tab-separated exports list, and members written as files."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.functions.text_expr import base_name, escape_name, unescape_name


def scan_files(spark: SparkSession, folder: str, glob: str | None = None, max_length: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of all regular files under a folder, one row each. Unreadable, missing and empty
    files are skipped. Conditions on path and length reach the scan, so files over max_length are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(folder)
    return files if max_length is None else files.filter(F.col("length") <= max_length)


def spread(files: DataFrame, partitions: int) -> DataFrame:
    """Files over partitions by a hash of their path, so that neighbours of one folder do not share a task."""
    return files.repartition(partitions, F.xxhash64("path"))


def exports_lines(exports: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(path_parts, ordinal, name) as lines: JSON path list, ordinal or empty, escaped name or empty; after the columns in keep."""
    cells = [F.to_json("path_parts"), F.coalesce(F.col("ordinal").cast("string"), F.lit("")), F.coalesce(escape_name("name"), F.lit(""))]
    return exports.select(*keep, F.concat_ws("\t", *cells).alias("value"))


def filtered_lines(exports: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(filename, ordinal, name) as lines; the path is a JSON list of one. After the columns in keep."""
    cells = [F.to_json(F.array("filename")), F.coalesce(F.col("ordinal").cast("string"), F.lit("")), F.coalesce(escape_name("name"), F.lit(""))]
    return exports.select(*keep, F.concat_ws("\t", *cells).alias("value"))


def parse_lines(lines: DataFrame, value: str = "value", mode: str = "PERMISSIVE", unescape: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Lines to (path_parts, base_name, ordinal, name, bad_line), after the columns in keep. Empty cells are null.

    A line that cannot be read gives nulls and itself as bad_line (PERMISSIVE), is dropped (DROPMALFORMED), or ends the query
    (FAILFAST).
    """
    text = F.regexp_replace(F.col(value), r"[\r\n]+$", "")
    cells = F.split(text, "\t", -1)
    parts = F.from_json(cells[0], "array<string>")
    name = F.nullif(F.try_element_at(cells, F.lit(3)), F.lit(""))
    ordinal = F.nullif(F.try_element_at(cells, F.lit(2)), F.lit(""))
    fine = F.coalesce(parts.isNotNull() & (F.size(cells) == 3) & (ordinal.isNull() | ordinal.rlike("^[0-9]+$")), F.lit(False))
    sound = lambda c: F.when(fine, c)
    bad = F.when(~fine, text)
    if mode == "FAILFAST":
        bad = F.when(fine, F.lit(None).cast("string")).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), text)).cast("string"))
    out = lines.select(
        *keep, sound(parts).alias("path_parts"), sound(base_name(F.element_at(parts, -1))).alias("base_name"), sound(ordinal).cast("bigint").alias("ordinal"),
        sound(unescape_name(name) if unescape else name).alias("name"), bad.alias("bad_line"),
    )
    return out.filter("bad_line IS NULL") if mode == "DROPMALFORMED" else out


def read_exports(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_lines(spark.read.text(path), **options)


def write_exports(exports: DataFrame, path: str) -> None:
    """Text files without quoting; the csv writer would quote the JSON cell."""
    exports_lines(exports).write.text(path)


def pretty_json(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})


def write_members(df: DataFrame, folder: str, name: str, data: str) -> None:
    """Binary column to files, from the executors. The folder must be shared; equal names overwrite each other in any order,
    so make them unique before. Names cannot leave the folder."""

    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            place = os.path.normpath(os.path.join(folder, r[0].replace("\\", "/").lstrip("/")))
            if not place.startswith(os.path.normpath(folder) + os.sep):
                raise ValueError(f"name leaves the folder: {r[0]!r}")
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(f"{place}.part", "wb") as f:
                f.write(r[1])
            os.replace(f"{place}.part", place)

    df.select(name, data).filter(F.col(data).isNotNull()).foreachPartition(run)


def cbor(value) -> bytes:
    """CBOR of plain values: None, bool, int, float, str, bytes, list, dict."""
    import struct

    def head(kind: int, n: int) -> bytes:
        for limit, code, layout in ((24, None, None), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I"), (1 << 64, 27, ">Q")):
            if n < limit:
                return bytes([kind << 5 | (n if code is None else code)]) + (b"" if code is None else struct.pack(layout, n))
        raise OverflowError("number over 64 bits")

    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, (bytes, bytearray)):
        return head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        raw = value.encode("utf-8")
        return head(3, len(raw)) + raw
    if isinstance(value, dict):
        return head(5, len(value)) + b"".join(cbor(k) + cbor(v) for k, v in value.items())
    if hasattr(value, "asDict"):
        return cbor(value.asDict())
    return head(4, len(value)) + b"".join(map(cbor, value))
