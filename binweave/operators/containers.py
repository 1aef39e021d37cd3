"""Recursion through nested containers, level by level, with the path of every member.

Each level is classified in the JVM; only the files of one format are shipped to its decoder. Members of a level are written
to the shared folder before the next, in row groups that are read apart, so one large container does not keep its members in
one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binweave.codecs.compressed import KWAJ, SZ, SZDD, expand
from binweave.formats import disks
from binweave.formats.reader import parse
from binweave.functions.bytes_expr import has_magic
from binweave.operators.exports import TAGGED_SCHEMA, TAGGED_WIDTH, binary_kind, executable, tagged_exports, tagged_rows
from binweave.runtime import materialise


def container_kind(content: str = "content"):
    """'single', 'fat', 'iso', 'cab' or null, in this order of tests. The parser of the kind decides whether it is sound."""
    single = has_magic(content, KWAJ) | has_magic(content, SZDD) | has_magic(content, SZ)
    fat = (has_magic(content, b"\xeb") & has_magic(content, b"\x90", 2)) | has_magic(content, b"\xe9")
    iso = has_magic(content, b"CD001", 0x8001) | has_magic(content, b"CDROM", 0x8009)
    return F.when(single, "single").when(fat, "fat").when(iso, "iso").when(has_magic(content, b"MSCF"), "cab")


def _single(data: bytes):
    # The only member of a compressed file has an empty name.
    yield "", expand(data), None


_KINDS = {"single": _single, "fat": disks.fat_extract(errors=True), "iso": disks.iso_extract(errors=True), "cab": disks.cab_extract(errors=True)}


def _members(data: bytes):
    """The members of a container of any kind, by its first bytes."""
    yield from _KINDS[kind_of_bytes(data)](data)


def kind_of_bytes(data: bytes) -> str | None:
    """container_kind for bytes in Python."""
    if data[:8] in (KWAJ, SZDD, SZ):
        return "single"
    if data[:1] == b"\xe9" or data[:1] == b"\xeb" and data[2:3] == b"\x90":
        return "fat"
    if data[0x8001:0x8006] == b"CD001" or data[0x8009:0x800E] == b"CDROM":
        return "iso"
    return "cab" if data[:4] == b"MSCF" else None


def members(files: DataFrame) -> DataFrame:
    """(path_parts, content, error): the members of all containers among (path_parts, content), one level deep. Containers of
    every kind are opened in one pass; other files are not shipped to Python."""
    known = files.filter(container_kind().isNotNull())
    out = parse(known, _members, disks.MEMBER_OR_ERROR_SCHEMA, ("path_parts",))
    return out.select(F.concat("path_parts", F.array(F.coalesce("file_path", F.lit("")))).alias("path_parts"), F.col("data").alias("content"), F.coalesce("member_error", "error").alias("error"))


#: Row groups of a level: bytes, and rows after which the size is looked at first, as members may be large.
_LEVEL = {"compression": "zstd", "parquet.block.size": str(1 << 22), "parquet.page.size.row.check.min": "10"}


def expand_all(files: DataFrame, max_depth: int | None = None, partitions: int | None = None) -> DataFrame:
    """(path_parts, content, depth, error): the files and all members, level by level until a level has none. With max_depth,
    containers at that depth are not opened, and each gives one more row, without content and with an error. A level is spread
    by its row groups; with partitions, also by a hash of the paths over so many tasks, for which it is shuffled."""
    start = files.select("path_parts", "content").withColumn("depth", F.lit(0)).withColumn("error", F.lit(None).cast("string"))
    levels, level, depth = [start], start, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        inner = members(level.select("path_parts", "content")).withColumn("depth", F.lit(depth))
        level = materialise(inner.repartition(partitions, F.xxhash64("path_parts")) if partitions else inner, **_LEVEL)
        if not level.limit(1).count():
            break
        levels.append(level)
    else:
        left = level.filter(container_kind().isNotNull())
        levels.append(left.select("path_parts", F.lit(None).cast("binary").alias("content"), "depth", F.lit(f"container below level {max_depth} is not opened").alias("error")))
    return reduce(DataFrame.unionByName, levels)


_SCANNED = f"part string, content binary, member string, {TAGGED_SCHEMA}"


def _scanner(with_members: bool):
    """Rows of a file, which is looked at once: export rows of an executable, or the members of a container."""

    def run(data: bytes):
        if (kind := binary_kind(data)) is not None:
            for row in tagged_rows(kind, data):
                yield "export", None, None, *row
        elif with_members and kind_of_bytes(data) is not None:
            for name, raw, error in _members(data):
                yield "member", raw, name, *[None] * (TAGGED_WIDTH - 1), error

    return run


def scan_exports(files: DataFrame, containers: bool = False, compat: bool = False) -> DataFrame:
    """(path_parts, kind, ordinal, name, error) of (path, content). With containers=True, files in containers too, at any depth;
    a member or container that cannot be read gives a row with its path and the error.

    Every file is read and shipped once: one pass dispatches on its first bytes and gives the rows of both export formats, and
    the members of containers, which the next level is made of."""
    rows = files.select(F.array("path").alias("path_parts"), "content")
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(level: DataFrame) -> DataFrame:
        wanted = executable() | container_kind().isNotNull() if containers else executable()
        out = parse(level.filter(wanted), _scanner(containers), _SCANNED, ("path_parts",))
        return out.withColumn("error", F.coalesce("row_error", "error"))

    level = scan(rows)
    if not containers:
        return tagged_exports(level, ("path_parts",), compat)
    tagged, failed = [], []
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("ordinal", "bigint"), ("name", "string"))]
    while True:
        level = materialise(level)
        tagged.append(level.filter("part IS NULL OR part = 'export'"))
        inside = level.filter("part = 'member'").select(F.concat("path_parts", F.array("member")).alias("path_parts"), "content", "error")
        failed.append(inside.filter("error IS NOT NULL").select("path_parts", *nothing, "error"))
        inside = inside.filter("error IS NULL").drop("error")
        if not inside.limit(1).count():
            break
        level = scan(inside.repartition(n, F.xxhash64("path_parts")))
    return tagged_exports(reduce(DataFrame.unionByName, tagged), ("path_parts",), compat).unionByName(reduce(DataFrame.unionByName, failed))
