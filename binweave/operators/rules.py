"""Filtering and rewriting of the exports list, as Column expressions that Catalyst can fold and push down.

filter_exports applies any rule set; system_library_rules is the one for system libraries: it drops ordinal 0 and nested
paths, lower-cases paths, crops extraction folders, keeps libraries and a fixed list of system programs, and flattens the
folders of each operating system.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Programs that export an interface like a library.
PROGRAMS = ("user.exe", "gdi.exe", "krnl286.exe", "krnl386.exe", "ntoskrnl.exe", "ntkrnlmp.exe", "ntkrnlpa.exe", "ntkrpamp.exe")
#: Middle folders that are removed, and those that are kept, in paths of three pieces.
DROPPED_FOLDERS = ("win95", "win98", "win9x", "i386")
KEPT_FOLDERS = ("alpha", "mips", "ppc")

Rules = Callable[[DataFrame], DataFrame]


def filter_exports(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows of (path_parts, ordinal, name) that the rules keep, as (filename, ordinal, name)."""
    return rules(df).select("filename", "ordinal", "name")


def system_path(path_parts: Column, strict_syswow64: bool = False) -> Column:
    """The flattened path of a system library, or null if it is dropped."""
    low = F.lower(path_parts[0])
    low = F.when(low.rlike(r"^[a-z]:\\"), F.translate(low, "\\", "/")).otherwise(low)
    mark = F.lit("/_extracted/")
    at = F.instr(low, mark)
    path = F.when(at > 0, F.substring(low, at + 12, F.length(low))).when(low.startswith("_extracted/"), F.substring(low, F.lit(12), F.length(low))).otherwise(low)
    program = F.lit(False)
    for p in PROGRAMS:
        program = program | path.endswith(f"/{p}")
    kept = F.when(path.endswith(".exe"), program).otherwise(path.endswith(".dll"))
    p = F.split(path, "/")
    n = F.size(p)
    last = F.element_at(p, -1)
    without = lambda *gone: F.filter(p, lambda _, i: ~i.isin(*gone))
    interface = (last.startswith("api-") | last.startswith("ext-")) & last.endswith(".dll")
    wow = (p[1] == "windows") & (p[2] == "syswow64")
    flat = (p[1] == "windows") | (p[2] == "system32")
    if strict_syswow64:
        four = F.when(interface, F.lit(None)).when(wow, without(1)).when(flat, without(1, 2))
    else:
        four = F.when(interface, F.lit(None)).when(flat, without(1, 2)).when(wow, without(1))
    pieces = F.when(n == 2, p).when((n == 3) & p[1].isin(*DROPPED_FOLDERS), without(1)).when((n == 3) & p[1].isin(*KEPT_FOLDERS), p).when(n == 4, four)
    return F.when((F.size(path_parts) == 1) & kept, F.array_join(pieces, "/"))


def system_library_rules(strict_syswow64: bool = False) -> Rules:
    """By default a path under syswow64 is flattened like system32, because the wider test comes first; strict_syswow64 keeps
    the folder."""

    def run(df: DataFrame) -> DataFrame:
        kept = df.filter(F.col("ordinal").isNull() | (F.col("ordinal") != 0)).filter(F.size("path_parts") == 1)
        return kept.withColumn("filename", system_path(F.col("path_parts"), strict_syswow64)).filter(F.col("filename").isNotNull())

    return run
