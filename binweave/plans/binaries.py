"""Queries of the binary formats: rows of the tables are encoded to images, decoded by the engine, and compared with SQL on the
same rows. Every query runs over its whole tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.codecs import compressed
from binweave.formats import clr, debug, disks, ne, pe, pictures, synth
from binweave.formats.reader import parse
from binweave.functions import bytes_expr as B
from binweave.functions import codes, dostime
from binweave.functions import text_expr as X
from binweave.operators import containers, exports, rules, sections
from binweave.runtime import table
from binweave.sources import files as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A batch of encoded bytes ends when it is larger.
_BATCH = 1 << 24


def encode(f: Callable, kind: str = "binary"):
    """A row-wise encoder as an Arrow UDF. Images are larger than the rows that they are made of, so the batches are cut anew."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            out, size = [], 0
            for row in zip(*cols) if isinstance(cols, tuple) else ((x,) for x in cols):
                out.append(f(*row))
                size += len(out[-1]) if isinstance(out[-1], bytes) else sum(map(len, out[-1]))
                if size > _BATCH:
                    yield pd.Series(out, dtype=object)
                    out, size = [], 0
            if out:
                yield pd.Series(out, dtype=object)

    # Else filters on the bytes are pushed below the encoder, which then runs once more for each.
    return run.asNondeterministic()


def hexed(c: Column | str) -> Column:
    return F.lower(F.hex(c))


# ---- executables -------------------------------------------------------------------------------------------------------

_PARTS = "WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS k FROM p) "


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per supplier with its sorted parts, spread over all cores."""
    own = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    return own.repartition(spark.sparkContext.defaultParallelism, "l_suppkey")


def _dll(parts) -> bytes:
    return synth.pe_dll([(i + 1, f"fn_{p}" if p % 3 else None, f"OTHER.fn_{p}" if p % 7 == 0 else None) for i, p in enumerate(parts)])


@query(_PARTS + "SELECT l_suppkey AS file_id, 'pe' AS kind, k AS ordinal, CASE WHEN l_partkey % 3 <> 0 THEN 'fn_' || l_partkey END AS name FROM r")
def pe_exports(spark, sf):
    images = _parts(spark, sf).select(F.col("l_suppkey").alias("file_id"), encode(_dll)("parts").alias("content"))
    return exports.exports(images, ("file_id",)).select("file_id", "kind", "ordinal", "name")


@query(_PARTS + "SELECT l_suppkey AS file_id, k AS ordinal, CASE WHEN l_partkey % 7 = 0 THEN 'forwarder' ELSE 'code' END AS kind, CASE WHEN l_partkey % 7 = 0 THEN 'OTHER.fn_' || l_partkey END AS target, CASE WHEN l_partkey % 7 <> 0 THEN 1048576 + 16 * k END AS code_rva FROM r")
def pe_export_addresses(spark, sf):
    images = _parts(spark, sf).select(F.col("l_suppkey").alias("file_id"), encode(_dll)("parts").alias("content"))
    return parse(images, pe.pe_export_addresses, pe.EXPORT_ADDRESS_SCHEMA, ("file_id",)).select("file_id", "ordinal", "kind", "target", "code_rva")


def _pe_of(machine, stamp, size, wide) -> bytes:
    return synth.pe_file([(b".text", 0x1000, b"x" * int(size), int(size)), (b".data", 0x4000, b"y" * (int(size) * 2), int(size) * 2)], {1: (0x4000, int(size))}, machine=int(machine), stamp=int(stamp), wide=bool(wide))


def _pes(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), "p_size")
    machine = F.element_at(F.array(F.lit(0x14C), F.lit(0x8664), F.lit(0x1F0), F.lit(0x7777)), (F.col("file_id") % 4 + 1).cast("int"))
    return p.select("file_id", "p_size", encode(_pe_of)(machine, F.col("file_id") * 1000, F.col("p_size"), F.col("file_id") % 2).alias("content"))


@query("SELECT p_partkey AS file_id, CASE p_partkey % 4 WHEN 0 THEN 'I386' WHEN 1 THEN 'Amd64' WHEN 2 THEN 'PowerPc' ELSE 'Other(30583)' END AS machine, p_partkey * 1000 AS stamp, 2 AS n_sections, p_partkey % 2 = 1 AS wide, 'WindowsGui' AS subsystem, 'EXECUTABLE_IMAGE,IS_32BIT_MACHINE,DLL' AS flags FROM part")
def pe_headers(spark, sf):
    h = parse(_pes(spark, sf), pe.pe_header, pe.PE_HEADER_SCHEMA, ("file_id",))
    return h.select("file_id", codes.enum_text("MachineType", "machine").alias("machine"), F.col("time_date_stamp").alias("stamp"), F.col("section_count").alias("n_sections"), (F.col("magic") == 0x20B).alias("wide"), codes.enum_text("Subsystem", F.col("subsystem").cast("int")).alias("subsystem"), F.array_join(codes.flags_text("Characteristics", "characteristics"), ",").alias("flags"))


@query("""SELECT p_partkey AS file_id, pos, name, virtual_address, virtual_size, CAST((virtual_size + 511) // 512 * 512 AS BIGINT) AS raw_size FROM (
  SELECT p_partkey, 0 AS pos, '.text' AS name, CAST(4096 AS BIGINT) AS virtual_address, CAST(p_size AS BIGINT) AS virtual_size FROM part
  UNION ALL SELECT p_partkey, 1, '.data', 16384, 2 * p_size FROM part)""")
def pe_sections(spark, sf):
    s = parse(_pes(spark, sf), pe.pe_sections, pe.SECTION_SCHEMA, ("file_id",))
    return s.select("file_id", "pos", F.rtrim(F.translate(F.col("name").cast("string"), "\0", " ")).alias("name"), "virtual_address", "virtual_size", "raw_size")


@query("SELECT p_partkey AS file_id, CAST(i AS INT) AS idx, CASE WHEN i = 1 THEN CAST(16384 AS BIGINT) ELSE 0 END AS address, CASE WHEN i = 1 THEN CAST(p_size AS BIGINT) ELSE 0 END AS size FROM part, range(16) t(i)")
def pe_directories(spark, sf):
    return parse(_pes(spark, sf), pe.pe_directories, pe.DIRECTORY_SCHEMA, ("file_id",)).select("file_id", "idx", "address", "size")


def _resources(ids, names) -> bytes:
    return synth.pe_with_resources([(3 if i % 2 else 14, int(i), 1033 if i % 3 else 1031, n.encode()) for i, n in zip(ids, names)])


@query("SELECT c_custkey // 50 AS file_id, CASE WHEN c_custkey % 2 = 1 THEN 3 ELSE 14 END AS type_id, c_custkey AS res_id, CASE WHEN c_custkey % 3 <> 0 THEN 1033 ELSE 1031 END AS lang_id, lower(hex(encode(c_name))) AS data, CAST(strlen(c_name) AS BIGINT) AS size FROM customer")
def pe_resources(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.expr("c_custkey div 50").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("r"))
    images = c.select("file_id", encode(_resources)("r.c_custkey", "r.c_name").alias("content"))
    leaves = parse(images, pe.pe_resources, pe.RESOURCE_SCHEMA, ("file_id",))
    return exports.wanted_resources(leaves, [3, 14]).select("file_id", F.col("type_id").cast("int").alias("type_id"), "res_id", F.col("lang_id").cast("int").alias("lang_id"), hexed("data").alias("data"), "size")


def _ne(parts) -> bytes:
    bundles, ordinal, resident, other = [], 1, [(b"MODULE", 0)], [(b"Description", 0)]
    for p in parts:
        bundles.append((255 if p % 2 else 3, [(1 if p % 4 else 0, int(p) & 0xFFFF)]))
        if p % 3 == 0:
            resident.append((f"N{p}".encode(), ordinal))
        if p % 6 == 0:
            other.append((f"M{p}".encode(), ordinal))
        ordinal += 1
        if p % 5 == 0:
            bundles.append((0, [(0, 0)] * 2))
            ordinal += 2
    return synth.ne_dll(bundles, resident, other)


@query(_PARTS + """, n AS (SELECT *, k + 2 * CAST(coalesce(sum(CAST(l_partkey % 5 = 0 AS INT)) OVER (PARTITION BY l_suppkey ORDER BY l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ordinal FROM r)
SELECT l_suppkey AS file_id, ordinal, CASE WHEN l_partkey % 6 = 0 THEN 'M' || l_partkey WHEN l_partkey % 3 = 0 THEN 'N' || l_partkey END AS name FROM n WHERE l_partkey % 4 <> 0""")
def ne_exports(spark, sf):
    images = _parts(spark, sf).select(F.col("l_suppkey").alias("file_id"), encode(_ne)("parts").alias("content"))
    return exports.exports(images, ("file_id",)).select("file_id", "ordinal", "name")


@query(_PARTS + """, n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS q FROM r WHERE l_partkey % 3 = 0)
SELECT l_suppkey AS file_id, 'resident' AS table_kind, CAST(q + 1 AS INT) AS pos, 'N' || l_partkey AS name FROM n UNION ALL SELECT DISTINCT l_suppkey, 'resident', 0, 'MODULE' FROM p
UNION ALL SELECT DISTINCT l_suppkey, 'nonresident', 0, 'Description' FROM p
UNION ALL SELECT l_suppkey, 'nonresident', CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS INT), 'M' || l_partkey FROM r WHERE l_partkey % 6 = 0""")
def ne_name_tables(spark, sf):
    images = _parts(spark, sf).select(F.col("l_suppkey").alias("file_id"), encode(_ne)("parts").alias("content"))
    return parse(images, ne.ne_names, ne.NAME_SCHEMA, ("file_id",)).select("file_id", "table_kind", "pos", B.utf8("name").alias("name"))


#: Of one NE image: its tables lie within 64 KB of the header (12 bytes a resource), and data starts within 64 K units of 16 bytes.
_NE_RESOURCES, _NE_BYTES = 5000, 900_000


def _ne_resources(ids, sizes) -> list[bytes]:
    """The resources as images, of which each holds as many as the format lets it."""
    images, room = [], 0
    for i, s in zip(ids, sizes):
        padded = -(-int(s) // 16) * 16
        if not images or len(images[-1]) == _NE_RESOURCES or padded > room:
            images.append([])
            room = _NE_BYTES
        images[-1].append((3 if i % 2 else 8, int(i) & 0x7FFF, 0x30, bytes([i % 256]) * int(s)))
        room -= padded
    return [synth.ne_dll([(1, [(1, 0)])], [(b"M", 0)], resources=r) for r in images]


@query("""SELECT p_size AS file_id, CASE WHEN p_partkey % 2 = 1 THEN 3 ELSE 8 END AS res_type, CAST(p_partkey & 32767 AS INT) AS res_id, (length(p_name) + 15) // 16 * 16 AS size, CASE WHEN length(p_name) > 0 THEN lower(hex(p_partkey % 256 // 16) || hex(p_partkey % 16)) END AS first_byte FROM part""")
def ne_resources(spark, sf):
    # A file takes any number of images, from ranges of its keys, so that no list grows with the table.
    own = [F.col("p_size").alias("file_id"), F.expr("p_partkey div 65536").alias("range")]
    p = table(spark, sf, "part").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.length("p_name").alias("n")))).alias("r"))
    images = p.select("file_id", F.explode(encode(_ne_resources, "array<binary>")("r.p_partkey", "r.n")).alias("content"))
    rows = parse(images, ne.ne_resources, ne.NE_RESOURCE_SCHEMA, ("file_id",))
    return rows.select("file_id", (F.col("type_num") - 32768).alias("res_type"), (F.col("res_num") - 32768).alias("res_id"), F.length("data").cast("bigint").alias("size"), hexed(F.substring("data", 1, 1)).alias("first_byte"))


def _relocated(ords) -> bytes:
    # The imported name follows the two module names.
    records = b"".join(struct.pack("<BBHHH", 3, 1 if o % 2 else 2, i * 4, 1 if o % 3 else 2, int(o) % 60000 if o % 2 else 1 + 7 + 5) for i, o in enumerate(ords))
    return synth.ne_dll([(1, [(1, 0)])], [(b"M", 0)], segments=[(b"code" * 4, records)], modules=[b"KERNEL", b"USER"], imports=[b"ImportedName"])


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT c_custkey // 50 AS file_id, CAST(i * 4 AS INT) AS chain_offset, CASE WHEN c_custkey % 3 <> 0 THEN 'KERNEL' ELSE 'USER' END AS module_name, CASE WHEN c_custkey % 2 = 1 THEN CAST(c_custkey % 60000 AS INT) END AS import_ordinal, CASE WHEN c_custkey % 2 = 0 THEN 'ImportedName' END AS import_name FROM r""")
def ne_relocation_targets(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.expr("c_custkey div 50").alias("file_id")).agg(F.array_sort(F.collect_list("c_custkey")).alias("r"))
    images = c.select("file_id", encode(_relocated)("r").alias("content"))
    relocations = parse(images, ne.ne_relocations, ne.RELOCATION_SCHEMA, ("file_id",)).drop("error")
    imports = parse(images, ne.ne_import_modules, "kind string, idx int, offset int, name binary", ("file_id",)).drop("error")
    out = exports.relocation_targets(relocations, imports, ("file_id",))
    return out.select("file_id", "chain_offset", B.utf8("module_name").alias("module_name"), "import_ordinal", B.utf8("import_name").alias("import_name"))


# ---- section logic -----------------------------------------------------------------------------------------------------

_SECTIONS = """WITH s AS (SELECT p_brand AS file_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_partkey * 64 AS virtual_address, CAST(p_size * 3 AS BIGINT) AS virtual_size,
  CAST(p_size * 2 AS BIGINT) AS raw_size, p_partkey * 16 AS raw_ptr, p_name AS name FROM part) """


def _section_rows(spark, sf):
    from pyspark.sql import Window

    pos = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("bigint")
    return table(spark, sf, "part").select(F.col("p_brand").alias("file_id"), pos.alias("pos"), (F.col("p_partkey") * 64).alias("virtual_address"), (F.col("p_size") * 3).cast("bigint").alias("virtual_size"), (F.col("p_size") * 2).cast("bigint").alias("raw_size"), (F.col("p_partkey") * 16).alias("raw_ptr"), F.col("p_name").alias("name"))


@query(_SECTIONS + """, a AS (SELECT p_brand AS file_id, p_partkey * 64 + p_size AS rva FROM part), h AS (
  SELECT a.*, s.virtual_address, s.raw_ptr, s.raw_size, row_number() OVER (PARTITION BY a.file_id, a.rva ORDER BY s.pos) AS k FROM a LEFT JOIN s ON a.file_id = s.file_id AND rva >= virtual_address AND rva < virtual_address + virtual_size)
SELECT file_id, rva, CASE WHEN rva - virtual_address < raw_size THEN raw_ptr + rva - virtual_address END AS file_offset FROM h WHERE k = 1""")
def section_lookup(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_brand").alias("file_id"), (F.col("p_partkey") * 64 + F.col("p_size")).alias("rva"))
    return sections.section_lookup(a, _section_rows(spark, sf), ["file_id"])


@query(_SECTIONS + """, a AS (SELECT p_brand AS file_id, p_partkey * 16 + 1 AS file_offset FROM part), h AS (
  SELECT a.*, s.virtual_address, s.raw_ptr, row_number() OVER (PARTITION BY a.file_id, a.file_offset ORDER BY s.pos) AS k FROM a LEFT JOIN s ON a.file_id = s.file_id AND file_offset >= raw_ptr AND file_offset < raw_ptr + raw_size)
SELECT file_id, file_offset, virtual_address + file_offset - raw_ptr AS rva FROM h WHERE k = 1""")
def section_lookup_inverse(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_brand").alias("file_id"), (F.col("p_partkey") * 16 + 1).alias("file_offset"))
    return sections.section_lookup(a, _section_rows(spark, sf), ["file_id"], inverse=True)


@query(_SECTIONS + """, v AS (SELECT file_id, coalesce(max(virtual_address + virtual_size) OVER (PARTITION BY file_id ORDER BY virtual_address, virtual_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > virtual_address, false) AS hit FROM s
  UNION ALL SELECT file_id, coalesce(max(raw_ptr + raw_size) OVER (PARTITION BY file_id ORDER BY raw_ptr, raw_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > raw_ptr, false) FROM s WHERE raw_ptr <> 0 AND raw_size <> 0)
SELECT file_id, bool_or(hit) AS overlaps FROM v GROUP BY file_id""")
def section_overlap(spark, sf):
    return sections.section_overlap(_section_rows(spark, sf), ["file_id"])


@query(_SECTIONS.replace("CAST(p_size * 3 AS BIGINT)", "CAST(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_size * 3 END AS BIGINT)") + """
SELECT file_id, virtual_address, CASE WHEN virtual_size = 0 THEN least((raw_size + 511) // 512 * 512, lead(virtual_address) OVER (PARTITION BY file_id ORDER BY virtual_address, virtual_size, name) - virtual_address) ELSE virtual_size END AS virtual_size FROM s""")
def virtual_size_fix(spark, sf):
    s = _section_rows(spark, sf).withColumn("virtual_size", F.when(F.col("virtual_address") / 64 % 2 == 0, 0).otherwise(F.col("virtual_size")))
    return sections.virtual_size_fix(s, ["file_id"], F.lit(512)).select("file_id", "virtual_address", "virtual_size")


@query("""WITH o AS (SELECT p_brand AS file_id, p_partkey * 10 AS "at", max(p_partkey * 10 + 7) OVER (PARTITION BY p_brand) AS total FROM part)
SELECT file_id, "at", coalesce(lead("at") OVER (PARTITION BY file_id ORDER BY "at"), total) - "at" AS length FROM o""")
def lengths_from_offsets(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("file_id"), (F.col("p_partkey") * 10).alias("at"))
    total = p.groupBy("file_id").agg((F.max("at") + 7).alias("total"))
    return sections.lengths_from_offsets(p.join(total, "file_id"), ["file_id"], "at", "total").select("file_id", "at", "length")


@query("SELECT file_id, ordinal, name, forwarder FROM export_snapshots QUALIFY row_number() OVER (PARTITION BY file_id, ordinal ORDER BY row_id DESC) = 1")
def last_wins(spark, sf):
    return exports.last_wins(table(spark, sf, "export_snapshots").select("file_id", "ordinal", "name", "forwarder", "row_id"), ["file_id", "ordinal"], "row_id").select("file_id", "ordinal", "name", "forwarder")


@query("""WITH e AS (SELECT c_nationkey, c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Professional' WHEN 'MACHINERY' THEN 'Enterprise' WHEN 'FURNITURE' THEN 'Ultimate' ELSE 'Core' END AS edition_id FROM customer)
SELECT c_nationkey AS archive, CAST(c_custkey AS INT) AS "index", edition_id FROM e WHERE edition_id <> 'Core'
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE edition_id WHEN 'Ultimate' THEN 1 WHEN 'Enterprise' THEN 2 ELSE 3 END, c_custkey) = 1""")
def edition_choice(spark, sf):
    edition = F.when(F.col("c_mktsegment") == "BUILDING", "Professional").when(F.col("c_mktsegment") == "MACHINERY", "Enterprise").when(F.col("c_mktsegment") == "FURNITURE", "Ultimate").otherwise("Core")
    image = F.concat(F.lit('<IMAGE INDEX="'), F.col("c_custkey").cast("string"), F.lit('"><WINDOWS><EDITIONID>'), edition, F.lit("</EDITIONID></WINDOWS></IMAGE>"))
    xml = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("archive")).agg(F.concat(F.lit("<WIM>"), F.array_join(F.collect_list(image), ""), F.lit("</WIM>")).alias("xml"))
    return sections.chosen_edition(sections.image_editions(xml, "xml", ["archive"]), ["archive"])


@query("""SELECT dir_path AS folder, file_name, row_id FROM fat_files WHERE lower(trim(file_name)) IN ('setup', 'config')
QUALIFY row_number() OVER (PARTITION BY dir_path ORDER BY CASE lower(trim(file_name)) WHEN 'setup' THEN 1 ELSE 2 END, row_id) = 1""")
def first_match(spark, sf):
    f = table(spark, sf, "fat_files").select(F.col("dir_path").alias("folder"), "file_name", "row_id").withColumn("bare", F.trim("file_name"))
    return sections.first_match(f, ["folder"], "bare", ["setup", "config"], "row_id").select("folder", "file_name", "row_id")


# ---- rules and lists ---------------------------------------------------------------------------------------------------

_PATHS = ["win95/user.exe", "nt4/alpha/NTDLL.DLL", "w2k/i386/gdi32.dll", "w2k/x86/gdi32.dll", "xp/windows/system32/kernel32.dll", "xp/windows/syswow64/kernel32.dll", "w10/windows/system32/api-ms.dll", "C:\\win98\\shell.dll", "/x/_extracted/nt5/i386/ole.dll", "_extracted/nt5/mips/ole.dll", "nt/tools/setup.exe", "nt/krnl386.exe", "a/b/c/d/e.dll", "readme.txt", "os/other/dir/x.dll"]
_PATH_ARRAY = "[" + ", ".join("'" + p + "'" for p in _PATHS) + "]"
_RULES_SQL = f"""
WITH raw AS (SELECT p_partkey, ({_PATH_ARRAY})[CAST(p_partkey % {len(_PATHS)} + 1 AS INT)] AS path, p_partkey % 11 AS ordinal, p_name AS name FROM part WHERE p_partkey % 11 <> 0),
low AS (SELECT *, CASE WHEN regexp_matches(lower(path), '^[a-z]:\\\\') THEN replace(lower(path), '\\', '/') ELSE lower(path) END AS l FROM raw),
crop AS (SELECT *, CASE WHEN instr(l, '/_extracted/') > 0 THEN substr(l, instr(l, '/_extracted/') + 12) WHEN l LIKE '\\_extracted/%' ESCAPE '\\' THEN substr(l, 12) ELSE l END AS q FROM low),
cut AS (SELECT *, string_split(q, '/') AS p FROM crop WHERE CASE WHEN q LIKE '%.exe' THEN regexp_matches(q, '/(user|gdi|krnl286|krnl386|ntoskrnl|ntkrnlmp|ntkrnlpa|ntkrpamp)\\.exe$') ELSE q LIKE '%.dll' END),
flat AS (SELECT *, CASE WHEN len(p) = 2 THEN q
  WHEN len(p) = 3 AND p[2] IN ('win95', 'win98', 'win9x', 'i386') THEN p[1] || '/' || p[3] WHEN len(p) = 3 AND p[2] IN ('alpha', 'mips', 'ppc') THEN q
  WHEN len(p) = 4 AND regexp_matches(p[4], '^(api|ext)-.*\\.dll$') THEN NULL WHEN len(p) = 4 AND (p[2] = 'windows' OR p[3] = 'system32') THEN p[1] || '/' || p[4] END AS filename FROM cut)
SELECT filename, ordinal, name FROM flat WHERE filename IS NOT NULL"""


@query(_RULES_SQL)
def rules_filter(spark, sf):
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("p_partkey") % len(_PATHS) + 1).cast("int"))
    rows = table(spark, sf, "part").select(F.array(path).alias("path_parts"), (F.col("p_partkey") % 11).alias("ordinal"), F.col("p_name").alias("name"))
    return rules.filter_exports(rows, rules.system_library_rules())


@query("SELECT string_split(replace(path_parts[len(path_parts)], chr(92), '/'), '/')[-1] AS base_name, count(*) AS n_rows, count(ordinal) AS n_ordinals, count(CASE WHEN name <> '' THEN 1 END) AS n_names FROM exports GROUP BY 1")
def exports_list_parsed(spark, sf):
    """The whole list by base name; rows without a name or an ordinal are lines with empty cells."""
    rows = src.parse_lines(src.exports_lines(table(spark, sf, "exports").select("path_parts", "ordinal", "name")), mode="FAILFAST")
    return rows.groupBy("base_name").agg(F.count("*").alias("n_rows"), F.count("ordinal").alias("n_ordinals"), F.count("name").alias("n_names"))


# ---- scalar functions --------------------------------------------------------------------------------------------------

@query(r"""SELECT event_id, replace(replace(replace(replace(t, chr(92), chr(92) || chr(92)), chr(13), chr(92) || 'r'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') AS escaped, t AS restored FROM (SELECT event_id, props || chr(9) || event_type || chr(92) || 'n' || chr(10) AS t FROM events)""")
def escape_name(spark, sf):
    t = table(spark, sf, "events").select("event_id", F.concat("props", F.lit("\t"), "event_type", F.lit("\\n\n")).alias("t"))
    return t.select("event_id", X.escape_name("t").alias("escaped"), X.unescape_name(X.escape_name("t")).alias("restored"))


@query(r"""SELECT p_partkey, 'b"' || p_name || '\x' || upper(hex(encode(chr(233)))[1:2]) || '\x' || upper(hex(encode(chr(233)))[3:4]) || '\0\n\""' AS shown, '[0x' || array_to_string(regexp_extract_all(hex(encode(p_type)), '..'), ', 0x') || ']' AS hexed FROM part""")
def display_bytes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.encode("p_name", "UTF-8"), F.unhex(F.lit("C3A9000A22"))).alias("b"), F.encode("p_type", "UTF-8").alias("t"))
    return p.select("p_partkey", X.display_bytes("b").alias("shown"), X.hex_bytes("t").alias("hexed"))


@query("SELECT file_id, string_split(replace(path_parts[1], chr(92), '/'), '/')[-1] AS base_name, CASE WHEN path_parts[1] LIKE 'KQ-%' THEN substr(path_parts[1], 4) END AS rest, array_to_string(path_parts, '!') AS joined, count(*) AS n FROM exports GROUP BY ALL")
def path_functions(spark, sf):
    e = table(spark, sf, "exports")
    return e.select("file_id", X.base_name(F.col("path_parts")[0]).alias("base_name"), X.remove_prefix(F.col("path_parts")[0], "KQ-").alias("rest"), X.join_parts("!", "path_parts").alias("joined")).groupBy("file_id", "base_name", "rest", "joined").agg(F.count("*").alias("n"))


def _bytes_of(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2 * width, "0"))


@query("SELECT o_orderkey, o_orderkey AS be32, CAST((o_orderkey & 255) * 16777216 + (o_orderkey >> 8 & 255) * 65536 + (o_orderkey >> 16 & 255) * 256 + (o_orderkey >> 24 & 255) AS BIGINT) AS le32, CAST(o_orderkey & 65535 AS BIGINT) AS be16, CAST((o_orderkey & 255) * 256 + (o_orderkey >> 8 & 255) AS BIGINT) AS le16, CAST(NULL AS BIGINT) AS past FROM orders")
def fixed_width_integers(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", _bytes_of(F.col("o_orderkey"), 4).alias("b"))
    return o.select("o_orderkey", B.u32_be("b", 0).alias("be32"), B.u32_le("b", 0).alias("le32"), B.u16_be("b", 2).alias("be16"), B.u16_le("b", 2).alias("le16"), B.u32_le("b", 1).alias("past"))


@query("SELECT p_partkey, p_name AS z, p_type AS pascal, p_brand AS wide, p_name AS latin FROM part")
def byte_strings(spark, sf):
    p = table(spark, sf, "part")
    z = F.concat(F.encode("p_name", "UTF-8"), F.unhex(F.lit("00414200")))
    pas = F.concat(F.unhex(F.lpad(F.hex(F.length("p_type")), 2, "0")), F.encode("p_type", "UTF-8"), F.unhex(F.lit("FF")))
    wide = F.concat(F.unhex(F.rpad(F.lpad(F.hex(F.length("p_brand")), 2, "0"), 4, "0")), F.encode("p_brand", "UTF-16LE"))
    return p.select("p_partkey", z.alias("a"), pas.alias("b"), wide.alias("c"), F.encode("p_name", "ISO-8859-1").alias("d")).select("p_partkey", B.c_string("a", 0).alias("z"), B.utf8(B.pascal_string("b", 0)).alias("pascal"), B.utf16_pascal_string("c", 0).alias("wide"), B.latin1("d").alias("latin"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, strftime(make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), hour(o_orderdate), minute(o_orderdate), CAST(second(o_orderdate) // 2 * 2 AS DOUBLE)), '%Y-%m-%d %H:%M:%S') AS packed, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS digits FROM orders")
def dos_and_disc_times(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", dostime.pack_dos_date("o_orderdate").alias("dd"), dostime.pack_dos_time("o_orderdate").alias("tt"), F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("t"))
    y, m, d = dostime.dos_date_parts("dd")
    return o.select("o_orderkey", y.alias("y"), m.alias("m"), d.alias("d"), F.date_format(dostime.dos_timestamp("dd", "tt"), "yyyy-MM-dd HH:mm:ss").alias("packed"), F.date_format(dostime.iso_digit_timestamp(F.concat("t", F.lit("00"))), "yyyy-MM-dd HH:mm:ss").alias("digits"))


@query("SELECT p_partkey, CAST((p_size + 15) // 16 * 16 AS BIGINT) AS aligned, CAST(p_size % 32 * 255 // 31 AS BIGINT) AS scaled, CAST(p_size * 72000 // CASE WHEN p_size % 3 = 0 THEN 72 ELSE p_size END AS BIGINT) AS width, p_size & 5 = 5 AS both_flags FROM part")
def integer_functions(spark, sf):
    p = table(spark, sf, "part")
    s = F.col("p_size")
    return p.select("p_partkey", B.align_up(s, 16).alias("aligned"), B.scale_5_to_8(s % 32).alias("scaled"), B.afm_width(s, F.when(s % 3 == 0, 0).otherwise(s)).alias("width"), B.has_flags(s, 5).alias("both_flags"))


@query("""SELECT row_id, array_to_string(list_filter([CASE WHEN attributes & 1 > 0 THEN 'READ_ONLY' END, CASE WHEN attributes & 2 > 0 THEN 'HIDDEN' END, CASE WHEN attributes & 4 > 0 THEN 'SYSTEM' END, CASE WHEN attributes & 8 > 0 THEN 'VOLUME_LABEL' END,
 CASE WHEN attributes & 16 > 0 THEN 'SUBDIRECTORY' END, CASE WHEN attributes & 32 > 0 THEN 'ARCHIVE' END, CASE WHEN attributes & 64 > 0 THEN 'DEVICE' END, CASE WHEN attributes & 128 > 0 THEN 'RESERVED' END], lambda x: x IS NOT NULL), ',') AS names FROM fat_files""")
def attribute_names(spark, sf):
    return table(spark, sf, "fat_files").select("row_id", F.array_join(codes.flags_text("Attributes", "attributes"), ",").alias("names"))


# ---- compression -------------------------------------------------------------------------------------------------------

_DOC_MD5 = "SELECT doc_id, strlen(text) AS n_bytes, md5(text) AS digest FROM documents"


def _round_trip(name: str, pack: Callable[[bytes], bytes], unpack: Callable[[bytes], bytes]) -> None:
    def run(spark, sf):
        d = table(spark, sf, "documents").repartition(spark.sparkContext.defaultParallelism).select("doc_id", encode(lambda t: pack(t.encode()))("text").alias("content"))
        plain = parse(d, lambda b: [(unpack(b),)], "data binary", ("doc_id",))
        return plain.select("doc_id", F.length("data").cast("bigint").alias("n_bytes"), F.md5("data").alias("digest"))

    run.__name__ = name
    query(_DOC_MD5)(run)


def _deflate(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


_round_trip("inflate_round_trip", _deflate, compressed.inflate)
_round_trip("szdd_round_trip", synth.szdd, compressed.expand)
_round_trip("sz_round_trip", synth.sz, compressed.expand)
for _m in range(5):
    _round_trip(f"kwaj_{_m}_round_trip", lambda b, m=_m: synth.kwaj(b, m), compressed.expand)


# ---- disks and cabinets ------------------------------------------------------------------------------------------------

def _customers(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.expr("c_custkey div 50").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("r"))
    return c.select("file_id", F.col("r.c_custkey").alias("k"), F.col("r.c_name").alias("n"))


_MEMBER = "SELECT c_custkey // 50 AS file_id, {name} AS file_path, md5(repeat(c_name, CAST(c_custkey % 9 * 40 + 1 AS INT))) AS digest FROM customer"


def _members(keys, names, name: Callable[[int], str]) -> list[tuple[str, bytes]]:
    return [(name(int(k)), n.encode() * (int(k) % 9 * 40 + 1)) for k, n in zip(keys, names)]


def _extract(name: str, member: str, sql_name: str, build: Callable[[list], bytes], run) -> None:
    def q(spark, sf):
        images = _customers(spark, sf).select("file_id", encode(lambda k, n: build(_members(k, n, lambda i: member.format(i))))("k", "n").alias("content"))
        return parse(images, run, disks.MEMBER_SCHEMA, ("file_id",)).select("file_id", "file_path", F.md5("data").alias("digest"))

    q.__name__ = name
    query(_MEMBER.format(name=sql_name))(q)


for _name, _method in (("stored", 0), ("mszip", 1), ("lzx_stored", 3)):
    _extract(f"cab_extract_{_name}", "dir\\f{}.txt", "'dir' || chr(92) || 'f' || c_custkey || '.txt'", lambda m, k=_method: synth.cab(m, k, (8, 2, 4) if k else None), disks.cab_extract())
for _bits in (12, 16, 32):
    _extract(f"fat{_bits}_extract", "SUB/F{}.TXT", "'SUB/F' || c_custkey || '.TXT'", lambda m, b=_bits: synth.fat(m, b, fragmented=b == 16), disks.fat_extract())
for _name, _sierra in (("iso", False), ("high_sierra", True)):
    _extract(f"{_name}_extract", "SUB/F{}.TXT", "'SUB/F' || c_custkey || '.TXT;1'", lambda m, s=_sierra: synth.iso(m, s), disks.iso_extract())


@query("""SELECT c_custkey // 50 AS file_id, CAST(row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS INT) AS pos, 'f' || c_custkey AS file_path, CAST(strlen(c_name) * (c_custkey % 9 * 40 + 1) AS BIGINT) AS size,
 CAST(coalesce(sum(strlen(c_name) * (c_custkey % 9 * 40 + 1)) OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", '2001-04-01 02:30:42' AS modified, 'mszip' AS method FROM customer""")
def cab_files(spark, sf):
    images = _customers(spark, sf).select("file_id", encode(lambda k, n: synth.cab(_members(k, n, lambda i: f"f{i}"), 1))("k", "n").alias("content"))
    rows = parse(images, disks.cab_files, disks.CAB_FILE_SCHEMA, ("file_id",))
    return rows.select("file_id", "pos", "file_path", "size", "offset", F.date_format(dostime.dos_timestamp("date", "time"), "yyyy-MM-dd HH:mm:ss").alias("modified"), "method")


@query("SELECT c_custkey // 50 AS file_id, count(*) AS n_files, CAST(sum(strlen(c_name) * (c_custkey % 9 * 40 + 1)) AS BIGINT) AS n_bytes, 'ARCHIVE' AS names FROM customer GROUP BY 1")
def fat_directory(spark, sf):
    images = _customers(spark, sf).select("file_id", encode(lambda k, n: synth.fat(_members(k, n, lambda i: f"F{i}"), 16))("k", "n").alias("content"))
    rows = parse(images, disks.fat_files, disks.FAT_FILE_SCHEMA, ("file_id",))
    return rows.groupBy("file_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.min(F.array_join(codes.flags_text("Attributes", "attributes"), ",")).alias("names"))


@query("SELECT c_custkey // 50 AS file_id, CAST(sum((strlen(c_name) * (c_custkey % 9 * 40 + 1) + 511) // 512) AS BIGINT) AS n_clusters FROM customer GROUP BY 1")
def fat_chains(spark, sf):
    images = _customers(spark, sf).select("file_id", encode(lambda k, n: synth.fat(_members(k, n, lambda i: f"F{i}"), 12, fragmented=False))("k", "n").alias("content"))
    rows = parse(images, disks.fat_entries, disks.FAT_ENTRY_SCHEMA, ("file_id",))
    return rows.filter("cluster >= 2 AND kind <> 'empty'").groupBy("file_id").agg(F.count("*").alias("n_clusters"))


@query("SELECT doc_id, md5(text) AS digest, 3 AS depth FROM documents")
def nested_containers(spark, sf):
    """Each document inside a compressed file inside a cabinet inside a disc image."""
    build = encode(lambda d, t: synth.iso([("A.CAB", synth.cab([(f"{d}.TX_", synth.kwaj(t.encode(), 1))], 1))]))
    rows = table(spark, sf, "documents").select(F.array(F.col("doc_id").cast("string")).alias("path_parts"), build("doc_id", "text").alias("content"))
    out = containers.expand_all(rows, max_depth=4)
    # By the depth, which is known of every level, else the discs would be built once more to be dropped.
    return out.filter("depth = 3").select(F.col("path_parts")[0].cast("bigint").alias("doc_id"), F.md5("content").alias("digest"), "depth")


# ---- debug data and resources ------------------------------------------------------------------------------------------

def _symbols(keys, names) -> bytes:
    body = struct.pack("<I", 1) + b"".join(synth.symbol(0x202 if k % 2 else 0x102, (struct.pack("<IHH", int(k), 1, 0x74) if k % 2 else struct.pack("<HHH", int(k) & 0xFFFF, 1, 0x74)) + synth.pascal(n)) for k, n in zip(keys, names))
    lines = synth.line_module([("main.c", [(1, [(int(k) * 4, int(k) % 60000) for k in keys])])])
    types = synth.global_types([struct.pack("<HHH", 1, 1, 0x74) + b"", *[struct.pack("<HHHHHHHH", 5, 2, 0x1001, 0, 0, 0, int(k) % 30000, 0)[:14] + synth.pascal(n) for k, n in zip(keys, names)]])
    libraries = b"".join(synth.pascal(n) for n in names)
    return synth.dbg(synth.codeview([(0x125, 1, body), (0x127, 1, lines), (0x12B, 0, types), (0x128, 0, libraries)]), ["_main"], 12345)


def _debug_files(spark, sf):
    return _customers(spark, sf).select("file_id", encode(_symbols)("k", "n").alias("content"))


@query("""SELECT c_custkey // 50 AS file_id, CASE WHEN c_custkey % 2 = 1 THEN 'GlobalData32' ELSE 'GlobalData16' END AS kind, CASE WHEN c_custkey % 2 = 1 THEN c_custkey ELSE c_custkey & 65535 END AS "offset", 1 AS segment, 116 AS value_type, c_name AS name FROM customer""")
def cv_symbols(spark, sf):
    return parse(_debug_files(spark, sf), debug.cv_symbols, debug.SYMBOL_SCHEMA, ("file_id",)).select("file_id", "kind", "offset", "segment", "value_type", "name")


@query("SELECT c_custkey // 50 AS file_id, 'main.c' AS file_name, 1 AS segment_index, c_custkey * 4 AS \"offset\", CAST(c_custkey % 60000 AS INT) AS line FROM customer")
def cv_lines(spark, sf):
    return parse(_debug_files(spark, sf), debug.cv_lines, debug.LINE_SCHEMA, ("file_id",)).drop("error")


@query("""SELECT c_custkey // 50 AS file_id, CAST(4096 + row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) AS INT) AS type_index, 'Structure' AS leaf, c_name AS name, CAST(c_custkey % 30000 AS BIGINT) AS length FROM customer
 UNION ALL SELECT DISTINCT c_custkey // 50, 4096, 'Modifier', NULL, NULL FROM customer""")
def cv_types(spark, sf):
    rows = parse(_debug_files(spark, sf), debug.cv_types, debug.TYPE_SCHEMA, ("file_id",))
    v = F.parse_json("payload")
    return rows.select("file_id", "type_index", "leaf", F.variant_get(v, "$.name", "string").alias("name"), F.variant_get(v, "$.length", "bigint").alias("length"))


@query("SELECT c_custkey // 50 AS file_id, CAST(row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS INT) AS pos, c_name AS name FROM customer")
def cv_libraries(spark, sf):
    return parse(_debug_files(spark, sf), debug.cv_libraries, debug.LIBRARY_SCHEMA, ("file_id",)).drop("error")


def _dbg_of(machine, characteristics, base, size) -> bytes:
    return struct.pack("<HHHH10I", 0x4944, 0, int(machine), int(characteristics), 7, 0, int(base) & 0xFFFFFFFF, int(size) & 0xFFFFFFFF, 0, 2, 0, 0x1000, 0, 0) + b"f\0"


@query("""SELECT row_id, machine, image_base, image_size, list_contains(list_filter([1, 2, 4, 8, 256, 8192], lambda b: characteristics & b > 0), 8192) AS is_dll FROM dbg_headers""")
def dbg_headers(spark, sf):
    d = table(spark, sf, "dbg_headers")
    images = d.select("row_id", encode(_dbg_of)("machine", "characteristics", "image_base", "image_size").alias("content"))
    rows = parse(images, debug.dbg_header, debug.DBG_HEADER_SCHEMA, ("row_id",))
    return rows.select("row_id", "machine", "image_base", "image_size", F.array_contains(codes.flags_text("Characteristics", "characteristics"), "DLL").alias("is_dll"))


def _managed(keys, names) -> bytes:
    return synth.clr_pe([synth.clr_container([(f"k{k}", 1 if k % 2 else 33, n.encode() * (int(k) % 5)) for k, n in zip(keys, names)])])


@query("SELECT c_custkey // 50 AS file_id, 'k' || c_custkey AS name, CASE WHEN c_custkey % 2 = 1 THEN 'String' ELSE 'Stream' END AS type_name, CAST(strlen(c_name) * (c_custkey % 5) AS BIGINT) AS length, md5(repeat(c_name, CAST(c_custkey % 5 AS INT))) AS digest FROM customer")
def clr_resources(spark, sf):
    images = _customers(spark, sf).select("file_id", encode(_managed)("k", "n").alias("content"))
    rows = parse(images, clr.clr_resources, clr.CLR_RESOURCE_SCHEMA, ("file_id",))
    return rows.select("file_id", "name", "type_name", F.length("data").cast("bigint").alias("length"), F.md5("data").alias("digest"))


# ---- pictures ----------------------------------------------------------------------------------------------------------

@query("SELECT p_brand AS file_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS pos, CAST(p_size % 256 AS INT) AS width, CAST(p_size % 7 + 1 AS INT) AS height, CAST(p_partkey % 60000 AS INT) AS id FROM part")
def icon_groups(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))).alias("r"))
    images = p.select("file_id", encode(lambda k, s: synth.icon_group([(int(x) % 256, int(x) % 7 + 1, 4, int(i) % 60000) for i, x in zip(k, s)]))("r.p_partkey", "r.p_size").alias("content"))
    return parse(images, pictures.icon_group, pictures.ICON_GROUP_SCHEMA, ("file_id",)).select("file_id", "pos", "width", "height", "id")


@query("SELECT p_partkey AS file_id, 2 AS width, 1 AS height, lower(printf('%02X%02X%02XFF%02X0000FF', p_partkey % 256, p_size, 7, p_size)) AS rgba FROM part")
def bitmap_pixels(spark, sf):
    build = encode(lambda k, s: synth.bitmap24(2, 1, bytes([k % 256, s, 7, s, 0, 0])))
    images = table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), build("p_partkey", "p_size").alias("content"))
    return parse(images, pictures.bitmap(), pictures.BITMAP_SCHEMA, ("file_id",)).select("file_id", "width", "height", hexed("rgba").alias("rgba"))


@query("SELECT p_partkey AS file_id, CAST(65 + i AS INT) AS char_code, 9 AS width, lower(printf('%02X%02X%02X%02X', p_size, 128, i, 0)) AS bitmap FROM part, range(2) t(i)")
def font_glyphs(spark, sf):
    build = encode(lambda s: synth.font2([(9, bytes([s, 128, i, 0])) for i in range(2)], 2, 65))
    images = table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), build("p_size").alias("content"))
    return parse(images, pictures.font_glyphs, pictures.GLYPH_SCHEMA, ("file_id",)).select("file_id", "char_code", "width", hexed("bitmap").alias("bitmap"))
