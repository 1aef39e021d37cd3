"""Queries of the commands of the API and of the parsers and sinks behind them, over images that are encoded from whole tables,
with the SQL that gives the same from the rows."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from binweave import api
from binweave.formats import clr, debug, disks, pe, pictures, synth
from binweave.formats.reader import parse
from binweave.functions import bytes_expr as B
from binweave.functions import codes
from binweave.functions import text_expr as X
from binweave.operators import exports
from binweave.plans.binaries import _customers, _debug_files, _members, encode, hexed
from binweave.runtime import table
from binweave.sources import files as src

QUERIES, SQL = {}, {}
P = struct.pack
_PER_FILE = "c_custkey // 50 AS path"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _files(spark, sf, build):
    """(path, content): one image per fifty customers, built from their keys and names."""
    return _customers(spark, sf).select(F.col("file_id").alias("path"), encode(build)("k", "n").alias("content"))


# ---- executables -------------------------------------------------------------------------------------------------------

def _mz(keys, names) -> bytes:
    head = b"MZ" + P("<13H", 0, 1, len(keys), 4, 0, 0xFFFF, 0, 0xB8, 0, 0, 0, 0x40, 0)
    return head.ljust(64, b"\0") + b"".join(P("<HH", int(k) & 0xFFFF, int(k) % 7) for k in keys)


@query(f"SELECT {_PER_FILE}, CAST(row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS INT) AS pos, CAST(c_custkey & 65535 AS INT) AS \"offset\", CAST(c_custkey % 7 AS INT) AS segment, 184 AS initial_sp FROM customer")
def command_mz_header(spark, sf):
    rows = api.mz_header(_files(spark, sf, _mz))
    return rows.select("path", "initial_sp", F.posexplode("relocations").alias("pos", "r")).select("path", "pos", "r.offset", "r.segment", "initial_sp")


def _ne(keys, names) -> bytes:
    flags = int(keys[0]) % 256
    raw = bytearray(synth.ne_dll([(1, [(1, 0)])], [(b"M", 0), (b"F", 1)], resources=[(14, 9, 0x30, synth.icon_group([(int(k) % 256, 16, 4, int(k) % 30000) for k in keys])), (8, 5, 0x30, synth.font2([(9, bytes(range(8)))], 4))]))
    raw[64 + 12 : 64 + 14] = P("<H", 0x8000 | flags & 0xF)
    return bytes(raw)


@query("SELECT c_custkey // 50 AS path, 5 AS linker_major, 1 AS linker_minor, CAST(32768 + min(c_custkey) % 16 AS INT) AS flags, array_to_string(list_filter([CASE WHEN min(c_custkey) & 1 > 0 THEN 'SINGLE_DATA' END, CASE WHEN min(c_custkey) & 2 > 0 THEN 'MULTIPLE_DATA' END, CASE WHEN min(c_custkey) & 4 > 0 THEN 'GLOBAL_INIT' END, CASE WHEN min(c_custkey) & 8 > 0 THEN 'PROTECTED_MODE_ONLY' END, 'LIBRARY_MODULE'], lambda x: x IS NOT NULL), ',') AS names FROM customer GROUP BY 1")
def command_ne_header(spark, sf):
    return api.ne_header(_files(spark, sf, _ne)).select("path", "linker_major", "linker_minor", "flags", F.array_join("flag_names", ",").alias("names"))


@query(f"SELECT {_PER_FILE}, CAST(row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS INT) AS pos, CAST(c_custkey % 256 AS INT) AS width, CAST(c_custkey % 30000 AS INT) AS id, CAST(c_custkey % 30000 + 32768 AS INT) AS raw_id FROM customer")
def command_ne_icon_groups(spark, sf):
    return api.ne_icon_groups(_files(spark, sf, _ne)).select("path", "pos", "width", "id", "raw_id")


@query("SELECT DISTINCT c_custkey // 50 AS path, 'fonti32773.' || f AS file_name, f = 'fnt' OR f = 'bdf' AS known FROM customer, (SELECT unnest(['fnt', 'fd', 'bdf']) AS f)")
def command_ne_fonts(spark, sf):
    """All three forms of a font resource under their file names."""
    files = _files(spark, sf, _ne)
    heads = {"fnt": b"\0\2", "bdf": b"STARTFONT", "fd": b"-"}
    parts = [api.ne_fonts(files, f, "font").select("path", "file_name", B.has_magic("font", heads[f]).alias("known")) for f in heads]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _resources(keys, names) -> bytes:
    return synth.pe_with_resources([(16 if k % 2 else 10, int(k), 1033 if k % 3 else 1031, n.encode()) for k, n in zip(keys, names)])


@query("SELECT c_custkey // 50 AS path, c_custkey AS res_id, c_name AS data FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def command_pe_resources(spark, sf):
    """Resources of one type and language."""
    rows = exports.wanted_resources(api.pe_resources(_files(spark, sf, _resources)), [16], lang=1031)
    return rows.select("path", "res_id", F.col("data").cast("string").alias("data"))


@query("SELECT DISTINCT c_custkey // 50 AS path, 'I386' AS machine_name, 'EXECUTABLE_IMAGE,IS_32BIT_MACHINE,DLL' AS names, 1 AS section_count FROM customer")
def command_pe_header(spark, sf):
    return api.pe_header(_files(spark, sf, _resources)).select("path", "machine_name", F.array_join("characteristic_names", ",").alias("names"), "section_count")


@query("SELECT c_custkey // 50 AS path, CASE WHEN count(*) > 0 THEN 'pe' END AS kind FROM customer GROUP BY 1")
def command_interpret(spark, sf):
    return api.interpret(_files(spark, sf, _resources))


# ---- disks and cabinets ------------------------------------------------------------------------------------------------

def _disk(keys, names) -> bytes:
    return synth.fat(_members(keys, names, lambda i: f"F{i}"), 16)


@query("SELECT DISTINCT c_custkey // 50 AS path, 16 AS variant, 512 AS bytes_per_sector, 1 AS sectors_per_cluster, 1 AS reserved_sectors, 'SYNTHETIC' AS label FROM customer")
def command_fat_header(spark, sf):
    return api.fat_header(_files(spark, sf, _disk)).select("path", "variant", "bytes_per_sector", "sectors_per_cluster", "reserved_sectors", "label")


@query("""SELECT c_custkey // 50 AS path, rpad('F' || c_custkey, 11, ' ') AS name, 32 AS attributes, CAST(strlen(c_name) * (c_custkey % 9 * 40 + 1) AS BIGINT) AS size FROM customer
 UNION ALL SELECT DISTINCT c_custkey // 50, 'LABEL      ', 8, 0 FROM customer""")
def command_fat_directory(spark, sf):
    """Every entry of the root but the deleted one."""
    rows = api.fat_directory(_files(spark, sf, _disk)).filter(~B.has_magic("name", b"\xe5"))
    return rows.select("path", B.latin1("name").alias("name"), "attributes", "size")


@query("SELECT c_custkey // 50 AS path, md5(arg_min(repeat(c_name, CAST(c_custkey % 9 * 40 + 1 AS INT)), c_custkey)) AS digest FROM customer GROUP BY 1")
def command_fat_data(spark, sf):
    """The chain of the first file, cut to its size, which the directory states."""
    files = _files(spark, sf, _disk)
    first = parse(files, disks.fat_files, disks.FAT_FILE_SCHEMA).filter("first_cluster = 2").select("path", "size")
    return api.fat_data(files, 2).join(first, "path").select("path", F.md5(F.expr("substring(data, 1, CAST(size AS INT))")).alias("digest"))


def _disc(keys, names) -> bytes:
    return synth.iso(_members(keys, names, lambda i: f"F{i}.TXT"))


@query("SELECT DISTINCT c_custkey // 50 AS path, 'PrimaryVolumeDescriptor' AS kind_name, 'SYNTH' AS system_id, 'VOLUME' AS volume_id, 2048 AS block_size FROM customer")
def command_cd_volume(spark, sf):
    return api.cd_volume(_files(spark, sf, _disc)).select("path", "kind_name", "system_id", "volume_id", "block_size")


@query("""SELECT c_custkey // 50 AS path, CAST(row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) + 1 AS INT) AS pos, 'F' || c_custkey || '.TXT;1' AS name, CAST(strlen(c_name) * (c_custkey % 9 * 40 + 1) AS BIGINT) AS size, 0 AS flags FROM customer""")
def iso_directory_records(spark, sf):
    """Records of the root but its own and its parent's."""
    rows = parse(_files(spark, sf, _disc), disks.iso_records(), disks.DIRECTORY_RECORD_SCHEMA)
    return rows.filter("pos > 1").select("path", "pos", B.latin1("name").alias("name"), "size", "flags")


def _with_tables(keys, names) -> bytes:
    """A disc with a partition descriptor, path tables in both byte orders, and an attribute record per file."""
    raw = bytearray(20 * 2048)
    raw[0x8000:0x8006] = b"\1CD001"
    raw[0x8000 + 128 : 0x8000 + 130] = P("<H", 2048)
    raw[0x8800:0x8806], raw[0x8800 + 40 : 0x8800 + 72] = b"\3CD001", names[0].encode().ljust(32)
    raw[0x8800 + 72 : 0x8800 + 80] = P("<I", int(keys[0]) & 0xFFFFFFFF) + bytes(4)
    raw[0x8800 + 80 : 0x8800 + 84] = P("<I", len(keys))
    raw[0x9000:0x9006] = b"\xffCD001"
    tables = {"<": b"", ">": b""}
    for i, k in enumerate(keys):
        name = f"D{k}".encode()
        for order in tables:
            tables[order] += P(order + "BBIH", len(name), 0, 1000 + i, 1) + name + bytes(len(name) & 1)
    raw[0x8000 + 132 : 0x8000 + 136] = P("<I", len(tables["<"]))
    raw[0x8000 + 140 : 0x8000 + 144], raw[0x8000 + 148 : 0x8000 + 152] = P("<I", 20), P(">I", 30)
    out = bytes(raw) + tables["<"].ljust(10 * 2048, b"\0") + tables[">"].ljust(10 * 2048, b"\0")
    stamps = b"".join(f"{1990 + i}010203040506".ljust(16, "0").encode() + b"\0" for i in range(4))
    record = P("<H", int(keys[0]) & 0xFFFF) + bytes(2) + P("<H", 7) + bytes(2) + b"\1\2" + stamps + bytes([3, 4]) + P("<HH", 512, 0) + b"SYSTEM".ljust(32) + bytes(64)
    return out + (record + bytes([1, 0])).ljust(2048, b"\0")


@query("""WITH r AS (SELECT c_custkey // 50 AS path, 'D' || c_custkey AS name, row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) AS k FROM customer)
 SELECT path, CAST(k AS INT) AS pos, name, 999 + k AS extent, 1 AS parent, o AS "order" FROM r, (SELECT unnest(['<', '>']) AS o)""")
def iso_path_tables(spark, sf):
    """The path table in both byte orders."""
    files = _files(spark, sf, _with_tables)
    one = lambda big, name: parse(files, disks.iso_path_table(big), disks.PATH_TABLE_SCHEMA).drop("error").withColumn("order", F.lit(name))
    return one(False, "<").unionByName(one(True, ">"))


@query("SELECT c_custkey // 50 AS path, 1 AS pos, arg_min(c_name, c_custkey) AS partition_id, min(c_custkey) AS location, count(*) AS size FROM customer GROUP BY 1")
def iso_partitions(spark, sf):
    return parse(_files(spark, sf, _with_tables), disks.iso_partitions, disks.PARTITION_SCHEMA).select("path", "pos", "partition_id", "location", "size")


@query("SELECT c_custkey // 50 AS path, CAST(min(c_custkey) & 65535 AS INT) AS owner, 7 AS group_id, 258 AS permissions, '1990010203040506' AS created, '1993010203040506' AS effective, 512 AS record_length, 'SYSTEM' AS system_id FROM customer GROUP BY 1")
def iso_extended_attributes(spark, sf):
    rows = parse(_files(spark, sf, _with_tables), disks.iso_extended_attributes(40), disks.EXTENDED_SCHEMA)
    return rows.select("path", "owner", "group_id", "permissions", "created", "effective", "record_length", "system_id")


@query("""SELECT c_custkey // 50 AS path, 'F' || c_custkey AS file_path, 'member spans cabinets' AS reason FROM customer WHERE (c_custkey // 50) % 2 = 0
 UNION ALL SELECT c_custkey // 50, 'F' || c_custkey, 'compression method quantum is not supported' FROM customer WHERE (c_custkey // 50) % 2 = 1""")
def cab_errors(spark, sf):
    """Members that span cabinets, and members of a method without a decoder: one error each."""
    def build(keys, names):
        raw = bytearray(synth.cab(_members(keys, names, lambda i: f"F{i}"), 0, spanned=int(keys[0]) // 50 % 2 == 0))
        if int(keys[0]) // 50 % 2:
            raw[42:44] = P("<H", 2)
        return bytes(raw)

    rows = parse(_files(spark, sf, build), disks.cab_extract(errors=True), disks.MEMBER_OR_ERROR_SCHEMA)
    return rows.select("path", "file_path", F.col("member_error").alias("reason"))


@query("SELECT c_custkey // 50 AS path, string_agg('f' || c_custkey, ',' ORDER BY 'f' || c_custkey) AS listing FROM customer GROUP BY 1")
def member_listing(spark, sf):
    """The members of a cabinet in the order of their path components."""
    files = _files(spark, sf, lambda k, n: synth.cab(_members(k, n, lambda i: f"f{i}"), 1))
    rows = parse(files, disks.cab_files, disks.CAB_FILE_SCHEMA).select("path", F.split("file_path", "/").alias("p"))
    return rows.groupBy("path").agg(F.array_sort(F.collect_set("p")).alias("l")).select("path", F.array_join(F.transform("l", lambda p: F.array_join(p, "/")), ",").alias("listing"))


# ---- debug data and resources ------------------------------------------------------------------------------------------

@query("SELECT DISTINCT c_custkey // 50 AS path, 12345 AS time_date_stamp, '_main' AS exported FROM customer")
def command_dbg_info(spark, sf):
    rows = api.dbg_info(_debug_files(spark, sf).withColumnRenamed("file_id", "path"), container=True)
    return rows.select("path", "time_date_stamp", F.array_join("exported_names", ",").alias("exported"))


def _tables(keys, names) -> bytes:
    """Modules (those of odd keys without segments), a segment map, a file index, constants of several widths, and public symbols."""
    modules = [(0x120, i + 1, P("<HHHH", 0, 3, 0 if k % 2 else 1, 0x5643) + (b"" if k % 2 else P("<HHII", 1, 0, int(k) & 0xFFFFFFFF, 16)) + synth.pascal(n)) for i, (k, n) in enumerate(zip(keys, names))]
    segments = P("<HH", len(keys), 1) + b"".join(P("<6HII", 1, 0, 0, i + 1, 0xFFFF, 0xFFFF, 0, int(k) & 0xFFFFFFFF) for i, k in enumerate(keys))
    texts, offsets = b"", b""
    for n in names:
        offsets += P("<I", len(texts))
        texts += synth.pascal(n)
    index = P("<HH", 1, len(names)) + P("<H", 0) + P("<H", len(names)) + offsets + texts
    numbers = [P("<H", int(k) % 0x8000) if k % 3 == 0 else P("<Hi", 0x8003, -int(k)) if k % 3 == 1 else P("<HQ", 0x800A, int(k)) for k in keys]
    constants = P("<I", 1) + b"".join(synth.symbol(0x03, P("<H", 0x74) + v + synth.pascal(n)) for v, n in zip(numbers, names))
    flags = synth.symbol(0x01, bytes([6]) + (2 | 1 << 8 | 2 << 9 | 1 << 11 | 3 << 13 | 4 << 16 | 1 << 19).to_bytes(3, "little") + synth.pascal("v1"))
    public = b"".join(synth.symbol(0x203, P("<IHH", int(k) & 0xFFFFFFFF, 1, 0) + synth.pascal(n)) for k, n in zip(keys, names))
    pointers = [P("<HHH", 2, 3 | 1 << 8, 0x74) + P("<H", 9), P("<HHH", 2, 8, 0x74) + P("<H", 0x1000) + synth.pascal("T"), P("<HHH", 2, 10 | 2 << 5, 0x74) + P("<HH", 0x1001, 3)]
    return synth.dbg(synth.codeview([*modules, (0x12D, 0, segments), (0x133, 0, index), (0x124, 1, constants + flags), (0x12A, 0, P("<HHIII", 10, 12, len(public), 4, 2) + public + b"NAMEAD"), (0x12B, 0, synth.global_types(pointers))]))


@query(f"SELECT {_PER_FILE}, c_name AS name, 3 AS library_index, 'CV' AS style, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS \"offset\" FROM customer")
def cv_modules(spark, sf):
    """Modules with a segment, and without one."""
    return api.codeview(_files(spark, sf, _tables))["modules"].select("path", "name", "library_index", "style", "offset")


@query(f"SELECT {_PER_FILE}, CAST(row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) AS INT) AS frame, row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) = 1 AS logical, c_custkey AS size FROM customer")
def cv_segment_map(spark, sf):
    return api.codeview(_files(spark, sf, _tables))["segments"].select("path", "frame", "logical", "size")


@query(f"SELECT {_PER_FILE}, CAST(row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS INT) AS file_pos, c_name AS name FROM customer")
def cv_file_index(spark, sf):
    return api.codeview(_files(spark, sf, _tables))["files"].select("path", "file_pos", "name")


@query(f"SELECT {_PER_FILE}, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 32768 WHEN c_custkey % 3 = 1 THEN -c_custkey ELSE c_custkey END AS value FROM customer")
def cv_constants(spark, sf):
    """Constants as plain, signed and wide numeric leaves."""
    rows = api.codeview(_files(spark, sf, _tables))["symbols"].filter("kind = 'Constant'")
    return rows.select("path", "name", F.get_json_object("payload", "$.value").cast("bigint").alias("value"))


@query("SELECT DISTINCT c_custkey // 50 AS path, 6 AS machine, 2 AS language, 1 AS p_code, 2 AS float_precision, 1 AS float_package, 3 AS ambient_data, 4 AS ambient_code, 1 AS mode_32, 'v1' AS version FROM customer")
def cv_compile_flags(spark, sf):
    rows = api.codeview(_files(spark, sf, _tables))["symbols"].filter("kind = 'CompileFlags'")
    number = lambda k: F.get_json_object("payload", f"$.{k}").cast("int").alias(k)
    return rows.select("path", *map(number, ("machine", "language", "p_code", "float_precision", "float_package", "ambient_data", "ambient_code", "mode_32")), F.get_json_object("payload", "$.version").alias("version"))


@query(f"SELECT {_PER_FILE}, c_name AS name, c_custkey AS \"offset\", 1 AS segment FROM customer")
def cv_public_symbols(spark, sf):
    return api.codeview(_files(spark, sf, _tables))["symbols"].filter("kind = 'PublicData32'").select("path", "name", "offset", "segment")


@query("SELECT DISTINCT c_custkey // 50 AS path, 'GlobalPublicSymbols' AS type_name, 10 AS symbol_hash_function, 12 AS address_hash_function, '4e414d45' AS by_name, '4144' AS by_address FROM customer")
def cv_symbol_hashes(spark, sf):
    rows = parse(_files(spark, sf, _tables), debug.cv_symbol_hashes, debug.SYMBOL_HASH_SCHEMA)
    return rows.select("path", "type_name", "symbol_hash_function", "address_hash_function", hexed("symbol_hash_table").alias("by_name"), hexed("address_hash_table").alias("by_address"))


@query("""SELECT DISTINCT c_custkey // 50 AS path, p.* FROM customer, (VALUES (4096, 3, 0, 9, NULL, NULL, NULL), (4097, 8, 0, NULL, 'T', NULL, NULL), (4098, 10, 2, NULL, NULL, 4097, 3)) p(type_index, kind, mode, base_segment, based_on_name, class_type, member_format)""")
def cv_pointers(spark, sf):
    """Pointers based on a segment and on a type, and one to a member."""
    rows = api.codeview(_files(spark, sf, _tables))["types"].filter("leaf = 'Pointer'")
    number = lambda k: F.get_json_object("payload", f"$.{k}").cast("int").alias(k)
    return rows.select("path", "type_index", *map(number, ("kind", "mode", "base_segment", "class_type", "member_format")), F.get_json_object("payload", "$.based_on_name").alias("based_on_name"))


def _managed(keys, names) -> bytes:
    return synth.clr_pe([synth.clr_container([(f"k{k}", 1, n.encode()) for k, n in zip(keys, names)])])


@query("SELECT DISTINCT c_custkey // 50 AS path, 2 AS runtime_major, 5 AS runtime_minor, 1 AS flags FROM customer")
def clr_headers(spark, sf):
    rows = parse(_files(spark, sf, _managed), clr.clr_header, "header_size bigint, runtime_major int, runtime_minor int, flags bigint, entry bigint, idx int, range_name string, address bigint, size bigint")
    return rows.select("path", "runtime_major", "runtime_minor", F.col("flags").cast("int").alias("flags")).distinct()


# ---- pictures, fonts, text ---------------------------------------------------------------------------------------------

@query("SELECT p_partkey AS path, 8 AS width, 2 AS height, 'independent' AS variant, lower(printf('%02X%02X', p_size, 255 - p_size)) AS and_plane, lower(printf('%02X%02X', p_partkey % 256, 7)) AS xor_plane FROM part")
def icons_of_the_first_format(spark, sf):
    build = encode(lambda k, s: synth.icon1(8, 2, bytes([s, 255 - s]), bytes([k % 256, 7])))
    images = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), build("p_partkey", "p_size").alias("content"))
    rows = parse(images, pictures.icon1, pictures.ICON1_SCHEMA)
    return rows.select("path", "width", "height", "variant", hexed("and_plane").alias("and_plane"), hexed("xor_plane").alias("xor_plane"))


_BITS = "replace(replace(lpad(bin({0}), 8, '0'), '0', ' '), '1', '@')"


@query(f"""SELECT p_partkey AS path, f || '|' || {_BITS.format('p_size')} || '|' || n || '|' || {_BITS.format('255 - p_size')} || '|' || n || f || f || '|' || {_BITS.format('p_partkey % 256')} || '|' || n || '|' || {_BITS.format('7')} || '|' || n || f AS art
 FROM part, (SELECT '+--------+' || chr(10) AS f, chr(10) AS n)""")
def icon_ascii_art(spark, sf):
    build = encode(lambda k, s: pictures.ascii_art(bytes([s, 255 - s]), bytes([k % 256, 7]), 8, 2).encode())
    return table(spark, sf, "part").select(F.col("p_partkey").alias("path"), build("p_partkey", "p_size").cast("string").alias("art"))


@query("SELECT p_partkey AS path, CAST(p_size + p_size % 9 + 3 AS BIGINT) AS total_width, greatest(p_size, p_size % 9 + 2, 1) AS widest, CAST(2 * ((p_size + 7) // 8 + (p_size % 9 + 9) // 8 + 1) AS BIGINT) AS glyph_bytes FROM part")
def font_glyph_sums(spark, sf):
    """Sum and greatest of the glyph widths of a font, and the sum of their bytes."""
    build = encode(lambda s: synth.font2([(w, bytes(2 * -(-w // 8))) for w in (int(s), int(s) % 9 + 2, 1)], 2))
    images = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), build("p_size").alias("content"))
    rows = parse(images, pictures.font_glyphs, pictures.GLYPH_SCHEMA).select("path", "width", F.length("bitmap").alias("n"))
    return rows.groupBy("path").agg(F.sum("width").alias("total_width"), F.max("width").alias("widest"), F.sum("n").alias("glyph_bytes"))


@query("SELECT export_id, array_to_string(path_parts, '/') AS path_text, ordinal, CASE WHEN name <> '' THEN name END AS name FROM exports")
def exports_list_whole(spark, sf):
    """Every export as a line of the list, and back: also those without a name or an ordinal. The line of a row keeps its id."""
    rows = table(spark, sf, "exports").select("export_id", "path_parts", "ordinal", "name")
    lines = src.exports_lines(rows, keep=["export_id"])
    back = src.parse_lines(lines, mode="FAILFAST", keep=["export_id"])
    return back.select("export_id", F.array_join("path_parts", "/").alias("path_text"), "ordinal", "name")


@query("SELECT medium_id, '[\"' || label || '\"]' || chr(9) || medium_id || chr(9) || coalesce(zone_id, '') AS line, CASE WHEN zone_id IS NULL THEN 'no' ELSE 'yes' END AS zoned FROM media")
def filtered_list_lines(spark, sf):
    rows = table(spark, sf, "media").select("medium_id", F.col("label").alias("filename"), F.col("medium_id").alias("ordinal"), F.col("zone_id").alias("name"))
    return src.filtered_lines(rows, keep=["medium_id", "name"]).select("medium_id", F.col("value").alias("line"), X.yes_no(F.col("name").isNotNull()).alias("zoned"))


_PATHS = "SELECT c_custkey // 50 AS archive, c_custkey % 4 AS index, CASE c_custkey % 3 WHEN 0 THEN '/Windows/System32' WHEN 1 THEN '/WINDOWS/SYSWOW64' ELSE '/' || c_name END AS path FROM customer"


@query(f"SELECT DISTINCT archive, CAST(index AS INT) AS index, CASE WHEN archive % 2 = 0 THEN 'Enterprise' ELSE 'Professional' END AS edition_id, path FROM ({_PATHS}) WHERE lower(path) IN ('/windows/system32', '/windows/syswow64') AND index = CASE WHEN archive % 2 = 0 THEN 3 ELSE 2 END")
def command_installer_folders(spark, sf):
    """The system folders of the preferred edition in every installer archive."""
    c = table(spark, sf, "customer")
    archive = F.expr("c_custkey div 50").alias("archive")
    spot = F.when(F.col("c_custkey") % 3 == 0, "/Windows/System32").when(F.col("c_custkey") % 3 == 1, "/WINDOWS/SYSWOW64").otherwise(F.concat(F.lit("/"), "c_name"))
    tree = c.select(archive, (F.col("c_custkey") % 4).cast("int").alias("index"), spot.alias("path"))
    image = lambda i, e: F.concat(F.lit(f'<IMAGE INDEX="{i}"><WINDOWS><EDITIONID>'), e, F.lit("</EDITIONID></WINDOWS></IMAGE>"))
    third = F.when(F.col("archive") % 2 == 0, "Enterprise").otherwise("Starter")
    archives = c.select(archive).distinct().select("archive", F.concat(F.lit("<WIM>"), image(1, F.lit("Home")), image(2, F.lit("Professional")), image(3, third), F.lit("</WIM>")).alias("xml"))
    return api.installer_folders(archives, tree).distinct()


@query("SELECT p_partkey, bit_count(p_partkey) AS n_set FROM part")
def flag_bits(spark, sf):
    set_bits = sum((B.has_flags("p_partkey", 1 << i).cast("int") for i in range(1, 31)), B.has_flags("p_partkey", 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", set_bits.cast("tinyint").alias("n_set"))
