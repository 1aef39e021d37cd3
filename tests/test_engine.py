"""The Spark side of the engine: sources, export pipeline, rules, containers, streaming, and functions."""

import struct

import pytest
from pyspark.sql import functions as F

from binweave.codecs.compressed import expand
from binweave.formats import disks, ne, pe, synth
from binweave.formats.reader import parse
from binweave.functions import bytes_expr as B
from binweave.functions import codes, dostime
from binweave.functions import text_expr as X
from binweave.operators import containers, exports, rules, sections
from binweave.operators.graph import components
from binweave.runtime import join_counted, join_salted
from binweave.sources import files as src
from binweave.streaming import scan

DLL = synth.pe_dll([(1, "One", None), (2, None, None), (3, "Three", "X.Y")])
NE = synth.ne_dll([(1, [(1, 0), (0, 1)]), (0, [(0, 0)] * 2), (255, [(1, 2)])], [(b"M", 0), (b"A", 1), (b"B", 5)], [(b"D", 0), (b"B2", 5), (b"\xff", 5)])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    (d / "sub").mkdir()
    cab = synth.cab([("in.dl_", synth.szdd(DLL)), ("readme", b"text")], 1)
    for name, raw in {"a.dll": DLL, "sub/n.dll": NE, "empty": b"", "mz": b"MZ" + bytes(70), "text.txt": b"MSDOS", "broken.dll": DLL[:540], "disc.iso": synth.iso([("C.CAB", cab)])}.items():
        (d / name).write_bytes(raw)
    return str(d)


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


def test_scan_and_exports(spark, folder):
    files = src.scan_files(spark, folder)
    assert files.count() == 6 and src.scan_files(spark, folder, glob="*.dll").count() == 3 and src.scan_files(spark, folder, max_length=100).count() == 2
    out = containers.scan_exports(files).withColumn("base", X.base_name(F.element_at("path_parts", -1)))
    got = rows(out.filter("error IS NULL"), "base", "kind", "ordinal", "name")
    assert got == sorted([("a.dll", "pe", 1, "One"), ("a.dll", "pe", 2, None), ("a.dll", "pe", 3, "Three"), ("n.dll", "ne", 1, "A"), ("n.dll", "ne", 5, "B2")], key=repr)
    assert rows(out.filter("error IS NOT NULL"), "base", "kind") == [("broken.dll", "pe")]
    deep = containers.scan_exports(files, containers=True)
    inner = deep.filter(F.size("path_parts") == 4)
    assert rows(inner, F.slice("path_parts", 2, 3), "ordinal", "name") == sorted([(["C.CAB;1", "in.dl_", ""], i, n) for i, n in ((1, "One"), (2, None), (3, "Three"))], key=repr)


def test_an_unreadable_member_does_not_end_its_container(spark):
    cab = bytearray(synth.cab([("bad", b"x"), ("a.dll", DLL)]))
    cab[52:54] = b"\xfd\xff"  # the first member's folder
    iso = bytearray(synth.iso([("A.DLL", DLL), ("B.DLL", DLL)]))
    at = iso.index(b"A.DLL;1") - 33
    iso[at + 2 : at + 6] = b"\xff\xff\xff\x00"
    fat = bytearray(synth.fat([("A.TXT", b"x" * 1500), ("B.DLL", DLL)], 12))
    fat[512 + 3 : 512 + 6] = bytes([0x03, 0x20, 0x00])
    df = spark.createDataFrame([("cab", cab), ("iso", iso), ("fat", fat)], "path string, content binary")
    out = containers.scan_exports(df, containers=True)
    assert rows(out.filter("error IS NULL").distinct(), F.concat_ws("/", "path_parts"), "ordinal") == [(p, i) for p in ("cab/a.dll", "fat/B.DLL", "iso/B.DLL;1") for i in (1, 2, 3)]
    assert rows(out.filter("error IS NOT NULL"), F.concat_ws("/", "path_parts")) == [("cab/bad",), ("fat/A.TXT",), ("iso/A.DLL;1",)]


def test_ne_ordinals_from_zero(spark):
    df = spark.createDataFrame([("x", bytearray(NE))], "path string, content binary")
    assert rows(exports.exports(df, compat=True), "ordinal", "name") == sorted([(0, "D"), (4, None)], key=repr)


def test_errors_become_rows_and_columns_may_clash(spark):
    df = spark.createDataFrame([("a", 1, bytearray(b"junk")), ("b", 2, None), ("c", 3, bytearray(DLL))], "error_path string, ordinal int, content binary")
    out = parse(df.withColumnRenamed("ordinal", "n"), pe.pe_export_names, pe.EXPORT_NAME_SCHEMA, ("error_path", "n"))
    assert {r.error_path: r.error is None for r in out.collect()} == {"a": False, "b": False, "c": True}
    assert parse(df.limit(0), pe.pe_sections, pe.SECTION_SCHEMA, ("error_path",)).collect() == []


def test_exports_list(spark, tmp_path):
    df = spark.createDataFrame([(["a\\b.dll", 'q"x'], 1, "n\tame\n\\"), (["c"], None, None), (["d"], 7, None)], "path_parts array<string>, ordinal long, name string")
    src.write_exports(df, str(tmp_path / "out"))
    back = src.read_exports(spark, str(tmp_path / "out"))
    assert rows(back, "path_parts", "ordinal", "name") == rows(df, "path_parts", "ordinal", "name")
    assert rows(back, "base_name") == rows(spark.createDataFrame([('q"x',), ("c",), ("d",)], "base_name string"), "base_name")
    bad = spark.createDataFrame([('["a"]\t1\tx\r',), ("broken",), ('["a"]\tone\tx',), (None,)], "value string")
    assert src.parse_lines(bad).filter("bad_line IS NULL AND path_parts IS NOT NULL").count() == 1
    assert src.parse_lines(bad.filter("value IS NOT NULL"), mode="DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="malformed"):
        src.parse_lines(bad.filter("value = 'broken'"), mode="FAILFAST").collect()


def test_members_as_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", bytearray(b"1")), ("c", None)], "name string, data binary")
    src.write_members(df, str(tmp_path / "m"), "name", "data")
    assert (tmp_path / "m/a/b.txt").read_bytes() == b"1" and not (tmp_path / "m/c").exists()
    with pytest.raises(Exception, match="leaves"):
        src.write_members(spark.createDataFrame([("../x", bytearray(b"1"))], "name string, data binary"), str(tmp_path / "m"), "name", "data")


RULES = [
    ("win95/USER.EXE", "win95/user.exe"), ("nt/i386/a.dll", "nt/a.dll"), ("nt/mips/a.dll", "nt/mips/a.dll"), ("nt/other/a.dll", None), ("nt/a.exe", None), ("nt/a.txt", None),
    ("xp/windows/system32/a.dll", "xp/a.dll"), ("xp/windows/syswow64/a.dll", "xp/a.dll"), ("xp/x/system32/a.dll", "xp/a.dll"), ("xp/x/y/a.dll", None), ("xp/windows/system32/api-x.dll", None),
    ("C:\\nt\\a.dll", None), ("c:\\win98\\a.dll", "c:/a.dll"), ("/z/_extracted/nt/i386/a.dll", "nt/a.dll"), ("_extracted/nt/a.dll", "nt/a.dll"), ("/z/_extracted/nt/_extracted/a.dll", None), ("a.dll", None), ("a/b/c/d/e.dll", None),
]


def test_rules(spark):
    df = spark.createDataFrame([([p], 1, str(i)) for i, (p, _) in enumerate(RULES)] + [(["a/b.dll", "c"], 1, "two"), (["a/b.dll"], 0, "zero"), (["a/b.dll"], None, "none")], "path_parts array<string>, ordinal long, name string")
    got = {r.name: r.filename for r in rules.filter_exports(df, rules.system_library_rules()).collect()}
    assert got == {**{str(i): want for i, (_, want) in enumerate(RULES) if want}, "none": "a/b.dll"}
    strict = {r.name: r.filename for r in rules.filter_exports(df, rules.system_library_rules(strict_syswow64=True)).collect()}
    assert strict["7"] == "xp/syswow64/a.dll" and strict["6"] == "xp/a.dll"


def test_sections(spark):
    s = spark.createDataFrame([("f", 0, 0x1000, 0x100, 0x80, 0x400, "a"), ("f", 1, 0x1080, 0x100, 0x80, 0x480, "b"), ("g", 0, 0x1000, 0, 0x30, 0, "c"), ("g", 1, 0x1020, 0x10, 0x10, 0x900, "d")], "file string, pos int, virtual_address long, virtual_size long, raw_size long, raw_ptr long, name string")
    a = spark.createDataFrame([("f", 0x1010), ("f", 0x10F0), ("f", 0x1150), ("f", 0x5000), ("h", 0x1000), ("f", 0x1010)], "file string, rva long")
    assert rows(sections.section_lookup(a, s, ["file"]), "file", "rva", "file_offset") == sorted([("f", 0x1010, 0x410), ("f", 0x1010, 0x410), ("f", 0x10F0, None), ("f", 0x1150, None), ("f", 0x5000, None), ("h", 0x1000, None)], key=repr)
    assert rows(sections.section_overlap(s, ["file"]), "file", "overlaps") == [("f", True), ("g", False)]
    assert rows(sections.virtual_size_fix(s.filter("file = 'g'"), ["file"], F.lit(0x20)), "name", "virtual_size") == [("c", 0x20), ("d", 0x10)]


def test_editions(spark):
    image = lambda i, e: f'<IMAGE INDEX="{i}"><WINDOWS>{e and f"<EDITIONID>{e}</EDITIONID>"}</WINDOWS></IMAGE>'
    df = spark.createDataFrame([("a", f"<WIM>{image(1, 'Core')}{image(2, '')}{image(3, 'Professional')}{image(4, 'Enterprise')}{image(5, 'Enterprise')}</WIM>"), ("b", f"<WIM>{image(1, 'Core')}</WIM>"), ("c", "<WIM/>")], "k string, xml string")
    assert rows(sections.image_editions(df, "xml", ["k"]), "k", "index", "edition_id")[:2] == [("a", 1, "Core"), ("a", 2, None)]
    assert rows(sections.chosen_edition(sections.image_editions(df, "xml", ["k"]), ["k"]), "k", "index", "edition_id") == [("a", 4, "Enterprise")]
    assert sections.system_folders(spark.createDataFrame([("/Windows/System32",), ("/windows",)], "path string")).count() == 1


def test_byte_functions(spark):
    raw = bytes([0x78, 0x56, 0x34, 0x12, 0xFF, 0xFF, 0xFF, 0xFF]) + b"caf\xc3\xa9\0\xff\0"
    df = spark.createDataFrame([(bytearray(raw),), (None,)], "b binary")
    got = df.select(B.u32_le("b", 0), B.u32_be("b", 0), B.u16_le("b", 4), B.u64_le("b", 0), B.u64_be("b", 0), B.u32_le("b", 14), B.c_string("b", 8), B.c_string("b", 14), B.has_magic("b", b"xV"), B.pascal_string("b", 100)).collect()
    assert tuple(got[0])[:6] == (0x12345678, 0x78563412, 0xFFFF, 0xFFFFFFFF12345678, 0x78563412FFFFFFFF, None) and tuple(got[0])[6:] == ("café", None, True, None)
    assert tuple(got[1]) == (None,) * 8 + (False, None)
    one = spark.createDataFrame([(bytearray(b"a\0\"\\\xff~"), 0.0, float("nan")), (bytearray(b""), -0.0, float("nan"))], "b binary, z double, n double")
    assert rows(one, X.display_bytes("b"), X.hex_bytes("b")) == sorted([('b"a\\0\\"\\\\\\xFF~"', "[0x61, 0x00, 0x22, 0x5C, 0xFF, 0x7E]"), ('b""', "[]")], key=repr)
    bits = one.select(B.float_bits("z").alias("z"), B.float_bits("n").alias("n")).collect()
    assert bits[0].z != bits[1].z and bits[0].n == bits[1].n


def test_codes_and_times(spark):
    df = spark.createDataFrame([(0x14C, 0x2002, 0x2A81, 0x13D5, "2001040102304299"), (0x9999, 0, 0, 0, "0" * 16)], "m int, c int, d int, t int, s string")
    out = df.select(codes.enum_text("MachineType", "m"), codes.flags_text("Characteristics", "c"), dostime.dos_timestamp("d", "t").cast("string"), dostime.iso_digit_timestamp("s", F.lit(4)).cast("string"))
    assert rows(out, "*") == sorted([("I386", ["EXECUTABLE_IMAGE", "DLL"], "2001-04-01 02:30:42", "2001-04-01 01:30:42.99"), ("Other(39321)", [], None, None)], key=repr)
    stamp = spark.createDataFrame([(bytearray([101, 4, 1, 2, 30, 42, 252]),)], "b binary")
    assert stamp.select(dostime.iso_binary_timestamp("b").cast("string")).first()[0] == "2001-04-01 03:30:42"
    table = codes.code_table(spark)
    assert table.count() > 250 and table.filter("table_name = 'MachineType'").count() == 32


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, 200)], "a long, b long")
    got = {r.node: r.component for r in components(e, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200}
    assert components(e.limit(0), "a", "b").collect() == []


def test_heavy_keys_are_joined_whole(spark):
    left = spark.range(6000).select((F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 700)).alias("k"), "id")
    groups = left.groupBy("k").agg(F.count("*").alias("n"))
    assert join_counted(left, groups, ["k"], "n").count() == 6000


def test_streaming_scan(spark, folder, tmp_path):
    tables = scan.stream_export_tables(scan.stream_files(spark, folder))
    q = tables.writeStream.format("memory").queryName("names").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("names"), "kind", "ordinal", "name") == sorted([("pe", 1, "One"), ("pe", 3, "Three"), ("ne", 0, "M"), ("ne", 1, "A"), ("ne", 5, "B"), ("ne", 0, "D"), ("ne", 5, "B2")], key=repr)
    counts = scan.names_per_window(scan.stream_export_tables(scan.stream_files(spark, folder)))
    q = counts.writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n_names")).first()[0] == 7


def test_relocation_targets(spark):
    image = synth.ne_dll([(1, [(1, 0)])], [(b"M", 0)], segments=[(b"code", struct.pack("<BBHHH", 3, 2, 4, 2, 13))], modules=[b"KERNEL", b"USER"], imports=[b"Imported"])
    df = spark.createDataFrame([("x", bytearray(image))], "path string, content binary")
    out = exports.relocation_targets(parse(df, ne.ne_relocations, ne.RELOCATION_SCHEMA).drop("error"), parse(df, ne.ne_import_modules, "kind string, idx int, offset int, name binary").drop("error"))
    assert rows(out, F.col("module_name").cast("string"), F.col("import_name").cast("string")) == [("USER", "Imported")]


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert expand(synth.sz(b"x")) == b"x" and disks.METHODS[3] == "lzx"


def test_joins_divide_heavy_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 40}") for i in range(6000)] + [(9999, None), (9998, "none")], "id long, k string")
    groups = spark.createDataFrame([("hot", 1), ("hot", 2), *[(f"k{i}", 3) for i in range(0, 40, 4)]], "k string, v int")
    sizes = rows.groupBy("k").count()
    want = {how: sorted(map(tuple, rows.join(groups, ["k"], how).select("id", "v").collect()), key=repr) for how in ("inner", "left")}
    for heavy in (3, 1000):
        for how in want:
            assert sorted(map(tuple, join_salted(rows, groups, ["k"], sizes, "count", heavy, how).select("id", "v").collect()), key=repr) == want[how]
    one = groups.filter("v <> 2").join(sizes, "k")
    assert join_counted(rows, one, ["k"], "count", 3).count() == rows.join(one, "k").count()
    assert join_salted(rows.limit(0), groups, ["k"], sizes.limit(0), "count").count() == 0


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5100)] + [(7000, 7000), (None, 3), (8001, 8000)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 0 for i in range(3000)}, **{i: 5000 for i in range(5000, 5101)}, 7000: 7000, 8000: 8000, 8001: 8000}


def one_scan(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("binaryFile")


def test_scan_reads_every_file_once_and_reports_all_errors(spark, tmp_path):
    deep = DLL
    for i in range(10):
        deep = synth.cab([(f"L{i}", deep)], 0)
    broken = synth.cab([("X.DLL", DLL)], 1)
    for name, raw in {"a.dll": DLL, "n.dll": NE, "deep.cab": deep, "broken.cab": broken[:40], "cut.cab": broken[:-9], "bad.dll": DLL[:540]}.items():
        (tmp_path / name).write_bytes(raw)
    files = src.scan_files(spark, str(tmp_path)).select("path", "content")
    assert one_scan(containers.scan_exports(files)) == 1
    out = containers.scan_exports(files, containers=True)
    assert one_scan(out) == 0
    base = F.element_at(F.split(F.col("path_parts")[0], "/"), -1)
    got = {}
    for r in out.select(base.alias("f"), F.size("path_parts").alias("n"), "kind", "ordinal", "name", "error").collect():
        got.setdefault(r.f, []).append((r.n, r.kind, r.ordinal, r.error is not None))
    assert sorted(got["deep.cab"]) == [(11, "pe", i, False) for i in (1, 2, 3)] and sorted(got["a.dll"]) == [(1, "pe", i, False) for i in (1, 2, 3)]
    assert all(any(r[3] for r in got[f]) and not any(r[2] for r in got[f]) for f in ("broken.cab", "cut.cab", "bad.dll"))
    assert got["bad.dll"] == [(1, "pe", None, True)]
    levels = containers.expand_all(files.select(F.array("path").alias("path_parts"), "content").filter("path LIKE '%deep.cab'"))
    assert levels.agg(F.max("depth")).first()[0] == 10
    short = containers.expand_all(files.select(F.array("path").alias("path_parts"), "content").filter("path LIKE '%deep.cab'"), max_depth=3)
    assert [r.depth for r in short.filter("error IS NOT NULL").collect()] == [3]
