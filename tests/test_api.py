"""Every command of the API over one small image each."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from binweave import api
from binweave.formats import synth

ICON1 = synth.icon1(8, 2, b"\xf0\x0f", b"\xaa\x55")
ICON = struct.pack("<IiiHHIIiiII", 40, 2, 4, 1, 1, 0, 0, 0, 0, 0, 0) + bytes([1, 2, 3, 0, 4, 5, 6, 0]) + b"\x40\0\0\0" * 2 + b"\x80\0\0\0" * 2
GROUP = synth.icon_group([(16, 16, 4, 1), (32, 32, 8, 2)])
FONT = synth.font2([(9, bytes(range(8)))], 4)
PNG = b"\x89PNG\r\n\x1a\n" + b"rest"


def df_of(spark, **images):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in images.items()], "path string, content binary")


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


@pytest.fixture(scope="module")
def nes(spark):
    return df_of(spark, n=synth.ne_dll([(1, [(1, 0)])], [(b"M", 0), (b"F", 1)], resources=[(3, 1, 0x30, ICON1), (3, 2, 0x30, ICON), (14, 9, 0x30, GROUP), (8, 5, 0x30, FONT)]))


@pytest.fixture(scope="module")
def pes(spark):
    return df_of(spark, p=synth.pe_with_resources([(3, 1, 1033, ICON), (3, 2, 1031, PNG), (14, 7, 1033, GROUP), (16, 1, 0, b"version")]))


def test_commands_on_ne_files(spark, nes):
    assert rows(api.interpret(nes), "kind") == [("ne",)] and rows(api.scan(nes), "ordinal", "name") == [(1, "F")]
    assert rows(api.ne_header(nes), "linker_major", "error") == [(5, None)] and '"linker_major"' in api.ne_header(nes, json=True).first().json
    assert rows(api.ne_icon_groups(nes), "width", "id", "raw_id") == [(16, 1, 0x8001), (32, 2, 0x8002)]
    icons = api.ne_icons(nes).collect()
    assert len(icons) == 2 and all(bytes(r.picture).startswith(b"\x89PNG") for r in icons)
    assert b"@" in bytes(api.ne_icons(nes, "ascii", res_num=0x8001).first().picture) and bytes(api.ne_icons(nes, "sixel", res_num=0x8001).first().picture).startswith(b"\x1bPq")
    assert api.ne_icons(nes, type_num=0x8001).collect() == []
    assert {r.file_name for r in api.ne_fonts(nes, "fd", "font").collect()} == {"fonti32773.fd"}
    assert bytes(api.ne_fonts(nes, "bdf").first().font).startswith(b"STARTFONT") and bytes(api.ne_fonts(nes, "fnt").first().font).startswith(FONT)


def test_commands_on_pe_files(pes):
    assert rows(api.pe_header(pes), "machine_name", "characteristic_names") == [("I386", ["EXECUTABLE_IMAGE", "IS_32BIT_MACHINE", "DLL"])]
    assert rows(api.mz_header(pes), "relocation_offset", "new_header_offset") == [(64, 64)]
    assert api.pe_resources(pes).count() == 4 and '"res_path"' in api.pe_resources(pes, json=True).first().json
    assert rows(api.pe_icon_groups(pes), "res_id", "id") == [(7, 1), (7, 2)]
    got = {r.res_id: bytes(r.picture) for r in api.pe_icons(pes).collect()}
    assert got[2] == PNG and got[1].startswith(b"\x89PNG")
    assert api.pe_icons(pes, lang=1031).count() == 1 and api.pe_icons(pes, type_id=1).count() == 0 and api.pe_icons(pes, res_id=1).count() == 1


def test_commands_on_disks_and_streams(spark):
    fat = df_of(spark, f=synth.fat([("A.TXT", b"x" * 700), ("S/B", b"y")], 12))
    assert rows(api.fat_header(fat), "variant", "label") == [(12, "SYNTHETIC")]
    assert rows(api.fat_directory(fat), "attributes") == sorted([(8,), (32,), (32,), (16,)], key=repr)
    assert bytes(api.fat_data(fat, 2).first().data)[:700] == b"x" * 700 and api.fat_table(fat).filter("kind = 'chain'").count() == 1
    assert rows(api.cd_volume(df_of(spark, c=synth.iso([("A", b"1")]))), "kind_name", "volume_id") == [("PrimaryVolumeDescriptor", "VOLUME")]
    assert bytes(api.expand(df_of(spark, s=synth.szdd(b"data" * 9))).first().data) == b"data" * 9
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    assert bytes(api.inflate(df_of(spark, d=c.compress(b"abc" * 99) + c.flush())).first().data) == b"abc" * 99
    assert api.inflate(df_of(spark, d=b"\xff\xff")).first().error is not None


def test_debug_and_managed_data(spark):
    types = synth.global_types([struct.pack("<HHH", 1, 1, 0x74), struct.pack("<HHHH", 0x201, 2, 0x1000, 0x74)])
    dbg = df_of(spark, d=synth.dbg(synth.codeview([(0x12B, 0, types), (0x128, 0, synth.pascal("Lib"))]), ["_f"], 5))
    assert rows(api.dbg_info(dbg, container=True), "time_date_stamp", "exported_names") == [(5, ["_f"])]
    assert rows(api.dbg_info(dbg), "type_name") == [("GlobalTypes",), ("Libraries",)]
    tables = api.codeview(dbg)
    assert rows(tables["libraries"], "name") == [("Lib",)] and tables["lines"].collect() == []
    assert rows(api.type_edges(tables["types"]), "type_index", "role", "target") == sorted([(0x1000, "base_type", 0x74), (0x1001, "types", 0x1000), (0x1001, "types", 0x74)], key=repr)
    net = df_of(spark, n=synth.clr_pe([synth.clr_container([("a", 1, b"one"), ("b", 33, b"")])]))
    assert rows(api.clr_resources(net), "name", F.col("data").cast("string")) == [("a", "one"), ("b", "")]
    assert bytes(api.clr_resources(net, as_cbor=True).first().data)[:1] == b"\x82"
    assert api.clr_resources(df_of(spark, n=b"MZ")).first().error is not None
