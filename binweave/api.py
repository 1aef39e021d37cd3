"""One function per command: a DataFrame of (path, content) to a DataFrame keyed by path. Options are keyword arguments that add
filters; errors are rows, see formats.reader.parse."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binweave.codecs import compressed
from binweave.formats import clr, debug, disks, ne, pe, pictures
from binweave.formats.reader import FormatError, parse
from binweave.functions import codes
from binweave.functions.bytes_expr import has_magic
from binweave.functions.text_expr import resource_file_name
from binweave.operators import containers, exports, sections
from binweave.sources.files import cbor, pretty_json

#: Resource types of icons, cursors and their groups, and of fonts.
CURSOR, ICON, GROUP_CURSOR, GROUP_ICON, FONT = 1, 3, 12, 14, 8
NE_BIT = 0x8000


def scan(files: DataFrame, containers_too: bool = False, compat: bool = False) -> DataFrame:
    """All exports: (path_parts, kind, ordinal, name, error)."""
    return containers.scan_exports(files, containers_too, compat)


def interpret(files: DataFrame) -> DataFrame:
    """(path, kind): 'pe', 'ne', a container kind, or 'unidentified'."""
    return exports.classify(files).select("path", F.coalesce("kind", containers.container_kind(), F.lit("unidentified")).alias("kind"))


def expand(files: DataFrame) -> DataFrame:
    return parse(files, lambda b: [(compressed.expand(b),)], "data binary")


def inflate(files: DataFrame) -> DataFrame:
    """Raw DEFLATE streams."""
    return parse(files, lambda b: [(compressed.inflate(b),)], "data binary")


def fat_header(files: DataFrame) -> DataFrame:
    return parse(files, disks.fat_header, disks.FAT_HEADER_SCHEMA)


def fat_table(files: DataFrame) -> DataFrame:
    return parse(files, disks.fat_entries, disks.FAT_ENTRY_SCHEMA)


def fat_directory(files: DataFrame, cluster: int | None = None) -> DataFrame:
    """Raw entries of 32 bytes, deleted ones too, of the root or of the folder at a cluster: (path, pos, name, attributes,
    first_cluster, size)."""

    def run(data: bytes):
        f = disks.Fat(data)
        raw = f.root() if cluster is None else f.bytes_of(cluster)
        for i in range(0, len(raw) - 31, 32):
            if not raw[i]:
                return
            row = disks.View(raw[i : i + 32])
            yield i // 32, row.take(0, 11), row.u8(11), row.u16(20) << 16 | row.u16(26), row.u32(28)

    return parse(files, run, "pos int, name binary, attributes int, first_cluster bigint, size bigint")


def fat_data(files: DataFrame, cluster: int) -> DataFrame:
    """The bytes of the chain that starts at a cluster."""
    return parse(files, lambda b: [(disks.Fat(b).bytes_of(cluster),)], "data binary")


def mz_header(files: DataFrame) -> DataFrame:
    return parse(files, pe.mz_header, pe.MZ_SCHEMA)


def ne_header(files: DataFrame, json: bool = False) -> DataFrame:
    out = parse(files, ne.ne_header, ne.NE_HEADER_SCHEMA)
    return _json(out) if json else out.withColumn("flag_names", codes.flags_text("ExeFlags", "flags"))


def _json(df: DataFrame) -> DataFrame:
    return df.select("path", pretty_json(F.struct(*[c for c in df.columns if c not in ("path", "error")])).alias("json"), "error")


def _ne_resources(files: DataFrame, *types: int) -> DataFrame:
    rows = parse(files, ne.ne_resources, ne.NE_RESOURCE_SCHEMA)
    return rows.filter(F.col("type_num").isin(*[t | NE_BIT for t in types]) | F.col("error").isNotNull())


def _resource_parts(rows: DataFrame, keys: tuple[str, ...], parser, schema: str) -> DataFrame:
    """Parses the data of resources; resources whose bytes are missing give an error row."""
    return parse(rows.filter("error IS NULL").drop("error"), parser, schema, keys, "data")


def ne_icon_groups(files: DataFrame, json: bool = False) -> DataFrame:
    """(path, type_num, res_num, res_name, pos, width, …, id, raw_id)."""
    out = _resource_parts(_ne_resources(files, GROUP_CURSOR, GROUP_ICON), ("path", "type_num", "res_num", "res_name"), pictures.icon_group, pictures.ICON_GROUP_SCHEMA)
    out = out.withColumn("raw_id", F.col("id") + NE_BIT)
    return _json(out) if json else out


def _icon_picture(form: str):
    """An icon of the first format, or an icon bitmap (only as PNG)."""

    def run(data: bytes):
        try:
            for name, w, h, a, x in pictures.icon1(data):
                made = {"sixel": lambda: (pictures.sixel(a, w, h) + pictures.sixel(x, w, h)).encode(), "ascii": lambda: pictures.ascii_art(a, x, w, h).encode(), "png": lambda: pictures.icon1_png(a, x, w, h)}[form]()
                yield w, h, made
        except FormatError:
            if form != "png":
                raise
            for w, h, _, _, rgba in pictures.bitmap(icon=True)(data):
                yield w, h, pictures.rgba_png(rgba, w, h)

    return run


def ne_icons(files: DataFrame, form: str = "png", type_num: int | None = None, res_num: int | None = None) -> DataFrame:
    """(path, type_num, res_num, width, height, picture): form is sixel, ascii or png. Every match is a row."""
    rows = _ne_resources(files, CURSOR, ICON)
    if type_num is not None:
        rows = rows.filter(F.col("type_num") == type_num)
    if res_num is not None:
        rows = rows.filter(F.col("res_num") == res_num)
    return _resource_parts(rows, ("path", "type_num", "res_num"), _icon_picture(form), "width int, height int, picture binary")


def ne_fonts(files: DataFrame, form: str = "bdf", prefix: str = "") -> DataFrame:
    """(path, file_name, data): form is bdf, fd or fnt."""
    rows = _ne_resources(files, FONT).filter("error IS NULL")
    rows = rows.withColumn("file_name", resource_file_name(F.lit(prefix), "res_num", "res_name", form)).drop("error")
    make = {"fnt": lambda b: b, "bdf": lambda b: pictures.to_bdf(b).encode(), "fd": lambda b: pictures.to_fd(b).encode()}[form]
    return parse(rows, lambda b: [(make(b),)], "font binary", ("path", "file_name"), "data")


def pe_header(files: DataFrame) -> DataFrame:
    out = parse(files, pe.pe_header, pe.PE_HEADER_SCHEMA)
    return out.withColumn("machine_name", codes.enum_text("MachineType", "machine")).withColumn("characteristic_names", codes.flags_text("Characteristics", "characteristics"))


def pe_resources(files: DataFrame, json: bool = False) -> DataFrame:
    out = parse(files, pe.pe_resources, pe.RESOURCE_SCHEMA)
    return _json(out.withColumn("data", F.base64("data"))) if json else out


def pe_icon_groups(files: DataFrame, json: bool = False) -> DataFrame:
    rows = exports.wanted_resources(pe_resources(files), [GROUP_CURSOR, GROUP_ICON])
    out = _resource_parts(rows, ("path", "type_id", "res_id", "res_name", "lang_id"), pictures.icon_group, pictures.ICON_GROUP_SCHEMA)
    return _json(out) if json else out


def pe_icons(files: DataFrame, type_id: int | None = None, res_id: int | None = None, name: str | None = None, lang: int | None = None) -> DataFrame:
    """(path, type_id, res_id, res_name, lang_id, width, height, picture) as PNG; icons that are PNG already are kept as they
    are."""
    rows = exports.wanted_resources(pe_resources(files), [type_id] if type_id is not None else [CURSOR, ICON], res_id=res_id, name=name, lang=lang)
    keys = ("path", "type_id", "res_id", "res_name", "lang_id")
    ready = rows.filter(has_magic("data", b"\x89PNG\r\n\x1a\n")).select(*keys, F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.col("data").alias("picture"), "error")
    bitmaps = _resource_parts(rows.filter(~has_magic("data", b"\x89PNG\r\n\x1a\n")), keys, _icon_picture("png"), "width int, height int, picture binary")
    return ready.unionByName(bitmaps)


def dbg_info(files: DataFrame, container: bool = False) -> DataFrame:
    """The header of debug files, or the directory of their CodeView data."""
    return parse(files, debug.dbg_header, debug.DBG_HEADER_SCHEMA) if container else parse(files, debug.cv_subsections, debug.SUBSECTION_SCHEMA)


def codeview(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of CodeView data by name, each decoded only when it is used."""
    tables = {
        "subsections": (debug.cv_subsections, debug.SUBSECTION_SCHEMA), "modules": (debug.cv_modules, debug.MODULE_SCHEMA), "symbols": (debug.cv_symbols, debug.SYMBOL_SCHEMA), "types": (debug.cv_types, debug.TYPE_SCHEMA),
        "lines": (debug.cv_lines, debug.LINE_SCHEMA), "segments": (debug.cv_segment_map, debug.SEGMENT_SCHEMA), "files": (debug.cv_file_index, debug.FILE_INDEX_SCHEMA), "libraries": (debug.cv_libraries, debug.LIBRARY_SCHEMA),
    }
    return {k: parse(files, run, schema) for k, (run, schema) in tables.items()}


def type_edges(types: DataFrame) -> DataFrame:
    """(path, type_index, role, target): the type indices that a leaf refers to, from the payload of the types table."""
    v = F.parse_json("payload")
    single = ["base_type", "element_type", "index_type", "field_list", "derived", "vtable_shape", "return_type", "arguments", "class_type", "this_type", "member_type", "method_list"]
    one = [types.select("path", "type_index", F.lit(r).alias("role"), F.try_variant_get(v, f"$.{r}", "int").alias("target")) for r in single]
    many = types.select("path", "type_index", F.lit("types").alias("role"), F.explode(F.try_variant_get(v, "$.types", "array<int>")).alias("target"))
    return reduce(DataFrame.unionByName, [*one, many]).filter("target IS NOT NULL")


def clr_resources(files: DataFrame, as_cbor: bool = False) -> DataFrame:
    """Entries of managed resources; as_cbor gives one (path, container_idx, data) per container."""
    rows = parse(files, clr.clr_resources, clr.CLR_RESOURCE_SCHEMA)
    if not as_cbor:
        return rows

    @F.pandas_udf("binary")
    def encode(entries: pd.Series) -> pd.Series:
        return pd.Series([cbor([{k: (bytes(x) if isinstance(x, (bytes, bytearray)) else x) for k, x in dict(e).items()} for e in es]) for es in entries], dtype=object)

    own = rows.filter("error IS NULL").groupBy("path", "container_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "type_code", "type_name", "data"))).alias("e"))
    return own.select("path", "container_idx", encode("e").alias("data"))


def cd_volume(files: DataFrame) -> DataFrame:
    """The volume descriptor at byte 0x8000, of either flavour."""
    out = parse(files, disks.iso_volume, disks.VOLUME_SCHEMA)
    return out.withColumn("kind_name", codes.enum_text("DescriptorType", "kind"))


def installer_folders(archives: DataFrame, tree: DataFrame) -> DataFrame:
    """(archive, index, edition_id, path): of each installer archive (archive, xml) the folders of system libraries in the image
    of the preferred edition, from the listing of its images (archive, index, path). Archives without such an edition give none."""
    chosen = sections.chosen_edition(sections.image_editions(archives, "xml", ["archive"]), ["archive"])
    return sections.system_folders(tree).join(chosen, ["archive", "index"]).select("archive", "index", "edition_id", "path")
