"""The export pipeline: raw tables of PE and NE files, joined to one list of exports.

Bytes are decoded in Python once per table; everything relational is left to Catalyst. Names are reduced to one per
(file, ordinal) before the join, so no key of a file is ever multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binweave.formats import ne, pe
from binweave.formats.reader import error_text, parse
from binweave.functions.bytes_expr import has_magic, u16_le, u32_le

EXPORTED = 1


def classify_kind(content: str = "content") -> Column:
    """'pe', 'ne' or null, by magic bytes, before anything is shipped to Python. An MZ file counts only with at least 64 bytes
    and the relocation offset 0x40."""
    new = u32_le(content, 60)
    at = F.substring(F.col(content), (new + 1).cast("int"), F.lit(4))
    fine = has_magic(content, b"MZ") & (F.length(content) >= 64) & (u16_le(content, 24) == 0x40)
    return F.when(fine & (F.hex(at) == "50450000"), "pe").when(fine & F.hex(at).startswith("4E45"), "ne")


def classify(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("kind", classify_kind(content))


def pe_exports(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(*keys, ordinal, name, error): addresses with the greatest name of their ordinal, if any; names without an address are
    dropped. Both tables are decoded in one pass and meet in one aggregation, which is the left join of addresses with names
    reduced to one per ordinal. A file with a broken table gives one row with the error."""
    rows = parse(files, pe.pe_export_rows, pe.EXPORT_ROW_SCHEMA, keys)
    met = rows.groupBy(*keys, "ordinal", "error").agg(F.max("is_address").alias("is_address"), F.max("name").alias("name"))
    return met.filter("is_address OR error IS NOT NULL").select(*keys, "ordinal", "name", "error")


def ne_ordinals(entries: DataFrame, keys: tuple[str, ...] = ("path",), compat: bool = False) -> DataFrame:
    """(*keys, ordinal, flags, segment, offset): entries with their ordinals, by a running sum over the bundles of a file.
    Unused bundles advance the count. Ordinals start at 1; compat=True starts at 0."""
    bundles = entries.groupBy(*keys, "bundle_idx").agg(F.first("bundle_size").alias("size"))
    before = F.sum("size").over(Window.partitionBy(*keys).orderBy("bundle_idx").rowsBetween(Window.unboundedPreceding, -1))
    starts = bundles.select(*keys, "bundle_idx", F.coalesce(before, F.lit(0)).alias("start"))
    used = entries.filter("kind <> 'unused'").join(starts, [*keys, "bundle_idx"])
    return used.select(*keys, (F.col("start") + F.col("entry_idx") + (0 if compat else 1)).cast("bigint").alias("ordinal"), "flags", "segment", "offset")


def ne_best_names(names: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(*keys, ordinal, name): the last valid UTF-8 name of an ordinal, non-resident names after resident ones."""
    text = names.withColumn("text", F.col("name").cast("string")).filter(F.is_valid_utf8("text"))
    order = F.struct((F.col("table_kind") == "nonresident").cast("int").alias("k"), "pos")
    return text.groupBy(*keys, F.col("ordinal").cast("bigint").alias("ordinal")).agg(F.max_by("text", order).alias("name"))


def ne_exports(files: DataFrame, keys: tuple[str, ...] = ("path",), compat: bool = False) -> DataFrame:
    """(*keys, ordinal, name, error) of the entries marked as exported, each with the last valid UTF-8 name of its ordinal.

    Ordinals are a running sum over the entries of a file, names follow after them; window and aggregation share one exchange."""
    rows = parse(files, ne.ne_export_rows, ne.EXPORT_ROW_SCHEMA, keys)
    before = F.sum("step").over(Window.partitionBy(*keys).orderBy(F.col("bundle_idx").asc_nulls_last(), "entry_idx").rowsBetween(Window.unboundedPreceding, -1))
    counted = F.coalesce(before, F.lit(0)) + (0 if compat else 1)
    text = F.col("name").cast("string")
    rows = rows.withColumn("at", F.when(F.col("bundle_idx").isNotNull(), counted).otherwise(F.col("ordinal")))
    own = rows.groupBy(*keys, "at", "error").agg(F.max(F.col("flags").bitwiseAND(EXPORTED)).alias("exported"), F.max_by(F.when(F.is_valid_utf8(text), text), F.when(F.is_valid_utf8(text), F.col("rank"))).alias("name"))
    return own.filter("exported = 1 OR error IS NOT NULL").select(*keys, F.col("at").alias("ordinal"), "name", "error")


#: The rows of both formats in one schema: PE addresses and names, NE entries and names, or an error of one row.
TAGGED_SCHEMA = "kind string, ordinal bigint, is_address boolean, pe_name string, bundle_idx int, entry_idx int, step int, flags int, rank int, ne_name binary, row_error string"
TAGGED_WIDTH = 11


def executable(content: str = "content") -> Column:
    """Whether a file is of one of the two formats, by its first bytes."""
    return classify_kind(content).isNotNull()


def binary_kind(data: bytes) -> str | None:
    """classify_kind for bytes in Python."""
    if data[:2] != b"MZ" or len(data) < 64 or data[24:26] != b"\x40\0":
        return None
    at = int.from_bytes(data[60:64], "little")
    return "pe" if data[at : at + 4] == b"PE\0\0" else "ne" if data[at : at + 2] == b"NE" else None


def tagged_rows(kind: str, data: bytes):
    """The rows of a file, all or nothing; if it cannot be read, one row with its kind and the error."""
    try:
        if kind == "pe":
            rows = [(kind, ordinal, is_address, name, *[None] * 7) for ordinal, is_address, name in pe.pe_export_rows(data)]
        else:
            rows = [(kind, ordinal, None, None, bundle, entry, step, flags, rank, name, None) for bundle, entry, step, flags, ordinal, rank, name in ne.ne_export_rows(data)]
    except Exception as e:  # noqa: BLE001 - hostile input must not fail the task
        rows = [(kind, *[None] * (TAGGED_WIDTH - 2), error_text(e))]
    yield from rows


def tagged_exports(rows: DataFrame, keys: tuple[str, ...], compat: bool = False) -> DataFrame:
    """(*keys, kind, ordinal, name, error) of rows of TAGGED_SCHEMA with keys and error. NE ordinals are a running sum over the
    entries of a file; names meet the addresses and entries of their ordinal in one aggregation. Window and aggregation are by
    the file, so they share one exchange."""
    before = F.sum("step").over(Window.partitionBy(*keys, "kind").orderBy(F.col("bundle_idx").asc_nulls_last(), "entry_idx").rowsBetween(Window.unboundedPreceding, -1))
    counted = F.coalesce(before, F.lit(0)) + (0 if compat else 1)
    text = F.col("ne_name").cast("string")
    at = F.when((F.col("kind") == "ne") & F.col("bundle_idx").isNotNull(), counted).otherwise(F.col("ordinal"))
    met = rows.withColumn("at", at).groupBy(*keys, "kind", "at", "error").agg(
        F.max("is_address").alias("is_address"), F.max("pe_name").alias("pe_name"), F.max(F.col("flags").bitwiseAND(EXPORTED)).alias("exported"),
        F.max_by(F.when(F.is_valid_utf8(text), text), F.when(F.is_valid_utf8(text), F.col("rank"))).alias("ne_name"),
    )
    kept = met.filter("is_address OR exported = 1 OR error IS NOT NULL")
    return kept.select(*keys, "kind", F.col("at").alias("ordinal"), F.coalesce("pe_name", "ne_name").alias("name"), "error")


def exports(files: DataFrame, keys: tuple[str, ...] = ("path",), compat: bool = False) -> DataFrame:
    """(*keys, kind, ordinal, name, error) of all PE and NE files among (*keys, content). Each file is decoded once, by its
    first bytes; a file that cannot be read gives one row with the error."""

    def run(data: bytes):
        return tagged_rows(kind, data) if (kind := binary_kind(data)) is not None else ()

    rows = parse(files.filter(executable()), run, TAGGED_SCHEMA, keys)
    return tagged_exports(rows.withColumn("error", F.coalesce("row_error", "error")), keys, compat)


def relocation_targets(relocations: DataFrame, imports: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Relocations with the names of their imports, by two look-ups: module index to name offset, name offset to name."""
    modules = imports.filter("kind = 'module'").select(*keys, F.col("idx").alias("module_index"), F.col("offset").alias("module_at"))
    names = imports.filter("kind = 'name'").select(*keys, "offset", "name")
    first = relocations.join(modules, [*keys, "module_index"], "left")
    second = first.join(names.withColumnsRenamed({"offset": "module_at", "name": "module_name"}), [*keys, "module_at"], "left")
    return second.join(names.withColumnsRenamed({"offset": "name_offset", "name": "import_name"}), [*keys, "name_offset"], "left")


def last_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One row per keys, the one of the greatest position."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("r")).select(*keys, "r.*")


def wanted_resources(df: DataFrame, types: list[int] | None = None, type_name: str | None = None, res_id: int | None = None, name: str | None = None, lang: int | None = None) -> DataFrame:
    """Leaves of the three-level convention (type, id, language) as columns, filtered by what is given; an id is used before a
    name."""
    level = lambda i, f: F.try_element_at(F.col("res_path"), F.lit(i + 1))[f]
    out = df.select("*", level(0, "id").alias("type_id"), level(0, "name").alias("type_name"), level(1, "id").alias("res_id"), level(1, "name").alias("res_name"), level(2, "id").alias("lang_id"))
    cond: list[Column] = []
    if types is not None:
        cond.append(F.col("type_id").isin(*types))
    elif type_name is not None:
        cond.append(F.col("type_name") == type_name)
    if res_id is not None:
        cond.append(F.col("res_id") == res_id)
    elif name is not None:
        cond.append(F.col("res_name") == name)
    if lang is not None:
        cond.append(F.col("lang_id") == lang)
    for c in cond:
        out = out.filter(c)
    return out
