"""Section and range logic as joins and windows: address look-ups, overlaps, sizes from neighbours, and image editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_lookup(addresses: DataFrame, sections: DataFrame, keys: list[str], inverse: bool = False) -> DataFrame:
    """Addresses (*keys, rva) with the file offset of the first section, in table order, that holds them: (*, file_offset),
    null where none does or its raw data ends before. inverse=True maps column file_offset to rva.

    A section is cut into at most two blocks of each size 2**level, aligned to their size, that make up its range; of equal
    blocks of a file, the one of the first section is kept. An address lies in one block of each level, so it is joined by
    equality to at most one row a level, however many sections there are and however they overlap.
    """
    low, size, base = ("raw_ptr", "raw_size", "virtual_address") if inverse else ("virtual_address", "virtual_size", "raw_ptr")
    value, out = ("file_offset", "rva") if inverse else ("rva", "file_offset")
    found = [low, base, *(["raw_size"] if low != "raw_ptr" else [])]
    # One key, in which nulls are equal.
    block = lambda number: F.struct(*keys, "_level", number.alias("number")).alias("_block")
    start, end = F.col(low).cast("bigint"), F.col(low).cast("bigint") + F.col(size)
    s = sections.filter(F.col(size) > 0).select(*keys, "pos", *found, start.alias("_start"), end.alias("_end"))
    s = s.withColumn("_level", F.explode(F.expr("sequence(0, length(bin(_end - _start)) - 1)")))
    # The first and the last whole block of a level, if they are not halves of a block of the next.
    s = s.withColumn("_first", F.expr("shiftright(_start - 1, _level) + 1")).withColumn("_after", F.expr("shiftright(_end, _level)")).filter("_first < _after")
    ends = F.array(F.when(F.col("_first") % 2 != 0, F.col("_first")), F.when(F.col("_after") % 2 != 0, F.col("_after") - 1))
    s = s.withColumn("_number", F.explode(ends)).filter("_number IS NOT NULL")
    blocks = s.groupBy(block(F.col("_number"))).agg(F.min("pos").alias("_pos"), *[F.min_by(c, "pos").alias(f"_{c}") for c in found])
    top = sections.agg(F.coalesce(F.max(F.expr(f"CASE WHEN {size} > 0 THEN length(bin({size})) - 1 END")), F.lit(0)).alias("_top"))
    a = addresses.withColumn("_row", F.monotonically_increasing_id()).crossJoin(F.broadcast(top))
    a = a.withColumn("_level", F.explode(F.sequence(F.lit(0), "_top"))).select("_row", *addresses.columns, "_level", block(F.expr(f"shiftright(CAST({value} AS BIGINT), _level)")))
    # Level 0 is kept for the addresses in no section.
    held = a.join(blocks, "_block", "left").filter("_level = 0 OR _pos IS NOT NULL").groupBy("_row", *addresses.columns)
    held = held.agg(*[F.min_by(f"_{c}", "_pos").alias(f"_{c}") for c in found])
    inside = F.lit(True) if inverse else (F.col(value) - F.col(f"_{low}") < F.col("_raw_size"))
    return held.withColumn(out, F.when(inside, F.col(f"_{base}") + F.col(value) - F.col(f"_{low}"))).select(*addresses.columns, out)


def section_overlap(sections: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, overlaps): whether any two sections of a file share raw bytes (uninitialised ones apart) or addresses."""

    def clash(start: str, size: str, rows: DataFrame) -> DataFrame:
        end = F.max(F.col(start) + F.col(size)).over(Window.partitionBy(*keys).orderBy(start, size).rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("hit", F.coalesce(end > F.col(start), F.lit(False))).groupBy(*keys).agg(F.bool_or("hit").alias("hit"))

    raw = clash("raw_ptr", "raw_size", sections.filter("raw_ptr <> 0 AND raw_size <> 0"))
    both = raw.unionByName(clash("virtual_address", "virtual_size", sections))
    return both.groupBy(*keys).agg(F.bool_or("hit").alias("overlaps"))


def virtual_size_fix(sections: DataFrame, keys: list[str], alignment: Column) -> DataFrame:
    """Sections whose missing virtual size is the raw size rounded up to the alignment, but not beyond the next section."""
    step = F.greatest(alignment, F.lit(1))
    after = F.lead("virtual_address").over(Window.partitionBy(*keys).orderBy("virtual_address", "virtual_size", "name"))
    grown = F.ceil(F.col("raw_size") / step).cast("bigint") * step
    return sections.withColumn("virtual_size", F.when(F.col("virtual_size") == 0, F.least(grown, after - F.col("virtual_address"))).otherwise(F.col("virtual_size")))


def lengths_from_offsets(df: DataFrame, keys: list[str], offset: str, total: str) -> DataFrame:
    """Adds length: up to the next offset of the same container, for the last one up to the total."""
    after = F.lead(offset).over(Window.partitionBy(*keys).orderBy(offset))
    return df.withColumn("length", F.coalesce(after, F.col(total)) - F.col(offset))


def image_editions(df: DataFrame, xml: str, keys: list[str]) -> DataFrame:
    """(*keys, index, edition_id): one row per IMAGE of an archive's XML. An image without an edition gives a null."""
    # Each image is cut out and read for itself, so one that lacks an edition shifts no other.
    images = df.select(*keys, F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<IMAGE\b.*?</IMAGE>)"), 1)).alias("image"))
    edition = F.trim(F.xpath_string("image", F.lit("/IMAGE/WINDOWS/EDITIONID")))
    return images.select(*keys, F.xpath_int("image", F.lit("/IMAGE/@INDEX")).alias("index"), F.nullif(edition, F.lit("")).alias("edition_id"))


#: Editions in the order in which they are preferred.
EDITIONS = ("Ultimate", "Enterprise", "Professional")


def chosen_edition(images: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, index, edition_id): of each archive the image of the best edition, of equal ones the first; archives without
    any of them give no row."""
    rank = F.array_position(F.lit(list(EDITIONS)), F.col("edition_id"))
    known = images.withColumn("rank", rank).filter("rank > 0")
    return known.groupBy(*keys).agg(F.min_by(F.struct("index", "edition_id"), F.struct("rank", "index")).alias("b")).select(*keys, "b.index", "b.edition_id")


def system_folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """The folders that hold system libraries, in any case."""
    return paths.filter(F.lower(F.col(path)).isin("/windows/system32", "/windows/syswow64"))


def first_match(entries: DataFrame, keys: list[str], name: str, wanted: list[str], pos: str) -> DataFrame:
    """Of each directory the first entry, by position, of the first wanted name that it has, in any case."""
    rank = F.array_position(F.lit([w.lower() for w in wanted]), F.lower(F.col(name)))
    rest = [c for c in entries.columns if c not in keys]
    hits = entries.withColumn("_rank", rank).filter("_rank > 0")
    return hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_rank", pos)).alias("r")).select(*keys, "r.*")
