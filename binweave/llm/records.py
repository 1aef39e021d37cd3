"""Duplicates hidden by formatting: records that are equal up to case, white space, punctuation, layout and field order.

A record is a tree, hashed from its leaves up. Leaves are normalised texts; an array is an ordered node, whose digest is that of
its children in order; a struct or map is an unordered one, whose children are hashed with their names and sorted before they are
hashed again. Rows are grouped by the root digest alone. A group is confirmed by comparing the whole normalised structures of its
rows: the least and the greatest of them are equal. Where they are not, different records share a digest, and the rows of that
root are grouped by their structure instead.

Defined cases: rows without a record (null fields as the parser gives for noise) are left out; null ids never have copies but
may count as copies. Rows that repeat an id are one line delivered twice: they count as copies but are not listed. Null leaves
equal each other and nothing else. An empty table gives no rows. Groups of any size are handled: a group is reduced to one row
before it is joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.runtime import join_counted, materialise


#: White space and the mark that some tools put before a text.
_BLANKS = " \t\n\v\f\r\ufeff"


def bare(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def leaf(value: Column) -> Column:
    return F.xxhash64(value)


def named(name: Column, digest: Column) -> Column:
    return F.xxhash64(name, digest)


def unordered(digests: Column) -> Column:
    return F.xxhash64(F.array_sort(digests))


def ordered(digests: Column) -> Column:
    return F.xxhash64(digests)


def normalised(value: Column, kind: T.DataType) -> Column:
    """The structure with normalised leaves and names: structs as structs in the order of their names, maps as sorted entries."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[normalised(value[f.name], f.dataType).alias(f"n{i}") for i, f in enumerate(fields)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: normalised(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(bare(e["key"].cast("string")).alias("name"), normalised(e["value"], kind.valueType).alias("value"))))
    return bare(value.cast("string"))


def digest(value: Column, kind: T.DataType) -> Column:
    """The digest of a normalised structure whose original type is kind."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return unordered(F.array(*[named(F.lit(f.name.lower()), digest(value[f"n{i}"], f.dataType)) for i, f in enumerate(fields)]))
    if isinstance(kind, T.ArrayType):
        return ordered(F.transform(value, lambda x: digest(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        return unordered(F.transform(value, lambda e: named(e["name"], digest(e["value"], kind.valueType))))
    return leaf(value)


def export_records(df: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """(line_id, file, ordinal, name) of raw lines in one of three layouts; other lines give no row.

    Layouts: tab-separated (JSON path list, ordinal, name), key=value parts split by ; , or |, and JSON objects. The parts of a
    path list are joined to one leaf, because the other layouts do not tell them apart. Keys are read in any case and order; of
    equal keys the first counts.
    """
    # Each step is a projection of its own, so nothing that several fields need is computed for each of them.
    rows = df.select(F.col(id_col).alias("line_id"), F.col(line_col).alias("line"))
    rows = rows.select("line_id", F.btrim("line", F.lit(_BLANKS)).alias("text"), F.split("line", "\t", -1).alias("cells"))
    is_json = F.col("text").startswith("{")
    # A trailing tab of an empty name must survive, so this layout is split from the untouched line.
    is_tab = ~is_json & (F.size("cells") == 3)
    # A value ends where the next key begins; the line is cut there once.
    cut = F.split(F.when(~is_json & ~is_tab, F.col("text")), r"[;,|]\s*(?=(?i:file|ordinal|name)\s*=)", -1)
    rows = rows.select(
        "line_id", F.when(is_tab, F.col("cells")).alias("cells"), F.from_json(F.when(is_tab, F.col("cells")[0]), "array<string>").alias("path"),
        F.map_entries(F.from_json(F.when(is_json, F.col("text")), "map<string,string>", {"mode": "PERMISSIVE"})).alias("entries"), cut.alias("cut"),
    )
    key = lambda text: F.lower(F.trim(text))
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    from_json = F.transform("entries", lambda e: pair(key(e["key"]), e["value"]))
    from_cut = F.transform("cut", lambda p: pair(key(F.substring_index(p, "=", 1)), F.substring(p, F.instr(p, "=") + 1, F.length(p))))
    from_cells = F.array(*[pair(F.lit(k), v) for k, v in (("file", F.coalesce(F.array_join("path", "/"), F.col("cells")[0])), ("ordinal", F.col("cells")[1]), ("name", F.col("cells")[2]))])
    rows = rows.select("line_id", F.when(F.col("cells").isNotNull(), from_cells).otherwise(F.coalesce(from_json, from_cut)).alias("pairs"))
    first = lambda k: F.try_element_at(F.filter("pairs", lambda e: e["key"] == k), F.lit(1))["value"].alias(k)
    rows = rows.select("line_id", first("file"), first("ordinal"), first("name"))
    # Headings and noise have no number where the ordinal stands.
    fine = F.col("file").rlike(r"[\p{L}\p{N}]") & bare(F.col("ordinal")).rlike("^[0-9]+$") & F.col("name").isNotNull()
    # A filter would be pushed below all steps, which then run twice.
    return rows.select("line_id", F.inline(F.array_compact(F.array(F.when(fine, F.struct("file", "ordinal", "name"))))))


def normal_records(df: DataFrame, id_col: str, fields: dict[str, Column], root: Callable[[Column, T.DataType], Column] = digest) -> DataFrame:
    """(line_id, canon, root): the normalised fields as one structure, and the digest of the record as an unordered node."""
    names = sorted(fields)
    rows = df.select(F.col(id_col).alias("line_id"), *[fields[n].alias(f"f_{n}") for n in names])
    kind = T.StructType([T.StructField(n, rows.schema[f"f_{n}"].dataType) for n in names])
    rows = rows.filter(" OR ".join(f"f_{n} IS NOT NULL" for n in names))
    rows = rows.select("line_id", F.struct(*[normalised(F.col(f"f_{n}"), rows.schema[f"f_{n}"].dataType).alias(f"n{i}") for i, n in enumerate(names)]).alias("canon"))
    return rows.withColumn("root", root(F.col("canon"), kind))


def formatting_duplicates(df: DataFrame, id_col: str, fields: dict[str, Column], root: Callable[[Column, T.DataType], Column] = digest) -> tuple[DataFrame, DataFrame]:
    """Two tables: groups (first_line_id, copies), one row per distinct record; members (first_line_id, line_id), one row per
    line that has an equal line with a smaller id. Fields may be texts, numbers, arrays, structs or maps."""
    rows = materialise(normal_records(df, id_col, fields, root))
    own = [F.min("line_id").alias("first_line_id"), F.count("*").alias("copies")]
    by_root = rows.groupBy("root").agg(*own, F.min("canon").alias("low"), F.max("canon").alias("high"))
    alike = F.col("low").eqNullSafe(F.col("high"))
    repeated = materialise(by_root.filter("copies > 1").select("root", "first_line_id", "copies", alike.alias("alike")))
    sound = repeated.filter("alike").drop("alike")
    groups = by_root.filter(alike).select("first_line_id", "copies")
    members = join_counted(rows.select("line_id", "root"), sound, ["root"], "copies")
    if repeated.filter("NOT alike").limit(1).count():
        # Roots that different records share: there their structures decide.
        mixed = materialise(join_counted(rows, repeated.filter("NOT alike").select("root", F.col("copies").alias("n")), ["root"], "n").drop("n"))
        by_structure = materialise(mixed.groupBy("root", "canon").agg(*own))
        groups = groups.unionByName(by_structure.select("first_line_id", "copies"))
        members = members.unionByName(join_counted(mixed, by_structure, ["root", "canon"], "copies").drop("canon"))
    return groups, members.filter("line_id > first_line_id").select("first_line_id", "line_id")
