"""Directories scanned as a stream: new files are decoded once, with the same parsers as the batch scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.formats import ne, pe
from binweave.formats.reader import parse
from binweave.operators.exports import classify

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New files under a folder, each once, by path."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)


def stream_export_tables(files: DataFrame) -> DataFrame:
    """(path, modificationTime, kind, ordinal, name): raw names of the export tables of PE files and the name tables of NE
    files. Narrow: nothing is shuffled and no state is kept; join and reduce the written table in batch."""
    known = classify(files)
    keys = ("path", "modificationTime")
    pes = parse(known.filter("kind = 'pe'"), pe.pe_export_names, pe.EXPORT_NAME_SCHEMA, keys).select(*keys, F.lit("pe").alias("kind"), "ordinal", "name")
    nes = parse(known.filter("kind = 'ne'"), ne.ne_names, ne.NAME_SCHEMA, keys).select(*keys, F.lit("ne").alias("kind"), F.col("ordinal").cast("bigint").alias("ordinal"), F.try_validate_utf8(F.col("name").cast("string")).alias("name"))
    return pes.unionByName(nes).filter("name IS NOT NULL")


def names_per_window(tables: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, kind, n_names) by the time of the files; rows later than the watermark are left out of closed windows."""
    return tables.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", width), "kind").agg(F.count("*").alias("n_names"))
