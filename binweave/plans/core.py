"""Queries of the core problems: timestamps and snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.functions import zones
from binweave.operators.snapshots import snapshot_changes
from binweave.operators.timestamps import utc_seconds
from binweave.runtime import table


def stamped(spark: SparkSession, sf: str, keep: bool = True) -> DataFrame:
    """(table_name, row_id, utc_second) of the rows of the three tables that hold timestamps; null if not determined, or left
    out with keep=False."""
    media = table(spark, sf, "media").select(F.col("medium_id").alias("m_id"), "zone_id")

    def with_zone(name: str, *cols: str) -> DataFrame:
        rows = table(spark, sf, name).select("row_id", "medium_id", *cols)
        return rows.join(media, rows.medium_id == media.m_id, "left").withColumn("table_name", F.lit(name))

    headers = utc_seconds(with_zone("dbg_headers", "time_date_stamp"), F.col("time_date_stamp"), None, F.col("zone_id"), keep=keep)
    fat = utc_seconds(with_zone("fat_files", "modification_date", "modification_time_h_m_2s"), F.col("modification_date"), F.col("modification_time_h_m_2s"), F.col("zone_id"), packed=True, keep=keep)
    cab = utc_seconds(with_zone("cab_files", "date", "time"), F.col("date"), F.col("time"), F.col("zone_id"), packed=True, keep=keep)
    cols = ["table_name", "row_id", "utc_second"]
    return headers.select(*cols).unionByName(fat.select(*cols)).unionByName(cab.select(*cols))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return stamped(spark, sf, keep=False)


def p1_determined(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows of each table denote a second, the range of those seconds, and the release of the zone tables."""
    return stamped(spark, sf).groupBy("table_name").agg(F.count("*").alias("n_rows"), F.count("utc_second").alias("n_determined"), F.min("utc_second").alias("first_second"), F.max("utc_second").alias("last_second"), F.lit(zones.release()).alias("zone_release"))


def _export_changes(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(table(spark, sf, "export_snapshots"), "snapshot_no", ["file_id", "ordinal"], ["name", "forwarder"], "delivered_at", "row_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _export_changes(spark, sf).drop("changed_fields")


def p3_changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Per snapshot and kind of change the number of keys, and in how many the name or the forwarder differs."""
    has = lambda f: F.sum(F.array_contains("changed_fields", f).cast("bigint"))
    return _export_changes(spark, sf).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n_keys"), has("name").alias("n_name"), has("forwarder").alias("n_forwarder"))


QUERIES = {"p1_found": p1_found, "p1_determined": p1_determined, "p3_found": p3_found, "p3_changed_fields": p3_changed_fields}

_STATES = """
WITH held AS (
  SELECT snapshot_no, file_id, ordinal, name, forwarder FROM export_snapshots
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, file_id, ordinal ORDER BY delivered_at DESC, row_id DESC) = 1
), diff AS (
  SELECT coalesce(b.snapshot_no, a.snapshot_no + 1) AS snapshot_no,
         CASE WHEN b.snapshot_no IS NULL THEN a.file_id ELSE b.file_id END AS file_id,
         CASE WHEN b.snapshot_no IS NULL THEN a.ordinal ELSE b.ordinal END AS ordinal,
         CASE WHEN a.snapshot_no IS NULL THEN 'added' WHEN b.snapshot_no IS NULL THEN 'removed'
              WHEN a.name IS DISTINCT FROM b.name OR a.forwarder IS DISTINCT FROM b.forwarder THEN 'changed' END AS change_kind,
         a.snapshot_no IS NOT NULL AND b.snapshot_no IS NOT NULL AND a.name IS DISTINCT FROM b.name AS by_name,
         a.snapshot_no IS NOT NULL AND b.snapshot_no IS NOT NULL AND a.forwarder IS DISTINCT FROM b.forwarder AS by_forwarder
  FROM held a FULL JOIN held b
    ON b.snapshot_no = a.snapshot_no + 1 AND a.file_id IS NOT DISTINCT FROM b.file_id AND a.ordinal IS NOT DISTINCT FROM b.ordinal
), changes AS (
  SELECT * FROM diff WHERE change_kind IS NOT NULL
    AND snapshot_no > (SELECT min(snapshot_no) FROM held) AND snapshot_no <= (SELECT max(snapshot_no) FROM held)
)
"""
SQL = {
    "p3_found": _STATES + "SELECT snapshot_no, file_id, ordinal, change_kind FROM changes",
    "p3_changed_fields": _STATES + "SELECT snapshot_no, change_kind, count(*) AS n_keys, CAST(sum(CAST(by_name AS INT)) AS BIGINT) AS n_name, CAST(sum(CAST(by_forwarder AS INT)) AS BIGINT) AS n_forwarder FROM changes GROUP BY ALL",
}
