"""Frequency of every distinct term: occurrences, records that hold it, and a mark where it is too rare or too common.

Per-record term counts are summed in hash tables before each shuffle: first by (record, term), which spreads a term that a
third of all rows hold over its records, then by term. Memory and the largest task do not depend on the commonest term.

Defined cases: null terms are no terms; an empty string is one. An occurrence with a null record counts as an occurrence but
in no record. An empty table gives no rows. Terms compare exactly, by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_frequencies(df: DataFrame, term: str, record: str, rare_records: int = 1, common_per_mille: int = 50) -> DataFrame:
    """(term, occurrences, records, mark): mark is 'rare' up to rare_records, else 'common' from common_per_mille of all
    records that hold any term, else null. Extra columns of df are ignored, whatever their names."""
    plain = df.select(F.col(term).alias("term"), F.col(record).alias("record")).filter(F.col("term").isNotNull())
    total = plain.select("record").distinct().agg(F.count("record")).first()[0]
    per_record = plain.groupBy("record", "term").agg(F.count("*").alias("n"))
    per_term = per_record.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("record").alias("records"))
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") * 1000 >= F.lit(total) * common_per_mille, "common")
    return per_term.withColumn("mark", mark)
