"""Queries of the text problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.llm import leakage, mixing, mojibake, neardup, quality, records, terms, truncation
from binweave.llm.sql import SQL  # noqa: F401
from binweave.runtime import table


# p2
def _fonts_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Fonts with their garbled copyright texts restored."""
    fonts = table(spark, sf, "fonts").select("font_id", "source", "copyright").withColumn("grp", F.lit("fonts"))
    both = mojibake.with_restored(fonts, "grp", "copyright")
    return both.select("font_id", "source", F.coalesce("restored_text", "copyright").alias("copyright"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_fonts_repaired(spark, sf), "font_id", "copyright")


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per source the rows with a text, those cut off, and their share."""
    cut = p2_found(spark, sf).withColumn("cut", F.lit(1))
    rows = table(spark, sf, "fonts").filter("trim(copyright) <> ''").select("font_id", "source").join(cut, "font_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.count("cut").alias("n_cut"), (F.count("cut") / F.count("*")).alias("cut_share"))


# p4
def _terms(spark: SparkSession, sf: str) -> DataFrame:
    ne = table(spark, sf, "ne_names").select("file_id", F.col("name").cast("string").alias("term")).filter(F.is_valid_utf8("term"))
    pe = table(spark, sf, "exports").filter("kind = 'pe' AND name IS NOT NULL").select("file_id", F.col("name").alias("term"))
    return terms.term_frequencies(ne.unionByName(pe), "term", "file_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf).filter("mark IS NOT NULL").select("term", "mark")


def p4_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf).withColumn("mark", F.coalesce("mark", F.lit("useful"))).withColumnRenamed("records", "n_files")


# p5
def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    def part(name: str, key: str, col: str) -> DataFrame:
        return table(spark, sf, name).select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), F.col(col).alias("text"))

    return part("fonts", "font_id", "copyright").unionByName(part("fat_files", "row_id", "file_name")).unionByName(part("cab_files", "row_id", "name"))


def p5_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled rows with the original text, null where it cannot be restored, and the transformation undone."""
    return mojibake.garbled(_decoded(spark, sf), "table_name", "text")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_restored(spark, sf).select("table_name", "row_id")


# p6
def _lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = records.export_records(table(spark, sf, "export_lines"), "line_id", "line")
    return records.formatting_duplicates(lines, "line_id", {c: F.col(c) for c in ("file", "ordinal", "name")})


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf)[1]


def p6_copies(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct record, with the smallest line_id and the number of copies."""
    return _lines(spark, sf)[0]


# p7
def _similar(spark: SparkSession, sf: str) -> neardup.Classes:
    return neardup.near_duplicates(table(spark, sf, "exports").select("file_id", "name"), "file_id", "name")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.record_pairs(_similar(spark, sf)).toDF("file_id_a", "file_id_b")


def p7_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Per file with names its class of equal files, the files of other classes that agree with it, and its group."""
    return neardup.record_groups(_similar(spark, sf)).withColumnRenamed("id", "file_id")


# p8
def p8_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The longest match of each document and item, with its places."""
    return leakage.leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_matches(spark, sf).select("doc_id", "item_id")


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold no passage."""
    docs = table(spark, sf, "documents")
    return leakage.without_leaks(docs.select("doc_id", "source", "n_chars"), "doc_id", p8_found(spark, sf))


# p9
def _common_words(spark: SparkSession, sf: str, most: int = 100_000) -> list[str]:
    """The fixed list of function words of all languages; one of over `most` words is an error."""
    words = table(spark, sf, "common_words").select("word").filter("word IS NOT NULL").distinct()
    common = [r.word for r in words.orderBy("word").limit(most + 1).collect()]
    if len(common) > most:
        raise ValueError(f"a list of function words has at most {most} words")
    return common


def _mixed(spark: SparkSession, sf: str, total_tokens: int | str | None = None, vocabulary: str = mixing.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    measured = mixing.sizes_and_weights(F.col("text"), mixing.shipped(spark, vocabulary), _common_words(spark, sf))
    docs = table(spark, sf, "documents").select("doc_id", "source", measured.alias("m")).select("doc_id", "source", "m.n_tokens", "m.weight")
    return mixing.mix(docs, "doc_id", "source", "n_tokens", "weight", table(spark, sf, "mix_targets"), total_tokens)


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix with their tokens and copies."""
    return _mixed(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def p9_shares_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """The shares where as many tokens are wanted as the sources hold: small sources are repeated as often as they may be."""
    return _mixed(spark, sf, "available")[1]


# p10
def _text_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_statistics(table(spark, sf, "documents"), "doc_id", "text", _common_words(spark, sf))


def p10_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _text_statistics(spark, sf).drop("prose_share", "shape")


def p10_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The share of running prose in every document, and its shape where that is less than half."""
    return _text_statistics(spark, sf).select("doc_id", "prose_share", "shape")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _text_statistics(spark, sf).filter("shape IS NOT NULL").select("doc_id", "shape")


QUERIES = {
    "p2_found": p2_found, "p2_rates": p2_rates, "p4_found": p4_found, "p4_terms": p4_terms, "p5_found": p5_found, "p5_restored": p5_restored, "p6_found": p6_found, "p6_copies": p6_copies,
    "p7_found": p7_found, "p7_groups": p7_groups, "p8_found": p8_found, "p8_matches": p8_matches, "p8_kept": p8_kept, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_shares_of_all": p9_shares_of_all, "p10_found": p10_found, "p10_stats": p10_stats, "p10_shapes": p10_shapes,
}
