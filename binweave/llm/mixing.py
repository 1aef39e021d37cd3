"""Mixing sources to target shares of tokens, by weighted sampling without replacement.

Every document gets an exponential key, -ln(u) / w, from a hash of its id and its quality weight w. Within a source, documents
in the order of their keys are a weighted sample without replacement, whatever length is taken. A source's token budget is met
by complete epochs first, each all of its documents once; the rest is the longest run of documents in key order whose tokens
do not exceed it.

The order is never built over a whole source. Keys are put into BINS bins that keep their order; sums of tokens per bin tell
which bins are taken whole and in which one the budget ends, and only that bin's documents are sorted.

The total is given, or the largest at which every source with documents can reach its share within its cap on repeats; shares
of sources without documents go to the others in proportion. A source that cannot reach its share of a given total is repeated
as often as it may be; the report states the shares that came out.

Defined cases: documents with a null source, or one without target, and documents without tokens are not used; null texts have
no tokens. Repeated ids are documents of their own with equal keys. A target of a source that has no documents gives a report
row of zeros; null or negative shares and repeats count as zero. Empty tables give an empty mix.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binweave.llm.quality import word_shares
from binweave.runtime import join_counted, materialise

BINS = 4096
#: Where the public vocabulary lies on the driver; every query takes another path. It is sent to the workers with the job.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def shipped(spark: SparkSession, vocabulary: str) -> str:
    """Sends a vocabulary file that lies on the driver to all workers, now and later, and gives the name they find it by."""
    spark.sparkContext.addFile(vocabulary)
    return os.path.basename(vocabulary)


def sizes_and_weights(text: Column, vocabulary: str, common_words: list[str], usual_common: float = 0.4, least: float = 0.05) -> Column:
    """A struct of n_tokens, the number of tokens of a whole text, and weight, its quality, by one reading of the text.

    The weight, between `least` and 1, is the share of characters that are letters or digits in words, times the share of common
    words against the usual share of running prose, both from the text statistics. vocabulary is a name given by shipped. A null
    text has no tokens and the least weight."""
    common = frozenset(w.lower() for w in common_words if w)

    @F.pandas_udf("n_tokens bigint, weight double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = _tokenizer(SparkFiles.get(vocabulary)).encode_ordinary
        for texts in batches:
            rows = []
            for t in texts:
                if t is None:
                    rows.append((0, least))
                    continue
                ratio, share = word_shares(t, common)
                rows.append((len(encode(t)), max(least, min(1.0, (1 - ratio) * min(1.0, share / usual_common)))))
            yield pd.DataFrame(rows, columns=["n_tokens", "weight"])

    return measure(text)


def mix(docs: DataFrame, doc_id: str, source: str, n_tokens: str, weight: str | None, targets: DataFrame, total_tokens: int | str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (doc_id, source, n_tokens, copies) with at least one copy, and shares (source, target_share,
    available_tokens, mixed_tokens, actual_share, epochs, n_docs), one row per target. total_tokens may be "available": as many
    tokens as the sources hold."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(1e-6)) if weight else F.lit(1.0)
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(source).alias("src"), F.col(n_tokens).cast("bigint").alias("n"), w.alias("w"), (-F.log(unit) / w).alias("key"))
    # A filter on n before the table is written would be pushed below the tokenizer, which then runs twice.
    rows = materialise(rows.filter("src IS NOT NULL")).filter("n > 0")
    sizes = rows.groupBy("src").agg(F.sum("n").alias("size"), F.count("*").alias("n_docs"), F.avg("w").alias("mean_w"))
    aims = targets.select(F.col("source").alias("src"), F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(0)), F.lit(0)).alias("cap"))
    plan = materialise(aims.filter("src IS NOT NULL").join(sizes, "src", "left").fillna(0, ["size", "n_docs"]))
    usable = plan.filter("size > 0 AND share > 0 AND cap > 0")
    spread, largest = usable.agg(F.sum("share"), F.min(F.col("size") * F.col("cap") / F.col("share"))).first()
    if total_tokens == "available":
        total = float(plan.agg(F.sum("size")).first()[0] or 0)
    else:
        total = float(total_tokens) if total_tokens is not None else (largest or 0.0) * (spread or 0.0)
    budget = F.when((F.col("size") > 0) & (F.col("cap") > 0), F.least(F.lit(total) * F.col("share") / F.lit(spread or 1.0), (F.col("size") * F.col("cap")).cast("double"))).otherwise(0.0)
    # Rounding must not turn the last complete epoch into a part of one.
    plan = plan.withColumn("budget", F.round(budget).cast("bigint"))
    plan = plan.withColumn("whole", F.when(F.col("size") > 0, F.expr("budget div size")).otherwise(0)).withColumn("rest", F.when(F.col("size") > 0, F.expr("budget % size")).otherwise(0))
    known = plan.filter("n_docs > 0").select("src", "n_docs", "mean_w", "whole", "rest")
    binned = join_counted(rows, known, ["src"], "n_docs").withColumn("bin", F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.col("mean_w"))) * BINS).cast("int"))
    sums = binned.groupBy("src", "bin").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    # At most BINS rows per source, whatever its size.
    upto = sums.withColumn("before", F.sum("n").over(Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    last = upto.filter("before <= rest").groupBy("src").agg(F.max_by(F.struct(F.col("bin").alias("edge"), "before"), "bin").alias("e")).select("src", "e.edge", "e.before")
    known = materialise(known.join(last, "src", "left"))
    binned = join_counted(rows, known, ["src"], "n_docs").withColumn("bin", F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.col("mean_w"))) * BINS).cast("int"))
    inner = binned.filter("bin <> edge").withColumn("extra", (F.col("bin") < F.col("edge")).cast("bigint"))
    run = F.sum("n").over(Window.partitionBy("src").orderBy("key", "doc").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = binned.filter("bin = edge").withColumn("run", run + F.col("before")).withColumn("extra", (F.col("run") <= F.col("rest")).cast("bigint")).drop("run")
    chosen = inner.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra")).filter("copies > 0").select("doc", "src", "n", "copies")
    chosen = materialise(chosen)
    got = chosen.groupBy("src").agg(F.sum(F.col("n") * F.col("copies")).alias("mixed"), F.count("*").alias("used"))
    all_mixed = got.agg(F.sum("mixed")).first()[0] or 0
    shares = plan.join(got, "src", "left").select(
        F.col("src").alias("source"), F.col("share").alias("target_share"), F.col("size").alias("available_tokens"), F.coalesce("mixed", F.lit(0)).alias("mixed_tokens"),
        (F.coalesce("mixed", F.lit(0)) / F.lit(float(all_mixed or 1))).alias("actual_share"), F.when(F.col("size") > 0, F.coalesce("mixed", F.lit(0)) / F.col("size")).otherwise(0.0).alias("epochs"), F.coalesce("used", F.lit(0)).alias("n_docs"),
    )
    return chosen.select(F.col("doc").alias("doc_id"), F.col("src").alias("source"), F.col("n").alias("n_tokens"), "copies"), shares
