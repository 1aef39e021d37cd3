"""Connected components of an edge table, by the smallest label reached, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binweave.runtime import join_salted, materialise


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of an edge, with the smallest node of its component.

    Each round takes the smallest label among the neighbours, then follows labels of labels, so long chains need a number of
    rounds that grows with the logarithm of their length. Rounds are written to the shared folder; only counts reach the
    driver. A node of many edges, and the label of a component that holds many nodes, are joined in parts. Null ends are
    ignored, self-loops make a node of their own.
    """
    plain = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    both = materialise(plain.unionByName(plain.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    first = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label"), F.count("*").alias("degree")))
    degrees, labels = first.select(F.col("u").alias("v"), "degree"), first.select("u", "label")
    while True:
        seen = join_salted(both, labels.toDF("v", "other"), ["v"], degrees, "degree").groupBy("u").agg(F.min("other").alias("other"))
        near = materialise(labels.join(seen, "u").select("u", F.col("label").alias("old"), F.least("label", "other").alias("label")))
        sizes = materialise(near.groupBy("label").agg(F.count("*").alias("n")))
        far = join_salted(near, labels.toDF("label", "root"), ["label"], sizes, "n", how="left")
        new = materialise(far.select("u", "old", F.least("label", F.coalesce("root", "label")).alias("label")))
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("u", "label")
        if not changed:
            return labels.toDF("node", "component")
