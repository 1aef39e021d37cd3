"""What changed between full snapshots of a table.

Snapshots are unpivoted into signed cells (key, field, value): +1 in their own snapshot, -1 in the next, plus one presence
marker per key. Equal cells of neighbouring snapshots cancel in a grouped sum; the cells that remain classify a row and name
the fields that changed.

Defined cases: of several rows of one key in one snapshot the one with the latest delivery holds (of equal ones that with the
greatest tie-breaker, null deliveries last). Null keys and null values are values like any other. Rows with a null snapshot
number belong to none and are left out. A snapshot without rows is empty: all keys of the one before were removed. An empty
table gives no changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], values: list[str], order: list[Column]) -> DataFrame:
    """One row per keys, with the values of the row that is greatest in order; partial maxima are taken before the shuffle."""
    best = F.max_by(F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("held")).select(*keys, *[F.col(f"held.v{i}").alias(v) for i, v in enumerate(values)])


def snapshot_changes(df: DataFrame, snapshot: str, keys: list[str], fields: list[str], delivered: str, tie: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """(snapshot, *keys, change_kind, changed_fields) for the snapshots after `first` up to `last` (default: those present).

    change_kind is 'added', 'removed' (the snapshot is the one where the key is missing) or 'changed'; changed_fields is the
    sorted list of differing fields, empty for the other kinds. Extra columns are ignored and may have any name.
    """
    if first is None or last is None:
        low, high = df.agg(F.min(snapshot), F.max(snapshot)).first()
        first, last = first if first is not None else low, last if last is not None else high
    names = [f"k{i}" for i in range(len(keys))]
    values = [f"f{i}" for i in range(len(fields))]
    plain = df.select(F.col(snapshot).alias("s"), *[F.col(k).alias(n) for k, n in zip(keys, names)], *[F.col(f).alias(v) for f, v in zip(fields, values)], F.col(delivered).alias("at"), (F.col(tie) if tie else F.lit(0)).alias("tie"))
    plain = plain.filter(F.col("s").isNotNull() & F.col("s").between(first if first is not None else 0, last if last is not None else -1))
    held = latest(plain, ["s", *names], values, [F.col("at"), F.col("tie")])
    # All further grouping is by supersets of the key, so this one exchange of rows serves both sums.
    held = held.repartition(*names)
    cells = F.array(
        F.struct(F.lit(-1).alias("field"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(i).alias("field"), F.col(v).cast("string").alias("value")) for i, v in enumerate(values)],
    )
    signs = F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("s") + 1).alias("at"), F.lit(-1).alias("sign")))
    signed = held.select(*names, cells.alias("cells"), F.explode(signs).alias("t")).filter(F.col("t.at").between(F.lit(first) + 1 if first is not None else F.lit(1), F.lit(last) if last is not None else F.lit(0)))
    signed = signed.select("t.at", *names, "t.sign", F.explode("cells").alias("c")).select("at", *names, "sign", "c.field", "c.value")
    sums = signed.groupBy("at", *names, "field", "value").agg(F.sum("sign").alias("n")).filter("n <> 0")
    changes = sums.groupBy("at", *names).agg(
        F.sum(F.when(F.col("field") == -1, F.col("n"))).alias("presence"),
        F.array_sort(F.collect_set(F.when(F.col("field") >= 0, F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)))).alias("fields"),
    )
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return changes.select(
        F.col("at").alias(snapshot), *[F.col(n).alias(k) for n, k in zip(names, keys)], kind.alias("change_kind"),
        F.when(F.col("presence").isNull(), F.col("fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
    )
