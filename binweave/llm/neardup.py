"""Near-duplicate sets: all pairs whose Jaccard similarity reaches a threshold, found by bit-sliced comparison of blocks.

1. Items are hashed to 64 bits; records of equal item sets form one class, and only classes are compared.
2. The items of a class are ordered: rare items first, by hash, then the few items held very often, by frequency. Two classes
   that reach the threshold share an item in short prefixes of that order, so classes are brought together by prefix items.
3. Within such a bucket, the parity sketches of 64 classes form a block that is stored vertically, one 64-bit word per bit
   plane. A class is compared with a block by XOR with its own bits; differing bits are added up in bit-sliced counters with
   carry-save adders, and a block is abandoned once all its lanes exceed the radius. The distance of two parity sketches never
   exceeds the size of the symmetric difference, so no pair is lost.
4. The remaining pairs are confirmed on the whole item sets. Items are compared by 64-bit hashes throughout, classes are formed
   by two such hashes of the whole set; the few bits by which two different items of a pair could agree by chance are not looked at.

Items held by at least one HOT-th of all (class, item) pairs are at most HOT many, whatever the data; only they go to the driver
and the workers. All other buckets are thereby bounded; a bucket over `bucket` rows is split into cells of two chunks each, so
memory stays bounded and no pair is lost.

Defined cases: null ids and null items are left out, records without items are in no pair. Repeated items count once. Empty
strings are items. Records of equal sets have similarity 1. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binweave.operators.graph import components
from binweave.runtime import join_counted, join_salted, materialise

PLANES, LANES, STEP, HOT = 256, 64, 32, 10_000
_PREFIX = "bucket bigint, cls bigint, size int, indexed boolean, sketch binary"
_ALL = ~np.uint64(0)


@dataclass
class Classes:
    """members (id, cls): every record with its class, whose number is the smallest id in it. classes (cls, items, n): one row
    per class. pairs (a, b), a < b: classes that reach the threshold."""

    members: DataFrame
    classes: DataFrame
    pairs: DataFrame


def _prefixes(hot: np.ndarray, rank: np.ndarray, num: int, den: int):
    """Batches of (cls, items) to the rows of the classes' prefix items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            lists = batch.column("items")
            values = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            row = np.repeat(np.arange(len(cls)), sizes)
            at = np.minimum(np.searchsorted(hot, values), max(len(hot) - 1, 0))
            heat = np.where(hot[at] == values, rank[at], 0) if len(hot) else np.zeros(len(values), dtype=np.int64)
            order = np.lexsort((values, heat, row))
            place = np.arange(len(values)) - start[row]
            probe = sizes - -(-sizes * num // den) + 1
            index = sizes - -(-sizes * 2 * num // (num + den)) + 1
            keep = place < np.maximum(probe, index)[row]
            bit = (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
            odd = np.bincount(row * PLANES + bit.astype(np.int64), minlength=len(cls) * PLANES).reshape(len(cls), PLANES) & 1
            packed = np.packbits(odd.astype(np.uint8), axis=1)
            who = row[keep]
            sketch = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(np.arange(len(who) + 1, dtype=np.int32) * (PLANES // 8)), pa.py_buffer(np.ascontiguousarray(packed[who]))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[order][keep]), pa.array(cls[who]), pa.array(sizes[who].astype(np.int32)), pa.array(place[keep] < index[who]), sketch],
                ["bucket", "cls", "size", "indexed", "sketch"],
            )

    return run


def _add(counter: list[np.ndarray], new: list[np.ndarray]) -> list[np.ndarray]:
    """Adds one bit per lane and vector to the bit-sliced counters: full adders on three words of equal weight at a time."""
    out, todo, weight = [], list(new), 0
    while todo or weight < len(counter):
        if weight < len(counter):
            todo.append(counter[weight])
        carries = []
        while len(todo) > 2:
            a, b, c = todo.pop(), todo.pop(), todo.pop()
            half = a ^ b
            carries.append((a & b) | (half & c))
            todo.insert(0, half ^ c)
        if len(todo) == 2:
            carries.append(todo[0] & todo[1])
            todo = [todo[0] ^ todo[1]]
        out.append(todo[0] if todo else np.zeros_like(counter[0]))
        todo = carries
        weight += 1
    return out


def _exceeds(counter: list[np.ndarray], radius: np.ndarray) -> np.ndarray:
    """Lanes whose count is greater than the radius of their row."""
    greater, equal = np.zeros_like(counter[0]), np.full_like(counter[0], _ALL)
    if len(counter) < 62:
        equal[radius >> len(counter) > 0] = 0
    for w in range(len(counter) - 1, -1, -1):
        limit = np.where((radius >> w) & 1, _ALL, np.uint64(0))
        greater |= equal & counter[w] & ~limit
        equal &= ~(counter[w] ^ limit)
    return greater


def compare(bucket: np.ndarray, cls: np.ndarray, size: np.ndarray, indexed: np.ndarray, bits: np.ndarray, num: int, den: int, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes in one bucket whose sketches allow the threshold. Rows are sorted by bucket, then size; bits is a
    matrix of rows by PLANES, 0 or 1."""
    group = np.cumsum(np.concatenate(([0], (bucket[1:] != bucket[:-1]).astype(np.int64))))
    lane = np.flatnonzero(indexed)
    none = np.empty(0, dtype=np.int64)
    if not len(lane):
        return none, none
    blocks = -(-len(lane) // LANES)
    rows = np.zeros((blocks * LANES, PLANES), dtype=np.uint8)
    rows[: len(lane)] = bits[lane]
    vertical = np.packbits(rows.reshape(blocks, LANES, PLANES), axis=1, bitorder="little")
    planes = np.ascontiguousarray(vertical.transpose(0, 2, 1)).view(np.uint64).reshape(blocks, PLANES)
    # Lanes of the same bucket that are not larger, and large enough: one range of lanes per row.
    span = int(size.max()) + 2
    key = group[lane] * span + size[lane]
    low = np.searchsorted(key, group * span + -(-size.astype(np.int64) * num // den))
    high = np.searchsorted(key, group * span + size, side="right")
    count = np.where(high > low, (high - 1) // LANES - low // LANES + 1, 0)
    query = np.repeat(np.arange(len(cls)), count)
    block = (low // LANES)[query] + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
    ones = np.where(bits == 1, _ALL, np.uint64(0)) if len(bits) <= chunk else None
    left, right = [], []
    for at in range(0, len(query), chunk):
        q, b = query[at : at + chunk], block[at : at + chunk]
        first, last = np.maximum(low[q] - b * LANES, 0), np.minimum(high[q] - b * LANES, LANES)
        alive = (_ALL << first.astype(np.uint64)) & (_ALL >> (LANES - last).astype(np.uint64))
        radius = (size[q].astype(np.int64) + size[lane[b * LANES + last - 1]]) * (den - num) // (den + num)
        counter = [np.zeros(len(q), dtype=np.uint64)]
        for p in range(0, PLANES, STEP):
            own = ones[q, p : p + STEP] if ones is not None else np.where(bits[q, p : p + STEP] == 1, _ALL, np.uint64(0))
            differ = np.ascontiguousarray((planes[b, p : p + STEP] ^ own).T)
            counter = _add(counter, list(differ))
            alive &= ~_exceeds(counter, radius)
            if not (stay := alive != 0).all():
                q, b, alive, radius, counter = q[stay], b[stay], alive[stay], radius[stay], [c[stay] for c in counter]
            if not len(q):
                break
        if len(q):
            r, l = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            x, y = cls[q[r]], cls[lane[b[r] * LANES + l]]
            left.append(np.minimum(x, y)[x != y])
            right.append(np.maximum(x, y)[x != y])
    if not left:
        return none, none
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), dtype=np.int64)
    return both[:, 0], both[:, 1]


def _compare_batches(num: int, den: int, rows: int = 20_000):
    """Sorted rows of whole partitions to pairs; a bucket that continues in the next batch is kept for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[pa.RecordBatch], end: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            bucket = t["bucket"].to_numpy()
            cut = len(bucket) if end else int(np.searchsorted(bucket, bucket[-1]))
            parts[:] = t.slice(cut).to_batches()
            if cut:
                t = t.slice(0, cut)
                same = np.concatenate(([False], bucket[1:cut] == bucket[: cut - 1]))
                same[:-1] |= same[1:]
                t = t.filter(pa.array(same))
                if t.num_rows:
                    bits = np.unpackbits(np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, PLANES // 8), axis=1)
                    a, b = compare(t["bucket"].to_numpy(), t["cls"].to_numpy(), t["size"].to_numpy(), t["indexed"].to_numpy(), bits, num, den)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield from flush(held, False)
        if held:
            yield from flush(held, True)

    return run


def _cells(prefixes: DataFrame, bucket: int) -> DataFrame:
    """Buckets of over `bucket` rows as cells: each row goes to the cells of its own chunk with every other."""
    big = prefixes.groupBy("bucket").count().filter(F.col("count") > bucket).withColumn("k", F.ceil(F.col("count") * 2 / bucket).cast("int"))
    if not big.limit(1).count():
        return prefixes
    # A bucket of over `bucket` rows holds that part of all rows, so their number is bounded by rows / bucket.
    big = materialise(big.select("bucket", "k"))
    own = F.pmod(F.xxhash64("cls"), F.col("k"))
    rows = prefixes.join(big, "bucket").withColumn("i", own).withColumn("j", F.explode(F.expr("sequence(0, k - 1)")))
    cell = F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j"))
    return prefixes.join(big, "bucket", "left_anti").unionByName(rows.select(cell.alias("bucket"), "cls", "size", "indexed", "sketch"))


def near_duplicates(df: DataFrame, id_col: str, item_col: str, num: int = 4, den: int = 5, bucket: int = 4096) -> Classes:
    """Classes of records with equal item sets, and the pairs of classes with a Jaccard similarity of at least num / den.
    Ids are bigint. Extra columns are ignored, whatever their names."""
    plain = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(item_col).alias("item")).filter("id IS NOT NULL AND item IS NOT NULL")
    sets = plain.groupBy("id").agg(F.array_sort(F.collect_set(F.xxhash64("item"))).alias("items"))
    sets = materialise(sets.withColumn("d1", F.xxhash64("items")).withColumn("d2", F.xxhash64(F.lit(1), "items")))
    classes = materialise(sets.groupBy("d1", "d2").agg(F.min("id").alias("cls"), F.first("items").alias("items"), F.count("*").alias("n")))
    members = join_counted(sets.select("id", "d1", "d2"), classes.select("d1", "d2", "cls", "n"), ["d1", "d2"], "n").select("id", "cls")

    counts = classes.select(F.explode("items").alias("item")).groupBy("item").count()
    pairs = classes.agg(F.sum(F.size("items"))).first()[0] or 0
    often = counts.filter((F.col("count") * HOT >= pairs) & (F.col("count") > 2)).orderBy("count", "item").collect()
    hot = np.array([r[0] for r in often], dtype=np.int64)
    by_value = np.argsort(hot)
    run = _prefixes(hot[by_value], np.arange(1, len(hot) + 1)[by_value], num, den)
    prefixes = classes.select("cls", "items").mapInArrow(run, _PREFIX)
    cells = _cells(prefixes, bucket).repartition("bucket").sortWithinPartitions("bucket", "size", "cls")
    found = materialise(cells.mapInArrow(_compare_batches(num, den), "a bigint, b bigint").distinct())

    # A class of many candidates is joined in parts.
    sides = classes.select("cls", "items")
    both = join_salted(found, sides.toDF("a", "x"), ["a"], found.groupBy("a").count(), "count")
    both = join_salted(both, sides.toDF("b", "y"), ["b"], found.groupBy("b").count(), "count")
    shared = F.size(F.array_intersect("x", "y"))
    confirmed = both.filter(shared * den >= (F.size("x") + F.size("y") - shared) * num).select("a", "b")
    return Classes(members, classes.select("cls", "items", "n"), materialise(confirmed))


def record_pairs(c: Classes) -> DataFrame:
    """(a, b), a < b: all pairs of records that reach the threshold, those of equal sets included. The result of n equal sets has
    n (n - 1) / 2 rows; record_groups states the same in one row per record, and is the form for large collections.

    The members of a large class are divided over many tasks."""
    m = materialise(c.members)
    sizes = c.classes.select("cls", "n")
    inside = join_salted(m.toDF("a", "cls"), m.toDF("b", "cls"), ["cls"], sizes, "n").filter("a < b").select("a", "b")
    left = materialise(join_salted(m.toDF("x", "cls"), c.pairs.toDF("cls", "other"), ["cls"], sizes, "n").select("x", F.col("other").alias("cls")))
    # A class stands here once for every record on the other side.
    ends = left.groupBy("cls").agg(F.count("*").alias("k")).join(sizes, "cls").select("cls", F.greatest("k", "n").alias("n"))
    across = join_salted(left, m.toDF("y", "cls"), ["cls"], ends, "n").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return inside.unionByName(across)


def record_groups(c: Classes) -> DataFrame:
    """(id, class_id, n_copies, n_links, group_id), one row per record: its class, the number of records in it, the number of
    records of other classes that reach the threshold with it, and its connected component, named by its smallest id."""
    both = c.pairs.unionByName(c.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(c.classes.select(F.col("cls").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("n_links"))
    group = components(c.pairs, "a", "b").toDF("a", "group_id")
    info = c.classes.select(F.col("cls").alias("a"), "n").join(links, "a", "left").join(group, "a", "left")
    info = info.select(F.col("a").alias("cls"), "n", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("group_id", "a").alias("group_id"))
    return join_counted(c.members, info, ["cls"], "n").select("id", F.col("cls").alias("class_id"), F.col("n").alias("n_copies"), "n_links", "group_id")
