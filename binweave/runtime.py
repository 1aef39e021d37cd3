"""Session helpers: sessions for tests and benches, shared scratch space, lineage cuts and heavy-hitter joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that is given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("binweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only where it is unset on a local master, a temporary one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor shares")
    made = tempfile.mkdtemp(prefix="binweave-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


_WRITTEN: list[str] = []


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write df once as a compressed table in the shared folder and read it back: cuts lineage and survives lost executors.
    options: of the writer."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that materialise wrote in this session, once their results are no longer needed."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_safe(keys: list[str], a: str = "a", b: str = "b") -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


#: A key is heavy if it holds at least one HEAVY-th of all rows; so there are at most HEAVY heavy keys, whatever the data.
HEAVY = 1000
#: Keys of fewer rows are never heavy.
FEW = 1000


def _no_heavy_key(sizes: DataFrame, count: str, heavy: int) -> bool:
    most = sizes.agg(F.max(F.col(count)), F.sum(F.col(count))).first()
    return not most[0] or most[0] <= FEW or most[0] * heavy < most[1]


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, heavy: int = HEAVY) -> DataFrame:
    """Inner join of rows with one narrow row per key in groups (which has the key's number of rows in column count).

    Heavy keys are joined by broadcasting their at most `heavy` group rows; all others are shuffled, where a key holds
    less than one `heavy`-th of the rows. No row is replicated or dropped. Null keys never join.
    """
    if _no_heavy_key(groups, count, heavy):
        return rows.join(groups, keys)
    total = groups.agg(F.sum(count)).first()[0]
    is_heavy = (F.col(count) * heavy >= F.lit(total)) & (F.col(count) > FEW)
    many = groups.filter(is_heavy).select(*groups.columns)
    hot = rows.join(F.broadcast(many), keys)
    cold = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(groups.filter(~is_heavy), keys)
    return hot.unionByName(cold)


def join_salted(rows: DataFrame, groups: DataFrame, keys: list[str], sizes: DataFrame, count: str, heavy: int = HEAVY, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with groups by keys, where sizes has the number of rows of every key in column count.

    The rows of a heavy key are divided by a hash of the whole row into parts of at most one `heavy`-th of all rows, and its
    group rows are repeated for each part: at most 2 x `heavy` parts in all. Only the heavy keys are broadcast, so group
    rows may be of any size and number. Null keys never join, and stay whole with how='left'.
    """
    if _no_heavy_key(sizes, count, heavy):
        return rows.join(groups, keys, how)
    part = max(sizes.agg(F.sum(count)).first()[0] // heavy, FEW)
    big = F.broadcast(sizes.filter(F.col(count) > part).select(*keys, F.ceil(F.col(count) / part).cast("int").alias("_parts")))
    own = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.col("_parts")).cast("int")).otherwise(0)
    a = rows.join(big, keys, "left").withColumn("_part", own).drop("_parts")
    b = groups.join(big, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return a.join(b, [*keys, "_part"], how).drop("_part")
