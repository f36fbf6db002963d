"""Helpers that keep plans safe on large and skewed data.

Nothing here collects rows that grow with the input: broadcasts are bounded by
construction, hot join keys are split by adaptive execution, and ranks over a whole table are built
from range partitions instead of one sorted task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

# A table proven to be no larger than this may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
NARROW_ROW_BYTES = 100
# How tables are written that lie beside others for long; a fifth to a third less than the default.
COMPACT = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
# Whether what an SQL execution has shuffled is deleted as it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from `spark.checkpoint.dir`.

    Only a local session may leave it unset; it then gets a folder of its own.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(set_dir)
        return set_dir
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="nearfold-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared one that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table, computed once and read back from the shared folder, and its path there; see `removed`."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**COMPACT).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it, what an action has shuffled leaves the disk as the action ends; otherwise
    it stays until the driver happens to collect its garbage. Cached tables keep theirs."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


def stable(df: DataFrame) -> DataFrame:
    """Checkpoint: computed once, readable after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fits_broadcast(max_rows: int | None, row_bytes: int = NARROW_ROW_BYTES) -> bool:
    return max_rows is not None and max_rows * row_bytes <= BROADCAST_BYTES


def bounded_broadcast(
    df: DataFrame, max_rows: int | None, row_bytes: int = NARROW_ROW_BYTES
) -> DataFrame:
    """Broadcast `df` when its caller proves it holds at most `max_rows` such rows.

    Above the limit the join strategy is left to the size Spark measures.
    """
    return F.broadcast(df) if fits_broadcast(max_rows, row_bytes) else df


def skewed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join where a few `key` values may hold a large share of `left`.

    Both sides are shuffled once and each is evaluated once. Adaptive execution sees
    the size of every partition, cuts the oversized ones of `left` into tasks and gives each its
    copy of the matching right rows, for any number of hot keys.
    """
    spark = left.sparkSession
    for switch in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"):
        if spark.conf.get(switch) != "true":
            raise RuntimeError(f"skewed joins rely on {switch}")
    return left.join(right, key, how)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    max_rows: int | None,
    how: str = "inner",
    row_bytes: int = NARROW_ROW_BYTES,
) -> DataFrame:
    """Broadcast a lookup table that is proven small; otherwise leave hot keys to adaptive execution."""
    if fits_broadcast(max_rows, row_bytes):
        return left.join(F.broadcast(right), key, how)
    return skewed_join(left, right, key, how)


def with_offsets(
    df: DataFrame, order: list[str], weight: Column | None = None, name: str = "offset"
) -> DataFrame:
    """Add the sum of `weight` (1: the row number from 0) over all earlier rows.

    `order` must be unique. Rows are range-partitioned and materialised, each
    range is summed on its own, and the ranges are joined through one row each.
    """
    weight = F.lit(1) if weight is None else weight
    ranged = stable(
        df.withColumn("__w", weight.cast("long"))
        .repartitionByRange(*order)
        .withColumn("__range", F.spark_partition_id())
    )
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("__range")
        .agg(F.sum("__w").alias("__total"))
        .select("__range", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__start"))
    )
    before = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.withColumn("__before", F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .join(F.broadcast(starts), "__range")
        .withColumn(name, (F.col("__start") + F.col("__before")).cast("long"))
        .drop("__w", "__range", "__start", "__before")
    )


def exact_quantiles(df: DataFrame, column: str, probs: list[float]) -> DataFrame:
    """One row `quantiles ARRAY<DOUBLE>`: exact, linearly interpolated.

    Values are counted first, so a value held by most rows costs one row; the
    ranks are then read off running counts.
    """
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    placed = with_offsets(counted, ["__v"], F.col("__n"), "__from")
    last = placed.select(F.sum("__n") - 1).scalar()

    def at(rank: Column) -> Column:
        here = (F.col("__from") <= rank) & (rank < F.col("__from") + F.col("__n"))
        return F.max(F.when(here, F.col("__v")))

    points = []
    for p in probs:
        target = last * F.lit(float(p))
        low = at(F.floor(target))
        points.append(low + (at(F.ceil(target)) - low) * F.max(target - F.floor(target)))
    return placed.agg(F.array(*points).alias("quantiles"))


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
