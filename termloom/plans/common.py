"""Helpers for plans that must not gather unbounded data in one place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def shared_path(spark, name: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark, path: str) -> bool:
    """Whether a table has been written there to its end."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: a durable cut of the lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for at most ``limit`` rows; beyond it the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def own_names(*names: str) -> list[str]:
    """Column names that no input has."""
    return [f"{n}_{uuid.uuid4().hex}" for n in names]


def numbered(df: DataFrame, *order) -> DataFrame:
    """Adds ``row`` (from 1) in a total order, without a window over all rows.

    A range-partitioned sort is written once; a row's number is its place in its partition plus the
    sizes of the partitions before it, of which there is one row each.
    """
    at, part, n, start = own_names("at", "part", "n", "start")
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(spread.withColumn(at, F.monotonically_increasing_id()), "numbered").withColumn(part, F.shiftright(at, 33))
    sizes = placed.groupBy(part).agg(F.count("*").alias(n))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    out = placed.join(F.broadcast(starts), part)  # one row a partition
    return out.withColumn("row", F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(at, part, start)


def running_sums(df: DataFrame, key: str, columns: dict[str, str], block: int = 65_536) -> DataFrame:
    """Running sums along a unique integer key, in two levels: within blocks of keys, then over blocks.

    Keys may be sparse: blocks are of rows, after ``numbered`` where the keys span more than twice the rows.
    """
    low, high, rows = df.agg(F.min(key), F.max(key), F.count("*")).first()
    place, number = key, None
    if rows and high - low + 1 > 2 * rows + block:
        (number,) = own_names("place")
        df = numbered(df, F.col(key)).withColumnRenamed("row", number)
        place = number
    at, *names = own_names("block", *columns)
    blocked = df.withColumn(at, F.floor(F.col(place) / block))
    totals = blocked.groupBy(at).agg(*[F.sum(c).alias(n) for c, n in zip(columns, names)])
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(at, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names])
    within = Window.partitionBy(at).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(small_or_shuffled(starts), at)
    for (c, name), n in zip(columns.items(), names):
        out = out.withColumn(name, F.col(n) + F.sum(c).over(within))
    return out.drop(at, *names, *([number] if number else []))
