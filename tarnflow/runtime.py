"""Session helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where that is unset a temporary one is made, but only on a local master: a
    folder of one machine can't be read by executors on others. Set spark.cleaner.referenceTracking.cleanCheckpoints to have
    checkpoints deleted with the results that read them."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tarnflow-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the checkpoint folder and cuts its lineage, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, bound: int, what: str) -> list:
    """Rows of a table that must be small; more than bound rows is an error, never a truncation."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows; raise the bound only if the driver can hold them")
    return rows


def small(df: DataFrame, bound: int = 100_000) -> DataFrame:
    """df to be broadcast if it has at most bound rows, else as it is, to be joined by shuffle; df should be cheap to count."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def shuffled(df: DataFrame) -> DataFrame:
    """df to be joined by shuffle. Spark's guess of a size knows nothing of what explode or an Arrow function makes of a row, or of how far a
    file was compressed, so without this a table that grows with the input may be sent to the driver and broadcast."""
    return df.hint("merge")


def shuffle_width(df: DataFrame) -> int:
    """Partitions an explicit repartition should use: the session's setting, at least the cluster's parallelism."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with its 0-based position in order, without sorting it in one task.

    Rows are split by ranges of order and numbered within; only one count per range is summed up in order.
    """
    parts = shuffle_width(df)
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")  # one row per range


def running(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before each in order, without sorting it in one task; order should be total.

    Rows are split by ranges of order and summed within; only one sum per range is added up in order.
    """
    placed = df.repartitionByRange(shuffle_width(df), *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    sums = placed.groupBy("__part").agg(F.sum(value).alias("__n"))
    before = sums.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("__in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inside.join(F.broadcast(before), "__part").withColumn(name, F.col("__base") + F.col("__in")).drop("__part", "__at", "__base", "__in")  # one row per range
