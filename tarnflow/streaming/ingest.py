"""Incremental forms of the batch stages on Structured Streaming; an extension, resumed from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_new_files(spark: SparkSession, directory: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def deliveries_by_window(stream: DataFrame, time: str, lateness: str, width: str, keys: list[str]) -> DataFrame:
    """Deliveries and distinct items per window; rows later than lateness are left out, as the watermark says."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("item_id").alias("items"))


def without_redeliveries(stream: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """The first delivery of each key; keys are forgotten after lateness, which bounds the state."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there and stops; a later call goes on where this one ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
