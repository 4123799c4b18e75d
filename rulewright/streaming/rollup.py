"""Structured Streaming over a file source: running counts and sums per key, as one available-now batch or continuously."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rollup_stream(spark: SparkSession, path: str) -> DataFrame:
    """The streaming DataFrame user_id, n, total over the event files of ``path`` (a file or a folder)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder if name.endswith(".parquet") else path)
    return stream.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def rollup_once(spark: SparkSession, path: str) -> DataFrame:
    """The rollup of what there is now."""
    out = f"rollup_{uuid.uuid4().hex}"
    rollup_stream(spark, path).writeStream.format("memory").queryName(out).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(out)


def windowed(spark: SparkSession, stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling windows over event time with a watermark for late rows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
