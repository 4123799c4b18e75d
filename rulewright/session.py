"""Session builder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def start(master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and skew joins on; further settings by keyword, dots as underscores doubled (``spark__sql__shuffle__partitions``)."""
    b = SparkSession.builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession, name: str = "table") -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors share; where that setting is unset, as in tests, in
    a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="rulewright-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get()
    return f"{at}/rulewright-{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the shared folder, which survives lost executors, gives the next plan
    exact sizes, and goes when the driver ends."""
    spark = df.sparkSession
    path = checkpoint_dir(spark)
    df.write.parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
    return spark.read.schema(df.schema).parquet(path)
