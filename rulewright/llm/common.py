"""Shared plumbing of the training-data operators: scratch tables in the shared
folder, grouped Arrow streams, splitting of large groups, connected components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes and rows of one Arrow batch, so that long texts keep a worker's memory bounded.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 2000
#: Spark's setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Only where that is unset, as in tests, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="rulewright-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def spread(rows: DataFrame) -> DataFrame:
    """A table as read, dealt out anew only if it has fewer partitions than the cluster has cores, as one small file has."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that none needs it installed."""
    sc, here = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(sc, "_rulewright_shipped", False) or not here.is_dir():
        return
    sc._rulewright_shipped = True
    at = Path(tempfile.mkdtemp(prefix="rulewright-")) / "rulewright-package.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(at))


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def trimmed(run):
    """``run`` over batches; afterwards the worker, which Spark keeps, hands its free memory back to the system."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return body


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_dir(spark)}/rulewright-{uuid.uuid4().hex}"
        bound_batches(spark)
        self.n = 0
        root = spark._jvm.org.apache.hadoop.fs.Path(self.at)
        root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)  # results may be read until the driver ends

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the written table.  The shuffle files of the writing job go when it ends, for nothing reads them again."""
        self.n += 1
        path = f"{self.at}/{self.n:02d}-{name}"
        was = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if was is None else self.spark.conf.set(CLEANUP, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict, list[tuple[int, int]]]]:
    """Splits a stream sorted by ``keys`` (non-null longs) at key changes.  Yields
    tables of whole groups as a dict of columns (numpy for numbers, else lists of
    Python values) and the groups' [start, end) bounds; a group that a batch cuts is carried over."""
    rest: pa.Table | None = None

    def cut(table: pa.Table):
        cols = {}
        for f in table.schema:
            c = table.column(f.name).combine_chunks()
            c = c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)
            cols[f.name] = c.to_pylist() if pa.types.is_binary(f.type) or pa.types.is_large_binary(f.type) or pa.types.is_string(f.type) else c.to_numpy(zero_copy_only=False)
        change = np.zeros(len(table), bool)
        change[:1] = True
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        at = np.flatnonzero(change)
        return cols, list(zip(at.tolist(), [*at[1:].tolist(), len(table)], strict=True))

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        first = [t.column(k)[len(t) - 1].as_py() for k in keys]
        same = np.ones(len(t), bool)
        for k, v in zip(keys, first, strict=True):
            same &= t.column(k).to_numpy() == v
        start = int(np.flatnonzero(same)[0])
        rest = t.slice(start)
        if start:
            yield cut(t.slice(0, start))
    if rest is not None and len(rest):
        yield cut(rest)


def split_blocks(rows: DataFrame, bucket: str, node: str, scratch: Scratch, block: int) -> DataFrame:
    """Deals the rows of each bucket into block pairs of at most ``block`` rows a side, so
    that one task never holds a whole large bucket.  Adds longs bi, bj (the block pair) and boolean
    left (row belongs to block bi); within a pair (i, i) every row is left.  Rows sharing a bucket
    meet in exactly one pair.  Buckets of one row are dropped."""
    sizes = scratch.stash(rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(bucket, F.ceil(F.col("_n") / block).cast("long").alias("_nb")), "sizes")
    own = F.pmod(F.xxhash64(F.col(node), F.lit(7)), F.col("_nb"))
    dealt = rows.join(sizes, bucket).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    return dealt.select(*rows.columns, F.least("_own", "_other").alias("bi"), F.greatest("_own", "_other").alias("bj"), (F.col("_own") <= F.col("_other")).alias("left"))


#: A key is hot if it has more rows than this share of all and than so many; by count there are fewer hot keys than HOT.
HOT, HOT_LEAST = 200, 1000


def hot_join(rows: DataFrame, unique: DataFrame, key: str, n: str = "_n") -> DataFrame:
    """Inner join of ``rows`` to ``unique``, which has one row per key and in ``n`` the key's number of rows.  Hot
    keys, fewer than HOT, meet their rows where these lie, by a broadcast of proven size; the rest are shuffled."""
    total = unique.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(total / HOT, HOT_LEAST)
    if not unique.where(hot).limit(1).count():
        return rows.join(unique.drop(n), key)
    few, rest = F.broadcast(unique.where(hot).drop(n)), unique.where(~hot).drop(n)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(unique.where(hot).select(key)), key, "left_anti").join(rest, key))


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star; the centres of large stars are hot keys.

    ``edges`` has longs ``a``, ``b``.  Returns ``node``, ``component`` (its smallest
    reachable node), a row per node of an edge.  A node's smallest neighbour comes from a
    pre-aggregated minimum that is joined back, so no neighbour list is ever collected."""
    now = scratch.stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = scratch.stash(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("a", "m")), "least")
        j = hot_join(both, least, "a")
        if large:
            new = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return new.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    mark = None
    for _ in range(rounds):
        old = now
        now = scratch.stash(stars(scratch.stash(stars(now, True), "large"), False), "small")
        new_mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == new_mark:
            break
        mark = new_mark
        scratch.drop(old)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
