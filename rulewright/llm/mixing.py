r"""Mixing sources to target token weights by hash-threshold histograms, in DataFrame operations only.

Every document gets a hash.  Sums of sizes by source and hash bucket show in which bucket a
source's budget ends; only that bucket is refined, level by level, until it holds one
hash.  A document is taken if its hash is at or below its source's threshold, so nothing is sorted and a
smaller budget takes a subset of a larger one.  Sources that need more than they have take
every document whole some times and the threshold decides on one more.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its own,
last in order; rows with equal doc_id share a hash and so a decision; rows without doc_id
likewise; an empty table gives an empty result.  Extra columns, whatever their names, are ignored by ``plan`` and carried by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, spread

#: Bits of the hash per histogram level, and in all.
LEVEL_BITS, HASH_BITS = 9, 63
WEIGHTS = (1.0, 2.0, 3.0)
#: No source is repeated more often.
MOST = 3


def words_in(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\f\r", "     "), " ")
    return F.size(F.array_remove(parts, "")).cast("long")


def hash_of(doc_id: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("mix")), 64 - HASH_BITS)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> with target: weights repeat over the sources in code point order; targets share
    all sizes; a source stops at ``most`` times its size and the excess is shared by weight among the rest.
    In the order of size over weight the stopped sources come first, so one running sum finds the level."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", "w", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("stopped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # If this source and all after it are unstopped, they share what the stopped ones leave.
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.col("stopped")) / F.col("left"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return s.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _thresholds(rows: DataFrame, goal: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size, target, full, threshold: a document is taken ``full`` times, and once more if its hash <= threshold."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    state = goal.withColumn("full", full).withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
    state = scratch.stash(state.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(-1).cast("long").alias("threshold"), (F.col("budget") > 0).alias("open")), "state")
    for level in range(HASH_BITS // LEVEL_BITS):
        if not state.where("open").limit(1).count():
            break
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        now = state.where("open").select(F.col("source").alias("s"), "prefix", "budget")
        inside = rows.join(now, rows["source"].eqNullSafe(now["s"]) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("tokens"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("budget").alias("budget"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("tokens").over(run)).withColumn("below", F.col("upto") - F.col("tokens"))
        # The first bucket that passes the budget is the boundary; if it holds one hash, the nearer side wins.
        cross = hist.where("upto > budget").groupBy("source").agg(F.min(F.struct("bucket", "below", "tokens", "lo", "hi", "budget")).alias("b")).select(F.col("source").alias("s"), "b.*")
        joined = state.drop("budget").join(cross, state["source"].eqNullSafe(cross["s"]), "left").join(state.select(F.col("source").alias("s2"), F.col("budget").alias("budget0")), state["source"].eqNullSafe(F.col("s2")))
        one, took = F.col("lo") == F.col("hi"), F.col("budget0") - F.col("below") >= F.col("tokens") / 2
        was = F.col("open")
        state = scratch.stash(joined.select(
            "source", "source_size", "target", "full",
            F.when(was & F.col("bucket").isNotNull(), F.col("budget0") - F.col("below")).otherwise(F.col("budget0")).alias("budget"),
            F.when(was & F.col("bucket").isNotNull(), F.col("bucket")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(was & F.col("bucket").isNull(), F.lit(2**HASH_BITS - 1)).when(was & one, F.when(took, F.col("hi")).otherwise(F.col("lo") - 1)).otherwise(F.col("threshold")).alias("threshold"),
            (was & F.col("bucket").isNotNull() & ~one).alias("open"),
        ), "state")
    return state.select(F.col("source").alias("_source"), "source_size", "target", "full", "threshold")


def plan(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), copies, taken: a row per row of ``docs``."""
    rows = scratch.stash(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h")), "sizes")
    goal = scratch.stash(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    at = _thresholds(rows, goal, scratch)
    out = rows.join(at, rows["source"].eqNullSafe(at["_source"]))
    copies = F.col("full") + (F.col("h") <= F.col("threshold")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` the mix takes, each as often as it is taken."""
    rows = scratch.stash(docs.select("source", words_in(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h")), "sizes")
    goal = scratch.stash(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    at = _thresholds(rows, goal, scratch)
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["source"].alias("s"), hash_of(docs["doc_id"]).alias("h"))
    taken = held.join(at, held["s"].eqNullSafe(at["_source"])).withColumn("copies", (F.col("full") + (F.col("h") <= F.col("threshold")).cast("long")).cast("int")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return plan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), Scratch(spark)).select("doc_id", "size", "source_size", "target", "taken")
