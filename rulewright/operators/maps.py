"""Map algebra over (id, dst) and (id, pos, dst) DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def image(m: DataFrame, domain: DataFrame) -> DataFrame:
    """{m(i): i in domain} as a set of ids."""
    return m.join(domain.select("id"), "id", "left_semi").select(F.col("dst").alias("id")).distinct()


def preimage_any(m: DataFrame, codomain: DataFrame) -> DataFrame:
    """Entities with some image in ``codomain``."""
    return m.join(codomain.select(F.col("id").alias("dst")), "dst", "left_semi").select("id").distinct()


def preimage_all(m: DataFrame, codomain: DataFrame, domain: DataFrame | None = None) -> DataFrame:
    """Entities with every image in ``codomain``; of ``domain``, those with an empty list qualify too."""
    bad = m.join(codomain.select(F.col("id").alias("dst")), "dst", "left_anti").select("id")
    return (m if domain is None else domain).select("id").distinct().join(bad, "id", "left_anti")


def inverse(m: DataFrame, images: DataFrame | None = None, preimages: DataFrame | None = None) -> DataFrame:
    """(id, pos, dst) of the inverse, lists in the order of their members; optionally limited to sets."""
    pairs = m.select(F.col("dst").alias("id"), F.col("id").alias("dst"))
    if images is not None:
        pairs = pairs.join(images.select("id"), "id", "left_semi")
    if preimages is not None:
        pairs = pairs.join(preimages.select(F.col("id").alias("dst")), "dst", "left_semi")
    order = Window.partitionBy("id").orderBy("dst")
    return pairs.select("id", (F.row_number().over(order) - 1).alias("pos"), "dst")


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """second after first: (id, dst)."""
    return first.join(second.select(F.col("id").alias("dst"), F.col("dst").alias("_end")), "dst").select("id", F.col("_end").alias("dst"))


def flatten(mm: DataFrame) -> DataFrame:
    """The pairs of a multimap."""
    return mm.select("id", "dst")


def remove_identity(pairs: DataFrame) -> DataFrame:
    return pairs.where("id <> dst")


def join_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (a, b) with (k, a) in left and (k, b) in right, both as (id, dst)."""
    return left.select(F.col("id").alias("k"), F.col("dst").alias("a")).join(right.select(F.col("id").alias("k"), F.col("dst").alias("b")), "k").select("a", "b").distinct()


def to_multimap(pairs: DataFrame, order_by: str = "dst") -> DataFrame:
    return pairs.select("id", (F.row_number().over(Window.partitionBy("id").orderBy(order_by)) - 1).alias("pos"), "dst")


def mint(rows: DataFrame, top: int) -> DataFrame:
    """``rows`` with new ids after ``top``, without gaps.  Ids come from per-partition counts, so no task sees all rows."""
    from ..session import checkpoint

    fixed = checkpoint(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = {r["_part"]: r["count"] for r in fixed.groupBy("_part").count().collect()}  # a row per partition
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    start = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _before long")
    new = fixed.join(F.broadcast(start), "_part")  # a row per partition
    return new.withColumn("id", F.lit(top + 1) + F.col("_before") + (F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33))).drop("_part", "_at", "_before")


def add_pairs(*pairs: DataFrame) -> DataFrame:
    """Pair lists put together, as maps are before they become one multimap."""
    out = pairs[0].select("id", "dst")
    for p in pairs[1:]:
        out = out.unionByName(p.select("id", "dst"))
    return out
