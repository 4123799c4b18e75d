"""Entity sets: a driver-side interval algebra with symbolic complements, and the same operations on DataFrames of ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOW, HIGH = -(2**63), 2**63 - 1


def _normal(parts: Iterable[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    out: list[list[int]] = []
    for a, b in sorted((a, b) for a, b in parts if a <= b):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return tuple((a, b) for a, b in out)


@dataclass(frozen=True)
class EntitySet:
    """Ordered disjoint closed intervals; LOW and HIGH bound the universe, so a complement stays an interval list."""

    parts: tuple[tuple[int, int], ...] = ()

    @staticmethod
    def of(*items: int | tuple[int, int]) -> EntitySet:
        return EntitySet(_normal((i, i) if isinstance(i, int) else i for i in items))

    def __or__(self, o: EntitySet) -> EntitySet:
        return EntitySet(_normal((*self.parts, *o.parts)))

    __add__ = __or__

    def __and__(self, o: EntitySet) -> EntitySet:
        out, i, j = [], 0, 0
        while i < len(self.parts) and j < len(o.parts):
            (a, b), (c, d) = self.parts[i], o.parts[j]
            out.append((max(a, c), min(b, d)))
            i, j = (i + 1, j) if b < d else (i, j + 1)
        return EntitySet(_normal(out))

    def __invert__(self) -> EntitySet:
        out, at = [], LOW
        for a, b in self.parts:
            out.append((at, a - 1))
            at = b + 1
        return EntitySet(_normal([*out, (at, HIGH)]))

    def __sub__(self, o: EntitySet) -> EntitySet:
        return self & ~o

    def __xor__(self, o: EntitySet) -> EntitySet:
        return (self - o) | (o - self)

    def __lshift__(self, k: int) -> EntitySet:
        return EntitySet(tuple((a - k, b - k) for a, b in self.parts))

    def __rshift__(self, k: int) -> EntitySet:
        return self << -k

    def __le__(self, o: EntitySet) -> bool:
        return not (self - o).parts

    def __lt__(self, o: EntitySet) -> bool:
        return self <= o and self != o

    def __contains__(self, i: int) -> bool:
        return any(a <= i <= b for a, b in self.parts)

    def __len__(self) -> int:
        return sum(b - a + 1 for a, b in self.parts)

    def __bool__(self) -> bool:
        return bool(self.parts)

    def __iter__(self) -> Iterator[int]:
        for a, b in self.parts:
            yield from range(a, b + 1)

    @property
    def num_intervals(self) -> int:
        return len(self.parts)

    @property
    def min(self) -> int:
        return self.parts[0][0]

    @property
    def max(self) -> int:
        return self.parts[-1][1]

    def df(self, spark: SparkSession) -> DataFrame:
        out = spark.range(0).toDF("id")
        for a, b in self.parts:
            if a == LOW or b == HIGH:
                raise ValueError("an unbounded set stays symbolic; intersect it with a key space first")
            out = out.unionByName(spark.range(a, b + 1).toDF("id"))
        return out


EMPTY, UNIVERSE = EntitySet(), EntitySet(((LOW, HIGH),))


@dataclass(frozen=True)
class Sequence:
    """An ordered list of ids, duplicates kept."""

    ids: tuple[int, ...] = ()

    def __add__(self, o: Sequence) -> Sequence:
        return Sequence(self.ids + o.ids)

    def reverse(self) -> Sequence:
        return Sequence(self.ids[::-1])

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.ids)), "pos long, id long")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return difference(a, b).unionByName(difference(b, a))


def complement(a: DataFrame, universe: DataFrame) -> DataFrame:
    return difference(universe, a)


def shift(a: DataFrame, k: int) -> DataFrame:
    return a.select((F.col("id") + k).alias("id"))


def intervals(a: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(low, high): the maximal runs of consecutive ids.  Runs are found inside id ranges of ``width``; only runs
    that touch a range's edge, at most two a range, are then joined in order, so no task sees more than a range or those."""
    cell = F.floor(F.col("id") / width)
    run = F.col("id") - F.row_number().over(Window.partitionBy(cell).orderBy("id"))
    local = a.select("id").distinct().select("id", cell.alias("cell"), run.alias("run")).groupBy("cell", "run").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    at_edge = (F.pmod("low", F.lit(width)) == 0) | (F.pmod("high", F.lit(width)) == width - 1)
    order = Window.orderBy("low")
    starts = local.where(at_edge).withColumn("new", (F.coalesce(F.lag("high").over(order) + 1 < F.col("low"), F.lit(True))).cast("long"))
    joined = starts.withColumn("group", F.sum("new").over(order)).groupBy("group").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("group")
    return local.where(~at_edge).select("low", "high").unionByName(joined)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether a is a subset and a superset of b."""
    x, y = (d.select("id").distinct().withColumn(n, F.lit(True)) for d, n in ((a, "_a"), (b, "_b")))
    j = x.join(y, "id", "full_outer")
    return j.agg(F.coalesce(F.bool_and(F.col("_a").isNull() | F.col("_b").isNotNull()), F.lit(True)).alias("subset"), F.coalesce(F.bool_and(F.col("_b").isNull() | F.col("_a").isNotNull()), F.lit(True)).alias("superset"))


def describe(a: DataFrame) -> DataFrame:
    """One row: size, low and high of a set."""
    return a.select("id").distinct().agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.max("id").alias("high"))
