"""Reduction operators: an identity, a built-in aggregate, and how a result joins the identity.

Each operator aggregates with partial (map-side) combination; float sums are order dependent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reduction:
    name: str
    identity: Any
    aggregate: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]


Summation = Reduction("Summation", 0, F.sum, lambda a, b: a + b)
Product = Reduction("Product", 1, F.product, lambda a, b: a * b)
Maximum = Reduction("Maximum", None, F.max, F.greatest)
Minimum = Reduction("Minimum", None, F.min, F.least)
LogicalOr = Reduction("LogicalOr", False, F.bool_or, lambda a, b: a | b)
LogicalAnd = Reduction("LogicalAnd", True, F.bool_and, lambda a, b: a & b)
SetUnion = Reduction("SetUnion", None, lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_set(x)))), lambda a, b: F.array_sort(F.array_union(a, b)))
Append = Reduction("Append", None, lambda x: F.array_sort(F.collect_list(x)), lambda a, b: F.concat(a, b))
MaxMin = Reduction("MaxMin", None, lambda x: F.struct(F.max(x).alias("max"), F.min(x).alias("min")), lambda a, b: F.struct(F.greatest(a["max"], b["max"]).alias("max"), F.least(a["min"], b["min"]).alias("min")))
SumMaxMin = Reduction("SumMaxMin", None, lambda x: F.struct(F.sum(x).alias("sum"), F.max(x).alias("max"), F.min(x).alias("min")), lambda a, b: F.struct((a["sum"] + b["sum"]).alias("sum"), F.greatest(a["max"], b["max"]).alias("max"), F.least(a["min"], b["min"]).alias("min")))
MaxMagnitude = Reduction("MaxMagnitude", 0.0, lambda x: F.max_by(x, F.struct(F.abs(x), x)), lambda a, b: F.when(F.abs(b) > F.abs(a), b).otherwise(a))


def _axes(f) -> Callable:
    """A function of one or two numbers, applied to the components of vectors."""
    return lambda *v: F.struct(*(f(*(x[k] for x in v)).alias(k) for k in "xyz"))


#: Operators on vectors (struct x, y, z), component by component.
SumVector = Reduction("SumVector", None, _axes(F.sum), _axes(lambda a, b: a + b))
MaxVector = Reduction("MaxVector", None, _axes(F.max), _axes(F.greatest))
MinVector = Reduction("MinVector", None, _axes(F.min), _axes(F.least))
MaxMinVector = Reduction("MaxMinVector", None, lambda x: F.struct(MaxVector.aggregate(x).alias("max"), MinVector.aggregate(x).alias("min")), lambda a, b: F.struct(MaxVector.join(a["max"], b["max"]).alias("max"), MinVector.join(a["min"], b["min"]).alias("min")))
SumMaxMinVector = Reduction("SumMaxMinVector", None, lambda x: F.struct(SumVector.aggregate(x).alias("sum"), MaxVector.aggregate(x).alias("max"), MinVector.aggregate(x).alias("min")), lambda a, b: F.struct(SumVector.join(a["sum"], b["sum"]).alias("sum"), MaxVector.join(a["max"], b["max"]).alias("max"), MinVector.join(a["min"], b["min"]).alias("min")))


def _refuse(*_):
    raise TypeError("NullOp never joins: it is for side-effecting rules")


NullOp = Reduction("NullOp", None, _refuse, _refuse)
OPERATORS = {r.name: r for r in (Summation, Product, Maximum, Minimum, LogicalOr, LogicalAnd, SetUnion, Append, MaxMin, SumMaxMin, MaxMagnitude, SumVector, MaxVector, MinVector, MaxMinVector, SumMaxMinVector, NullOp)}


def reduce_to(contributions: DataFrame, units: DataFrame, op: Reduction) -> DataFrame:
    """(id, value): each unit row joined with what was contributed to it.  ``contributions`` has dst and value;
    entities without a unit get nothing, units without contributions keep their value."""
    got = contributions.groupBy("dst").agg(op.aggregate(F.col("value")).alias("_got"))
    out = units.join(got, units["id"] == got["dst"], "left")
    return out.select("id", F.when(F.col("_got").isNull(), F.col("value")).otherwise(op.join(F.col("value"), F.col("_got"))).alias("value"))


def reduce_global(contributions: DataFrame, ops: dict[str, tuple[str, Reduction]]) -> DataFrame:
    """One pass over a frame for several params: {param: (column, operator)}."""
    return contributions.agg(*(op.aggregate(F.col(c)).alias(name) for name, (c, op) in ops.items()))


def elementwise(df: DataFrame, key: str, array: str, op: Reduction) -> DataFrame:
    """Reduction of arrays position by position: key, value (array)."""
    flat = df.select(key, F.posexplode(array).alias("pos", "x")).groupBy(key, "pos").agg(op.aggregate(F.col("x")).alias("x"))
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("value"))
