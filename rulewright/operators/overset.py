"""Overset grids: component motion, hole cutting and interpolation to blanked cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import spatial

#: Cell states: solved, fringe of a hole (interpolated), blanked, blanked without a donor.
SOLVED, FRINGE, BLANK, ORPHAN = 0, 1, 2, 3


def move(cells: DataFrame, component: str, shift: tuple[float, float, float] = (0.0, 0.0, 0.0), axis: str | None = None, angle: float = 0.0) -> DataFrame:
    """Rigid motion of one component's centres: rotation about an axis (radians), then a shift.  cells: id, component, center."""
    import math

    c = F.col("center")
    turned = V.rotate(c, axis, math.cos(angle), math.sin(angle)) if axis else c
    moved = V.add(turned, V.vec(*shift))
    return cells.withColumn("center", F.when(F.col("component") == component, moved).otherwise(c))


def cut_holes(cells: DataFrame, neighbours: DataFrame, holes: dict[str, Column]) -> DataFrame:
    """Adds iblank.  ``holes`` has, per component, a predicate over x, y, z of the region its body takes from the
    others; a blanked cell beside a solved one is fringe.  neighbours: pairs (id, dst) in both directions."""
    flat = cells.select("*", *(F.col(f"center.{a}").alias(a) for a in spatial.AXES))
    inside = F.lit(False)
    for component, where in holes.items():
        inside = inside | ((F.col("component") != component) & where)
    flat = flat.withColumn("_hole", inside).drop(*spatial.AXES)
    solved = flat.where("NOT _hole").select(F.col("id").alias("dst"))
    edge = neighbours.join(solved, "dst", "left_semi").select("id").distinct().withColumn("_edge", F.lit(True))
    state = F.when(~F.col("_hole"), SOLVED).when(F.col("_edge"), FRINGE).otherwise(BLANK)
    return flat.join(edge, "id", "left").withColumn("iblank", state).drop("_hole", "_edge")


def interpolate_fringe(cells: DataFrame, value: str, h: float) -> DataFrame:
    """id, value, iblank for fringe cells: inverse-distance interpolation from solved cells of other components' grids within
    neighbouring search cells of size h; a fringe cell without donors becomes an orphan."""
    flat = cells.select("id", "component", "iblank", F.col(value).alias("value"), *(F.col(f"center.{a}").alias(a) for a in spatial.AXES))
    fringe = flat.where(F.col("iblank") == FRINGE)
    out = None
    for r in cells.select("component").distinct().collect():  # a handful of components
        got = spatial.interpolate(fringe.where(F.col("component") == r[0]), flat.where((F.col("component") != r[0]) & (F.col("iblank") == SOLVED)).select("id", "value", *spatial.AXES), h)
        out = got if out is None else out.unionByName(got)
    filled = fringe.select("id").join(out, "id", "left")
    return filled.withColumn("iblank", F.when(F.col("value").isNull(), ORPHAN).otherwise(FRINGE))
