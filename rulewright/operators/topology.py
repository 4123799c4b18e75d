"""Mesh topology: faces from element cells, ghost cells and surfaces, edges, stencils, node neighbourhoods, periodic pairs.

All are joins on ids or on sorted node lists and pre-aggregated sums; nothing holds a mesh in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import order
from .mesh import Mesh, barth, sides, with_cells

#: The faces of element cells by local nodes, each seen from outside.
ELEMENTS = {
    "tet": ((0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)),
    "pyramid": ((0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)),
    "prism": ((0, 2, 1), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5)),
    "hex": ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)),
}


def from_cells(pos: DataFrame, cells: DataFrame, boundary: DataFrame | None = None) -> Mesh:
    """A face mesh of element cells (id, type, nodes): faces with the same nodes are one, its normal out of the cell with the
    smaller id.  ``boundary`` (nodes, surface) names faces of one cell, others are called "boundary"; a face of three cells
    or of one cell twice is an error."""
    at = lambda ring: F.array(*(F.get("nodes", F.lit(i)) for i in ring))
    faces = None
    for kind, rings in ELEMENTS.items():
        one = cells.where(F.col("type") == kind).select(F.col("id").alias("cell"), F.explode(F.array(*(F.struct(at(r).alias("ring")) for r in rings))).alias("f"))
        faces = one if faces is None else faces.unionByName(one)
    faces = faces.select("cell", F.col("f.ring").cast("array<long>").alias("ring")).withColumn("key", F.array_sort("ring"))
    met = faces.groupBy("key").agg(F.min("cell").alias("cl"), F.max("cell").alias("last"), F.min_by("ring", "cell").alias("ring"), F.count(F.lit(1)).alias("n"))
    wrong = F.raise_error(F.concat(F.lit("a face of more than two cells or of one cell twice: nodes "), F.array_join(F.col("key").cast("array<string>"), " ")))
    met = met.withColumn("cr", F.when(F.col("n") == 1, F.lit(None)).when((F.col("n") == 2) & (F.col("cl") != F.col("last")), F.col("last")).otherwise(wrong.cast("long")))
    name = F.lit("boundary")
    if boundary is not None:
        met = met.join(boundary.select(F.array_sort(F.col("nodes").cast("array<long>")).alias("key"), F.col("surface").cast("string").alias("_surface")), "key", "left")
        name = F.coalesce("_surface", name)
    met = order.ranks(met.withColumn("boundary", F.when(F.col("cr").isNull(), name)), "cl", "key").withColumn("id", F.col("rank") - 1)
    return Mesh(pos, met.select("id", F.posexplode("ring").alias("pos", "dst")), met.select("id", "cl", "cr", "boundary"))


def setup(mesh: Mesh) -> dict[str, DataFrame]:
    """The derived topology of a mesh, by name: cl and cr as maps (cr of a boundary face is its ghost cell), ci (boundary face to inner
    cell), ref (boundary face to surface), surfaces (id, name), and the sets geom_cells, ghost_cells, interior_faces, boundary_faces.  Ghost ids follow the cells'."""
    f = mesh.faces
    geom = sides(f).select(F.col("cell").alias("id")).distinct()
    top = geom.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    edge = order.ranks(f.where("cr IS NULL"), "id").crossJoin(F.broadcast(top)).withColumn("ghost", F.col("top") + F.col("rank"))  # one row
    surfaces = order.ranks(f.where("cr IS NULL").select(F.col("boundary").alias("name")).distinct(), "name").select((F.col("rank") - 1).alias("id"), "name")
    return {
        "cl": f.select("id", F.col("cl").alias("dst")),
        "cr": f.where("cr IS NOT NULL").select("id", F.col("cr").alias("dst")).unionByName(edge.select("id", F.col("ghost").alias("dst"))),
        "ci": edge.select("id", F.col("cl").alias("dst")),
        "ref": edge.select("id", "boundary").join(surfaces.select(F.col("id").alias("dst"), F.col("name").alias("boundary")), "boundary").select("id", "dst"),
        "surfaces": surfaces, "geom_cells": geom, "ghost_cells": edge.select(F.col("ghost").alias("id")),
        "interior_faces": f.where("cr IS NOT NULL").select("id"), "boundary_faces": edge.select("id"),
    }


def edges(mesh: Mesh) -> tuple[DataFrame, DataFrame]:
    """(edge2node: id, a, b with a < b; face2edge: id, pos, dst, along), along +1 where the face runs from a to b."""
    n = mesh.face_nodes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("r"))
    ring = n.select("id", F.posexplode("r").alias("pos", "s"), F.size("r").alias("k"), "r").select("id", "pos", F.col("s.dst").alias("from"), F.get("r", (F.col("pos") + 1) % F.col("k"))["dst"].alias("to"))
    ring = ring.select("id", "pos", F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b"), F.when(F.col("from") < F.col("to"), 1).otherwise(-1).alias("along"))
    edge = order.ranks(ring.select("a", "b").distinct(), "a", "b").select((F.col("rank") - 1).alias("id"), "a", "b")
    return edge, ring.join(edge.withColumnRenamed("id", "dst"), ["a", "b"]).select("id", "pos", "dst", "along")


def cell_nodes(mesh: Mesh) -> DataFrame:
    """(id of the cell, dst = node), each once."""
    return sides(mesh.faces).select(F.col("id").alias("face"), "cell").join(mesh.face_nodes.select(F.col("id").alias("face"), "dst"), "face").select(F.col("cell").alias("id"), "dst").distinct()


def cell_stencil(mesh: Mesh) -> DataFrame:
    """(id, dst): cells that share a node with a cell, itself left out."""
    c = cell_nodes(mesh)
    return c.join(c.select(F.col("id").alias("other"), "dst"), "dst").where("id <> other").select("id", F.col("other").alias("dst")).distinct()


def node_range(mesh: Mesh, cells: DataFrame, value: str) -> DataFrame:
    """id (node), qmax, qmin over the cells around it."""
    c = cell_nodes(mesh).join(cells.select("id", F.col(value).alias("q")), "id")
    return c.groupBy(F.col("dst").alias("id")).agg(F.max("q").alias("qmax"), F.min("q").alias("qmin"))


def mlp_limiter(mesh: Mesh, cells: DataFrame, value: str, grad: str) -> DataFrame:
    """id, limiter: the least over a cell's nodes of how far the extrapolation to the node may go inside the range of the node's cells."""
    at = mesh.pos.select(F.col("id").alias("dst"), F.struct("x", "y", "z").alias("_p")).join(node_range(mesh, cells, value).withColumnRenamed("id", "dst"), "dst")
    j = cell_nodes(mesh).join(at, "dst").join(cells.select("id", F.col(value).alias("_q"), F.col(grad).alias("_g"), F.col("center").alias("_c")), "id")
    diff = V.dot(F.col("_g"), V.sub(F.col("_p"), F.col("_c")))
    return j.groupBy("id").agg(F.min(barth(F.col("_q"), diff, F.col("qmax"), F.col("qmin"))).alias("limiter"))


def node_values(mesh: Mesh, faces: DataFrame, cells: DataFrame, value: str, boundary: str) -> DataFrame:
    """id, value: inverse-distance means; nodes of boundary faces from those faces' centres and column ``boundary``, others from the cells around them."""
    p = mesh.pos.select(F.col("id").alias("node"), F.struct("x", "y", "z").alias("_p"))
    f = faces.where("cr IS NULL").select(F.col("id").alias("face"), F.col("center").alias("_c"), F.col(boundary).alias("_q")).join(mesh.face_nodes.select(F.col("id").alias("face"), F.col("dst").alias("node")), "face").drop("face")
    c = cell_nodes(mesh).select("id", F.col("dst").alias("node")).join(f.select("node"), "node", "left_anti").join(cells.select("id", F.col("center").alias("_c"), F.col(value).alias("_q")), "id").drop("id")
    j = f.unionByName(c.select(*f.columns)).join(p, "node")
    w = 1 / V.norm(V.sub(F.col("_p"), F.col("_c")))
    return j.groupBy("node").agg((F.sum(w * F.col("_q")) / F.sum(w)).alias("value")).withColumnRenamed("node", "id")


def flux_integral(faces: DataFrame, flux: Column) -> DataFrame:
    """id, value: per cell, the sum of a flux through its faces, out of it; ``flux`` is positive from cl to cr and counts the whole face."""
    return sides(faces.withColumn("_flux", flux)).groupBy("cell").agg(F.sum(F.col("sign") * F.col("_flux")).alias("value")).withColumnRenamed("cell", "id")


def periodic_pairs(faces: DataFrame, first: str, second: str, shift: tuple[float, float, float], tolerance: float = 1e-6) -> DataFrame:
    """(id, dst): faces of one boundary and their images on another, a translation away, by an equi-join on grid cells."""
    from .spatial import within_radius

    side = lambda name, move: faces.where(F.col("boundary") == name).select("id", *((F.col(f"center.{a}") + m).alias(a) for a, m in zip("xyz", move, strict=True)))
    return within_radius(side(first, shift), side(second, (0.0, 0.0, 0.0)), tolerance).select("id", F.col("near").alias("dst"))


def make_periodic(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """Faces with the pairs glued: a first face's cr is its image's inner cell, and the image goes."""
    inner = faces.select(F.col("id").alias("dst"), F.col("cl").alias("_cr"))
    glued = pairs.join(inner, "dst").select("id", "_cr")
    out = faces.join(pairs.select(F.col("dst").alias("id")), "id", "left_anti").join(glued, "id", "left")
    return out.withColumn("cr", F.coalesce("cr", "_cr")).withColumn("boundary", F.when(F.col("_cr").isNull(), F.col("boundary"))).drop("_cr").select(faces.columns)


def orient(mesh: Mesh) -> Mesh:
    """The mesh with cl below cr: faces whose cells are the other way round change sides and run backwards."""
    turn = mesh.faces.where("cr < cl").select("id")
    size = mesh.face_nodes.join(turn, "id").groupBy("id").agg(F.max("pos").alias("_last"))
    nodes = mesh.face_nodes.join(size, "id", "left").select("id", F.coalesce(F.col("_last") - F.col("pos"), F.col("pos")).alias("pos"), "dst")
    faces = mesh.faces.withColumn("_lo", F.least("cl", "cr")).withColumn("cr", F.when(F.col("cr").isNotNull(), F.greatest("cl", "cr"))).withColumn("cl", F.coalesce("_lo", "cl")).drop("_lo")
    return Mesh(mesh.pos, nodes, faces)


def face_jump(faces: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """id, jump of a cell value across interior faces, from cl to cr."""
    return with_cells(faces.where("cr IS NOT NULL"), cells, value).select("id", (F.col(f"{value}_r") - F.col(f"{value}_l")).alias("jump"))
