"""Volume meshes as files: positions, face nodes and faces as Parquet beside a header, element meshes, and their facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, CatalogError, constraint, map_, multimap, store
from ..operators import topology
from ..operators.mesh import Mesh
from .facts import read_ugrid_ascii

SECTIONS = ("pos", "face_nodes", "faces")


def write_mesh(mesh: Mesh, path: str) -> None:
    """The sections of a mesh and a header with their row counts, which a reader checks."""
    counts = []
    for name in SECTIONS:
        df = getattr(mesh, name)
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        counts.append((name, df.sparkSession.read.parquet(f"{path}/{name}").count()))
    mesh.pos.sparkSession.createDataFrame(counts, "section string, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def read_mesh(spark: SparkSession, path: str) -> Mesh:
    """A mesh that ``write_mesh`` wrote; a section that lost rows is an error."""
    parts = {name: spark.read.parquet(f"{path}/{name}") for name in SECTIONS}
    for r in spark.read.parquet(f"{path}/header").collect():  # a row per section
        if parts[r["section"]].count() != r["n"]:
            raise CatalogError(f"{path}: section {r['section']} isn't whole")
    return Mesh(**parts)


def read_element_mesh(spark: SparkSession, path: str) -> Mesh:
    """An ASCII element mesh as a face mesh, its surfaces by their numbers."""
    u = read_ugrid_ascii(spark, path)
    return topology.from_cells(u["pos"], u["cells"], u["boundary"])


def setup_facts(mesh: Mesh, catalog: Catalog) -> list[str]:
    """Puts a mesh and its derived topology into a catalog: pos, face2node, cl, cr, ci, ref, surface names, upper, lower, boundary_map and the entity sets."""
    t = topology.setup(mesh)
    catalog.create("pos", store(mesh.pos.select("id", F.struct("x", "y", "z").alias("value")), "nodes"))
    catalog.create("face2node", multimap(mesh.face_nodes, "faces"))
    for name in ("cl", "cr", "ci", "ref"):
        catalog.create(name, map_(t[name], "faces"))
    catalog.create("boundary_names", store(t["surfaces"].select("id", F.col("name").alias("value")), "surfaces"))
    for name, space in (("geom_cells", "cells"), ("ghost_cells", "cells"), ("interior_faces", "faces"), ("boundary_faces", "faces")):
        catalog.create(name, constraint(t[name], space))
    from ..operators.maps import to_multimap
    from ..operators.mesh import lower_upper

    domain: DataFrame = t["geom_cells"]
    for name, pairs in zip(("upper", "lower", "boundary_map"), lower_upper(mesh.faces), strict=True):
        catalog.create(name, multimap(to_multimap(pairs), "cells", domain))
    return sorted(map(str, catalog.facts))
