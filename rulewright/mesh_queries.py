"""Registered queries of mesh topology, stencils, limiters and mesh files on grids whose fields and elements come from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import Catalog
from .engine import Engine
from .functions import vectors as V
from .operators import mesh as G
from .operators import topology as T
from .operators.reduce import Summation
from .queries import query, t
from .session import checkpoint, checkpoint_dir
from .sources import facts, mesh_files

N = 4
_C = "c AS (SELECT id, id % 4 AS i, id // 4 % 4 AS j, id // 16 AS k FROM range(64) r(id))"
#: Cells with the field of the tables: the balance of the customer with the cell's number.
_Q = f"WITH {_C}, q AS (SELECT c.*, c_acctbal AS q FROM c JOIN customer ON c_custkey = c.id)"
_BESIDE = "abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1"
_AROUND = "greatest(abs(a.i - b.i), abs(a.j - b.j), abs(a.k - b.k)) <= 1"


def _field(spark, sf):
    """The grid, its face metrics and cells with the tables' field, written once."""
    m = G.hex_grid(spark, N)
    f = checkpoint(G.face_metrics(m))
    c = checkpoint(G.cell_metrics(f).join(t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("q")), "id"))
    return m, f, c


@query(f"{_Q} SELECT a.id, max(b.q) AS qmax, min(b.q) AS qmin FROM q a JOIN q b ON {_BESIDE} OR a.id = b.id GROUP BY 1")
def neighbourhood_range(spark, sf):
    _, f, c = _field(spark, sf)
    return G.neighbour_range(f, c, "q")


@query(f"{_Q} SELECT a.id, round(avg(b.q), 6) AS value FROM q a JOIN q b ON {_BESIDE} OR a.id = b.id GROUP BY 1")
def spatial_filter(spark, sf):
    _, f, c = _field(spark, sf)
    return G.spatial_filter(f, c, "q").select("id", F.round("value", 6).alias("value"))


@query(f"{_Q} SELECT a.id, count(*) - 1 AS n, round(sum(b.q) - max(a.q), 4) AS total FROM q a JOIN q b ON {_AROUND} GROUP BY 1")
def cell_stencils(spark, sf):
    """Cells that share a node: their number and the sum of the field over them."""
    m, _, c = _field(spark, sf)
    s = T.cell_stencil(m).join(c.select(F.col("id").alias("dst"), "q"), "dst")
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("q"), 4).alias("total"))


_NODE = "n AS (SELECT id, id % 5 AS i, id // 5 % 5 AS j, id // 25 AS k FROM range(125) r(id))"


@query(f"{_Q}, {_NODE} SELECT n.id, max(q) AS qmax, min(q) AS qmin FROM n JOIN q ON n.i - q.i IN (0, 1) AND n.j - q.j IN (0, 1) AND n.k - q.k IN (0, 1) GROUP BY 1")
def node_neighbourhoods(spark, sf):
    m, _, c = _field(spark, sf)
    return T.node_range(m, c, "q")


_JUMP = "SELECT round(b.q - a.q, 4) AS jump FROM q a JOIN q b ON b.id IN (a.id + 1, a.id + 4, a.id + 16) AND " + _BESIDE


@query(f"{_Q} SELECT count(*) AS n, round(sum(abs(jump)), 2) AS total, max(jump) AS most FROM ({_JUMP})")
def face_jumps(spark, sf):
    _, f, c = _field(spark, sf)
    return T.face_jump(f, c, "q").select(F.round("jump", 4).alias("jump")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("jump")), 2).alias("total"), F.max("jump").alias("most"))


@query(f"{_Q} SELECT a.id, round(sum(a.q - b.q), 4) AS value FROM q a JOIN q b ON {_BESIDE} GROUP BY 1 HAVING count(*) FILTER (b.i > a.i) > 0")
def flux_integrals(spark, sf):
    """The sum of the field's drops through the interior faces of each cell that isn't at the far end along x."""
    _, f, c = _field(spark, sf)
    both = G.with_cells(f, c, "q")
    out = T.flux_integral(both, F.when(F.col("cr").isNotNull(), F.col("q_l") - F.col("q_r")).otherwise(0.0))
    return out.where("id % 4 < 3").select("id", F.round("value", 4).alias("value"))


_R = f"{_Q}, r AS (SELECT a.id, max(a.q) AS q, max(b.q) AS hi, min(b.q) AS lo FROM q a JOIN q b ON {_BESIDE} OR a.id = b.id GROUP BY 1), d AS (SELECT r.*, unnest([1.0, -1.0, 0.0]) * 8.0 * 0.125 * 500.0 AS d FROM r)"
_CLIP = "greatest(0.0, least(1.0, {0}))"


def _limited(spark, sf, kind, eps2=0.0):
    """The limiter of a gradient of 4000 along x, so that faces change by 500, 0 or -500."""
    _, f, c = _field(spark, sf)
    c = c.join(G.neighbour_range(f, c, "q"), "id").withColumn("grad", V.vec(4000.0, 0.0, 0.0))
    return G.limiter(f, c, "q", "grad", kind, eps2).select("id", F.round("limiter", 6).alias("limiter"))


@query(f"{_R} SELECT id, round(min({_CLIP.format('CASE WHEN d > 0 THEN (hi - q) / (d + 1e-30) ELSE (lo - q) / (d - 1e-30) END')}), 6) AS limiter FROM d GROUP BY 1")
def barth_limiter(spark, sf):
    return _limited(spark, sf, "barth")


_VEN = "(m * (p * p + 1e4) + 2 * m * m * p) / (m * (p * p + 2 * m * m + m * p + 1e4))"


@query(f"{_R}, v AS (SELECT id, CASE WHEN d >= 0 THEN hi - q ELSE lo - q END AS p, CASE WHEN d > 0 THEN d + 1e-30 ELSE d - 1e-30 END AS m FROM d) SELECT id, round(min({_CLIP.format(_VEN)}), 6) AS limiter FROM v GROUP BY 1")
def venkatakrishnan_limiter(spark, sf):
    return _limited(spark, sf, "venkatakrishnan", 1e4)


@query(f"{_Q}, {_NODE}, w AS (SELECT n.*, max(q) AS hi, min(q) AS lo FROM n JOIN q ON n.i - q.i IN (0, 1) AND n.j - q.j IN (0, 1) AND n.k - q.k IN (0, 1) GROUP BY ALL), d AS (SELECT q.id, q.q, hi, lo, (w.i - q.i - 0.5) * 1000.0 AS d FROM w JOIN q ON w.i - q.i IN (0, 1) AND w.j - q.j IN (0, 1) AND w.k - q.k IN (0, 1)) SELECT id, round(min({_CLIP.format('CASE WHEN d > 0 THEN (hi - q) / (d + 1e-30) ELSE (lo - q) / (d - 1e-30) END')}), 6) AS limiter FROM d GROUP BY 1")
def node_limiter(spark, sf):
    """The limiter by the ranges around a cell's nodes."""
    m, _, c = _field(spark, sf)
    return T.mlp_limiter(m, c.withColumn("grad", V.vec(4000.0, 0.0, 0.0)), "q", "grad").select("id", F.round("limiter", 6).alias("limiter"))


@query(f"WITH {_C}, s AS (SELECT id, unnest([CASE WHEN i = 0 THEN 'xmin' END, CASE WHEN i = 3 THEN 'xmax' END, CASE WHEN j = 0 THEN 'ymin' END, CASE WHEN j = 3 THEN 'ymax' END, CASE WHEN k = 0 THEN 'zmin' END, CASE WHEN k = 3 THEN 'zmax' END]) AS name FROM c) SELECT id AS cell, name, 64 <= 64 + 95 AS outside FROM s WHERE name IS NOT NULL")
def topology_setup(spark, sf):
    """Boundary faces with their inner cell, their surface and a ghost cell beyond the cells."""
    s = T.setup(G.hex_grid(spark, N))
    j = s["ci"].withColumnRenamed("dst", "cell").join(s["ref"].withColumnRenamed("dst", "surface"), "id").join(s["surfaces"].select(F.col("id").alias("surface"), "name"), "surface").join(s["cr"].withColumnRenamed("dst", "ghost"), "id")
    return j.select("cell", "name", F.col("ghost").between(64, 64 + 95).alias("outside"))


@query(f"WITH {_NODE} SELECT a.id, count(*) AS edges FROM n a JOIN n b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 GROUP BY 1")
def mesh_edges(spark, sf):
    """The number of edges at each node; every face is closed by its edges."""
    m = G.hex_grid(spark, N)
    edge, face = T.edges(m)
    assert face.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("d")).where("n <> 4 OR d <> 4").count() == 0
    ends = edge.select(F.col("a").alias("id")).unionAll(edge.select(F.col("b").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("edges"))


@query(f"WITH {_C} SELECT a.id AS cell, b.id AS image FROM c a JOIN c b ON a.i = 0 AND b.i = 3 AND a.j = b.j AND a.k = b.k")
def periodic_faces(spark, sf):
    """Faces of two opposite boundaries are glued: each inner cell's partner across the boundary."""
    f = G.face_metrics(G.hex_grid(spark, N))
    pairs = T.periodic_pairs(f, "xmin", "xmax", (1.0, 0.0, 0.0))
    glued = T.make_periodic(f, pairs)
    return glued.join(pairs.select("id"), "id", "left_semi").select(F.col("cl").alias("cell"), F.col("cr").alias("image"))


_SPLIT = "s AS (SELECT n_nationkey AS col, n_regionkey % 2 AS split FROM nation WHERE n_nationkey < 9), c AS (SELECT col + 9 * k AS hex, split, k FROM s, range(3) r(k)), e AS (SELECT CASE WHEN split = 1 THEN hex * 2 + half ELSE hex * 2 END AS id, split FROM c, range(2) h(half) WHERE half = 0 OR split = 1)"


def _mixed(spark, sf):
    """27 blocks in 9 columns, one for each of the first nations: in columns of odd regions each block is cut into two prisms."""
    n = t(spark, sf, "nation").where("n_nationkey < 9").select(F.col("n_nationkey").cast("long").alias("col"), (F.col("n_regionkey") % 2).alias("split"))
    hexes = G.hex_cells(spark, 3).select(F.col("id").alias("hex"), "nodes", (F.col("id") % 9).alias("col")).join(n, "col")
    at = lambda *i: F.array(*(F.get("nodes", F.lit(k)) for k in i))
    whole = hexes.where("split = 0").select((F.col("hex") * 2).alias("id"), F.lit("hex").alias("type"), "nodes")
    halves = hexes.where("split = 1").select("hex", F.posexplode(F.array(at(0, 1, 2, 4, 5, 6), at(0, 2, 3, 4, 6, 7))).alias("half", "n")).select((F.col("hex") * 2 + F.col("half")).alias("id"), F.lit("prism").alias("type"), F.col("n").alias("nodes"))
    return G.hex_grid(spark, 3).pos, whole.unionByName(halves)


@query(f"WITH {_SPLIT} SELECT id::BIGINT AS id, CASE WHEN split = 1 THEN 'prism' ELSE 'hex' END AS type, round(CASE WHEN split = 1 THEN 0.5 ELSE 1 END / 27.0, 9) AS vol, true AS closed FROM e")
def mixed_elements(spark, sf):
    """Faces from element cells of two kinds: types found again, exact volumes, closed cells."""
    pos, cells = _mixed(spark, sf)
    m = T.from_cells(pos, cells)
    f = checkpoint(G.face_metrics(m))
    s = G.sides(f).groupBy(F.col("cell").alias("id")).agg(*(F.abs(F.sum(F.col("sign") * F.col("sada") * F.col(f"n.{k}"))).alias(k) for k in "xyz"))
    out = G.element_types(m).join(G.cell_metrics(f), "id").join(s, "id")
    return out.select("id", "type", F.round("vol", 9).alias("vol"), ((F.col("x") < 1e-12) & (F.col("y") < 1e-12) & (F.col("z") < 1e-12)).alias("closed"))


@query(f"WITH {_SPLIT} SELECT id::BIGINT AS id, 2.0::DOUBLE AS gx, -3.0::DOUBLE AS gy, 0.5::DOUBLE AS gz FROM e")
def mixed_element_gradients(spark, sf):
    """Least squares on the mixed mesh give a linear field's gradient exactly."""
    pos, cells = _mixed(spark, sf)
    f = checkpoint(G.face_metrics(T.from_cells(pos, cells)))
    q = lambda p: F.col(f"{p}.x") * 2 - F.col(f"{p}.y") * 3 + F.col(f"{p}.z") * 0.5 + 1
    g = G.least_squares(f.withColumn("qb", q("center")), G.cell_metrics(f).withColumn("q", q("center")), "q", "qb")
    return g.select("id", *(F.round(f"grad.{k}", 9).alias(f"g{k}") for k in "xyz"))


@query(f"WITH {_SPLIT}, w AS (SELECT id, split, c_acctbal AS q FROM e JOIN customer ON c_custkey = id) SELECT round(sum(q * CASE WHEN split = 1 THEN 0.5 ELSE 1 END / 27.0), 6) AS integral, count(*) AS cells FROM w")
def mesh_file(spark, sf):
    """The mixed mesh written as a file, read, put into a catalog with its topology, and used by rules: the integral of the tables' field."""
    pos, cells = _mixed(spark, sf)
    at = checkpoint_dir(spark, "mesh")
    mesh_files.write_mesh(T.from_cells(pos, cells), at)
    m = mesh_files.read_mesh(spark, at)
    c = Catalog()
    names = mesh_files.setup_facts(m, c)
    assert {"pos", "face2node", "cl", "cr", "ci", "ref", "upper", "lower", "boundary_map", "geom_cells", "ghost_cells"} <= set(names)
    vol = G.cell_metrics(G.face_metrics(m))
    from .catalog import store

    c.create("vol", store(vol.select("id", F.col("vol").alias("value")), "cells"))
    c.create("q", store(t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")), "cells"))
    e = Engine(spark, c)
    e.rules.unit("integral", 0.0)
    e.rules.apply("integral <- vol, q", Summation, constraint="geom_cells")(lambda v, q: v * q)
    out = e.query("integral")
    return out.crossJoin(F.broadcast(c.get("geom_cells").df().agg(F.count(F.lit(1)).alias("cells")))).select(F.round("value", 6).alias("integral"), "cells")  # single rows


@query("SELECT 'prism' AS type, 2::BIGINT AS n, 1.0::DOUBLE AS vol, 6::BIGINT AS walls, 2::BIGINT AS ends")
def element_mesh_file(spark, sf):
    """An ASCII element mesh of two prisms in a unit cube: cells, volume, and faces by surface."""
    text = "8 4 4 0 0 2 0\n0 0 0 1 0 0 1 1 0 0 1 0\n0 0 1 1 0 1 1 1 1 0 1 1\n1 3 2 1 4 3 5 6 7 5 7 8\n1 2 6 5 2 3 7 6 3 4 8 7 4 1 5 8\n2 2 3 3 1 1 1 1\n1 2 3 5 6 7\n1 3 4 5 7 8\n"
    at = checkpoint_dir(spark, "elements")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
    m = mesh_files.read_element_mesh(spark, at)
    f = G.face_metrics(m)
    vol = G.cell_metrics(f).agg(F.sum("vol")).first()[0]
    per = {r["boundary"]: r["count"] for r in m.faces.where("cr IS NULL").groupBy("boundary").count().collect()}  # a row per surface
    return G.element_types(m).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select("type", "n", F.round(F.lit(vol), 9).alias("vol"), F.lit(per["1"] + per.get("2", 0)).cast("long").alias("walls"), F.lit(per["3"]).cast("long").alias("ends"))


@query(f"WITH {_NODE} SELECT id, round(i / 4.0 * 2 - j / 4.0 * 3 + k / 4.0 * 0.5 + 1, 9) AS value FROM n WHERE i BETWEEN 1 AND 3 AND j BETWEEN 1 AND 3 AND k BETWEEN 1 AND 3")
def node_values_of_linear_field(spark, sf):
    """Inverse-distance means of a linear field meet it at inner nodes, where the cells around lie evenly."""
    m = G.hex_grid(spark, N)
    f = checkpoint(G.face_metrics(m))
    q = lambda p: F.col(f"{p}.x") * 2 - F.col(f"{p}.y") * 3 + F.col(f"{p}.z") * 0.5 + 1
    v = T.node_values(m, f.withColumn("qb", q("center")), G.cell_metrics(f).withColumn("q", q("center")), "q", "qb")
    inner = lambda c: c.between(1, 3)
    return v.where(inner(F.col("id") % 5) & inner(F.floor(F.col("id") / 5) % 5) & inner(F.floor(F.col("id") / 25))).select("id", F.round("value", 9).alias("value"))


@query("SELECT 240 AS faces, 2.0::DOUBLE AS gx, -3.0::DOUBLE AS gy, 0.5::DOUBLE AS gz")
def face_gradients(spark, sf):
    """Face gradients of a linear field are exact on every face."""
    f = checkpoint(G.face_metrics(G.hex_grid(spark, N)))
    q = lambda p: F.col(f"{p}.x") * 2 - F.col(f"{p}.y") * 3 + F.col(f"{p}.z") * 0.5 + 1
    f, c = f.withColumn("qb", q("center")), G.cell_metrics(f).withColumn("q", q("center"))
    g = G.face_gradient(f, c.join(G.least_squares(f, c, "q", "qb"), "id"), "q", "grad", "qb")
    return g.groupBy(*(F.round(f"grad.{k}", 9).alias(f"g{k}") for k in "xyz")).agg(F.count(F.lit(1)).cast("int").alias("faces"))


@query("WITH f AS (SELECT 0 AS turned, 240 AS faces) SELECT * FROM f")
def oriented_faces(spark, sf):
    """Faces whose cells are swapped run backwards again after orientation, so normals agree with the grid's."""
    m = G.hex_grid(spark, N)
    turn = m.faces.where("cr IS NOT NULL AND id % 3 = 0").select("id")
    last = m.face_nodes.join(turn.withColumn("_t", F.lit(True)), "id", "left")
    nodes = last.select("id", F.when(F.col("_t"), 3 - F.col("pos")).otherwise(F.col("pos")).alias("pos"), "dst")
    swapped = m.faces.join(turn.withColumn("_t", F.lit(True)), "id", "left").select("id", F.when(F.col("_t"), F.col("cr")).otherwise(F.col("cl")).alias("cl"), F.when(F.col("_t"), F.col("cl")).otherwise(F.col("cr")).alias("cr"), "boundary")
    back = G.face_metrics(T.orient(G.Mesh(m.pos, nodes, swapped))).select("id", F.col("n").alias("m"))
    j = G.face_metrics(T.orient(m)).join(back, "id")
    return j.agg(F.sum((V.dot(F.col("n"), F.col("m")) < 0.99).cast("int")).cast("int").alias("turned"), F.count(F.lit(1)).cast("int").alias("faces"))


@query(f"{_Q} SELECT count(*) AS n, round(sum((a.q + b.q) / 2), 3) AS total FROM q a JOIN q b ON a.k = 1 AND b.k = 2 AND a.i = b.i AND a.j = b.j")
def cutting_plane(spark, sf):
    """The plane between the second and third layer cuts the lines from cell to cell half way."""
    _, f, c = _field(spark, sf)
    lines = f.where("cr IS NOT NULL").select("id", F.col("cl").alias("a"), F.col("cr").alias("b"))
    cut = facts.cutting_plane(lines, c.select("id", "center.*"), c.select("id", F.col("q").alias("value")), (0.0, 0.0, 1.0), 0.5)
    return cut.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))
