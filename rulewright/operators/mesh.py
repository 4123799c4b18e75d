"""Unstructured-mesh kernels: a generated hexahedral grid, metrics, gradients, limiters, node values, integrals.

A mesh is a set of DataFrames: pos (id, x, y, z), face_nodes (id, pos, dst), faces (id, cl, cr, boundary), where cr is
null and boundary names the surface on boundary faces.  Face normals point from cl to cr, out of the domain at boundaries.
Every kernel is joins on face or cell ids and pre-aggregated sums: one shuffle per step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V

TINY = 1e-30


@dataclass
class Mesh:
    pos: DataFrame
    face_nodes: DataFrame
    faces: DataFrame


def hex_grid(spark: SparkSession, n: int, size: float = 1.0) -> Mesh:
    """n x n x n cells of a cube, made on the executors."""
    m, h = n + 1, size / n
    i, j, k = F.col("id") % m, F.floor(F.col("id") / m) % m, F.floor(F.col("id") / (m * m))
    pos = spark.range(m**3).select("id", (i * h).alias("x"), (j * h).alias("y"), (k * h).alias("z"))
    parts = []
    node = lambda a, b, c: a + b * m + c * m * m
    cell = lambda a, b, c: a + b * n + c * n * n
    per = m * n * n
    for axis in range(3):
        a, b, c = F.col("id") % m, F.floor(F.col("id") / m) % n, F.floor(F.col("id") / (m * n))
        at = {0: (a, b, c), 1: (c, a, b), 2: (b, c, a)}[axis]
        u = [(0, 1, 0), (0, 0, 1), (1, 0, 0)][axis]
        w = [(0, 0, 1), (1, 0, 0), (0, 1, 0)][axis]
        corner = lambda s, t, at=at, u=u, w=w: node(*(at[q] + s * u[q] + t * w[q] for q in range(3)))
        low, high = a == 0, a == n
        back = cell(*(at[q] - (1 if q == axis else 0) for q in range(3)))
        ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
        name = "xyz"[axis]
        parts.append(spark.range(per).select((F.col("id") + axis * per).alias("id"), F.when(low, cell(*at)).otherwise(back).cast("long").alias("cl"), F.when(~low & ~high, cell(*at)).cast("long").alias("cr"),
            F.when(low, F.lit(f"{name}min")).when(high, F.lit(f"{name}max")).alias("boundary"), F.when(low, F.reverse(ring)).otherwise(ring).alias("ring")))
    faces = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return Mesh(pos, faces.select("id", F.posexplode("ring").alias("pos", "dst")).select("id", "pos", F.col("dst").cast("long").alias("dst")), faces.drop("ring"))


def hex_cells(spark: SparkSession, n: int) -> DataFrame:
    """(id, nodes, type): the cells of ``hex_grid`` by their eight nodes, with the type number of exporters."""
    m = n + 1
    i, j, k = F.col("id") % n, F.floor(F.col("id") / n) % n, F.floor(F.col("id") / (n * n))
    node = lambda a, b, c: (i + a) + (j + b) * m + (k + c) * m * m
    ring = ((0, 0), (1, 0), (1, 1), (0, 1))
    return spark.range(n**3).select("id", F.array(*(node(a, b, c) for c in (0, 1) for a, b in ring)).alias("nodes"), F.lit(12).alias("type"))


def face_metrics(mesh: Mesh) -> DataFrame:
    """id, cl, cr, boundary, center, n (unit normal), sada (area).  The centre is the edge-length weighted
    mean of edge midpoints; the area vector sums triangles around it."""
    p = mesh.pos.select(F.col("id").alias("dst"), F.struct("x", "y", "z").alias("p"))
    ring = mesh.face_nodes.join(p, "dst").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("r"))
    ring = ring.select("id", F.transform("r", lambda s: s["p"]).alias("r"))
    edges = F.transform("r", lambda a, i: F.struct(a.alias("a"), F.get("r", (i + 1) % F.size("r")).alias("b")))
    ring = ring.withColumn("e", edges)
    zero = V.vec(0, 0, 0)
    lengths = F.aggregate("e", F.lit(0.0), lambda s, e: s + V.norm(V.sub(e["b"], e["a"])))
    center = V.scale(F.aggregate("e", zero, lambda s, e: V.add(s, V.scale(V.add(e["a"], e["b"]), V.norm(V.sub(e["b"], e["a"])) * 0.5))), 1 / lengths)
    ring = ring.withColumn("center", center)
    area = F.aggregate("e", zero, lambda s, e: V.add(s, V.cross(V.sub(e["a"], F.col("center")), V.sub(e["b"], F.col("center")))))
    ring = ring.withColumn("s", area)
    size = V.norm(F.col("s"))
    ring = ring.select("id", "center", V.scale(F.col("s"), 1 / (size + TINY)).alias("n"), (size * 0.5).alias("sada"))
    return mesh.faces.join(ring, "id")


def sides(faces: DataFrame) -> DataFrame:
    """A row per face and cell beside it: cell, sign (+1 for cl, -1 for cr), and the face's columns."""
    return faces.withColumn("side", F.explode(F.when(F.col("cr").isNull(), F.array(F.struct(F.col("cl").alias("cell"), F.lit(1.0).alias("sign")))).otherwise(F.array(F.struct(F.col("cl").alias("cell"), F.lit(1.0).alias("sign")), F.struct(F.col("cr").alias("cell"), F.lit(-1.0).alias("sign")))))).select("*", "side.cell", "side.sign").drop("side")


def cell_metrics(faces: DataFrame) -> DataFrame:
    """id, center (area-weighted mean of face centres), vol (a third of the outward sum of area times distance along the normal)."""
    s = sides(faces)
    total = F.sum("sada")
    centers = s.groupBy("cell").agg(V.vec(*(F.sum(F.col("sada") * F.col(f"center.{k}")) / total for k in V.AXES)).alias("cc"))
    j = s.join(centers, "cell")
    vol = F.sum(F.col("sign") * F.col("sada") * V.dot(V.sub(F.col("center"), F.col("cc")), F.col("n"))) / 3
    return j.groupBy("cell").agg(vol.alias("vol"), F.first("cc").alias("center")).select(F.col("cell").alias("id"), "center", "vol")


def with_cells(faces: DataFrame, cells: DataFrame, *columns: str) -> DataFrame:
    """Faces with <c>_l and <c>_r of their cells; the right ones are null at boundaries."""
    side = lambda key, s: cells.select(F.col("id").alias(key), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    return faces.join(side("cl", "l"), "cl").join(side("cr", "r"), "cr", "left")


def green_gauss(faces: DataFrame, cells: DataFrame, value: str, boundary: str) -> DataFrame:
    """id, grad: face values by opposite-volume weights, given at boundaries by column ``boundary`` of faces."""
    f = with_cells(faces, cells.withColumn("v", F.col("vol")), value, "v")
    l, r = F.col(f"{value}_l"), F.col(f"{value}_r")
    xf = F.when(F.col("cr").isNull(), F.col(boundary)).otherwise((l * F.col("v_r") + r * F.col("v_l")) / (F.col("v_l") + F.col("v_r")))
    s = sides(f.withColumn("_flux", V.scale(F.col("n"), xf * F.col("sada"))))
    g = s.groupBy("cell").agg(*(F.sum(F.col("sign") * F.col(f"_flux.{k}")).alias(k) for k in V.AXES))
    return cells.join(g, cells["id"] == g["cell"]).select("id", V.vec(*(F.col(k) / F.col("vol") for k in V.AXES)).alias("grad"))


def least_squares(faces: DataFrame, cells: DataFrame, value: str, boundary: str) -> DataFrame:
    """id, grad: area-weighted least squares over face neighbours, the face centre and value standing in at boundaries."""
    f = with_cells(faces, cells, value, "center")
    inner = F.col("cr").isNotNull()
    own = F.col("sign") > 0
    mine, other = F.when(own, F.col("center_l")).otherwise(F.col("center_r")), F.when(own, F.col("center_r")).otherwise(F.col("center_l"))
    qm, qo = F.when(own, F.col(f"{value}_l")).otherwise(F.col(f"{value}_r")), F.when(own, F.col(f"{value}_r")).otherwise(F.col(f"{value}_l"))
    s = sides(f).withColumn("d", V.sub(F.when(inner, other).otherwise(F.col("center")), mine)).withColumn("dq", F.when(inner, qo).otherwise(F.col(boundary)) - qm)
    w = F.col("sada")
    m = [[F.sum(w * F.col(f"d.{a}") * F.col(f"d.{b}")) for b in V.AXES] for a in V.AXES]
    t = F.struct(*(V.vec(*m[i]).alias(a) for i, a in enumerate(V.AXES)))
    b = V.vec(*(F.sum(w * F.col(f"d.{a}") * F.col("dq")) for a in V.AXES))
    g = s.groupBy("cell").agg(t.alias("m"), b.alias("b"))
    return g.select(F.col("cell").alias("id"), V.solve3(F.col("m"), F.col("b")).alias("grad"))


def face_gradient(faces: DataFrame, cells: DataFrame, value: str, grad: str, boundary: str) -> DataFrame:
    """id, grad: volume-averaged cell gradients with the normal part replaced by the difference across the face."""
    f = with_cells(faces, cells, value, grad, "center", "vol")
    inner = F.col("cr").isNotNull()
    mean = lambda k: (F.col(f"{grad}_l.{k}") * F.col("vol_r") + F.col(f"{grad}_r.{k}") * F.col("vol_l")) / (F.col("vol_l") + F.col("vol_r"))
    avg = V.vec(*(F.when(inner, mean(k)).otherwise(F.col(f"{grad}_l.{k}")) for k in V.AXES))
    f = f.withColumn("_g", avg).withColumn("_d", V.sub(F.when(inner, F.col("center_r")).otherwise(F.col("center")), F.col("center_l")))
    dq = F.when(inner, F.col(f"{value}_r")).otherwise(F.col(boundary)) - F.col(f"{value}_l")
    n = F.col("n")
    normal = dq / V.dot(F.col("_d"), n) - V.dot(F.col("_g"), n)
    return f.select("id", V.add(F.col("_g"), V.scale(n, normal)).alias("grad"))


def neighbour_range(faces: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """id, qmax, qmin over a cell and its face neighbours."""
    f = with_cells(faces.where("cr IS NOT NULL"), cells, value)
    both = f.select(F.col("cl").alias("cell"), F.col(f"{value}_r").alias("q")).unionByName(f.select(F.col("cr").alias("cell"), F.col(f"{value}_l").alias("q"))).unionByName(cells.select(F.col("id").alias("cell"), F.col(value).alias("q")))
    return both.groupBy("cell").agg(F.max("q").alias("qmax"), F.min("q").alias("qmin")).withColumnRenamed("cell", "id")


def venkatakrishnan(up: Column, diff: Column, eps2: Column) -> Column:
    d = F.when(diff > 0, diff + TINY).otherwise(diff - TINY)
    y = (d * (up * up + eps2) + 2 * d * d * up) / (d * (up * up + 2 * d * d + d * up + eps2))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))


def barth(x: Column, diff: Column, qmax: Column, qmin: Column) -> Column:
    y = F.when(diff > 0, (qmax - x) / (diff + TINY)).otherwise((qmin - x) / (diff - TINY))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))


def nishikawa(up: Column, diff: Column, eps: float, p: int = 4) -> Column:
    """Smooth limiter of order p = 3, 4 or 5 on the sizes of the changes: 1 where the allowed change is over twice the
    extrapolated one, which it meets there without a step (published forms with a - b in place of a - 2b for p = 4 don't)."""
    a, b = F.abs(up), F.abs(diff)
    s = {3: 4 * b * b, 4: 2 * b * (a * a - 2 * b * (a - 2 * b)), 5: 8 * b * b * (a * a - 2 * b * (a - b))}[p]
    top = F.pow(a, F.lit(p)) + eps**p
    y = (top + a * s) / (top + b * (F.pow(a, F.lit(p - 1)) + s) + TINY)
    return F.when(a > 2 * b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))


def limiter(faces: DataFrame, cells: DataFrame, value: str, grad: str, kind: str = "barth", eps2: float = 0.0) -> DataFrame:
    """id, limiter: the least face limiter of each cell; cells need qmax and qmin.  kind: barth, venkatakrishnan, nishikawa3 to nishikawa5, none, zero."""
    if kind in ("none", "zero"):
        return cells.select("id", F.lit(1.0 if kind == "none" else 0.0).alias("limiter"))
    s = sides(faces).join(cells.select(F.col("id").alias("cell"), F.col(value).alias("_q"), F.col(grad).alias("_g"), F.col("center").alias("_c"), "qmax", "qmin"), "cell")
    diff = V.dot(F.col("_g"), V.sub(F.col("center"), F.col("_c")))
    if kind == "barth":
        one = barth(F.col("_q"), diff, F.col("qmax"), F.col("qmin"))
    elif kind == "venkatakrishnan":
        one = venkatakrishnan(F.when(diff >= 0, F.col("qmax") - F.col("_q")).otherwise(F.col("qmin") - F.col("_q")), diff, F.lit(eps2))
    elif kind in ("nishikawa3", "nishikawa4", "nishikawa5"):
        one = nishikawa(F.when(diff >= 0, F.col("qmax") - F.col("_q")).otherwise(F.col("qmin") - F.col("_q")), diff, eps2**0.5, int(kind[-1]))
    else:
        raise ValueError(f"unknown limiter {kind!r}")
    return s.groupBy("cell").agg(F.min(one).alias("limiter")).withColumnRenamed("cell", "id")


def muscl(faces: DataFrame, cells: DataFrame, value: str, grad: str, lim: str = "limiter", floor: float | None = None) -> DataFrame:
    """id, left, right: limited extrapolation to the face; with ``floor``, a result below it falls back to the cell's value."""
    f = with_cells(faces, cells, value, grad, lim, "center")

    def side(s: str) -> Column:
        x = F.col(f"{value}_{s}")
        y = x + F.col(f"{lim}_{s}") * V.dot(F.col(f"{grad}_{s}"), V.sub(F.col("center"), F.col(f"center_{s}")))
        return y if floor is None else F.when(y < floor, x).otherwise(y)

    return f.select("id", side("l").alias("left"), side("r").alias("right"))


def node_values(mesh: Mesh, cells: DataFrame, value: str) -> DataFrame:
    """id, value: inverse-distance weighted mean of the cells around each node; a cell counts once."""
    s = sides(mesh.faces).select(F.col("id").alias("face"), "cell").join(mesh.face_nodes.select(F.col("id").alias("face"), F.col("dst").alias("node")), "face").select("cell", "node").distinct()
    s = s.join(cells.select(F.col("id").alias("cell"), F.col("center").alias("_c"), F.col(value).alias("_q")), "cell").join(mesh.pos.select(F.col("id").alias("node"), F.struct("x", "y", "z").alias("_p")), "node")
    w = 1 / V.norm(V.sub(F.col("_p"), F.col("_c")))
    return s.groupBy("node").agg((F.sum(w * F.col("_q")) / (F.sum(w) + 1e-20)).alias("value")).withColumnRenamed("node", "id")


def surface_integral(faces: DataFrame, field: str) -> DataFrame:
    """id, value: outward sum of area times field . n for each cell; ``field`` is a vector column of faces."""
    return sides(faces).groupBy("cell").agg(F.sum(F.col("sign") * F.col("sada") * V.dot(F.col(field), F.col("n"))).alias("value")).withColumnRenamed("cell", "id")


def spatial_filter(faces: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """id, value: volume-weighted mean over a cell and its face neighbours."""
    f = with_cells(faces.where("cr IS NOT NULL"), cells, value, "vol")
    rows = f.select(F.col("cl").alias("cell"), F.col(f"{value}_r").alias("q"), F.col("vol_r").alias("v")).unionByName(f.select(F.col("cr").alias("cell"), F.col(f"{value}_l").alias("q"), F.col("vol_l").alias("v"))).unionByName(cells.select(F.col("id").alias("cell"), F.col(value).alias("q"), F.col("vol").alias("v")))
    return rows.groupBy("cell").agg((F.sum(F.col("q") * F.col("v")) / F.sum("v")).alias("value")).withColumnRenamed("cell", "id")


def lower_upper(faces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(upper, lower, boundary_map) as pairs (id of the cell, dst = face)."""
    inner = faces.where("cr IS NOT NULL")
    return inner.select(F.col("cl").alias("id"), F.col("id").alias("dst")), inner.select(F.col("cr").alias("id"), F.col("id").alias("dst")), faces.where("cr IS NULL").select(F.col("cl").alias("id"), F.col("id").alias("dst"))


def element_types(mesh: Mesh) -> DataFrame:
    """id, type: tet, pyramid, prism, hex or general, by the number of triangles and quadrilaterals around a cell."""
    size = mesh.face_nodes.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    c = sides(mesh.faces).join(size, "id").groupBy("cell").agg(F.sum((F.col("k") == 3).cast("int")).alias("tri"), F.sum((F.col("k") == 4).cast("int")).alias("quad"), F.count(F.lit(1)).alias("all"))
    t = F.when(F.expr("tri = 4 AND all = 4"), "tet").when(F.expr("tri = 4 AND quad = 1 AND all = 5"), "pyramid").when(F.expr("tri = 2 AND quad = 3 AND all = 5"), "prism").when(F.expr("quad = 6 AND all = 6"), "hex").otherwise("general")
    return c.select(F.col("cell").alias("id"), t.alias("type"))


def quality_report(faces: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: cells, faces, total volume, least and greatest volume, largest closure error (sum of area vectors relative to area)."""
    s = sides(faces).groupBy("cell").agg(*(F.sum(F.col("sign") * F.col("sada") * F.col(f"n.{k}")).alias(k) for k in V.AXES), F.sum("sada").alias("a"))
    closure = s.agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) / F.col("a")).alias("closure"))
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("vol").alias("volume"), F.min("vol").alias("min_volume"), F.max("vol").alias("max_volume")).crossJoin(F.broadcast(faces.agg(F.count(F.lit(1)).alias("faces")))).crossJoin(F.broadcast(closure))  # single rows


def jacobi(matrix: DataFrame, rhs: DataFrame, steps: int = 200, tolerance: float = 1e-10, partial: bool = False) -> DataFrame:
    """(id, value): Jacobi iteration for a sparse system; matrix (row, col, a), rhs (id, b).
    Values that still change by more than the tolerance after all steps are returned only if ``partial``."""
    from ..session import checkpoint

    diagonal = matrix.where("row = col").select(F.col("row").alias("id"), F.col("a").alias("d"))
    off = matrix.where("row <> col")
    fixed = checkpoint(rhs.join(diagonal, "id"))
    x = checkpoint(fixed.select("id", (F.col("b") / F.col("d")).alias("value")))
    for _ in range(steps):
        s = off.join(x.select(F.col("id").alias("col"), "value"), "col").groupBy(F.col("row").alias("id")).agg(F.sum(F.col("a") * F.col("value")).alias("s"))
        new = checkpoint(fixed.join(s, "id", "left").join(x.withColumnRenamed("value", "old"), "id").select("id", ((F.col("b") - F.coalesce("s", F.lit(0.0))) / F.col("d")).alias("value"), "old"))
        change = new.agg(F.max(F.abs(F.col("value") - F.col("old")))).first()[0]
        x = new.select("id", "value")
        if change is None or change <= tolerance:
            return x
    if not partial:
        raise ValueError(f"no convergence in {steps} steps")
    return x
