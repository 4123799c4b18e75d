import pytest
from pyspark.sql import functions as F

from rulewright.catalog import store
from rulewright.engine import Engine
from rulewright.functions import vectors as V
from rulewright.operators import mesh, overset, stats
from rulewright.sources import facts


@pytest.fixture(scope="module")
def linear(spark):
    m = mesh.hex_grid(spark, 3)
    f = mesh.face_metrics(m).cache()
    c = mesh.cell_metrics(f).cache()
    q = lambda p: F.col(f"{p}.x") * 2 - F.col(f"{p}.y") + 3
    return m, f.withColumn("qb", q("center")), c.withColumn("q", q("center"))


def test_face_gradient_and_filter_are_exact(linear):
    _, f, c = linear
    g = c.join(mesh.least_squares(f, c, "q", "qb"), "id")
    assert mesh.face_gradient(f, g, "q", "grad", "qb").where("abs(grad.x - 2) > 1e-9 OR abs(grad.y + 1) > 1e-9").count() == 0
    assert mesh.spatial_filter(f, c.withColumn("one", F.lit(1.0)), "one").where("abs(value - 1) > 1e-12").count() == 0


@pytest.mark.parametrize("kind", ["barth", "venkatakrishnan", "nishikawa3", "nishikawa4", "nishikawa5", "none", "zero"])
def test_limiters_are_bounded(linear, kind):
    _, f, c = linear
    g = c.join(mesh.least_squares(f, c, "q", "qb"), "id").join(mesh.neighbour_range(f, c, "q"), "id")
    assert mesh.limiter(f, g, "q", "grad", kind).where("limiter BETWEEN 0 AND 1").count() == 27


def test_overset(spark, linear):
    _, f, c = linear
    one = c.select("id", F.lit("a").alias("component"), "center", F.lit(1.0).alias("q"))
    two = overset.move(c.select((F.col("id") + 100).alias("id"), F.lit("b").alias("component"), "center", F.lit(5.0).alias("q")), "b", (0.02, 0.0, 0.0))
    cells = one.unionByName(two)
    pairs = f.where("cr IS NOT NULL").select(F.col("cl").alias("id"), F.col("cr").alias("dst"))
    pairs = pairs.unionByName(pairs.select(F.col("dst").alias("id"), F.col("id").alias("dst")))
    cut = overset.cut_holes(cells, pairs, {"b": F.col("x") > 0.4})
    states = {r.iblank: r.n for r in cut.groupBy("iblank").agg(F.count("*").alias("n")).collect()}
    assert states == {overset.SOLVED: 27 + 9, overset.FRINGE: 9, overset.BLANK: 9}
    assert overset.interpolate_fringe(cut, "q", 0.4).where("abs(value - 5) > 1e-9 OR iblank <> 1 OR value IS NULL").count() == 0


def test_nested_loops(spark):
    """Outer steps of x -> x + 1, each by an inner loop of two halves."""
    e = Engine(spark)
    e.catalog.create("v", store(spark.createDataFrame([(0, 0.0), (1, 10.0)], "id long, value double")))
    r = e.rules
    r.pointwise("x{n=0} <- v")(lambda v: v)
    r.pointwise("y{n,it=0} <- x{n}")(lambda x: x)
    r.pointwise("y{n,it+1} <- y{n,it}")(lambda y: y + 0.5)
    r.singleton("inner{n,it} <- $it")(lambda k: k >= 2)
    r.pointwise("x{n+1} <- y{n,it}", conditional="inner{n,it}")(lambda y: y)
    r.singleton("outer{n} <- $n")(lambda n: n >= 3)
    r.pointwise("out <- x{n}", conditional="outer{n}")(lambda x: x)
    assert {q.id: q.value for q in e.query("out").collect()} == {0: 3.0, 1: 13.0}


def test_dual_numbers_and_solve(spark):
    x = V.dual(F.lit(0.3), F.lit(1.0))
    assert spark.range(1).select(V.dual_div(V.dual_apply("exp", x), x)["d"].alias("d")).first().d == pytest.approx(1.349858807576003 * (0.3 - 1) / 0.09)
    t = F.struct(V.vec(2, 0, 1).alias("x"), V.vec(0, 3, 0).alias("y"), V.vec(1, 0, 1).alias("z"))
    s = spark.range(1).select(V.solve3(t, V.vec(5, 6, 3)).alias("s")).first().s
    assert (s.x, s.y, s.z) == pytest.approx((2, 2, 1))
    m = spark.createDataFrame([([[2.0, 1.0], [1.0, 3.0]], [3.0, 4.0])], "a array<array<double>>, b array<double>")
    assert m.select(V.lu_solve("a", "b", 2).alias("x")).first().x == pytest.approx([1, 1])


def test_compare_columns(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "id long, p double")
    assert stats.compare_columns(a, a, "id", ["p"], 1e-12, 1e-12).first().agree
    assert not stats.compare_columns(a, a.where("id = 0"), "id", ["p"], 1e-12, 1e-12).first().agree


def test_mesh_files(spark, linear, tmp_path):
    (tmp_path / "g.ugrid").write_text("4 4 0 1 0 0 0\n0 0 0 1 0 0 0 1 0 0 0 1\n1 2 3 1 2 4 2 3 4 1 3 4\n1 1 2 2\n1 2 3 4\n")
    g = facts.read_ugrid_ascii(spark, str(tmp_path / "g.ugrid"))
    assert g["cells"].first().nodes == [0, 1, 2, 3] and g["boundary"].count() == 4
    cells = g["cells"].withColumn("type", F.lit(10))
    lines = list(facts.vtk_lines(g["pos"], cells, {"p": g["pos"].select("id", F.col("x").alias("value"))}))
    assert "POINTS 4 double" in lines and "4 0 1 2 3" in lines and lines[-4:] == ["0", "1", "0", "0"]
    edges = spark.createDataFrame([(0, 0, 1), (1, 2, 3)], "id long, a long, b long")
    cut = facts.cutting_plane(edges, g["pos"], g["pos"].select("id", F.col("x").alias("value")), (1, 0, 0), 0.25).collect()
    assert [(r.id, r.x, r.value) for r in cut] == [(0, 0.25, 0.25)]
    moved = facts.transform(g["pos"], (1, 0, 0), (2, 2, 2), "x", ("z", 90)).where("id = 1").first()
    assert (moved.x, moved.y) == pytest.approx((1, -2))
    glue = facts.merge_meshes(g["pos"], g["pos"].withColumn("x", F.col("x") + 1e-4), 1e-3)
    assert {r.id: r.dst for r in glue.collect()} == {i: i for i in range(4)}


def test_jacobi_reaches_its_tolerance_or_raises(spark):
    m = spark.createDataFrame([(i, (i + d) % 5, a) for i in range(5) for d, a in ((0, 4.0), (1, -1.0), (4, -1.0))], "row long, col long, a double")
    b = spark.createDataFrame([(i, 2.0) for i in range(5)], "id long, b double")
    with pytest.raises(ValueError, match="no convergence in 3 steps"):
        mesh.jacobi(m, b, 3, 1e-6)
    assert all(abs(r.value - 1) < 1e-6 for r in mesh.jacobi(m, b, tolerance=1e-6).collect())
