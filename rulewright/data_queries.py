"""Registered queries of operators, functions, sources and sinks over the driver's tables, with equivalent SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, constraint, map_, multimap, param, store
from .functions import expr
from .functions import vectors as V
from .functions.options import parse_options
from .operators import maps as M
from .operators import mesh as G
from .operators import order, overset, sets, spatial, stats
from .operators.reduce import Minimum, Summation, elementwise
from .queries import _P, _points, query, r2, t
from .session import checkpoint_dir
from .sources import facts


def ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("long").alias("id"))


# -- maps and sets ------------------------------------------------------------------------------------------


@query("SELECT DISTINCT l_partkey AS id, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <> o_custkey")
def pairs_without_identity(spark, sf):
    """Pairs of two maps put together, those of an entity with itself left out."""
    pairs = M.add_pairs(t(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("dst")), t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dst")))
    return M.remove_identity(pairs).distinct()


@query("SELECT o_custkey + 7 AS id FROM orders GROUP BY 1")
def shifted_set(spark, sf):
    return sets.shift(ids(t(spark, sf, "orders"), "o_custkey").distinct(), 7)


@query("WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT c_custkey AS id FROM customer) SELECT (SELECT count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)) = 0 AS subset, (SELECT count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a)) = 0 AS superset, (SELECT count(*) FROM a) AS size, (SELECT min(id) FROM a) AS low, (SELECT max(id) FROM a) AS high, 5 IN (SELECT id FROM a) AS has_five")
def compare_sets(spark, sf):
    a, b = ids(t(spark, sf, "orders"), "o_custkey"), ids(t(spark, sf, "customer"), "c_custkey")
    return sets.compare(a, b).crossJoin(sets.describe(a)).crossJoin(sets.describe(a.where("id = 5")).select((F.col("size") > 0).alias("has_five")))  # single rows


@query("SELECT i AS id FROM range(10, 20) r(i) UNION SELECT i FROM range(15, 31) r(i) UNION SELECT 40")
def created_set(spark, sf):
    """A set from items and intervals, overlaps joined."""
    return sets.EntitySet.of((10, 19), (15, 30), 40).df(spark)


@query("SELECT row_number() OVER (ORDER BY k, n_nationkey * (1 - 2 * k)) - 1 AS pos, n_nationkey::BIGINT AS id FROM nation, (VALUES (0), (1)) v(k)")
def sequences(spark, sf):
    """A sequence and its reverse, one after the other."""
    s = sets.Sequence(tuple(r.n_nationkey for r in t(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey").collect()))  # a sequence is a driver's list; this one has a row per nation
    return (s + s.reverse()).df(spark)


@query("SELECT label, i - 1 AS pos, round(min(embedding[i])::DOUBLE, 5) AS low, round(sum(embedding[i]::DOUBLE), 3) AS total FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2")
def elementwise_reductions(spark, sf):
    """Minimum and sum of arrays position by position."""
    e = t(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    side = lambda op, name: elementwise(e, "label", "v", op).select("label", F.posexplode("value").alias("pos", name))
    return side(Minimum, "low").join(side(Summation, "total"), ["label", "pos"]).select("label", F.col("pos").cast("long").alias("pos"), F.round("low", 5).alias("low"), F.round("total", 3).alias("total"))


# -- orders and partitions ----------------------------------------------------------------------------------


@query("SELECT 8 AS parts, (SELECT count(*) FROM lineitem) AS n, true AS even")
def balanced_partitions(spark, sf):
    """Rows dealt out evenly: parts differ by fewer rows than there are source partitions and parts."""
    df = order.balance(t(spark, sf, "lineitem"), 8)
    per = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).cast("int").alias("parts"), F.sum("n").alias("n"), (F.max("n") - F.min("n") <= 64).alias("even"))


@query("SELECT 8 AS parts, (SELECT count(*) FROM embeddings) AS n, true AS even, true AS apart")
def recursive_bisection(spark, sf):
    """Halves at the median of the longest axis, three times: parts of like size, the first cut separating them."""
    p = order.bisect(_points(spark, sf), ["x", "y", "z"], 3)
    span = p.agg(*(F.max(a) - F.min(a) for a in "xyz")).first()
    axis = "xyz"[max(range(3), key=lambda i: (span[i], i))]
    per = p.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    apart = F.max(F.when(F.col("part") < 4, F.col("hi"))) <= F.min(F.when(F.col("part") >= 4, F.col("lo")))
    return per.agg(F.count(F.lit(1)).cast("int").alias("parts"), F.sum("n").alias("n"), (F.max("n") - F.min("n") <= 0.05 * F.sum("n")).alias("even"), apart.alias("apart"))


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def sorted_ranks(spark, sf):
    """Sample sort, with the place of each row: counts of the range partitions before it and its place inside."""
    return order.ranks(t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), "o_totalprice", "id").select("id", "rank")


@query("SELECT c_custkey AS cust, id, place FROM (SELECT o_custkey AS c_custkey, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def top_k_of_groups(spark, sf):
    """The three largest orders of each customer, with their places."""
    return order.top_k_by(t(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), "o_totalprice"), "cust", 3, F.desc("o_totalprice"), "id", place="place").select("cust", "id", "place")


@query("SELECT n_nationkey::BIGINT AS id, n_nationkey // 5 AS wave FROM nation")
def topological_waves(spark, sf):
    """Entities in the order of their dependencies: each waits for the one five before it."""
    n = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return order.waves(n, n.where("id >= 5").select("id", (F.col("id") - 5).alias("dst"))).select("id", F.col("wave").cast("int"))


# -- space --------------------------------------------------------------------------------------------------


@query(f"WITH p AS ({_P}) SELECT q.id, count(*) AS n FROM p q JOIN p ON (q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2 <= 0.01 * 0.01 * 25 GROUP BY 1")
def points_within_radius(spark, sf):
    """How many points lie within a radius of each, itself included."""
    p = _points(spark, sf)
    return spatial.within_radius(p, p, 0.05).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


_SOLIDS = {
    "box": (dict(x1=-0.1, y1=-0.1, z1=-0.1, x2=0.1, y2=0.2, z2=0.1), "x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.2 AND z BETWEEN -0.1 AND 0.1"),
    "sphere": (dict(x0=0.05, y0=0, z0=0, r=0.15), "(x - 0.05) ** 2 + y * y + z * z <= 0.15 ** 2"),
    "plane": (dict(x0=0.02, y0=0, z0=0, nx=1, ny=2, nz=-1), "(x - 0.02) + 2 * y - z >= 0"),
    "cylinder": (dict(x1=0, y1=0, z1=-0.1, x2=0, y2=0, z2=0.2, r=0.12), "z BETWEEN -0.1 AND 0.2 AND x * x + y * y <= 0.12 ** 2"),
    "cone": (dict(x1=0, y1=0, z1=-0.1, x2=0, y2=0, z2=0.3, r1=0.2, r2=0), "z BETWEEN -0.1 AND 0.3 AND x * x + y * y <= (0.2 - (z + 0.1) / 0.4 * 0.2) ** 2"),
}


@query(f"WITH p AS ({_P}) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM p WHERE {v[1]}" for k, v in _SOLIDS.items()))
def solid_regions(spark, sf):
    """Points inside solids."""
    out = None
    for k, (a, _) in _SOLIDS.items():
        one = _points(spark, sf).where(spatial.region(k, **a)).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "n")


@query(f"WITH p AS ({_P}), t AS (SELECT id, x * 2 + 1 AS a, -y * 3 AS b, z AS c FROM p) SELECT id, round(-b + 1, 6) AS x, round(a, 6) AS y, round(c + 2, 6) AS z FROM t")
def affine_transform(spark, sf):
    """Scale and mirror, a move, a quarter turn about z, and another move."""
    p = facts.transform(_points(spark, sf), translate=(1.0, 0.0, 0.0), scale=(2.0, 3.0, 1.0), mirror="y")
    p = facts.transform(p, translate=(1.0, 0.0, 2.0), rotate=("z", 90.0))
    return p.select("id", *(F.round(c, 6).alias(c) for c in "xyz"))


# -- functions ----------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, (p_size > 10 AND p_size <= 30)::INT AS a, (p_size = 7 OR NOT (p_size <> 9))::INT AS b, (p_size >= 20)::INT + (p_size < 5)::INT AS c, (p_size % 4)::DOUBLE AS d FROM part")
def expression_tokens(spark, sf):
    """Comparisons, logic and remainders in the expression language; truth is 1 and 0."""
    c = lambda s: expr.column(s, s=F.col("p_size").cast("double"))
    one = lambda s: c(s).cast("int")
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), one("s>10 && s<=30").alias("a"), one("s==7 || !(s!=9)").alias("b"), (one("s>=20") + one("s<5")).alias("c"), c("s%4").alias("d"))


@query("SELECT p_partkey AS id, round(sqrt(p_size + 1.0) + sin(sqrt(p_size + 1.0)), 6) AS a, round(sqrt(p_size + 1.0) * 2, 6) AS b, 1 AS shared FROM part")
def common_subexpressions(spark, sf):
    """Expressions that share a part; the part is found."""
    a, b = expr.parse("sqrt(s+1)+sin(sqrt(s+1))"), expr.parse("sqrt(s+1)*2")
    found = [n for n in expr.shared([a, b]) if str(n) == str(expr.parse("sqrt(s+1)"))]
    c = lambda n: F.round(expr.column(n, s=F.col("p_size").cast("double")), 6)
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), c(a).alias("a"), c(b).alias("b"), F.lit(len(found)).alias("shared"))


@query("SELECT l_orderkey AS k, round(l_discount ** 2.5 + l_quantity * 0, 9) AS v, round(2.5 * l_discount ** 1.5, 9) AS d, round(atan2(l_discount, 2.0), 9) AS a, round(2.0 / (l_discount * l_discount + 4.0), 9) AS da, greatest(l_discount, 0.05) AS m, CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END AS dm, round(2 / sqrt(pi()) * exp(-l_discount * l_discount), 9) AS derf FROM lineitem")
def dual_functions(spark, sf):
    """Values and derivatives by l_discount: powers, arctangents of two, maxima and the error function."""
    x, two = V.dual(F.col("l_discount"), F.lit(1.0)), V.dual(F.lit(2.0), F.lit(0.0))
    p, a, m, e = V.dual_pow(x, V.dual(F.lit(2.5), F.lit(0.0))), V.dual_atan2(x, two), V.dual_max(x, V.dual(F.lit(0.05), F.lit(0.0))), V.dual_erf(x)
    r9 = lambda c: F.round(c, 9)
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), r9(p["v"]).alias("v"), r9(p["d"]).alias("d"), r9(a["v"]).alias("a"), r9(a["d"]).alias("da"), m["v"].alias("m"), m["d"].alias("dm"), r9(e["d"]).alias("derf"))


@query("SELECT p_partkey AS id, round(3.0 * p_size + 1, 6) AS x, round(p_size / 2.0, 6) AS y, round(-1.0 * p_size, 6) AS z FROM part")
def dense_solve(spark, sf):
    """A pivoted 3 x 3 solve per row, whose right hand side is made from a known solution."""
    s = F.col("p_size").cast("double")
    x, a = (3 * s + 1, s / 2, -s), [[0.0, 2.0, 1.0], [1.0, -1.0, 3.0], [2.0, 0.5, 1.0]]
    b = F.array(*(sum((F.lit(c) * v for c, v in zip(row, x, strict=True)), F.lit(0.0)) for row in a))
    m = F.array(*(F.array(*map(F.lit, row)) for row in a))
    df = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), m.alias("a"), b.alias("b"))
    return df.select("id", V.lu_solve("a", "b", 3).alias("x")).select("id", *(F.round(F.element_at("x", i + 1), 6).alias(n) for i, n in enumerate("xyz")))


@query("SELECT i AS id, round(sin(i / 10.0), 4) AS value, round(cos(i / 10.0), 2) AS slope FROM range(1, 31) r(i)")
def splines(spark, sf):
    """A spline of the sine and its slope."""
    s = V.Spline(math.sin, 0.0, math.pi + 0.1, 1e-8)
    rows = [(i, float(s(i / 10)), float(s.slope(i / 10))) for i in range(1, 31)]
    return spark.createDataFrame(rows, "id long, value double, slope double").select("id", F.round("value", 4).alias("value"), F.round("slope", 2).alias("slope"))


@query("SELECT c_custkey AS id, round(c_acctbal * 0.3048, 4) AS meters, 'symmetry' AS kind FROM customer")
def options_in_use(spark, sf):
    """A list of options with units, read by name, one of them a nested call."""
    o = parse_options("<scale=1 ft, kind=symmetry, wall=specified(Twall=500K)>")
    scale = o.get_units("scale", "m")
    assert o.check("kind", "symmetry") and o.exists("wall")
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") * scale, 4).alias("meters"), F.lit("symmetry").alias("kind"))


@query("SELECT vec_id AS id, round(sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2) / 340, 6) AS mach, round(embedding[4]::DOUBLE + 101325, 4) AS pressure, round(embedding[2]::DOUBLE, 6) AS v FROM embeddings")
def derived_variables(spark, sf):
    """Mach number, absolute pressure and a component from velocity, speed of sound and gauge pressure."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    df = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), at(1).alias("u"), at(2).alias("v"), at(3).alias("w"), F.lit(340.0).alias("a"), at(4).alias("pg"))
    return df.select("id", F.round(stats.derived("m"), 6).alias("mach"), F.round(stats.derived("P", 101325.0), 4).alias("pressure"), F.round(stats.derived("1"), 6).alias("v"))


@query("SELECT l_returnflag AS flag, round(sum(l_quantity), 2) AS mass, round(sum(l_quantity * l_discount) / sum(l_quantity), 8) AS favre, round(sum(l_quantity * l_discount * l_discount) / sum(l_quantity) - (sum(l_quantity * l_discount) / sum(l_quantity)) ** 2, 8) AS favre_var FROM lineitem GROUP BY 1")
def favre_combined(spark, sf):
    """Density-weighted means and variances of spans, put together."""
    li = t(spark, sf, "lineitem").withColumn("span", F.concat_ws(":", "l_returnflag", (F.col("l_orderkey") % 5).cast("string")))
    parts = stats.favre(li, "span", "l_quantity", ["l_discount"]).join(li.groupBy("span").agg(F.first("l_returnflag").alias("flag"), F.sum("l_quantity").alias("w")), "span")
    out = stats.favre_combine(parts, "flag", "w", "favre_l_discount", "favre_var_l_discount")
    return out.select("flag", r2(F.col("mass")).alias("mass"), F.round("favre", 8).alias("favre"), F.round("favre_var", 8).alias("favre_var"))


@query("SELECT event_type, u, v, w, round(cov, 3) AS cov FROM (SELECT event_type, round(avg(value), 4) AS u, round(avg(user_id), 4) AS v, round(avg(value * 2), 4) AS w, covar_pop(value, value * 2) AS cov FROM events GROUP BY 1)")
def vector_covariance(spark, sf):
    c = stats.covariance(t(spark, sf, "events").withColumn("w", F.col("value") * 2), "event_type", "value", "user_id", "w")
    return c.select("event_type", F.round("mean_value", 4).alias("u"), F.round("mean_user_id", 4).alias("v"), F.round("mean_w", 4).alias("w"), F.round("cov_uw", 3).alias("cov"))


@query("SELECT 4 AS same, 1 AS differs FROM range(1)")
def compared_columns(spark, sf):
    """Columns of two tables held against each other by their relative rms difference; one was changed."""
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), *(F.col("c_acctbal").alias(n) for n in "abcd"), F.col("c_acctbal").alias("e"))
    out = stats.compare_columns(c, c.withColumn("e", F.col("e") * 1.001), "id", list("abcde"), 1e-12, 1e-6)
    return out.agg(F.sum(F.col("agree").cast("int")).cast("int").alias("same"), F.sum((~F.col("agree")).cast("int")).cast("int").alias("differs"))


@query("SELECT p_partkey AS id, round(p_retailprice * 100000, 3) AS dynes, round(p_size * 30.48::DOUBLE, 6) AS centimeters, 10.0::DOUBLE AS erg FROM part")
def cgs_units(spark, sf):
    """Newtons as dynes, feet as centimetres, and a quantity read from text."""
    from .functions import units

    p = t(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(units.to_cgs(F.col("p_retailprice"), "N"), 3).alias("dynes"), F.round(units.to_cgs(F.col("p_size").cast("double"), "ft"), 6).alias("centimeters"), F.lit(round(units.parse_quantity("1e-6 J").cgs, 9)).alias("erg"))


_XYZ = "embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z"


@query(f"SELECT label, round(sum(x), 4) AS sx, round(sum(z), 4) AS sz, round(max(x), 6) AS hx, round(max(y), 6) AS hy, round(min(y), 6) AS ly, round(min(z), 6) AS lz FROM (SELECT label, {_XYZ} FROM embeddings) GROUP BY 1")
def vector_reductions(spark, sf):
    """Sum, maximum and minimum of vectors component by component, in one pass."""
    from .operators.reduce import MaxMinVector, SumMaxMinVector

    at = lambda i: F.element_at("embedding", i).cast("double")
    v = t(spark, sf, "embeddings").select("label", V.vec(at(1), at(2), at(3)).alias("v"))
    r = v.groupBy("label").agg(SumMaxMinVector.aggregate(F.col("v")).alias("s"), MaxMinVector.aggregate(F.col("v")).alias("m"))
    out = {"sx": ("s.sum.x", 4), "sz": ("s.sum.z", 4), "hx": ("s.max.x", 6), "hy": ("m.max.y", 6), "ly": ("m.min.y", 6), "lz": ("s.min.z", 6)}
    return r.select("label", *(F.round(c, k).alias(n) for n, (c, k) in out.items()))


@query(f"SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(1 - (x + 1) / 2 - (y + 1) / 2 - (z + 1) / 2, 6) AS first, x + y + z <= -1 AND x >= -1 AND y >= -1 AND z >= -1 AS inside FROM (SELECT vec_id AS id, {_XYZ} FROM embeddings)")
def tetra_interpolation(spark, sf):
    """Positions interpolated from a tetrahedron's corners by a point's weights, and whether it lies inside."""
    corner = [V.vec(*(F.lit(float(c)) for c in p)) for p in ((-1, -1, -1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1))]
    p = _points(spark, sf).select("id", F.struct("x", "y", "z").alias("p"))
    w = p.select("id", spatial.tetra_weights(F.col("p"), *corner).alias("w"))
    mean = lambda k: sum((F.get("w", F.lit(i)) * c[k] for i, c in enumerate(corner)), F.lit(0.0))
    return w.select("id", *(F.round(mean(k), 6).alias(k) for k in "xyz"), F.round(F.get("w", F.lit(0)), 6).alias("first"), F.forall("w", lambda x: x >= -1e-15).alias("inside"))


@query("SELECT count(*) AS n, true AS inside, true AS repeats, true AS differs, true AS centred FROM orders")
def seeded_random(spark, sf):
    """Uniform numbers by entity and seed: the same whenever and wherever they are asked for, others for another seed."""
    o = ids(t(spark, sf, "orders"), "o_orderkey")
    u = V.uniform(F.col("id"), 7)
    again = o.repartition(5).select("id", u.alias("w"), V.uniform(F.col("id"), 8).alias("o"))
    j = o.select("id", u.alias("u")).join(again, "id")
    return j.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("u") >= 0) & (F.col("u") < 1)).alias("inside"), F.bool_and(F.col("u") == F.col("w")).alias("repeats"), F.bool_or(F.col("u") != F.col("o")).alias("differs"), F.abs(F.avg("u") - 0.5).between(0, 0.05).alias("centred"))


# -- sources and sinks --------------------------------------------------------------------------------------


@query("SELECT name, value FROM (VALUES ('stop', '4'), ('note', 'warm'), ('time', '0.5')) v(name, value)")
def variable_file(spark, sf):
    """Settings written to a variable file and read as params."""
    at = checkpoint_dir(spark, "vars")
    spark.createDataFrame([("{\n stop: 4 // steps\n note: warm\n time: 0.5\n}\n",)], "value string").coalesce(1).write.text(at)
    c = Catalog()
    names = facts.read_vars(spark, at, c)
    return spark.createDataFrame([(n, f"{c.get(n).literal:g}" if isinstance(c.get(n).literal, (int, float)) else str(c.get(n).literal)) for n in names], "name string, value string")


def _saved(spark, sf):
    c = Catalog()
    o = t(spark, sf, "orders")
    c.create("total", store(o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")), "orders"))
    c.create("cust", map_(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dst")), "orders"))
    c.create("orders_of", multimap(M.inverse(c.get("cust").df()), "customers"))
    c.create("open", constraint(o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id")), "orders"))
    c.create("limit", param(250.5))
    return c


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS total, o_custkey AS cust, o_orderstatus = 'O' AS open, pos, 250.5::DOUBLE AS most FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)")
def fact_store(spark, sf):
    """Containers of every kind written as a fact store and read back."""
    at = checkpoint_dir(spark, "facts")
    facts.write_catalog(_saved(spark, sf), at)
    c = facts.read_catalog(spark, at)
    assert {str(v): r.frame.key_space for v, r in c.facts.items() if r.frame}["orders_of"] == "customers"
    out = c.get("total").df().join(c.get("cust").df().withColumnRenamed("dst", "cust"), "id").join(c.get("open").df().withColumn("open", F.lit(True)), "id", "left")
    lists = c.get("orders_of").df().select(F.col("dst").alias("id"), F.col("pos").cast("long").alias("pos"))
    return out.join(lists, "id").select("id", r2(F.col("value")).alias("total"), "cust", F.coalesce("open", F.lit(False)).alias("open"), "pos", F.lit(facts.read_parameter(spark, at, "limit")).alias("most"))


@query("SELECT fact, n FROM (VALUES ('cust', (SELECT count(*) FROM orders)), ('limit', 1), ('open', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O')), ('orders_of', (SELECT count(*) FROM orders)), ('total', (SELECT count(*) FROM orders))) v(fact, n)")
def fact_text(spark, sf):
    """Containers written as text, a JSON line per row from the executors, and read back."""
    at = checkpoint_dir(spark, "text")
    facts.write_text(_saved(spark, sf), at)
    c = facts.read_text_facts(spark, at)
    back = c.get("total").df().join(t(spark, sf, "orders"), F.col("id") == F.col("o_orderkey")).where("value <> o_totalprice").count()
    assert back == 0 and c.get("limit").df().first()[0] == 250.5
    out = None
    for v, r in c.facts.items():
        one = r.df().agg(F.lit(str(v)).alias("fact"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.select("fact", "n")


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS value, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS file_id FROM orders")
def numbered_container(spark, sf):
    """A container written in a file order of its own and read back by its numbering."""
    at = checkpoint_dir(spark, "numbered")
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), r2(F.col("o_totalprice")).alias("value"))
    numbering = order.ranks(o.select("id", (-F.col("id")).alias("k")), "k").select("id", (F.col("rank") - 1).alias("file_id"))
    facts.write_numbered(o, numbering, at)
    return facts.read_numbered(spark.read.parquet(at), numbering).join(numbering, "id").select("id", "value", "file_id")


@query("SELECT vec_id AS id, i - 1 AS pos, round(embedding[i]::DOUBLE, 5) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def vector_container(spark, sf):
    """Arrays of numbers per entity, written and read."""
    at = checkpoint_dir(spark, "vectors")
    v = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("value"))
    facts.write_vectors(v, at)
    return facts.read_vectors(spark, at).select("id", F.posexplode("value").alias("pos", "value")).select("id", F.col("pos").cast("long").alias("pos"), F.round("value", 5).alias("value"))


@query("SELECT p_partkey AS id, p_size::BIGINT AS size, round(p_retailprice, 2) AS price FROM part")
def ascii_table(spark, sf):
    """A space-separated table without a header."""
    at = checkpoint_dir(spark, "ascii")
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"), r2(F.col("p_retailprice")).alias("price"))
    facts.write_ascii(p, at, "id", "size", "price")
    return spark.read.option("sep", " ").schema("id long, size long, price double").csv(at)


@query("SELECT 'POINTS' AS part, 27 AS n UNION ALL SELECT 'CELLS', 8 UNION ALL SELECT 'SCALARS', 27 UNION ALL SELECT 'NODES', 64")
def vtk_export(spark, sf):
    """A grid written by the executors as a VTK file's parts, counted as they are read back."""
    at = checkpoint_dir(spark, "vtk")
    m = G.hex_grid(spark, 2)
    facts.write_vtk(m.pos, G.hex_cells(spark, 2), {"height": m.pos.select("id", F.col("z").alias("value"))}, at)
    rows = spark.read.text(at).select(F.split("value", " ").alias("w"))
    heads = {r["w"][0]: int(r["w"][1]) for r in rows.where(F.element_at("w", 1).isin("POINTS", "CELLS")).collect()}  # two header lines
    nodes = rows.where(F.size("w") == 9).agg(F.sum(F.size("w") - 1)).first()[0]
    values = rows.where((F.size("w") == 1) & F.col("w")[0].rlike("^[0-9.]+$")).count() - heads["CELLS"]
    return spark.createDataFrame([("POINTS", heads["POINTS"]), ("CELLS", heads["CELLS"]), ("SCALARS", values), ("NODES", int(nodes))], "part string, n int")


# -- overset ------------------------------------------------------------------------------------------------


@query(f"WITH p AS ({_P}) SELECT id, CASE WHEN x * x + y * y + z * z <= 0.01 THEN 'cut' ELSE 'open' END AS state FROM p")
def overset_holes(spark, sf):
    """Cells of one component inside the hole of another are cut."""
    p = _points(spark, sf).select("id", F.lit("background").alias("component"), F.struct("x", "y", "z").alias("center"))
    none = p.select("id", F.col("id").alias("dst")).where("false")
    out = overset.cut_holes(p, none, {"body": spatial.region("sphere", x0=0, y0=0, z0=0, r=0.1)})
    return out.select("id", F.when(F.col("iblank") == overset.SOLVED, "open").otherwise("cut").alias("state"))
