"""Registered queries of the engine and its operators over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, constraint, map_, multimap, param, store
from .engine import Engine, wavefront
from .functions import expr, units
from .functions import vectors as V
from .operators import maps as M
from .operators import mesh as G
from .operators import order, sets, spatial, stats
from .operators.reduce import LogicalAnd, LogicalOr, Maximum, MaxMin, Minimum, SetUnion, Summation, elementwise, reduce_global

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r2(c):
    return F.round(c, 2)


def sales(spark: SparkSession, sf: str) -> Engine:
    """Lines, orders, customers and nations as containers; keys of different tables are different key spaces."""
    c = Catalog()
    lines = t(spark, sf, "lineitem").withColumn("k", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    c.table(lines, "k", {"price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "quantity": "l_quantity", "flag": "l_returnflag", "linestatus": "l_linestatus"}, {"order": "l_orderkey", "part": "l_partkey"}, "lines", "lines")
    c.table(t(spark, sf, "orders"), "o_orderkey", {"status": "o_orderstatus", "total": "o_totalprice"}, {"cust": "o_custkey"}, "orders", "orders")
    c.table(t(spark, sf, "customer"), "c_custkey", {"balance": "c_acctbal", "segment": "c_mktsegment"}, {"nation": "c_nationkey"}, "customers", "customers")
    c.table(t(spark, sf, "nation"), "n_nationkey", {"nation_name": "n_name"}, {"region": "n_regionkey"}, "nations", "nations")
    c.table(t(spark, sf, "part"), "p_partkey", {"brand": "p_brand", "retail": "p_retailprice", "size": "p_size"}, {}, "parts", "parts")
    e = Engine(spark, c)
    e.rules.pointwise("revenue <- price, discount", comments="net of discount")(lambda p, d: p * (1 - d))
    return e


LINE = "SELECT l_orderkey * 8 + l_linenumber AS id"


@query("SELECT n.n_nationkey::BIGINT AS id, round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0), 2) AS revenue FROM nation n LEFT JOIN customer c ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def revenue_by_nation(spark, sf):
    e = sales(spark, sf)
    e.rules.pointwise("line_nation <- order->cust->nation")(lambda n: n)
    e.rules.unit("nation_revenue", 0.0, constraint="nations")
    e.rules.apply("line_nation->nation_revenue <- revenue", Summation)(lambda r: r)
    return e.query("nation_revenue").select("id", r2(F.col("value")).alias("revenue"))


@query("SELECT round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def pointwise_charge(spark, sf):
    e = sales(spark, sf)
    e.rules.pointwise("charge <- revenue, tax")(lambda r, x: r * (1 + x))
    return e.query("charge").select(F.round("value", 6).alias("charge"))


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) AS value FROM lineitem")
def singleton_ratio(spark, sf):
    e = sales(spark, sf)
    for name, source in (("total_revenue", "revenue"), ("total_quantity", "quantity")):
        e.rules.unit(name, 0.0)
        e.rules.apply(f"{name} <- {source}", Summation)(lambda x: x)
    e.rules.singleton("mean_price <- total_revenue, total_quantity")(lambda a, b: a / b)
    return e.query("mean_price").select(F.round("value", 6).alias("value"))


@query("SELECT c_custkey AS id, count(o_orderkey) AS orders, coalesce(round(max(o_totalprice), 2), -1) AS largest, coalesce(round(min(o_totalprice), 2), -1) AS smallest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def unit_apply_reducers(spark, sf):
    e = sales(spark, sf)
    for name, start, op, body in (("n_orders", 0, Summation, lambda x: F.lit(1)), ("largest", None, Maximum, lambda x: x), ("smallest", None, Minimum, lambda x: x)):
        e.rules.unit(name, F.lit(start) if start is not None else F.lit(None).cast("double"), constraint="customers")
        e.rules.apply(f"cust->{name} <- total", op)(body)
    q = e.query("n_orders, largest, smallest")
    out = q["n_orders"].select("id", F.col("value").cast("long").alias("orders"))
    for name in ("largest", "smallest"):
        out = out.join(q[name].select("id", F.coalesce(r2(F.col("value")), F.lit(-1.0)).alias(name)), "id")
    return out


@query("SELECT c_custkey AS id, coalesce(bool_or(o_orderstatus = 'F'), false) AS some_f, coalesce(bool_and(o_orderstatus = 'F'), true) AS all_f FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def logical_reductions(spark, sf):
    e = sales(spark, sf)
    for name, start, op in (("some_f", False, LogicalOr), ("all_f", True, LogicalAnd)):
        e.rules.unit(name, start, constraint="customers")
        e.rules.apply(f"cust->{name} <- status", op)(lambda s: s == "F")
    q = e.query("some_f, all_f")
    return q["some_f"].withColumnRenamed("value", "some_f").join(q["all_f"].withColumnRenamed("value", "all_f"), "id")


@query("SELECT l_returnflag AS flag, l_linestatus AS linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2")
def pricing_summary(spark, sf):
    e = sales(spark, sf)
    q = e.relations("flag, linestatus, quantity, price, discount, revenue")
    df = q["flag"].frame.df.select(*(r.value.alias(n) for n, r in q.items()))  # one frame: no join
    return df.groupBy("flag", "linestatus").agg(r2(F.sum("quantity")).alias("sum_qty"), r2(F.sum("price")).alias("sum_base"), r2(F.sum("revenue")).alias("sum_disc"), F.round(F.avg("discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT round(sum(l_extendedprice), 2) AS total, round(max(l_extendedprice), 2) AS top, round(min(l_quantity), 2) AS low FROM lineitem")
def batched_params(spark, sf):
    out = reduce_global(t(spark, sf, "lineitem"), {"total": ("l_extendedprice", Summation), "top": ("l_extendedprice", Maximum), "low": ("l_quantity", Minimum)})
    return out.select(*(r2(F.col(c)).alias(c) for c in out.columns))


@query("SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderstatus))::VARCHAR AS statuses, round(max(o_totalprice), 2) AS hi, round(min(o_totalprice), 2) AS lo FROM orders GROUP BY 1")
def user_functor_reductions(spark, sf):
    o = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(SetUnion.aggregate(F.array("o_orderstatus")).alias("s"), MaxMin.aggregate(F.col("o_totalprice")).alias("m"))
    return o.select("id", F.concat(F.lit("["), F.array_join("s", ", "), F.lit("]")).alias("statuses"), r2(F.col("m.max")).alias("hi"), r2(F.col("m.min")).alias("lo"))


@query("SELECT label, i - 1 AS pos, round(max(embedding[i])::DOUBLE, 5) AS value FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2")
def elementwise_maximum(spark, sf):
    """The maximum of every component."""
    e = t(spark, sf, "embeddings").select("label", F.col("embedding").alias("v"))
    return elementwise(e, "label", "v", Maximum).select("label", F.posexplode("value").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), F.round(F.col("v").cast("double"), 5).alias("value"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')")
def for_all_vacuous(spark, sf):
    """Customers all of whose orders are final; those without orders qualify."""
    o = t(spark, sf, "orders")
    pairs = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("dst"))
    final = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return M.preimage_all(pairs, final, t(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS dst FROM orders")
def inverse_map(spark, sf):
    return M.inverse(t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dst"))).select("id", F.col("pos").cast("long").alias("pos"), "dst")


@query("SELECT o_orderkey AS id, c_nationkey::BIGINT AS dst FROM orders JOIN customer ON c_custkey = o_custkey")
def compose_maps(spark, sf):
    a = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dst"))
    return M.compose(a, t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("dst")))


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'")
def image_of_set(spark, sf):
    o = t(spark, sf, "orders")
    return M.image(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dst")), o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")))


@query("SELECT DISTINCT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0")
def preimage_any(spark, sf):
    poor = t(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return M.preimage_any(t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dst")), poor)


@query("SELECT DISTINCT a.l_suppkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey")
def pair_join(spark, sf):
    li = t(spark, sf, "lineitem")
    return M.join_pairs(li.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("dst")), li.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("dst")))


@query("SELECT c_custkey AS id, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def multimap_source(spark, sf):
    """A list per customer, empty lists included, read through a multimap."""
    e = sales(spark, sf)
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dst"))
    e.catalog.create("orders_of", multimap(M.inverse(o), "customers", t(spark, sf, "customer").select(F.col("c_custkey").alias("id"))))
    e.rules.pointwise("spent <- orders_of->total")(lambda l: F.aggregate(l, F.lit(0.0), lambda s, x: s + x))
    return e.query("spent").select("id", r2(F.col("value")).alias("spent"))


@query("SELECT c_custkey AS id FROM customer WHERE NOT (c_acctbal < 0) AND (c_mktsegment = 'BUILDING' OR c_nationkey < 5)")
def constraint_algebra(spark, sf):
    e = sales(spark, sf)
    e.catalog.create("entities.customers", constraint(t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "customers"))
    e.rules.constraint("poor <- balance")(lambda b: b < 0)
    e.rules.constraint("builders <- segment")(lambda s: s == "BUILDING")
    e.rules.constraint("near <- nation")(lambda n: n < 5)
    return e.query("AND(NOT(poor),OR(builders,near))")


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 AND o_orderstatus = 'O'")
def constrained_rule(spark, sf):
    e = sales(spark, sf)
    e.rules.constraint("poor <- balance")(lambda b: b < 0)
    e.rules.constraint("open <- status")(lambda s: s == "O")
    e.rules.pointwise("risk <- total", constraint="open, cust->poor")(lambda x: x)
    return e.query("risk").select("id")


@query("SELECT p_partkey AS id, round(CASE WHEN p_brand = 'Brand#11' THEN p_retailprice * 0.5 WHEN p_size > 40 THEN p_retailprice * 0.8 ELSE p_retailprice END, 2) AS price FROM part")
def priority_override(spark, sf):
    e = sales(spark, sf)
    e.rules.constraint("large <- size")(lambda s: s > 40)
    e.rules.constraint("house_brand <- brand")(lambda b: b == "Brand#11")
    e.rules.pointwise("list_price <- retail")(lambda p: p)
    e.rules.pointwise("bulk::list_price <- retail", constraint="large")(lambda p: p * 0.8)
    e.rules.pointwise("promo::bulk::list_price <- retail", constraint="house_brand")(lambda p: p * 0.5)
    return e.query("list_price").select("id", r2(F.col("value")).alias("price"))


@query("SELECT o_orderkey AS id, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice * 1.1 END, 3) AS due FROM orders")
def disjoint_union(spark, sf):
    e = sales(spark, sf)
    e.rules.constraint("final <- status")(lambda s: s == "F")
    e.rules.constraint("pending <- status")(lambda s: s != "F")
    e.rules.pointwise("due <- total", constraint="final")(lambda x: x)
    e.rules.pointwise("due <- total", constraint="pending")(lambda x: x * 1.1)
    return e.query("due").select("id", F.round("value", 3).alias("due"))


@query("SELECT n_nationkey::BIGINT AS id, round(coalesce(avg(c_acctbal), 0), 6) AS mean FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def parametric_rules(spark, sf):
    e = sales(spark, sf)
    r = e.rules
    r.unit("sum_of(X)", 0.0, constraint="nations", parametric="X")
    r.apply("nation->sum_of(X) <- X", Summation, parametric="X")(lambda x: x)
    r.unit("count_of(X)", 0, constraint="nations", parametric="X")
    r.apply("nation->count_of(X) <- X", Summation, parametric="X")(lambda x: F.lit(1))
    r.pointwise("mean_of(X) <- sum_of(X), count_of(X)", parametric="X")(lambda s, n: F.when(n > 0, s / n).otherwise(0.0))
    return e.query("mean_of(balance)").select("id", F.round("value", 6).alias("mean"))


@query("SELECT c_custkey AS id, round(c_acctbal * 2 + 10, 2) AS value FROM customer")
def defaults_optionals_namespaces(spark, sf):
    from .rules import RuleBase

    def module(scale):
        m = RuleBase()
        m.default("offset", 1.0)
        m.optional("extra")
        m.pointwise("scaled <- balance, offset")(lambda b, o: b * scale + o)
        return m

    e = sales(spark, sf)
    e.load(module, namespace="finance", scale=2)
    e.catalog.create("offset", param(10.0), namespace="finance")
    return e.query("finance@scaled").select("id", r2(F.col("value")).alias("value"))


@query("WITH RECURSIVE s(k, id, v) AS (SELECT 0, c_custkey, c_acctbal FROM customer UNION ALL SELECT k + 1, id, (v + avg(v) OVER (PARTITION BY c_nationkey)) / 2 FROM s JOIN customer ON c_custkey = id WHERE k < 4) SELECT id, round(v, 2) AS smoothed FROM s WHERE k = 4")
def iterate_smoothing(spark, sf):
    """Build, advance and collapse: four steps of smoothing balances towards the nation's mean."""
    e = sales(spark, sf)
    r = e.rules
    r.default("steps", 4)
    r.pointwise("s{n=0} <- balance")(lambda b: b)
    r.unit("sum{n}", 0.0, constraint="nations")
    r.apply("nation->sum{n} <- s{n}", Summation)(lambda x: x)
    r.unit("cnt{n}", 0, constraint="nations")
    r.apply("nation->cnt{n} <- s{n}", Summation)(lambda x: F.lit(1))
    r.pointwise("s{n+1} <- s{n}, nation->sum{n}, nation->cnt{n}")(lambda x, t, c: (x + t / c) / 2)
    r.singleton("done{n} <- $n, steps")(lambda n, k: n >= k)
    r.pointwise("smoothed <- s{n}", conditional="done{n}")(lambda x: x)
    return e.query("smoothed").select("id", r2(F.col("value")).alias("smoothed"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey::BIGINT AS id, ((n_nationkey * 7 + 3) % 25)::BIGINT AS dst FROM nation), w(id, wave) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, wave + 1 FROM w JOIN e USING (id) WHERE wave < 30) SELECT id, min(wave) AS wave FROM w GROUP BY 1")
def recursion_wavefront(spark, sf):
    n = t(spark, sf, "nation")
    edges = n.select(F.col("n_nationkey").cast("long").alias("id"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("dst"))
    return wavefront(spark.range(1), edges)


@query("SELECT count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) FROM customer WHERE c_acctbal < 0)")
def dynamic_key_space(spark, sf):
    """Insertion mints keys after the largest, deletion removes entities of every container of the key space."""
    e = sales(spark, sf)
    o = t(spark, sf, "orders")
    e.insert({"total": "c_acctbal"}, t(spark, sf, "customer").where("c_acctbal < 0"), "orders")
    e.delete(o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")), "orders")
    return e.catalog.get("total").df().agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("(SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0) EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def set_algebra(spark, sf):
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    a = sets.union(o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id")), c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))
    return sets.difference(a, c.where("c_nationkey = 3").select(F.col("c_custkey").alias("id")))


@query("WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), g AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM a) SELECT min(id) AS low, max(id) AS high FROM g GROUP BY g")
def set_intervals(spark, sf):
    return sets.intervals(t(spark, sf, "orders").select(F.col("o_custkey").alias("id")))


@query("(SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 EXCEPT SELECT o_custkey FROM orders) UNION (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def set_symmetric_difference(spark, sf):
    return sets.symmetric_difference(t(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id")), t(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct())


@query("SELECT event_type, round(avg(value), 6) AS mean_value, round(var_pop(value), 4) AS var_value FROM events GROUP BY 1")
def mean_variance(spark, sf):
    m = stats.mean_variance(t(spark, sf, "events"), "event_type", ["value"])
    return m.select("event_type", F.round("mean_value", 6).alias("mean_value"), F.round("var_value", 4).alias("var_value"))


@query("SELECT event_type, round(covar_pop(value, user_id), 2) AS cov_uv, round(var_pop(user_id), 2) AS var_v FROM events GROUP BY 1")
def covariance(spark, sf):
    c = stats.covariance(t(spark, sf, "events").withColumn("w", F.col("value") * 2), "event_type", "value", "user_id", "w")
    return c.select("event_type", r2(F.col("cov_uv")).alias("cov_uv"), r2(F.col("var_user_id")).alias("var_v"))


@query("SELECT l_returnflag AS flag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS favre FROM lineitem GROUP BY 1")
def favre_average(spark, sf):
    f = stats.favre(t(spark, sf, "lineitem"), "l_returnflag", "l_quantity", ["l_discount"])
    return f.select(F.col("l_returnflag").alias("flag"), F.round("favre_l_discount", 6).alias("favre"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS var FROM events GROUP BY 1")
def combine_averages(spark, sf):
    part = t(spark, sf, "events").groupBy("event_type", (F.col("event_id") % 4).alias("span")).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    c = stats.combine(part, "event_type", "n", "m", "v")
    return c.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"))


@query("SELECT round(sum(abs(l_discount) * l_quantity) / sum(l_quantity), 6) AS L1, round(sqrt(sum(l_discount * l_discount * l_quantity) / sum(l_quantity)), 6) AS L2, max(abs(l_discount)) AS Linf FROM lineitem")
def field_norms(spark, sf):
    n = t(spark, sf, "lineitem").agg(*stats.norms(F.col("l_discount"), F.col("l_quantity")))
    return n.select(F.round("L1", 6).alias("L1"), F.round("L2", 6).alias("L2"), "Linf")


@query(f"{LINE}, round(sqrt(l_extendedprice) * exp(-l_discount) + ln(l_quantity) / pi() + pow(l_tax, 2), 6) AS value FROM lineitem")
def expression_language(spark, sf):
    c = expr.column("sqrt(l_extendedprice)*exp(-l_discount)+ln(l_quantity)/pi+pow(l_tax,2)")
    return t(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.round(c, 6).alias("value"))


@query(f"{LINE}, round(2 * l_quantity * sin(l_discount) , 6) AS value FROM lineitem")
def symbolic_derivative(spark, sf):
    d = expr.derivative(expr.parse("x*x*sin(y)"), "x")
    c = expr.column(d, x=F.col("l_quantity"), y=F.col("l_discount"))
    return t(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.round(c, 6).alias("value"))


@query("SELECT p_partkey AS id, round(p_size * 0.3048::DOUBLE, 6) AS meters, round((p_retailprice + 459.67) / 1.8, 4) AS kelvin FROM part")
def unit_conversion(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(units.convert(F.col("p_size").cast("double"), "ft", "m"), 6).alias("meters"), F.round(units.convert(F.col("p_retailprice"), "F", "K"), 4).alias("kelvin"))


@query("SELECT vec_id AS id, round(sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2), 5) AS norm, round(embedding[1]::DOUBLE * embedding[5]::DOUBLE - embedding[2]::DOUBLE * embedding[4]::DOUBLE, 5) AS cross_z FROM embeddings")
def vector_algebra(spark, sf):
    at = lambda i: F.element_at("embedding", i).cast("double")
    e = t(spark, sf, "embeddings").select("vec_id", V.vec(at(1), at(2), at(3)).alias("a"), V.vec(at(4), at(5), at(6)).alias("b"))
    return e.select(F.col("vec_id").alias("id"), F.round(V.norm(F.col("a")), 5).alias("norm"), F.round(V.cross(F.col("a"), F.col("b"))["z"], 5).alias("cross_z"))


@query(f"{LINE}, round(cos(l_quantity) * 2 * l_quantity * l_quantity + sin(l_quantity) * 2 * l_quantity, 6) AS slope FROM lineitem" .replace("cos(l_quantity) * 2 * l_quantity * l_quantity", "cos(l_quantity) * l_quantity * l_quantity"))
def automatic_differentiation(spark, sf):
    x = V.dual(F.col("l_quantity"), F.lit(1.0))
    y = V.dual_mul(V.dual_apply("sin", x), V.dual_mul(x, x))
    return t(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.round(y["d"], 6).alias("slope"))


def _points(spark, sf):
    e = t(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *(F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate("xyz")))


_P = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"


@query(f"WITH p AS ({_P}), d AS (SELECT q.id, p.id AS near, (q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2 AS d2 FROM p q JOIN p ON q.id <> p.id) SELECT id, arg_min(near, (d2, near)) AS near, round(min(d2), 9) AS d2 FROM d GROUP BY 1")
def nearest_neighbour(spark, sf):
    """The nearest other point of every one; the points are the first three components of the vectors, here and in the other queries in space."""
    p = _points(spark, sf)
    return spatial.nearest(p, p, 0.05, others=True).select("id", "near", F.round("d2", 9).alias("d2"))


_BOX = "SELECT n_nationkey AS box, -0.2 + n_nationkey * 0.01 AS xlo, n_nationkey * 0.01 AS xhi, -0.1 AS ylo, 0.1 AS yhi, -0.15 AS zlo, 0.15 AS zhi FROM nation"


@query(f"WITH p AS ({_P}), b AS ({_BOX}) SELECT box, count(p.id) AS n FROM b LEFT JOIN p ON x BETWEEN xlo AND xhi AND y BETWEEN ylo AND yhi AND z BETWEEN zlo AND zhi GROUP BY 1")
def range_join(spark, sf):
    b = t(spark, sf, "nation").select(F.col("n_nationkey").alias("box"), (F.lit(-0.2) + F.col("n_nationkey") * 0.01).alias("xlo"), (F.col("n_nationkey") * 0.01).alias("xhi"), F.lit(-0.1).alias("ylo"), F.lit(0.1).alias("yhi"), F.lit(-0.15).alias("zlo"), F.lit(0.15).alias("zhi"))
    return spatial.count_boxes(_points(spark, sf), b, 0.1)


@query(f"WITH p AS ({_P}) SELECT id FROM p WHERE x * x + y * y + z * z <= 0.04 AND NOT (x >= 0)")
def region_filter(spark, sf):
    return _points(spark, sf).where(spatial.region("sphere", x0=0, y0=0, z0=0, r=0.2) & ~spatial.region("plane", x0=0, y0=0, z0=0, nx=1, ny=0, nz=0)).select("id")


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark, sf):
    return order.top_k(t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), r2(F.col("o_totalprice")).alias("total"), F.col("o_totalprice").alias("k")), 100, F.desc("k"), "id").drop("k")


@query("SELECT o_orderkey AS id FROM orders")
def sample_sort(spark, sf):
    return order.sample_sort(t(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id")


@query("SELECT id, x, y FROM (SELECT id, id % 16 AS x, id // 16 AS y FROM range(256) r(id))")
def hilbert_order(spark, sf):
    """Grid cells along the curve; the order itself is checked by tests."""
    g = spark.range(256).select("id", (F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    return g.withColumn("h", order.hilbert([F.col("x"), F.col("y")], 4)).repartitionByRange(4, "h").drop("h")


@query("SELECT CASE WHEN l_returnflag = 'A' THEN 'early' WHEN l_quantity > 25 THEN 'large' ELSE 'rest' END AS zone, count(*) AS n FROM lineitem GROUP BY 1")
def initial_regions(spark, sf):
    zone = F.when(F.col("l_returnflag") == "A", "early").when(F.col("l_quantity") > 25, "large").otherwise("rest")
    return t(spark, sf, "lineitem").groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"))


def _grid(spark, n=4):
    m = G.hex_grid(spark, n)
    f = G.face_metrics(m)
    return m, f, G.cell_metrics(f)


@query("SELECT 64 AS cells, 1.0::DOUBLE AS volume, 0.015625::DOUBLE AS min_volume, 0.015625::DOUBLE AS max_volume, 240 AS faces, 0.0::DOUBLE AS closure")
def mesh_metrics(spark, sf):
    _, f, c = _grid(spark)
    q = G.quality_report(f, c)
    return q.select(F.col("cells").cast("int"), F.round("volume", 9).alias("volume"), F.round("min_volume", 9).alias("min_volume"), F.round("max_volume", 9).alias("max_volume"), F.col("faces").cast("int"), F.abs(F.round("closure", 9)).alias("closure"))


def _linear(spark):
    m, f, c = _grid(spark)
    q = lambda p: F.col(f"{p}.x") * 2 - F.col(f"{p}.y") * 3 + F.col(f"{p}.z") * 0.5 + 1
    return m, f.withColumn("qb", q("center")), c.withColumn("q", q("center"))


_EXACT = "SELECT i AS id, 2.0::DOUBLE AS gx, -3.0::DOUBLE AS gy, 0.5::DOUBLE AS gz FROM range(64) r(i)"


@query(_EXACT)
def green_gauss_gradient(spark, sf):
    _, f, c = _linear(spark)
    return G.green_gauss(f, c, "q", "qb").select("id", *(F.round(f"grad.{k}", 9).alias(f"g{k}") for k in "xyz"))


@query(_EXACT)
def least_squares_gradient(spark, sf):
    _, f, c = _linear(spark)
    return G.least_squares(f, c, "q", "qb").select("id", *(F.round(f"grad.{k}", 9).alias(f"g{k}") for k in "xyz"))


@query("SELECT i AS id, 0.0::DOUBLE AS jump FROM range(240) r(i)")
def muscl_extrapolation(spark, sf):
    """Unlimited extrapolation of a linear field meets at interior faces; boundary faces have one side."""
    _, f, c = _linear(spark)
    c = c.join(G.least_squares(f, c, "q", "qb"), "id").withColumn("limiter", F.lit(1.0))
    x = G.muscl(f, c, "q", "grad")
    return x.select("id", F.abs(F.round(F.coalesce(F.col("left") - F.col("right"), F.lit(0.0)), 9)).alias("jump"))


@query("SELECT true AS bounded, 64::BIGINT AS n")
def limiters(spark, sf):
    _, f, c = _linear(spark)
    c = c.join(G.least_squares(f, c, "q", "qb"), "id").join(G.neighbour_range(f, c, "q"), "id")
    a, b = (G.limiter(f, c, "q", "grad", k).withColumnRenamed("limiter", k) for k in ("barth", "venkatakrishnan"))
    return a.join(b, "id").agg(F.bool_and(F.col("barth").between(0, 1) & F.col("venkatakrishnan").between(0, 1)).alias("bounded"), F.count(F.lit(1)).alias("n"))


@query("SELECT i AS id, 1.0::DOUBLE AS value FROM range(125) r(i)")
def node_interpolation(spark, sf):
    m, _, c = _linear(spark)
    return G.node_values(m, c.withColumn("one", F.lit(1.0)), "one").select("id", F.round("value", 9).alias("value"))


@query("SELECT i AS id, round(3.0::DOUBLE / 64, 9) AS value FROM range(64) r(i)")
def surface_integration(spark, sf):
    """The outward flux of the position vector is three times the volume."""
    _, f, _ = _linear(spark)
    return G.surface_integral(f, "center").select("id", F.round("value", 9).alias("value"))


@query("SELECT 'hex' AS type, 64::BIGINT AS n")
def element_types(spark, sf):
    m, _, _ = _linear(spark)
    return G.element_types(m).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT i AS id, 1.0::DOUBLE AS value FROM range(50) r(i)")
def jacobi_solver(spark, sf):
    """Diagonally dominant system whose solution is all ones, solved to its tolerance."""
    n = 50
    i = spark.range(n)
    m = i.select(F.col("id").alias("row"), F.explode(F.array(*(F.struct(((F.col("id") + d) % n).alias("col"), F.lit(a).alias("a")) for d, a in ((0, 4.0), (1, -1.0), (n - 1, -1.0))))).alias("e")).select("row", "e.*")
    return G.jacobi(m, i.select("id", F.lit(2.0).alias("b")), 40, 1e-6).select("id", F.round("value", 5).alias("value"))


_LIFE = "g(id) AS (SELECT * FROM range(64)), c AS (SELECT id, id // 8 AS i, id % 8 AS j FROM g), nb AS (SELECT c.id, ((c.i + di + 8) % 8) * 8 + (c.j + dj + 8) % 8 AS dst FROM c, (VALUES (-1), (0), (1)) a(di), (VALUES (-1), (0), (1)) b(dj) WHERE di <> 0 OR dj <> 0)"
_STEP = "SELECT s.id, (n = 3 OR (s.value = 1 AND n = 2))::INT AS value FROM {0} s JOIN (SELECT nb.id, sum(value) AS n FROM nb JOIN {0} x ON x.id = nb.dst GROUP BY 1) k ON k.id = s.id"


@query("WITH " + _LIFE + ", s0 AS (SELECT id, (id IN (10, 19, 25, 26, 27))::INT AS value FROM g), " + ", ".join(f"s{k + 1} AS ({_STEP.format(f's{k}')})" for k in range(4)) + " SELECT id, value FROM s4")
def game_of_life(spark, sf):
    """Four generations on a torus through map chains; integer exact."""
    n = 8
    ids = spark.range(n * n)
    i, j = F.floor(F.col("id") / n), F.col("id") % n
    e = Engine(spark)
    for name, dst in (("N", i * n + (j + n - 1) % n), ("S", i * n + (j + 1) % n), ("E", ((i + 1) % n) * n + j), ("W", ((i + n - 1) % n) * n + j)):
        e.catalog.create(name, map_(ids.select("id", dst.cast("long").alias("dst"))))
    e.catalog.create("initial_life", store(ids.select("id", F.col("id").isin(10, 19, 25, 26, 27).cast("int").alias("value"))))
    r = e.rules
    r.default("max_iteration", 4)
    r.pointwise("life{I=0} <- initial_life")(lambda x: x)

    @r.pointwise("life{I+1} <- life{I}, (N,S,E,W)->life{I}, E->N->life{I}, E->S->life{I}, W->N->life{I}, W->S->life{I}")
    def advance(x, *around):
        s = sum(around[1:], around[0])
        return F.when((s == 3) | ((x == 1) & (s == 2)), 1).otherwise(0)

    r.singleton("finished{I} <- $I, max_iteration")(lambda k, m: k >= m)
    r.pointwise("final_life <- life{I}", conditional="finished{I}")(lambda x: x)
    return e.query("final_life")


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def streaming_rollup(spark, sf):
    from .streaming.rollup import rollup_once

    return rollup_once(spark, f"{sf}/events.parquet").select("user_id", "n", r2(F.col("total")).alias("total"))

# The other modules of queries register theirs here.
from . import data_queries, mesh_queries, rule_queries  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES"]
