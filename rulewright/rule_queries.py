"""Registered queries of every kind of rule, access and loop over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import constraint, map_, multimap, param, store
from .engine import Engine
from .operators import maps as M
from .operators.reduce import NullOp, Summation
from .queries import query, r2, sales, t
from .rules import RuleBase, RuleError


@query("SELECT p_partkey AS id, round(CASE WHEN p_size > 40 THEN p_retailprice * 0.9 ELSE p_retailprice END, 2) AS given, round(p_retailprice, 2) AS without FROM part")
def optional_rule(spark, sf):
    """A rule that reads an optional fact runs if the fact is given; else the rule under it stands."""

    def priced(extra):
        e = sales(spark, sf)
        e.rules.optional("rebate")
        e.rules.constraint("large <- size")(lambda s: s > 40)
        e.rules.pointwise("offer <- retail")(lambda p: p)
        e.rules.pointwise("special::offer <- retail, rebate", constraint="large")(lambda p, r: p * (1 - r))
        if extra:
            e.catalog.create("rebate", param(0.1))
        return e.query("offer")

    return priced(True).select("id", r2(F.col("value")).alias("given")).join(priced(False).select("id", r2(F.col("value")).alias("without")), "id")


@query("SELECT o_orderkey AS id, c_nationkey::BIGINT AS dst, n_name AS name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def map_rule(spark, sf):
    """A rule that makes a map, and one that reads through it."""
    e = sales(spark, sf)
    e.rules.map("home <- cust->nation")(lambda n: n)
    e.rules.pointwise("home_name <- home->nation_name")(lambda n: n)
    q = e.query("home, home_name")
    return q["home"].join(q["home_name"].withColumnRenamed("value", "name"), "id")


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'partial' END AS label FROM orders")
def blackbox_rule(spark, sf):
    """An opaque driver object made by a rule and read by another."""
    e = sales(spark, sf)
    e.catalog.create("words", param("F=final,O=open"))
    e.rules.blackbox("labels <- words")(lambda w: dict(x.split("=") for x in (w if isinstance(w, str) else "F=final,O=open").split(",")))
    e.rules.pointwise("label <- status, labels")(lambda s, names: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), s), F.lit("partial")))
    return e.query("label").select("id", F.col("value").alias("label"))


@query("SELECT n_nationkey::BIGINT AS id, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def super_rule(spark, sf):
    """A rule whose body plans for itself: it asks for goals and returns a relation."""
    e = sales(spark, sf)

    @e.rules.super("customers_of")
    def body(planner, v, scope):
        per = planner.goal(planner.catalog.key("nation"), scope).df().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        everyone = planner.goal(planner.catalog.key("nations"), scope).df()
        return store(everyone.join(per, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("value")), "nations")

    return e.query("customers_of").select("id", F.col("value").alias("customers"))


_TOP = "(SELECT max(o_orderkey) FROM orders)"


@query(f"SELECT count(*) AS n, min(id) - {_TOP} AS first, max(id) - {_TOP} AS last, round(sum(v), 2) AS total FROM (SELECT {_TOP} + row_number() OVER () AS id, v FROM (SELECT o_totalprice / 2 AS v FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_totalprice / 2 FROM orders WHERE o_orderstatus = 'P'))")
def insertion_rule(spark, sf):
    """Each partial order becomes two new entities, with keys after the largest of the orders' key space."""
    e = sales(spark, sf)
    top = t(spark, sf, "orders").agg(F.max("o_orderkey").alias("top"))
    e.rules.insertion("instalment <- status, total", key_space="orders")(lambda s, x: F.when(s == "P", F.array(x / 2, x / 2)).otherwise(F.array().cast("array<double>")))
    out = e.query("instalment").crossJoin(F.broadcast(top))  # one row
    return out.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("id") - F.col("top")).alias("first"), F.max(F.col("id") - F.col("top")).alias("last"), r2(F.sum("value")).alias("total"))


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS total, o_custkey AS cust FROM orders WHERE o_orderstatus <> 'P'")
def deletion_rule(spark, sf):
    """Partial orders leave every container of their key space."""
    e = sales(spark, sf)
    e.rules.deletion("cancelled <- status", key_space="orders")(lambda s: s == "P")
    e.rules.pointwise("left <- total")(lambda x: x)
    e.rules.map("buyer <- cust")(lambda c: c)
    q = e.query("left, buyer")
    return q["left"].select("id", r2(F.col("value")).alias("total")).join(q["buyer"].withColumnRenamed("dst", "cust"), "id")


@query("SELECT c_custkey AS id, round(c_acctbal, 2) AS balance, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer")
def erase_rule(spark, sf):
    """Customers in debt lose their segment and stay in the other containers."""
    e = sales(spark, sf)
    e.rules.erase("segment <- balance", key_space="customers")(lambda b: b < 0)
    e.rules.pointwise("money <- balance")(lambda b: b)
    e.rules.pointwise("group <- segment")(lambda s: s)
    q = e.query("money, group")
    return q["money"].select("id", r2(F.col("value")).alias("balance")).join(q["group"].withColumnRenamed("value", "segment"), "id", "left")


@query("SELECT p_partkey AS id, round(p_retailprice * 1.19, 6) AS gross FROM part")
def inplace_rule(spark, sf):
    """A target in the place of a source; a name that is neither is refused."""
    e = sales(spark, sf)
    e.rules.pointwise("net <- retail")(lambda p: p)
    e.rules.pointwise("gross <- net", inplace="gross|net")(lambda n: n * 1.19)
    try:
        e.rules.pointwise("x <- net", inplace="x|other")(lambda n: n)
    except RuleError:
        return e.query("gross").select("id", F.round("value", 6).alias("gross"))
    raise AssertionError("an in-place name that isn't a source was taken")


@query("SELECT c_custkey AS id, round(greatest(c_acctbal * 2, 0), 2) AS value, 1 AS begun FROM customer")
def prelude_postlude(spark, sf):
    """Hooks before a rule is planned and after its value is made."""
    e, begun = sales(spark, sf), []
    e.rules.pointwise("credit <- balance", prelude=lambda planner: begun.append(planner), postlude=lambda v: F.greatest(v, F.lit(0.0)))(lambda b: b * 2)
    out = e.query("credit")
    return out.select("id", r2(F.col("value")).alias("value"), F.lit(len(begun)).alias("begun"))


@query("SELECT c_custkey AS id, round(c_acctbal / 2, 6) AS half, round(c_acctbal * 100, 2) AS special FROM customer")
def specialized_rule(spark, sf):
    """A specialized rule answers its own name; a parametric one answers all others."""
    e = sales(spark, sf)
    e.rules.pointwise("scaled(X) <- X", parametric="X")(lambda x: x / 2)
    e.rules.pointwise("exact(balance) <- balance", specialized=True)(lambda x: x * 100)
    assert not e.rules.defining(e.catalog.key("exact(total)"))
    q = e.query("scaled(balance), exact(balance)")
    return q["scaled(balance)"].select("id", F.round("value", 6).alias("half")).join(q["exact(balance)"].select("id", r2(F.col("value")).alias("special")), "id")


@query("SELECT o_orderkey AS id, round(o_totalprice + 1, 2) AS value, 3 AS parts, 'one more' AS comment FROM orders")
def rule_options(spark, sf):
    """Options reach the plan, comments the rule."""
    e = sales(spark, sf)
    e.rules.pointwise("more <- total", partitions=3, comments="one more")(lambda x: x + 1)
    out = e.query("more")
    text = e.explain("more", "spark")
    parts = 3 if "hashpartitioning(id" in text and ", 3)" in text else 0
    return out.select("id", r2(F.col("value")).alias("value"), F.lit(parts).alias("parts"), F.lit(e.rules.rules[-1].comments).alias("comment"))


@query("SELECT space, count(*) AS n FROM (SELECT 'customers' AS space FROM customer UNION ALL SELECT 'orders' FROM orders UNION ALL SELECT 'nations' FROM nation) GROUP BY 1")
def key_spaces(spark, sf):
    """Each table's entities are a key space of their own, and derived containers stay in theirs."""
    e = sales(spark, sf)
    e.rules.pointwise("a <- balance")(lambda x: x)
    e.rules.pointwise("b <- total")(lambda x: x)
    e.rules.pointwise("c <- nation_name")(lambda x: x)
    out = None
    for r in e.relations("a, b, c").values():
        one = r.df().groupBy(F.lit(r.frame.key_space).alias("space")).agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'NullOp' AS name, true AS refused")
def null_operator(spark, sf):
    """The operator of side-effecting rules joins nothing: a reduction with it is refused."""
    e = sales(spark, sf)
    e.rules.unit("nothing", 0.0, constraint="customers")
    e.rules.apply("cust->nothing <- total", NullOp)(lambda x: x)
    try:
        e.query("nothing")
        refused = False
    except TypeError:
        refused = True
    return spark.range(1).select(F.lit(NullOp.name).alias("name"), F.lit(refused).alias("refused"))


@query("SELECT round(o_totalprice + p_retailprice, 2) AS both FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")
def map_group_access(spark, sf):
    """One name read through each map of a group: (a, b)->x."""
    e = Engine(spark)
    worth = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")).unionByName(t(spark, sf, "part").select((-1 - F.col("p_partkey")).alias("id"), F.col("p_retailprice").alias("value")))
    lines = t(spark, sf, "lineitem").withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    e.catalog.create("worth", store(worth, "worth"))
    e.catalog.table(lines.withColumn("p", -1 - F.col("l_partkey")), "id", {}, {"order": "l_orderkey", "piece": "p"}, key_space="lines")
    e.rules.pointwise("both <- (order,piece)->worth")(lambda a, b: a + b)
    return e.query("both").select(r2(F.col("value")).alias("both"))


def _tree(spark, sf):
    """Customers as a tree: the parent of k is k // 3, and 1 is the root."""
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    e = Engine(spark)
    e.catalog.create("balance", store(c))
    e.catalog.create("parent", map_(c.where("id > 2").select("id", F.floor(F.col("id") / 3).alias("dst"))))
    e.catalog.create("roots", constraint(c.where("id <= 2").select("id")))
    return e


_TREE = "WITH RECURSIVE w(id, depth, total) AS (SELECT c_custkey, 0, c_acctbal FROM customer WHERE c_custkey <= 2 UNION ALL SELECT c_custkey, depth + 1, total + c_acctbal FROM w JOIN customer ON c_custkey // 3 = w.id AND c_custkey > 2) "


@query(_TREE + "SELECT id, depth, round(total, 2) AS total FROM w")
def recursion_rule(spark, sf):
    """Rules that read their own target through a map: depth and sum along the path to the root."""
    e = _tree(spark, sf)
    e.rules.pointwise("depth <- balance", constraint="roots")(lambda b: F.lit(0))
    e.rules.pointwise("depth <- parent->depth")(lambda d: d + 1)
    e.rules.pointwise("path <- balance", constraint="roots")(lambda b: b)
    e.rules.pointwise("path <- parent->path, balance")(lambda p, b: p + b)
    q = e.query("depth, path")
    return q["depth"].withColumnRenamed("value", "depth").join(q["path"].select("id", r2(F.col("value")).alias("total")), "id")


@query(_TREE + "SELECT id, round(total * 2, 2) AS twice FROM w")
def mutual_recursion(spark, sf):
    """A recursion over two rules: each reads the other, one of them through the map."""
    e = _tree(spark, sf)
    e.rules.pointwise("sum <- balance", constraint="roots")(lambda b: b)
    e.rules.pointwise("sum <- parent->twice, balance")(lambda p, b: p / 2 + b)
    e.rules.pointwise("twice <- sum")(lambda s: s * 2)
    return e.query("sum").select("id", r2(F.col("value") * 2).alias("twice"))


@query(_TREE + "SELECT id, depth FROM w WHERE depth <= 1")
def relaxed_recursion(spark, sf):
    """A single pass: what the first rules gave and one step from it."""
    e = _tree(spark, sf)
    e.rules.pointwise("depth <- balance", constraint="roots")(lambda b: F.lit(0))
    e.rules.pointwise("depth <- parent->depth", relaxed_recursion=True)(lambda d: d + 1)
    return e.query("depth").withColumnRenamed("value", "depth")


@query("WITH RECURSIVE s(k, id, v) AS (SELECT 0, c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 UNION ALL SELECT k + 1, id, v / 2 FROM s WHERE k < 6 AND v / 2 >= 100) SELECT id, round(v, 8) AS v FROM s WHERE k = 6")
def dynamic_iteration(spark, sf):
    """Entities leave while a loop runs: balances halve, and those below 100 are deleted after each step."""
    e = sales(spark, sf)
    r = e.rules
    r.default("steps", 6)
    r.constraint("solvent <- balance")(lambda b: b > 0)
    r.pointwise("v{n=0} <- balance", constraint="solvent")(lambda b: b)
    r.pointwise("v{n+1} <- v{n}")(lambda v: v / 2)
    r.deletion("poor{n} <- v{n}", key_space="customers")(lambda v: v < 100)
    r.singleton("done{n} <- $n, steps")(lambda n, k: n >= k)
    r.pointwise("rest <- v{n}", conditional="done{n}")(lambda v: v)
    return e.query("rest").select("id", F.round("value", 8).alias("v"))


@query("WITH RECURSIVE s(k, id, a, b) AS (SELECT 1, n_nationkey::BIGINT, 1::DOUBLE, n_nationkey::DOUBLE FROM nation UNION ALL SELECT k + 1, id, b, a + b FROM s WHERE k < 8) SELECT id, b AS value FROM s WHERE k = 8")
def history_rotation(spark, sf):
    """A two-term recurrence: x{n+1} reads x{n} and x{n-1}, which starts as what the build rules gave for it."""
    e = sales(spark, sf)
    n = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    e.catalog.create("first", store(n.withColumn("value", F.lit(1.0)), "nations"))
    e.catalog.create("second", store(n.withColumn("value", F.col("id").cast("double")), "nations"))
    r = e.rules
    r.default("steps", 7)
    r.pointwise("old{n=0} <- first")(lambda x: x)
    r.pointwise("x{n=0} <- second")(lambda x: x)
    r.pointwise("old{n+1} <- x{n}")(lambda x: x)
    r.pointwise("x{n+1} <- x{n}, old{n}")(lambda x, o: x + o)
    r.singleton("done{n} <- $n, steps")(lambda n, k: n >= k)
    r.pointwise("fib <- x{n}", conditional="done{n}")(lambda x: x)
    return e.query("fib")


@query("SELECT c_custkey AS id, round(c_acctbal + 3 * (1 + 2), 2) AS value FROM customer")
def nested_levels(spark, sf):
    """A loop inside a loop: three outer steps, in each of which two inner steps add one, and then one more is added."""
    e = sales(spark, sf)
    r = e.rules
    r.pointwise("y{n=0} <- balance")(lambda b: b)
    r.pointwise("z{n,it=0} <- y{n}")(lambda y: y)
    r.pointwise("z{n,it+1} <- z{n,it}")(lambda z: z + 1)
    r.singleton("inner{n,it} <- $it")(lambda k: k >= 2)
    r.pointwise("w{n} <- z{n,it}", conditional="inner{n,it}")(lambda z: z)
    r.pointwise("y{n+1} <- w{n}")(lambda w: w + 1)
    r.singleton("outer{n} <- $n")(lambda k: k >= 3)
    r.pointwise("answer <- y{n}", conditional="outer{n}")(lambda y: y)
    return e.query("answer").select("id", r2(F.col("value")).alias("value"))


@query("SELECT step, round(sum(c_acctbal + step), 2) AS total FROM customer, range(4) r(step) GROUP BY 1")
def output_rules(spark, sf):
    """A side effect in each step of a loop: the total of the balances, which grow by one a step."""
    e, seen = sales(spark, sf), []
    r = e.rules
    r.pointwise("y{n=0} <- balance")(lambda b: b)
    r.pointwise("y{n+1} <- y{n}")(lambda y: y + 1)
    r.output("report{n} <- y{n}")(lambda df, y: seen.append(df.agg(F.sum(y)).first()[0]))
    r.singleton("done{n} <- $n")(lambda k: k >= 4)
    r.pointwise("answer <- y{n}", conditional="done{n}")(lambda y: y)
    e.query("answer")
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(seen)], "step long, total double").select("step", r2(F.col("total")).alias("total"))


@query("SELECT c_custkey AS id, round(CASE WHEN (SELECT count(*) FROM orders) > 1000 THEN c_acctbal * 2 ELSE c_acctbal END, 2) AS value FROM customer")
def conditional_rules(spark, sf):
    """Two rules for one target under conditions that exclude each other; the one that is false is never planned."""
    e = sales(spark, sf)
    r = e.rules
    r.unit("n_orders", 0)
    r.apply("n_orders <- total", Summation)(lambda x: F.lit(1))
    r.singleton("many <- n_orders")(lambda n: n > 1000)
    r.singleton("few <- many")(lambda m: ~m)
    r.pointwise("worth <- balance", conditional="many")(lambda b: b * 2)
    r.pointwise("worth <- balance", conditional="few")(lambda b: b)
    return e.query("worth").select("id", r2(F.col("value")).alias("value"))


@query("SELECT 1 AS overlaps, 1 AS uncovered, 1 AS conflicts, 1 AS priorities")
def plan_errors(spark, sf):
    """Overlapping rules of one priority, a constraint that sources don't cover, operators that differ and priorities that don't nest are errors."""
    from .plans.planner import PlanError

    def fails(build, goal):
        e = sales(spark, sf)
        e.rules.constraint("poor <- balance")(lambda b: b < 0)
        build(e.rules)
        try:
            e.query(goal)
        except PlanError:
            return 1
        return 0

    def overlap(r):
        r.pointwise("a <- balance")(lambda b: b)
        r.pointwise("a <- balance", constraint="poor")(lambda b: b)

    def uncovered(r):
        r.pointwise("debt <- balance", constraint="poor")(lambda b: -b)
        r.pointwise("a <- debt", constraint="customers")(lambda b: b)

    def conflict(r):
        from .operators.reduce import Maximum

        r.unit("a", 0.0, constraint="customers")
        r.apply("cust->a <- total", Summation)(lambda x: x)
        r.apply("cust->a <- total", Maximum)(lambda x: x)

    def priorities(r):
        r.pointwise("p::q::a <- balance")(lambda b: b)
        r.pointwise("s::a <- balance", constraint="poor")(lambda b: b)

    names = {"overlaps": overlap, "uncovered": uncovered, "conflicts": conflict, "priorities": priorities}
    return spark.range(1).select(*(F.lit(fails(f, "a")).alias(n) for n, f in names.items()))


@query("SELECT c_custkey AS id, count(o_orderkey) AS orders, coalesce(string_agg(o_orderstatus, '' ORDER BY o_orderkey), '') AS states FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def ordered_lists(spark, sf):
    """Neighbours in the order of their list, empty lists included."""
    e = sales(spark, sf)
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dst"))
    e.catalog.create("orders_of", multimap(M.inverse(o), "customers", t(spark, sf, "customer").select(F.col("c_custkey").alias("id"))))
    e.rules.pointwise("states <- orders_of->status")(lambda s: F.struct(F.size(s).cast("long").alias("orders"), F.array_join(s, "").alias("states")))
    return e.query("states").select("id", "value.orders", "value.states")


@query("SELECT c_custkey AS id, round(c_acctbal + 5, 2) AS value FROM customer")
def module_with_parameters(spark, sf):
    """A module of rules loaded twice, with parameters and namespaces of their own."""

    def module(add):
        m = RuleBase()
        m.pointwise("shifted <- balance")(lambda b: b + add)
        return m

    e = sales(spark, sf)
    e.load(module, namespace="one", add=2)
    e.load(module, namespace="two", add=3)
    q = e.query("one@shifted, two@shifted")
    a, b = (q[k].withColumnRenamed("value", k[:3]) for k in ("one@shifted", "two@shifted"))
    return a.join(b, "id").join(t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "id").select("id", r2(F.col("one") + F.col("two") - F.col("c_acctbal")).alias("value"))


@query("SELECT 'revenue <- given' AS plan, 4 AS steps, true AS formatted")
def explain_modes(spark, sf):
    """The plan as rules and as Spark's operators."""
    e = sales(spark, sf)
    e.rules.pointwise("charge <- revenue, tax")(lambda r, x: r * (1 + x))
    rules, plan = e.explain("charge").splitlines(), e.explain("charge", "spark")
    given = "revenue <- given" if any("revenue" in x for x in rules) and any("given" in x for x in rules) else "?"
    return spark.range(1).select(F.lit(given).alias("plan"), F.lit(len(rules) - 1).alias("steps"), F.lit("Scan parquet" in plan).alias("formatted"))
