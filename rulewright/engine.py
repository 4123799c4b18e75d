"""The engine: facts, rules and queries.

``query("a,b")`` plans backward from the names, returns a DataFrame per name and puts the results
into the catalog as intensional facts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, CatalogError, Frame, Kind, Relation
from .names import Variable, parse_query
from .operators import maps as M
from .plans.planner import Inapplicable, Planner, PlanError, Scope
from .rules import RuleBase
from .session import checkpoint


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, rules: RuleBase | None = None, strict: bool = True):
        """``strict`` checks that sources cover constraints and that rules of one priority don't overlap; where it is
        off, for plans known to be right, no job runs for it."""
        self.spark, self.catalog, self.rules, self.strict = spark, catalog or Catalog(), rules or RuleBase(), strict
        self.planner: Planner | None = None

    def load(self, module: Callable[..., RuleBase] | RuleBase, namespace: str | None = None, **parameters) -> None:
        """Adds a module's rules; with a namespace its variables are namespaced, parameters become facts."""
        rules = module(**parameters) if callable(module) else module
        if namespace:
            rules = _namespaced(rules, namespace)
        self.rules.extend(rules)

    def relations(self, names: str, keep: bool = True) -> dict[str, Relation]:
        goals = parse_query(names)
        done = {str(g): self.catalog.get(g) for g in goals if g in self.catalog and self.catalog.resolve(g) in self.catalog.given}
        local = self.catalog.copy()
        local.erase_intensional()
        self.planner = Planner(self.rules, local, self.strict)
        scope = Scope({})
        local.facts = self.planner.changed((), local.facts, scope)
        scope = Scope({})
        for g in goals:
            if str(g) not in done:
                done[str(g)] = self.planner.goal(g, scope)
                if keep:
                    self.catalog._put(g, done[str(g)], False)
        self._outputs(scope)
        return done

    def _outputs(self, scope: Scope) -> None:
        for r in self.rules.rules:
            if r.kind == "output" and not any(s.levels for a in r.signature.sources for _, s in a.paths()):
                try:
                    if r.conditional is None or self.planner.truth(r.conditional, scope):
                        frame, sources, _ = self.planner.context(r, scope)
                        r.body(frame.df if frame else None, *sources)
                except Inapplicable:
                    continue

    def query(self, names: str) -> DataFrame | dict[str, DataFrame]:
        out = {k: r.df() for k, r in self.relations(names).items()}
        return next(iter(out.values())) if len(out) == 1 else out

    def scalar(self, name: str):
        r = next(iter(self.relations(name).values()))
        return r.literal if r.frame is None else r.df().first()[0]

    def explain(self, names: str, mode: str = "rules") -> str:
        """``rules``: which rules answer the goal; ``spark``: the physical plan."""
        rel = self.relations(names, keep=False)
        if mode == "rules":
            return "\n".join(map(str, self.planner.trace))
        return "\n".join(r.df()._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) for r in rel.values())

    # -- dynamic key spaces -------------------------------------------------------------------------

    def insert(self, values: dict[str, str], rows: DataFrame, key_space: str = "main") -> DataFrame:
        """New entities, a row of ``rows`` each: {fact: column}.  Keys follow the largest one in use; the
        new ids are returned.  Ids come from per-partition counts, so no task sees all rows."""
        stores = {n: self.catalog.get(n) for n in values}
        top = 0
        for r in self.catalog.facts.values():
            if r.frame is not None and r.frame.key_space == key_space and r.kind is not Kind.PARAM:
                top = max(top, r.frame.df.agg(F.max("id")).first()[0] or 0)
        new = M.mint(rows, top)
        for n, r in stores.items():
            add = new.select("id", F.col(values[n]).alias("value" if r.kind is not Kind.MAP else "dst"))
            self.catalog._put(self.catalog.key(n), Relation(r.kind, Frame(r.df().unionByName(add), key_space), F.col(add.columns[1])), True)
        return new.select("id")

    def delete(self, ids: DataFrame, key_space: str = "main") -> None:
        """Removes entities from every container of a key space."""
        self._without(ids, [v for v, r in self.catalog.facts.items() if r.frame is not None and r.frame.key_space == key_space and r.kind is not Kind.PARAM])

    def erase(self, ids: DataFrame, names: Iterable[str]) -> None:
        """Removes the records of some containers only."""
        self._without(ids, [self.catalog.resolve(n) for n in names])

    def _without(self, ids: DataFrame, names: Iterable[Variable]) -> None:
        frames: dict[int, Frame] = {}
        for v in list(names):
            r = self.catalog.get(v)
            if r.frame is None:
                raise CatalogError(f"{v} has no entities")
            left = frames.setdefault(id(r.frame), Frame(r.frame.df.join(ids.select("id"), "id", "left_anti"), r.frame.key_space))
            self.catalog.facts[v] = Relation(r.kind, left, r.value, r.literal, r.domain and Frame(r.domain.df.join(ids.select("id"), "id", "left_anti")))


def _namespaced(rules: RuleBase, namespace: str) -> RuleBase:
    from dataclasses import replace

    own = {t.base.name for r in rules.rules for t in r.targets}
    put = lambda v: replace(v, namespace=(namespace, *v.namespace), args=tuple(map(put, v.args))) if v.name in own else replace(v, args=tuple(map(put, v.args)))
    acc = lambda a: replace(a, maps=tuple(tuple(map(put, g)) for g in a.maps), values=tuple(map(put, a.values)))
    out = RuleBase()
    for r in rules.rules:
        sig = replace(r.signature, targets=tuple(map(acc, r.signature.targets)), sources=tuple(map(acc, r.signature.sources)))
        out.rules.append(replace(r, signature=sig, constraints=tuple(map(acc, r.constraints)), conditional=r.conditional and put(r.conditional)))
    return out


def wavefront(seeds: DataFrame, edges: DataFrame, max_waves: int = 1000) -> DataFrame:
    """(id, wave): recursion through a map.  Each wave reaches entities from the last one's, and only
    those not reached before go on; ``edges`` is (id, dst)."""
    front = checkpoint(seeds.select("id").distinct().withColumn("wave", F.lit(0)))
    done = front
    for wave in range(1, max_waves):
        front = checkpoint(front.select("id").join(edges, "id").select(F.col("dst").alias("id")).distinct().join(done.select("id"), "id", "left_anti").withColumn("wave", F.lit(wave)))
        if front.isEmpty():
            return done
        done = done.unionByName(front)
    raise PlanError(f"recursion did not settle in {max_waves} waves")
