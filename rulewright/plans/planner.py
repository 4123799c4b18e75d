"""Goal-directed planning: from a goal, backward over the rules, to lazy DataFrames.

Containers over one frame are combined without a join; each further frame costs one equi-join on
the entity.  Nothing runs while a plan is built but the conditions of loops, the waves of recursions and, unless
checking is off, the coverage and conflict checks.  Loop-carried facts are cut from their lineage by checkpoints.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, Frame, Kind, Relation
from ..names import Access, Variable
from ..operators import maps as M
from ..operators.reduce import Reduction
from ..rules import Rule, RuleBase


class PlanError(ValueError):
    """A conflict of definitions, an uncovered constraint or another plan that can't be."""


class Inapplicable(PlanError):
    """A rule that doesn't apply: a source that nothing gives, or a condition that is false.  Another rule may define the target."""


@dataclass
class Step:
    goal: Variable
    rules: list[Rule]
    depth: int

    def __str__(self) -> str:
        return f"{'  ' * self.depth}{self.goal}: " + ("; ".join(map(str, self.rules)) if self.rules else "given")


@dataclass
class Scope:
    """Facts of one loop level, over those of the level around it."""

    facts: dict[Variable, Relation]
    level: str | None = None
    parent: Scope | None = None
    memo: dict[Variable, Relation] = field(default_factory=dict)

    def find(self, v: Variable) -> Relation | None:
        s: Scope | None = self
        while s:
            if v in s.facts:
                return s.facts[v]
            s = s.parent
        return None

    @property
    def levels(self) -> tuple[str, ...]:
        out, s = (), self
        while s:
            out, s = ((s.level, *out) if s.level else out), s.parent
        return out


class Planner:
    def __init__(self, rules: RuleBase, catalog: Catalog, strict: bool = True, checkpoint_every: int = 1, max_steps: int = 10_000):
        self.rules, self.catalog, self.strict = rules, catalog, strict
        self.checkpoint_every, self.max_steps = checkpoint_every, max_steps
        self.trace: list[Step] = []
        self.depth = self.names = 0
        self.pending: list[Variable] = []

    def fresh(self) -> str:
        """A column name that no frame of this plan has."""
        self.names += 1
        return f"_rw{self.names}"

    # -- goals ------------------------------------------------------------------------------------

    def goal(self, v: Variable, scope: Scope | None = None) -> Relation:
        scope = scope or Scope({})
        found = self.lookup(v, scope)
        if found is None:
            raise Inapplicable(f"no fact and no rule gives {v}" + (f" (asked for by {self.pending[-1]})" if self.pending else ""))
        return found

    def lookup(self, v: Variable, scope: Scope) -> Relation | None:
        v = self.catalog.resolve(v)
        if (r := scope.find(v)) is not None:
            return r
        if v in self.catalog:
            if v not in scope.memo:
                self.trace.append(Step(v, [], self.depth))
                scope.memo[v] = self.catalog.get(v)
            return scope.memo[v]
        if v.levels and v.levels != scope.levels and len(v.levels) <= len(scope.levels) and scope.parent:
            return self.lookup(v, scope.parent)
        if v in scope.memo:
            return scope.memo[v]
        if v in self.pending:
            raise PlanError(f"{v} depends on itself: {' <- '.join(map(str, [*self.pending[self.pending.index(v):], v]))}; use recursion or iteration")
        rules = [r for r in self.rules.defining(v) if self.applies(r, v)]
        if v.priority == () and not rules and v.name in ("NOT", "AND", "OR") and v.args:
            return self.constraint_algebra(v, scope)
        if not rules:
            if v.levels and scope.level and v.levels == scope.levels:
                # A fact without a time level, or one of the level outside, is promoted.
                return self.lookup(v.at(v.levels[:-1]) if len(v.levels) > 1 else v.base, scope)
            return None
        self.pending.append(v)
        self.depth += 1
        self.trace.append(Step(v, rules, self.depth - 1))
        try:
            scope.memo[v] = out = self.define(v, rules, scope)
        finally:
            self.pending.pop()
            self.depth -= 1
        return out

    def applies(self, r: Rule, v: Variable) -> bool:
        if r.kind in ("insertion", "deletion", "erase", "output"):
            return False
        t = next(t for t in r.targets if t.base == v.base)
        return t.levels == v.levels and t.offset == v.offset and t.start == v.start

    # -- definitions ------------------------------------------------------------------------------

    def define(self, v: Variable, rules: list[Rule], scope: Scope) -> Relation:
        if any(r.phase == "collapse" for r in rules):
            return self.iterate(v, rules, scope)
        if again := [r for r in rules if self.recursive(r, v)]:
            return self.recurse(v, [r for r in rules if r not in again], again, scope)
        reductions = [r for r in rules if r.kind in ("unit", "apply")]
        plain = [r for r in rules if r.kind not in ("unit", "apply")]
        parts: list[tuple[tuple[str, ...], Relation]] = []
        if reductions:
            parts.append((self.target(reductions[0], v).priority, self.reduction(v, reductions, scope)))
        needs_all = len(plain) == 1 and not reductions
        for r in plain:
            if r.kind in ("default", "optional"):
                if r.kind == "default" and not parts and needs_all:
                    parts.append(((), Relation(Kind.PARAM, literal=r.body)))
                continue
            try:
                parts.append((self.target(r, v).priority, self.apply_rule(r, v, scope)))
            except Inapplicable:
                if needs_all:  # else another rule may define the variable
                    raise
        if not parts:
            defaults = [r for r in plain if r.kind == "default"]
            if defaults:
                return Relation(Kind.PARAM, literal=defaults[0].body)
            raise Inapplicable(f"no rule for {v} can run: {'; '.join(map(str, rules))}")
        return self.resolve(v, parts)

    # -- recursion --------------------------------------------------------------------------------

    def reaches(self, source: Variable, v: Variable, seen: set[Variable]) -> bool:
        """Whether ``source`` depends on ``v`` by rules of its time level."""
        if source.plain == v.plain:
            return True
        if source in seen or source in self.catalog:
            return False
        seen.add(source)
        return any(self.reaches(s, v, seen) for r in self.rules.defining(source) if self.applies(r, source) for a in r.signature.sources for _, s in a.paths())

    def recursive(self, r: Rule, v: Variable) -> bool:
        """Whether a rule for ``v`` reads ``v``, itself or by other rules, at the end of a chain of maps."""
        return r.kind in ("pointwise", "map") and any(chain and self.reaches(s, v, set()) for a in r.signature.sources for chain, s in a.paths())

    def recurse(self, v: Variable, base: list[Rule], again: list[Rule], scope: Scope) -> Relation:
        """Waves: the rules without recursion begin; each wave gives entities whose recursive sources are there, and
        those that an earlier wave gave keep its value.  A rule with one recursive source reads the last wave alone.  With the
        option ``relaxed_recursion`` the rules run once, over what the others gave."""
        if not base:
            raise PlanError(f"{v} depends on itself and no rule begins it: {'; '.join(map(str, again))}")
        done = self.cut(self.define(v, base, scope))
        front, relaxed = done, all(r.options.get("relaxed_recursion") for r in again)
        for _ in range(self.max_steps):
            new = None
            for r in again:
                ends = [s for a in r.signature.sources for chain, s in a.paths() if chain and self.reaches(s, v, set())]
                got = self.apply_rule(r, v, Scope({v: front if len(ends) == 1 else done}, parent=scope)).df()
                got = got.join(done.df().select("id"), "id", "left_anti")
                if new is not None and self.strict and got.join(new.select("id"), "id", "left_semi").limit(1).count():
                    raise PlanError(f"rules of one priority overlap in {v}")
                new = got if new is None else new.unionByName(got)
            front = self.cut(Relation(done.kind, Frame(new, done.frame.key_space), F.col(new.columns[1])))
            if front.df().isEmpty():
                return done
            done = Relation(done.kind, Frame(done.df().unionByName(front.df()), done.frame.key_space), F.col(new.columns[1]))
            if relaxed:
                return done
        raise PlanError(f"the recursion of {v} did not settle in {self.max_steps} waves")

    @staticmethod
    def target(r: Rule, v: Variable) -> Variable:
        return next(t for t in r.targets if t.base == v.base)

    def resolve(self, v: Variable, parts: list[tuple[tuple[str, ...], Relation]]) -> Relation:
        """Disjoint definitions are united; where definitions overlap the longer priority chain that extends the other wins."""
        if len(parts) == 1:
            return parts[0][1]
        parts = sorted(parts, key=lambda p: -len(p[0]))
        for (p, _), (q, _) in zip(parts, parts[1:], strict=False):
            if len(p) != len(q) and p[len(p) - len(q) :] != q and p[: len(q)] != q:
                raise PlanError(f"priorities of {v} don't nest: {'::'.join(p)} and {'::'.join(q)}")
        kind = parts[0][1].kind
        if kind is Kind.PARAM:
            if len(parts[0][0]) == len(parts[1][0]):
                raise PlanError(f"two rules of one priority give the param {v}")
            return parts[0][1]
        out, i = None, 0
        while i < len(parts):
            same = [r for p, r in parts if len(p) == len(parts[i][0])]
            level = same[0].df()
            for r in same[1:]:
                level = level.unionByName(r.df())
            if self.strict and len(same) > 1 and level.groupBy("id").count().where("count > 1").limit(1).count():
                raise PlanError(f"rules of one priority overlap in {v}")
            out = level if out is None else out.unionByName(level.join(out.select("id"), "id", "left_anti"))
            i += len(same)
        return Relation(kind, Frame(out), F.col("dst" if kind is Kind.MAP else "value") if kind is not Kind.CONSTRAINT else None)

    def constraint_algebra(self, v: Variable, scope: Scope) -> Relation:
        sets = [self.goal(a, scope) for a in v.args]
        ids = [s.frame.df.select("id").distinct() for s in sets]
        if v.name == "NOT":
            space = sets[0].frame.key_space
            universe = self.catalog.facts.get(Variable(f"entities.{space}")) or self.catalog.facts.get(Variable("entities"))
            if universe is None:
                raise PlanError(f"NOT needs the entities of key space {space!r}: create the constraint 'entities'")
            return Relation(Kind.CONSTRAINT, Frame(universe.frame.df.select("id").distinct().join(ids[0], "id", "left_anti"), space))
        out = ids[0]
        for other in ids[1:]:
            out = out.union(other).distinct() if v.name == "OR" else out.join(other, "id", "left_semi")
        return Relation(Kind.CONSTRAINT, Frame(out, sets[0].frame.key_space))

    # -- one rule ---------------------------------------------------------------------------------

    def context(self, r: Rule, scope: Scope, extra: list[Access] = ()) -> tuple[Frame | None, list[Column], list[Column]]:
        """(frame, source Columns, Columns of the extra accesses): the entities that have every source and satisfy every constraint."""
        cols: dict[tuple, Column] = {}
        frame: Frame | None = None
        params: dict[tuple, Relation] = {}
        paths = [p for a in (*r.signature.sources, *extra) for p in a.paths()]
        direct = [((), m) for chain, _ in paths for m in chain[:1]] + [p for p in paths if not p[0]]
        frames: dict[int, tuple[Frame, dict[tuple, Column]]] = {}
        lists: dict[tuple, Relation] = {}
        for _, v in dict.fromkeys(direct):
            rel = self.goal(v, scope)
            if rel.kind is Kind.PARAM:
                params[((), v)] = rel
            elif rel.kind is Kind.BLACKBOX:
                cols[((), v)] = rel.literal
            elif rel.kind is Kind.MULTIMAP:
                lists[((), v)] = rel
            elif rel.kind is Kind.CONSTRAINT:
                frames.setdefault(id(rel.frame), (rel.frame, {}))
            else:
                frames.setdefault(id(rel.frame), (rel.frame, {}))[1][((), v)] = rel.value
        # A frame that another one descends from is read through the descendant.
        for key in [k for k, (f, _) in frames.items() if any(g is not f and g.descends(f) for g, _ in frames.values())]:
            f, own = frames.pop(key)
            next(x for g, x in frames.values() if g.descends(f)).update(own)
        if len(frames) == 1:
            frame, own = next(iter(frames.values()))
            cols |= own
        elif frames:
            (frame, own), *rest = frames.values()
            cols |= own
            for f, own in rest:
                names = [self.fresh() for _ in own]
                part = f.df.select("id", *(c.alias(n) for n, c in zip(names, own.values(), strict=True)))
                frame = Frame(frame.df.join(part, "id"), frame.key_space, frame)
                cols |= {k: F.col(n) for n, k in zip(names, own, strict=True)}
        elif lists:
            rel = next(iter(lists.values()))
            frame = Frame((rel.domain or rel.frame).df.select("id").distinct(), rel.frame.key_space)
        # Through maps: one join per map of a chain, shared prefixes once.
        done: dict[tuple, str] = {}
        for chain, v in paths:
            if not chain:
                continue
            for depth in range(1, len(chain) + 1):
                prefix, nxt = chain[:depth], (chain[depth] if depth < len(chain) else v)
                key = (prefix, nxt)
                if key in done:
                    continue
                if ((), prefix[0]) in lists:
                    name = self.fresh()
                    frame = self.through_list(frame, lists[((), prefix[0])], nxt, name, scope, final=depth == len(chain))
                else:
                    at = cols[((), prefix[0])] if depth == 1 else F.col(done[(prefix[:-1], prefix[-1])])
                    rel = self.goal(nxt, scope)
                    if rel.kind is Kind.PARAM:
                        params[(prefix, nxt)] = rel
                        done[key] = ""
                        continue
                    name = self.fresh()
                    if rel.kind is Kind.CONSTRAINT:
                        look = rel.frame.df.select(F.col("id").alias(f"{name}_id")).distinct().withColumn(name, F.lit(True))
                    else:
                        look = rel.frame.df.select(F.col("id").alias(f"{name}_id"), rel.value.alias(name))
                    frame = Frame(frame.df.withColumn(f"{name}_at", at).join(look, F.col(f"{name}_at") == F.col(f"{name}_id")).drop(f"{name}_at", f"{name}_id"), frame.key_space, frame)
                done[key] = name
            if (chain, v) not in params:
                cols[(chain, v)] = F.col(done[(chain, v)])
        for key, rel in params.items():
            if rel.frame is None:
                cols[key] = F.lit(rel.literal)
            elif frame is None:
                cols[key] = rel
            else:
                name = self.fresh()
                frame = Frame(frame.df.crossJoin(F.broadcast(rel.df().select(F.col("value").alias(name)))), frame.key_space, frame)  # a param is one row
                cols[key] = F.col(name)
        for c in r.constraints:
            frame = self.restrict(frame, c, scope, r)
        pick = lambda accesses: [cols.get(p) for a in accesses for p in a.paths()]
        return frame, pick(r.signature.sources), pick(extra)

    def through_list(self, frame: Frame, mm: Relation, v: Variable, name: str, scope: Scope, final: bool) -> Frame:
        """An array of v over the list of each entity, in list order; entities that lack v at some member are out, empty lists stay."""
        if not final:
            raise PlanError("a multimap leads a chain by one step; compose the maps first")
        rel = self.goal(v, scope)
        look = rel.frame.df.select(F.col("id").alias("dst"), rel.value.alias("_v"))
        rows = mm.frame.df.select("id", "pos", "dst")
        whole = M.preimage_all(rows, rel.frame.df, mm.domain.df if mm.domain else None)
        got = rows.join(look, "dst").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "_v"))).alias("_l"))
        got = whole.join(got, "id", "left")
        kind = dict(look.dtypes)["_v"]
        listed = F.transform("_l", lambda s: s["_v"])
        got = got.select("id", F.coalesce(listed, F.array().cast(f"array<{kind}>")).alias(name))
        return Frame(frame.df.join(got, "id"), frame.key_space, frame)

    def restrict(self, frame: Frame, c: Access, scope: Scope, r: Rule) -> Frame:
        for chain, v in c.paths():
            rel = self.goal(v, scope)
            ids = rel.frame.df.select("id").distinct()
            for m in reversed(chain):
                mr = self.goal(m, scope)
                ids = M.preimage_all(mr.df(), ids, mr.domain.df if mr.domain else None)
            if frame is None:
                frame = Frame(ids, rel.frame.key_space)
                continue
            if self.strict and not chain and not rel.frame.descends(frame) and ids.join(frame.df.select("id"), "id", "left_anti").limit(1).count():
                raise PlanError(f"{r}: sources don't cover constraint {c}")
            frame = Frame(frame.df.join(ids, "id", "left_semi"), frame.key_space, frame)
        return frame

    @staticmethod
    def value(r: Rule, result, v: Variable) -> Column:
        if isinstance(result, tuple):
            return result[[t.base for t in r.targets].index(v.base)]
        return result

    def apply_rule(self, r: Rule, v: Variable, scope: Scope) -> Relation:
        if r.conditional is not None and r.phase != "collapse" and not self.truth(r.conditional, scope):
            raise Inapplicable(f"the condition {r.conditional} of {r} is false")
        if r.prelude:
            r.prelude(self)
        if r.kind == "super":
            return r.body(self, v, scope)
        frame, sources, _ = self.context(r, scope)
        if r.kind == "blackbox":
            return Relation(Kind.BLACKBOX, literal=r.body(*[s.df().first()[0] if isinstance(s, Relation) else s for s in sources]))
        if r.kind == "singleton":
            return self.singleton(r, v, sources)
        if (n := r.options.get("partitions")) and frame is not None:
            frame = Frame(frame.df.repartition(n, "id"), frame.key_space, frame)
        out = self.value(r, r.body(*sources), v)
        if r.kind == "constraint":
            return Relation(Kind.CONSTRAINT, Frame(frame.df.where(out), frame.key_space, frame))
        if isinstance(out, DataFrame):
            return Relation(Kind.MULTIMAP if "pos" in out.columns else Kind.MAP, Frame(out), F.col("dst"))
        if not isinstance(out, Column):
            out = F.lit(out)
        if r.postlude:
            out = r.postlude(out)
        kind = Kind.MAP if r.kind == "map" else Kind.STORE
        return Relation(kind, frame, out.cast("long") if kind is Kind.MAP else out)

    def singleton(self, r: Rule, v: Variable, sources: list) -> Relation:
        df, cols = None, []
        for i, s in enumerate(sources):
            if isinstance(s, Relation):
                one = s.df().select(F.col("value").alias(f"_s{i}"))
                df = one if df is None else df.crossJoin(F.broadcast(one))  # params are single rows
                cols.append(F.col(f"_s{i}"))
            else:
                cols.append(s)
        out = self.value(r, r.body(*cols), v)
        if df is None and not isinstance(out, Column):
            return Relation(Kind.PARAM, literal=out)
        if df is None:
            from pyspark.sql import SparkSession

            df = SparkSession.active().range(1)
        df = df.select((out if isinstance(out, Column) else F.lit(out)).alias("value"))
        return Relation(Kind.PARAM, Frame(df), F.col("value"))

    def reduction(self, v: Variable, rules: list[Rule], scope: Scope) -> Relation:
        units = [r for r in rules if r.kind == "unit"]
        if not units:
            raise PlanError(f"{v} has apply rules and no unit rule")
        ops: set[Reduction] = {r.op for r in rules if r.kind == "apply"}
        if len(ops) > 1:
            raise PlanError(f"apply rules of {v} use different operators: {', '.join(o.name for o in ops)}")
        op = next(iter(ops), None)
        is_param = not units[0].constraints and not units[0].signature.sources
        parts = []
        for r in (r for r in rules if r.kind == "apply"):
            target = next(t for t in r.signature.targets if any(x.base == v.base for x in t.values))
            if target.maps and len(target.maps) > 1:
                raise PlanError(f"{r}: compose the maps of a target first")
            through = target.maps[0] if target.maps else ()
            frame, sources, at = self.context(r, scope, [Access((), (m,)) for m in through])
            out = self.value(r, r.body(*sources), v)
            out = out if isinstance(out, Column) else F.lit(out)
            if is_param:
                parts.append(frame.df.select(out.alias("value")))
            elif through:
                for m, a in zip(through, at, strict=True):
                    if a is None:  # a multimap: a contribution per member
                        mm = self.goal(m, scope).df()
                        parts.append(frame.df.select("id", out.alias("value")).join(mm, "id").select("dst", "value"))
                    else:
                        parts.append(frame.df.select(a.cast("long").alias("dst"), out.alias("value")))
            else:
                parts.append(frame.df.select(F.col("id").alias("dst"), out.alias("value")))
        rows = None
        for p in parts:
            rows = p if rows is None else rows.unionByName(p)
        identity = units[0].body if units[0].body is not None or op is None else op.identity
        if is_param:
            if rows is None:
                return Relation(Kind.PARAM, literal=identity)
            total = op.aggregate(F.col("value"))
            start = identity if isinstance(identity, Column) else F.lit(identity)
            value = F.when(total.isNull(), start).otherwise(total if identity is None else op.join(start, total))
            return Relation(Kind.PARAM, Frame(rows.agg(value.alias("value"))), F.col("value"))
        domain = None
        for u in units:
            frame, sources, _ = self.context(u, scope)
            body = u.body(*sources) if callable(u.body) and not isinstance(u.body, Column) else identity
            one = frame.df.select("id", (body if isinstance(body, Column) else F.lit(body)).alias("value"))
            domain = one if domain is None else domain.unionByName(one)
        if rows is None:
            return Relation(Kind.STORE, Frame(domain), F.col("value"))
        from ..operators.reduce import reduce_to

        return Relation(Kind.STORE, Frame(reduce_to(rows, domain, op)), F.col("value"))

    # -- iteration --------------------------------------------------------------------------------

    def truth(self, v: Variable, scope: Scope) -> bool:
        r = self.goal(v, scope)
        return bool(r.literal) if r.frame is None else bool(r.df().first()[0])

    def iterate(self, v: Variable, rules: list[Rule], scope: Scope) -> Relation:
        """Build; then until the collapse rule's condition holds: advance all loop facts, rotate history, count.
        The condition is tested before the first advance."""
        rule = next(r for r in rules if r.phase == "collapse")
        deep = max((s for a in rule.signature.sources for _, s in a.paths()), key=lambda s: len(s.levels)).levels or rule.conditional.levels
        if rule.conditional is None:
            raise PlanError(f"{rule}: a collapse rule needs a condition")
        level, counter = deep[-1], Variable(f"${deep[-1]}")
        state: dict[Variable, Relation] = {counter: Relation(Kind.PARAM, literal=0)}
        build = {}
        for r in self.rules.rules:
            for t in r.targets:
                if r.phase == "build" and t.levels == deep and t.start == 0:
                    build[t.base] = t
        for base, t in build.items():
            state[base.at(deep)] = self.cut(self.goal(t.plain, scope))
        history = min((s.offset for r in self.rules.rules for a in r.signature.sources for _, s in a.paths() if s.levels == deep), default=0)
        for step in range(self.max_steps):
            inner = Scope(dict(state), level, scope)
            if self.truth(rule.conditional, inner):
                return self.apply_rule(rule, v, inner)
            self.run_outputs(deep, inner)
            new: dict[Variable, Relation] = {}
            for base in build:
                moved = self.goal(base.at(deep, 1), inner)
                new[base.at(deep)] = self.cut(moved) if (step + 1) % self.checkpoint_every == 0 or moved.kind is Kind.PARAM else moved
                for k in range(-1, history - 1, -1):
                    if (old := state.get(base.at(deep, k + 1))) is not None:
                        new[base.at(deep, k)] = old
            new[counter] = Relation(Kind.PARAM, literal=step + 1)
            state = self.changed(deep, new, Scope(dict(new), level, scope))
        raise PlanError(f"{v}: no end after {self.max_steps} steps")

    # -- dynamic key spaces -----------------------------------------------------------------------

    def changed(self, levels: tuple[str, ...], facts: dict[Variable, Relation], scope: Scope) -> dict[Variable, Relation]:
        """``facts`` after the insertion, deletion and erase rules whose sources are of the time level, in the order they were declared."""
        for r in self.rules.rules:
            if r.kind not in ("insertion", "deletion", "erase") or {s.levels for a in r.signature.sources for _, s in a.paths() if s.name[:1] != "$"} != {levels}:
                continue
            try:
                if r.conditional is not None and not self.truth(r.conditional, scope):
                    continue
                frame, sources, _ = self.context(r, scope)
            except Inapplicable:
                continue
            space = r.options.get("key_space", frame.key_space)
            held = {v: f for v, f in facts.items() if f.frame is not None and f.frame.key_space == space and f.kind is not Kind.PARAM}
            if r.kind == "insertion":
                made = r.body(*sources)
                values = dict(zip(r.targets, made if isinstance(made, tuple) else (made,), strict=True))
                rows = frame.df.select(F.explode(F.arrays_zip(*(c.alias(f"_{i}") for i, c in enumerate(values.values())))).alias("_n")).select("_n.*")
                new = M.mint(rows.toDF(*(f"_{i}" for i in range(len(values)))), max([f.frame.df.agg(F.max("id")).first()[0] or 0 for f in held.values()], default=0))
                for i, t in enumerate(values):
                    v = t.plain
                    old, add = facts.get(v), new.select("id", F.col(f"_{i}").alias("value"))
                    if old is not None:
                        add = old.df().unionByName(add.toDF(*old.df().columns))
                    facts[v] = Relation(old.kind if old else Kind.STORE, Frame(add, space), F.col(add.columns[1]))
            else:
                gone = self.cut(Relation(Kind.CONSTRAINT, Frame(frame.df.where(r.body(*sources)).select("id")))).frame.df
                names = held if r.kind == "deletion" else {t.plain: held[t.plain] for t in r.targets if t.plain in held}
                for v, f in names.items():
                    left = Frame(f.frame.df.join(gone, "id", "left_anti"), space)
                    facts[v] = Relation(f.kind, left, f.value, f.literal, f.domain and Frame(f.domain.df.join(gone, "id", "left_anti")))
            scope.facts.update(facts)
            scope.memo.clear()
        return facts

    def run_outputs(self, deep: tuple[str, ...], scope: Scope) -> None:
        for r in self.rules.rules:
            if r.kind == "output" and any(s.levels == deep for a in r.signature.sources for _, s in a.paths()):
                if r.conditional is None or self.truth(r.conditional, scope):
                    frame, sources, _ = self.context(r, scope)
                    r.body(frame.df if frame else None, *sources)

    def cut(self, r: Relation) -> Relation:
        """Cuts the lineage: params become literals, stores are checkpointed to the shared folder."""
        if r.kind is Kind.BLACKBOX or (r.kind is Kind.PARAM and r.frame is None):
            return r
        if r.kind is Kind.PARAM:
            return Relation(Kind.PARAM, literal=r.df().first()[0])
        from ..session import checkpoint

        df = checkpoint(r.df())
        return Relation(r.kind, Frame(df, r.frame.key_space), F.col("dst" if r.kind in (Kind.MAP, Kind.MULTIMAP) else "value") if r.kind is not Kind.CONSTRAINT else None)
