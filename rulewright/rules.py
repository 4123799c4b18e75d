"""Rules and the rule base.

Rules are declared with decorators over a signature; the body gets Columns for its sources, in
order, and returns a Column, or a tuple of them for several targets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from .names import Access, Signature, Variable, parse_accesses, parse_signature, parse_variable

KINDS = ("pointwise", "singleton", "unit", "apply", "default", "optional", "constraint", "map", "blackbox", "super", "insertion", "deletion", "erase", "output")

#: Options of a rule: ``specialized`` rules answer their own name alone and aren't instantiated; ``inplace`` ("new|old") says that
#: a target takes the place of a source, which for columns is a new column over the same rows; ``partitions`` deals the entities out
#: by id before the body; ``key_space`` is that of an insertion, deletion or erase rule; ``relaxed_recursion`` runs a recursion once.
OPTIONS = {"specialized", "inplace", "partitions", "key_space", "relaxed_recursion", "param"}


class RuleError(ValueError):
    """A rule that can't be registered."""


@dataclass(frozen=True)
class Rule:
    kind: str
    signature: Signature
    body: Callable | Any
    constraints: tuple[Access, ...] = ()
    op: Any = None
    conditional: Variable | None = None
    parametric: tuple[str, ...] = ()
    prelude: Callable | None = None
    postlude: Callable | None = None
    comments: str = ""
    options: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def targets(self) -> list[Variable]:
        return [v for a in self.signature.targets for v in a.values]

    @property
    def levels(self) -> tuple[str, ...]:
        return max((v.levels for v in self.targets), key=len, default=())

    @property
    def phase(self) -> str:
        """build (x{n=0}), advance (x{n+1}), collapse (no level from a level), specific (x{n}) or generic."""
        t = self.targets[0]
        deep = max((len(v.levels) for s in self.signature.sources for _, v in s.paths()), default=0)
        if max(deep, len(self.conditional.levels) if self.conditional else 0) > len(t.levels):
            return "collapse"
        if t.start is not None:
            return "build"
        if t.offset > 0:
            return "advance"
        return "specific" if t.levels else "generic"

    def substitute(self, binding: dict[str, Variable]) -> Rule:
        return replace(self, signature=self.signature.substitute(binding), constraints=tuple(c.substitute(binding) for c in self.constraints), conditional=self.conditional and self.conditional.substitute(binding), parametric=())

    def __str__(self) -> str:
        extra = "".join(f", constraint({c})" for c in self.constraints) + (f", conditional({self.conditional})" if self.conditional else "")
        return f"{self.kind}({self.signature}{extra})"


def unify(pattern: Variable, goal: Variable, free: set[str], binding: dict[str, Variable]) -> bool:
    """Binds the free names of a parametric pattern to the goal's arguments."""
    if not pattern.args and pattern.name in free and not pattern.namespace:
        if pattern.name in binding:
            return binding[pattern.name] == goal
        binding[pattern.name] = goal
        return True
    if pattern.name != goal.name or pattern.namespace != goal.namespace or len(pattern.args) != len(goal.args):
        return False
    return all(unify(p, g, free, binding) for p, g in zip(pattern.args, goal.args, strict=True))


class RuleBase:
    """Rules by target; parametric ones are instantiated when a goal asks for them."""

    def __init__(self):
        self.rules: list[Rule] = []

    def add(self, rule: Rule) -> Rule:
        if not rule.targets:
            raise RuleError(f"{rule}: no target")
        if rule.kind not in KINDS:
            raise RuleError(f"unknown kind of rule {rule.kind!r}")
        if rule.kind == "pointwise" and rule.options.get("param"):
            raise RuleError(f"{rule}: a pointwise rule can't produce a param; use singleton")
        if rule.kind == "singleton" and any(s.maps for s in rule.signature.sources):
            raise RuleError(f"{rule}: a singleton rule reads params alone")
        if rule.kind == "apply" and rule.op is None:
            raise RuleError(f"{rule}: an apply rule needs an operator")
        if unknown := set(rule.options) - OPTIONS:
            raise RuleError(f"{rule}: unknown options {', '.join(sorted(unknown))}")
        if rule.options.get("inplace"):
            new, _, old = rule.options["inplace"].partition("|")
            if new not in map(str, rule.targets) or old not in {str(v) for a in rule.signature.sources for _, v in a.paths()}:
                raise RuleError(f"{rule}: inplace names a target and a source, as in 'new|old'")
        if rule.kind not in ("apply", "insertion", "output") and any(t.maps for t in rule.signature.targets):
            raise RuleError(f"{rule}: only apply rules write through maps")
        self.rules.append(rule)
        return rule

    def extend(self, other: RuleBase) -> None:
        self.rules += other.rules

    def defining(self, goal: Variable) -> list[Rule]:
        """Rules with ``goal`` (time level and priority aside) as a target, parametric ones instantiated."""
        out = []
        for r in self.rules:
            for t in r.targets:
                if t.base == goal.base:
                    out.append(r)
                    break
                if t.args and not r.options.get("specialized"):
                    free = set(r.parametric) or {a.name for a in t.args if not a.args}
                    binding: dict[str, Variable] = {}
                    if unify(t.base, goal.base, free, binding):
                        out.append(r.substitute(binding))
                        break
        return out

    def _declare(self, kind: str, signature: str, **more):
        sig = parse_signature(signature)
        cons = more.pop("constraint", None)
        cond = more.pop("conditional", None)
        par = more.pop("parametric", ())
        known = {k: more.pop(k) for k in ("op", "prelude", "postlude", "comments") if k in more}

        def register(body):
            doc = known.pop("comments", "") or (getattr(body, "__doc__", None) or "" if callable(body) else "")
            self.add(Rule(kind, sig, body, parse_accesses(cons) if cons else (), conditional=parse_variable(cond) if cond else None, parametric=tuple(par.split(",")) if isinstance(par, str) else tuple(par), comments=doc, options=more, **known))
            return body

        return register

    def pointwise(self, signature: str, **kw):
        return self._declare("pointwise", signature, **kw)

    def singleton(self, signature: str, **kw):
        return self._declare("singleton", signature, **kw)

    def unit(self, signature: str, identity=None, **kw):
        """The identity of a reduction over a constraint; it alone decides for which entities the target exists."""
        return self._declare("unit", signature, **kw)(identity)

    def apply(self, signature: str, op, **kw):
        return self._declare("apply", signature, op=op, **kw)

    def default(self, name: str, value, **kw):
        return self._declare("default", name, **kw)(value)

    def optional(self, name: str, **kw):
        return self._declare("optional", name, **kw)(None)

    def constraint(self, signature: str, **kw):
        return self._declare("constraint", signature, **kw)

    def map(self, signature: str, **kw):
        return self._declare("map", signature, **kw)

    def blackbox(self, signature: str, **kw):
        return self._declare("blackbox", signature, **kw)

    def super(self, signature: str, **kw):
        return self._declare("super", signature, **kw)

    def insertion(self, signature: str, **kw):
        return self._declare("insertion", signature, **kw)

    def deletion(self, signature: str, **kw):
        return self._declare("deletion", signature, **kw)

    def erase(self, signature: str, **kw):
        return self._declare("erase", signature, **kw)

    def output(self, signature: str, **kw):
        """A side effect that runs whenever its sources can be had."""
        return self._declare("output", signature, **kw)
