"""The fact catalog: named containers over integer entity ids.

A container is a value expression over a *frame*, a DataFrame with a column ``id``.
Containers that come from one table share its frame, so a rule that reads several of them plans no
join.  Absence of an entity means absence of a row; values are never null to say so.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import Variable, parse_variable


class Kind(Enum):
    STORE = "store"  # a value per entity
    MAP = "map"  # an entity per entity
    MULTIMAP = "multimap"  # an ordered list of entities per entity
    MULTISTORE = "multistore"  # an array per entity
    PARAM = "param"  # one value
    CONSTRAINT = "constraint"  # a set of entities
    BLACKBOX = "blackbox"  # an opaque driver object


class CatalogError(KeyError):
    """An unknown, clashing or mistyped fact."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


@dataclass
class Frame:
    """Rows by entity.  Two containers over one Frame, or over a Frame and one derived from it, are aligned without a join."""

    df: DataFrame
    key_space: str = "main"
    parent: Frame | None = None  # a frame whose columns this one keeps, on a subset of its entities

    def descends(self, other: Frame) -> bool:
        f: Frame | None = self
        while f is not None:
            if f is other:
                return True
            f = f.parent
        return False


@dataclass
class Relation:
    kind: Kind
    frame: Frame | None = None
    value: Column | None = None
    literal: Any = None
    domain: Frame | None = None

    def df(self) -> DataFrame:
        """(id, value); (id, dst) for maps; (id, pos, dst) for multimaps; (id) for constraints; one row (value) for params."""
        if self.kind is Kind.BLACKBOX:
            raise CatalogError("a blackbox has no rows")
        if self.kind is Kind.PARAM and self.frame is None:
            return SparkSession.active().range(1).select(F.lit(self.literal).alias("value"))
        if self.kind is Kind.PARAM:
            return self.frame.df.select(self.value.alias("value"))
        if self.kind is Kind.CONSTRAINT:
            return self.frame.df.select("id").distinct()
        if self.kind is Kind.MAP:
            return self.frame.df.select("id", self.value.cast("long").alias("dst"))
        if self.kind is Kind.MULTIMAP:
            return self.frame.df.select("id", "pos", "dst")
        return self.frame.df.select("id", self.value.alias("value"))


def store(df: DataFrame, key_space: str = "main") -> Relation:
    return Relation(Kind.STORE, Frame(df, key_space), F.col("value"))


def map_(df: DataFrame, key_space: str = "main") -> Relation:
    return Relation(Kind.MAP, Frame(df, key_space), F.col("dst"))


def multimap(df: DataFrame, key_space: str = "main", domain: DataFrame | None = None) -> Relation:
    """``domain`` lists the entities that have a, possibly empty, list."""
    return Relation(Kind.MULTIMAP, Frame(df, key_space), F.col("dst"), domain=None if domain is None else Frame(domain, key_space))


def constraint(df: DataFrame, key_space: str = "main") -> Relation:
    return Relation(Kind.CONSTRAINT, Frame(df, key_space))


def param(value: Any) -> Relation:
    if isinstance(value, DataFrame):
        return Relation(Kind.PARAM, Frame(value), F.col(value.columns[0]))
    return Relation(Kind.PARAM, literal=value)


def blackbox(value: Any) -> Relation:
    return Relation(Kind.BLACKBOX, literal=value)


@dataclass
class Catalog:
    """Facts by name.  Extensional facts are given; intensional ones were derived by a query."""

    facts: dict[Variable, Relation] = field(default_factory=dict)
    given: set[Variable] = field(default_factory=set)
    synonyms: dict[Variable, Variable] = field(default_factory=dict)

    @staticmethod
    def key(name: str | Variable, namespace: str | None = None) -> Variable:
        v = parse_variable(name) if isinstance(name, str) else name
        return Variable(v.name, v.args, v.levels, v.offset, v.start, v.priority, (namespace, *v.namespace)) if namespace else v

    def resolve(self, name: str | Variable) -> Variable:
        v = self.key(name)
        seen = set()
        while v in self.synonyms and v not in seen:
            seen.add(v)
            v = self.synonyms[v]
        return v

    def create(self, name: str, relation: Relation, namespace: str | None = None) -> None:
        v = self.key(name, namespace)
        if self.resolve(v) in self.facts:
            raise CatalogError(f"fact {v} exists; update or replace it")
        self._put(v, relation, True)

    def _put(self, v: Variable, relation: Relation, given: bool) -> None:
        v = self.resolve(v)
        self.facts[v] = relation
        (self.given.add if given else self.given.discard)(v)

    def update(self, name: str | Variable, relation: Relation) -> None:
        """Same kind, new contents."""
        old = self.get(name)
        if old.kind is not relation.kind:
            raise CatalogError(f"fact {name} is a {old.kind.value}, not a {relation.kind.value}")
        self._put(self.key(name), relation, self.resolve(name) in self.given)

    def replace(self, name: str, relation: Relation) -> None:
        """Any kind."""
        self._put(self.key(name), relation, True)

    def setdefault(self, name: str | Variable, relation: Relation) -> Relation:
        v = self.resolve(name)
        if v not in self.facts:
            self._put(v, relation, False)
        return self.facts[v]

    def remove(self, name: str) -> None:
        v = self.resolve(name)
        self.get(v)
        del self.facts[v]
        self.given.discard(v)

    def synonym(self, name: str, of: str) -> None:
        v = self.key(name)
        if v in self.facts:
            raise CatalogError(f"fact {v} exists and can't become a synonym")
        self.synonyms[v] = self.key(of)

    def get(self, name: str | Variable) -> Relation:
        v = self.resolve(name)
        if v not in self.facts:
            raise CatalogError(f"no fact {v}; known: {', '.join(sorted(map(str, self.facts)))}")
        return self.facts[v]

    def __contains__(self, name: str | Variable) -> bool:
        return self.resolve(name) in self.facts

    def erase_intensional(self) -> None:
        for v in [v for v in self.facts if v not in self.given]:
            del self.facts[v]

    def copy(self) -> Catalog:
        return Catalog(dict(self.facts), set(self.given), dict(self.synonyms))

    def table(self, df: DataFrame, key: str, stores: dict[str, str] | None = None, maps: dict[str, str] | None = None, entities: str | None = None, key_space: str = "main") -> None:
        """Columns of a table as containers over one frame: stores and maps by name, the keys as a constraint."""
        frame = Frame(df.withColumn("id", F.col(key).cast("long")), key_space)
        for name, column in (stores or {}).items():
            self.create(name, Relation(Kind.STORE, frame, F.col(column)))
        for name, column in (maps or {}).items():
            self.create(name, Relation(Kind.MAP, frame, F.col(column).cast("long")))
        if entities:
            self.create(entities, Relation(Kind.CONSTRAINT, frame))
