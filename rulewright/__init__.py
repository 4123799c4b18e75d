"""rulewright: a goal-directed rule and fact analytics engine on PySpark."""

from .catalog import Catalog, CatalogError, Frame, Kind, Relation, blackbox, constraint, map_, multimap, param, store
from .engine import Engine, wavefront
from .names import parse_query, parse_signature, parse_variable
from .operators.reduce import OPERATORS, Reduction
from .plans.planner import Planner, PlanError
from .rules import Rule, RuleBase, RuleError
from .session import start

__all__ = ["OPERATORS", "Catalog", "CatalogError", "Engine", "Frame", "Kind", "PlanError", "Planner", "Reduction", "Relation", "Rule", "RuleBase", "RuleError", "blackbox", "constraint", "map_", "multimap", "param", "parse_query", "parse_signature", "parse_variable", "start", "store", "wavefront"]
