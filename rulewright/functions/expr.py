"""The numeric expression language: parser, evaluation on the driver or as a Column, substitution, derivative, simplification, LaTeX."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExprError(ValueError):
    """Not an expression, or an undefined name or function."""


@dataclass(frozen=True)
class Node:
    """op is 'num', 'name', 'call' or an operator; for calls and names ``value`` is the name."""

    op: str
    value: object = None
    args: tuple[Node, ...] = ()

    def __str__(self) -> str:
        if self.op == "num":
            return f"{self.value:g}" if self.value >= 0 else f"({self.value:g})"
        if self.op == "name":
            return str(self.value)
        if self.op == "call":
            return f"{self.value}({','.join(map(str, self.args))})"
        if len(self.args) == 1:
            return f"{self.op}{self.args[0]}"
        return "(" + self.op.join(map(str, self.args)) + ")"


def num(x: float) -> Node:
    return Node("num", float(x))


#: Binding strength, loosest first; one row binds alike, to the left.
PRECEDENCE = [[":"], [","], ["="], ["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">="], ["<<", ">>"], ["+", "-"], ["*", "/", "%"], ["->"], ["@", "::"]]
_POWER = {t: i for i, row in enumerate(PRECEDENCE) for t in row}
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z_0-9]*)|(<<|>>|<=|>=|==|!=|\|\||&&|->|::|[-+*/%<>=!~&|^@:,()$]))")
FUNCTIONS = {
    "sin": (math.sin, F.sin), "cos": (math.cos, F.cos), "tan": (math.tan, F.tan), "asin": (math.asin, F.asin), "acos": (math.acos, F.acos), "atan": (math.atan, F.atan),
    "sinh": (math.sinh, F.sinh), "cosh": (math.cosh, F.cosh), "tanh": (math.tanh, F.tanh), "exp": (math.exp, F.exp), "sqrt": (math.sqrt, F.sqrt),
    "ln": (math.log, F.log), "log": (math.log, F.log), "log10": (math.log10, F.log10), "pow": (math.pow, F.pow),
}
CONSTANTS = {"pi": math.pi}


def parse(text: str) -> Node:
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ExprError(f"can't read {text[at:]!r}")
        tokens.append(m.groups())
        at = m.end()
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else (None, None, None)

    def take(symbol: str) -> None:
        nonlocal pos
        if peek()[2] != symbol:
            raise ExprError(f"expected {symbol!r} in {text!r}")
        pos += 1

    def primary() -> Node:
        nonlocal pos
        number, name, symbol = peek()
        pos += 1
        if number is not None:
            return num(float(number))
        if name is not None:
            if peek()[2] != "(":
                return Node("name", name)
            take("(")
            args = []
            while peek()[2] != ")":
                args.append(binary(_POWER[","] + 1))
                if peek()[2] == ",":
                    take(",")
            take(")")
            return Node("call", name, tuple(args))
        if symbol == "(":
            inner = binary(0)
            take(")")
            return inner
        if symbol in ("+", "-", "!", "~", "&", "$", "*"):
            inner = primary()
            return inner if symbol == "+" else Node(symbol, None, (inner,))
        raise ExprError(f"unexpected end or symbol {symbol!r} in {text!r}")

    def binary(least: int) -> Node:
        nonlocal pos
        left = primary()
        while (s := peek()[2]) in _POWER and _POWER[s] >= least:
            pos += 1
            left = Node(s, None, (left, binary(_POWER[s] + 1)))
        return left

    out = binary(0)
    if pos != len(tokens):
        raise ExprError(f"unexpected rest in {text!r}")
    return out


_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}
_COMPARE = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "&&": lambda a, b: a & b, "||": lambda a, b: a | b, "%": lambda a, b: a % b}


def _run(n: Node, names: dict, which: int):
    if n.op == "num":
        return n.value if which == 0 else F.lit(n.value)
    if n.op == "name":
        if n.value in names:
            return names[n.value]
        if n.value in CONSTANTS:
            return CONSTANTS[n.value] if which == 0 else F.lit(CONSTANTS[n.value])
        if which == 1 and names.get("*"):
            return F.col(n.value)
        raise ExprError(f"undefined name {n.value}")
    args = [_run(a, names, which) for a in n.args]
    if n.op == "call":
        if n.value not in FUNCTIONS:
            raise ExprError(f"undefined function {n.value}")
        return FUNCTIONS[n.value][which](*args)
    if n.op == "-" and len(args) == 1:
        return -args[0]
    if n.op == "!" and len(args) == 1:
        return ~args[0] if which else not args[0]
    table = _ARITHMETIC | _COMPARE
    if len(args) == 2 and n.op in table:
        return table[n.op](*args)
    raise ExprError(f"operator {n.op} has no value")


def evaluate(n: Node | str, **names: float) -> float:
    return _run(parse(n) if isinstance(n, str) else n, names, 0)


def column(n: Node | str, **names: Column) -> Column:
    """A Column; names that aren't given are columns of that name."""
    return _run(parse(n) if isinstance(n, str) else n, {"*": True, **names}, 1)


def substitute(n: Node, names: dict[str, Node]) -> Node:
    if n.op == "name":
        return names.get(n.value, n)
    return Node(n.op, n.value, tuple(substitute(a, names) for a in n.args))


def _call(name: str, *args: Node) -> Node:
    return Node("call", name, args)


def _op(s: str, *args: Node) -> Node:
    return Node(s, None, args)


_OUTER = {
    "sin": lambda u: _call("cos", u), "cos": lambda u: _op("-", _call("sin", u)), "tan": lambda u: _op("/", num(1), _call("pow", _call("cos", u), num(2))),
    "asin": lambda u: _op("/", num(1), _call("sqrt", _op("-", num(1), _op("*", u, u)))), "acos": lambda u: _op("-", _op("/", num(1), _call("sqrt", _op("-", num(1), _op("*", u, u))))),
    "atan": lambda u: _op("/", num(1), _op("+", num(1), _op("*", u, u))), "ln": lambda u: _op("/", num(1), u), "log": lambda u: _op("/", num(1), u),
    "log10": lambda u: _op("/", num(1), _op("*", u, num(math.log(10)))), "exp": lambda u: _call("exp", u), "sinh": lambda u: _call("cosh", u), "cosh": lambda u: _call("sinh", u),
    "tanh": lambda u: _op("-", num(1), _call("pow", _call("tanh", u), num(2))), "sqrt": lambda u: _op("/", num(0.5), _call("sqrt", u)),
}


def derivative(n: Node, x: str) -> Node:
    return simplify(_derive(n, x))


def _derive(n: Node, x: str) -> Node:
    if n.op == "num":
        return num(0)
    if n.op == "name":
        return num(float(n.value == x))
    if n.op == "call" and n.value == "pow":
        u, v = n.args
        du, dv = _derive(u, x), _derive(v, x)
        power = _op("*", _op("*", v, _call("pow", u, _op("-", v, num(1)))), du)
        if simplify(dv) == num(0):
            return power
        return _op("+", power, _op("*", _op("*", n, _call("ln", u)), dv))
    if n.op == "call":
        if n.value not in _OUTER:
            raise ExprError(f"no derivative of {n.value}")
        return _op("*", _OUTER[n.value](n.args[0]), _derive(n.args[0], x))
    d = [_derive(a, x) for a in n.args]
    if n.op in "+-" and len(d) <= 2:
        return _op(n.op, *d)
    u, v = n.args
    if n.op == "*":
        return _op("+", _op("*", d[0], v), _op("*", u, d[1]))
    if n.op == "/":
        return _op("/", _op("-", _op("*", d[0], v), _op("*", u, d[1])), _op("*", v, v))
    raise ExprError(f"no derivative of {n.op}")


def simplify(n: Node) -> Node:
    """Folds constants and drops neutral elements."""
    args = tuple(simplify(a) for a in n.args)
    n = Node(n.op, n.value, args)
    if n.op in ("num", "name"):
        return n
    if all(a.op == "num" for a in args) and (n.op in _ARITHMETIC or (n.op == "call" and n.value in FUNCTIONS)):
        try:
            return num(_run(n, {}, 0))
        except (ZeroDivisionError, ValueError, OverflowError):
            return n
    zero, one = num(0), num(1)
    if len(args) == 2:
        a, b = args
        match n.op:
            case "+":
                return b if a == zero else a if b == zero else n
            case "-":
                return a if b == zero else simplify(_op("-", b)) if a == zero else zero if a == b else n
            case "*":
                return zero if zero in args else b if a == one else a if b == one else n
            case "/":
                return zero if a == zero else a if b == one else n
            case "call":
                return one if n.value == "pow" and b == zero else a if n.value == "pow" and b == one else n
    if n.op == "-" and args[0].op == "-" and len(args[0].args) == 1:
        return args[0].args[0]
    return n


def latex(n: Node) -> str:
    if n.op == "num":
        return f"{n.value:g}"
    if n.op == "name":
        return r"\pi" if n.value == "pi" else str(n.value)
    a = [latex(x) for x in n.args]
    if n.op == "call":
        return {"sqrt": lambda: rf"\sqrt{{{a[0]}}}", "pow": lambda: f"{{{a[0]}}}^{{{a[1]}}}"}.get(n.value, lambda: rf"\{n.value}\left({', '.join(a)}\right)")()
    if n.op == "/":
        return rf"\frac{{{a[0]}}}{{{a[1]}}}"
    if len(a) == 1:
        return n.op + a[0]
    return rf"\left({(' ' if n.op == '*' else n.op).join(a)}\right)"


def shared(nodes: list[Node]) -> list[Node]:
    """Sub-expressions that occur more than once, inner first (common sub-expressions)."""
    seen: dict[Node, int] = {}

    def walk(n: Node) -> None:
        seen[n] = seen.get(n, 0) + 1
        if seen[n] == 1:
            for a in n.args:
                walk(a)

    for n in nodes:
        walk(n)
    size = lambda n: 1 + sum(map(size, n.args))
    return sorted((n for n, c in seen.items() if c > 1 and n.args), key=size)


def total(nodes: list[Node]) -> Node:
    return reduce(lambda a, b: _op("+", a, b), nodes, num(0)) if nodes else num(0)
