"""Option lists and variable files: ``{ name: value ... }`` with nested options, units, lists and comments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from .units import Quantity, parse_quantity


class OptionsError(ValueError):
    """A malformed option list or a key that isn't allowed."""


_TOKEN = re.compile(r'\s*(?:(//[^\n]*|/\*.*?\*/)|("(?:[^"\\]|\\.)*")|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([A-Za-z_$][A-Za-z_0-9@.]*)|(.))', re.S)


@dataclass
class Options:
    """Named values: numbers, quantities, strings, booleans, names, lists, functions (a name with inner options)."""

    values: dict[str, Any] = field(default_factory=dict)
    allowed: frozenset[str] | None = None

    def get(self, name: str) -> Any:
        if name not in self.values:
            raise OptionsError(f"no option {name}")
        return self.values[name]

    def get_units(self, name: str, unit: str) -> float:
        v = self.get(name)
        return v.get_value_in(unit) if isinstance(v, Quantity) else float(v)

    def set(self, name: str, value: Any) -> None:
        if self.allowed is not None and name not in self.allowed:
            raise OptionsError(f"option {name} isn't one of {', '.join(sorted(self.allowed))}")
        self.values[name] = value

    def exists(self, name: str) -> bool:
        return name in self.values

    def check(self, name: str, value: str) -> bool:
        return self.exists(name) and str(self.values[name]) == value


@dataclass(frozen=True)
class Call:
    name: str
    options: Any


class _Reader:
    def __init__(self, text: str):
        self.tokens = [m.groups()[1:] for m in _TOKEN.finditer(text) if m[1] is None and m[0].strip()]
        self.at = 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None,) * 4

    def take(self, s: str) -> bool:
        if self.peek()[3] == s:
            self.at += 1
            return True
        return False

    def value(self, stop: str) -> Any:
        string, number, name, symbol = self.peek()
        self.at += 1
        if string is not None:
            return string[1:-1].replace('\\"', '"')
        if number is not None:
            unit = ""
            while (t := self.peek())[2] is not None or (t[3] is not None and t[3] in "*/^") or (unit[-1:] in ("/", "^") and t[1] is not None):
                nxt = self.tokens[self.at + 1] if self.at + 1 < len(self.tokens) else (None,) * 4
                if t[2] is not None and nxt[3] in (":", "=") and unit[-1:] not in ("*", "/"):
                    break
                unit += next(x for x in t if x is not None)
                self.at += 1
            x = float(number)
            return parse_quantity(f"{number} {unit}") if unit else int(x) if re.fullmatch(r"[-+]?\d+", number) else x
        if name is not None:
            if self.take("("):
                return Call(name, self.items(")", "="))
            return {"true": True, "false": False}.get(name, name)
        if symbol in "[(":
            out = []
            end = "]" if symbol == "[" else ")"
            while not self.take(end):
                if self.at >= len(self.tokens):
                    raise OptionsError(f"missing {end}")
                out.append(self.value(end))
                self.take(",")
            return out
        if symbol == "<":
            return self.items(">", "=")
        raise OptionsError(f"unexpected {symbol!r}")

    def items(self, end: str, sep: str) -> Any:
        named, rest = {}, []
        while not self.take(end):
            if self.at >= len(self.tokens):
                raise OptionsError(f"missing {end}")
            nxt = self.tokens[self.at + 1] if self.at + 1 < len(self.tokens) else (None,) * 4
            if self.peek()[2] is not None and nxt[3] == sep:
                key = self.peek()[2]
                self.at += 2
                named[key] = self.value(end)
            else:
                rest.append(self.value(end))
            self.take(",")
        return Options(named) if not rest else rest if not named else Options(named | {"": rest})


def parse_vars(text: str) -> dict[str, Any]:
    """A variable file's facts by name; ``ns @ { ... }`` blocks give names ns@x."""
    r, out = _Reader(text), {}
    while r.at < len(r.tokens):
        prefix = ""
        if r.peek()[2] is not None:
            prefix = r.peek()[2].rstrip("@") + "@"
            r.at += 1
            r.take("@")
        if not r.take("{"):
            raise OptionsError("expected {")
        while not r.take("}"):
            name = r.peek()[2]
            if name is None:
                raise OptionsError(f"expected a name, found {r.peek()}")
            r.at += 1
            if not r.take(":"):
                raise OptionsError(f"expected : after {name}")
            out[prefix + name] = r.value("}")
            r.take(",")
    return out


def parse_options(text: str, allowed: set[str] | None = None) -> Options:
    r = _Reader(text)
    start = r.take("<")
    out = r.items(">", "=") if start else _Reader(text + ">").items(">", "=")
    out = out if isinstance(out, Options) else Options({"": out})
    if allowed is not None and (bad := set(out.values) - allowed):
        raise OptionsError(f"options not allowed: {', '.join(sorted(bad))}")
    out.allowed = frozenset(allowed) if allowed is not None else None
    return out
