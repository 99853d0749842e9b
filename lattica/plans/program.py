"""Small dataflow programs as JSON: assignments, branches and loops on the driver around lazy tables.

A program is a list of statements; an expression is a literal, {"var": name}, {"op": o, "args": [...]}, {"list": [...]},
{"at": [list, index]}, {"slice": [list, start, stop, step]} or {"call": method, "args": [...], "kwargs": {...}} on Studio.
"""

from __future__ import annotations

import json
import math

from ..functions.numeric import INF, NAN
from ..studio import CALLS, Studio
from ..table import Table, View

MOST_ROUNDS = 1_000_000


class ProgramError(ValueError):
    pass


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class _Return(Exception):
    def __init__(self, value):
        self.value = value


def number(v) -> float:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return v
    if isinstance(v, str):
        try:
            return float(v) if v.strip() else 0.0
        except ValueError:
            return NAN
    raise ProgramError(f"not a number: {v!r}")


def truthy(v) -> bool:
    return True if isinstance(v, (Table, View)) else bool(v) and v == v


def _divide(a: float, b: float) -> float:
    return a / b if b else NAN if a == 0 or a != a else math.copysign(INF, a) * math.copysign(1, b)


ARITHMETIC = {
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": _divide,
    "//": lambda a, b: math.floor(a / b) if b else _divide(a, b),
    "%": lambda a, b: math.fmod(a, b) if b else NAN,
    "**": lambda a, b: a**b,
}
ORDER = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
KINDS = {"let": {"name", "value"}, "print": {"value"}, "if": {"cases"}, "repeat": {"times", "body"}, "while": {"test", "body"}, "each": {"name", "over", "body"}, "def": {"name", "params", "body"}, "run": {"value"}, "return": set(), "break": set(), "continue": set(), "raw": set()}


def problems(program: list) -> list[str]:
    """What is wrong with a program's shape; checked before every run."""
    out = []
    for k, s in enumerate(program):
        kind = s.get("do") if isinstance(s, dict) else None
        if kind not in KINDS:
            out.append(f"statement {k}: unknown {kind!r}")
            continue
        out += [f"statement {k}: {kind} needs {key}" for key in sorted(KINDS[kind] - s.keys())]
        bodies = [s.get("body", []), s.get("else", []), *(c.get("body", []) for c in s.get("cases", []))]
        out += [f"statement {k} > {p}" for b in bodies for p in problems(b)]
    return out


class Program:
    def __init__(self, body: list | str, studio: Studio):
        self.body = json.loads(body) if isinstance(body, str) else body
        self.studio, self.scopes, self.functions = studio, [{}], {}
        self.printed: list[str] = []

    def run(self) -> dict:
        """Runs the program; its variables at the end."""
        if found := problems(self.body):
            raise ProgramError("; ".join(found))
        try:
            self.block(self.body)
        except (_Break, _Continue, _Return):
            pass
        return self.scopes[0]

    def find(self, name: str):
        for scope in reversed(self.scopes):
            if name in scope:
                return scope[name]
        raise ProgramError(f"{name} is not defined")

    def value(self, e):
        if isinstance(e, list):
            return [self.value(x) for x in e]
        if not isinstance(e, dict):
            return e
        if "var" in e:
            return self.find(e["var"])
        if "list" in e:
            return [self.value(x) for x in e["list"]]
        if "dict" in e:
            return {k: self.value(x) for k, x in e["dict"].items()}
        if "at" in e:
            items, i = (self.value(x) for x in e["at"])
            i = int(number(i))
            return items[i] if -len(items) <= i < len(items) else None
        if "slice" in e:
            items, *cut = (self.value(x) for x in e["slice"])
            return items[slice(*(None if c is None else int(c) for c in cut))]
        if "op" in e:
            return self.operator(e["op"], [self.value(x) for x in e["args"]])
        if "call" in e:
            args = [self.value(x) for x in e.get("args", [])]
            if e["call"] in self.functions:
                return self.call(e["call"], args)
            if e["call"] not in CALLS:
                raise ProgramError(f"no such call {e['call']!r}")
            return getattr(self.studio, e["call"])(*args, **{k: self.value(x) for k, x in e.get("kwargs", {}).items()})
        raise ProgramError(f"no such expression {e!r}")

    def operator(self, op: str, args: list):
        """Both sides are evaluated first; and, or give one of them."""
        if op == "not":
            return not truthy(args[0])
        if len(args) == 1 and op == "-":
            return -number(args[0])
        a, b = args
        if op in ("and", "or"):
            return (b if truthy(a) else a) if op == "and" else (a if truthy(a) else b)
        if op == "+":
            return f"{a}{b}" if isinstance(a, str) or isinstance(b, str) else number(a) + number(b)
        if op in ORDER:
            return ORDER[op](a, b) if isinstance(a, str) and isinstance(b, str) else ORDER[op](number(a), number(b))
        if op in ARITHMETIC:
            return ARITHMETIC[op](number(a), number(b))
        raise ProgramError(f"no such operator {op!r}")

    def call(self, name: str, args: list):
        names, body = self.functions[name]
        self.scopes.append(dict(zip(names, [*args, *[None] * len(names)])))
        try:
            self.block(body)
        except _Return as r:
            return r.value
        finally:
            self.scopes.pop()
        return None

    def block(self, body: list) -> None:
        for s in body:
            getattr(self, f"do_{s['do']}")(s)

    def loop(self, body: list) -> bool:
        try:
            self.block(body)
        except _Continue:
            pass
        except _Break:
            return False
        return True

    def do_let(self, s: dict) -> None:
        self.scopes[-1][s["name"]] = self.value(s["value"])

    def do_run(self, s: dict) -> None:
        self.value(s["value"])

    def do_print(self, s: dict) -> None:
        self.printed.append(str(self.value(s["value"])))

    def do_if(self, s: dict) -> None:
        for case in s["cases"]:
            if truthy(self.value(case["test"])):
                return self.block(case["body"])
        self.block(s.get("else", []))

    def do_repeat(self, s: dict) -> None:
        times = number(self.value(s["times"]))
        times = 0 if times != times else max(0, math.floor(times))
        if times > MOST_ROUNDS:
            raise ProgramError("too many rounds")
        for _ in range(times):
            if not self.loop(s["body"]):
                break

    def do_while(self, s: dict) -> None:
        for _ in range(MOST_ROUNDS):
            if not truthy(self.value(s["test"])) or not self.loop(s["body"]):
                return
        raise ProgramError("too many rounds")

    def do_each(self, s: dict) -> None:
        over = self.value(s["over"])
        for item in over.columns if isinstance(over, Table) else over:
            self.scopes[-1][s["name"]] = item
            if not self.loop(s["body"]):
                break

    def do_def(self, s: dict) -> None:
        self.functions[s["name"]] = (s["params"], s["body"])

    def do_return(self, s: dict) -> None:
        raise _Return(self.value(s.get("value")))

    def do_break(self, s: dict) -> None:
        raise _Break

    def do_continue(self, s: dict) -> None:
        raise _Continue

    def do_raw(self, s: dict) -> None:
        """Foreign code is kept in a program and never run."""
