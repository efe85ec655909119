"""Two small languages, parsed once on the driver and compiled to columns.

Conditions: ``status in ['open', 'done'] and kind not in ["x"] or ...``; strings only, ``or`` binds least, no
parentheses. A field that is missing or no string is in no list, hence "not in" every list.

Formulas: one optional comparison over + - * / with unary minus, parentheses, numbers and names. Results follow
IEEE doubles (x / 0 is an infinity or NaN; comparisons with NaN are false); == and != allow 1e-9. A name without a
value makes the formula fail.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-9


class SyntaxProblem(ValueError):
    """The text is no expression of the language."""


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()


def _lex(text: str, pattern: re.Pattern) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = pattern.match(text, at)
        if not m or m.end() == at:
            raise SyntaxProblem(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


class _Stream:
    def __init__(self, found: list[tuple[str, str]]):
        self.found, self.at = found, 0

    def peek(self) -> tuple[str, str]:
        return self.found[self.at] if self.at < len(self.found) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        kind, text = self.peek()
        if kind in wanted or text in wanted:
            self.at += 1
            return text
        return None

    def need(self, wanted: str) -> str:
        found = self.take(wanted)
        if found is None:
            raise SyntaxProblem(f"expected {wanted}, found {self.peek()[1] or 'the end'}")
        return found

    def finish(self, node: Node) -> Node:
        if self.peek()[0] != "end":
            raise SyntaxProblem(f"unexpected {self.peek()[1]!r} after the expression")
        return node


_CONDITION = re.compile(r"""(?P<space>\s+)|(?P<mark>[\[\],])|(?P<string>'[^']*'|"[^"]*")|(?P<name>[A-Za-z_][\w.]*)""")
_FORMULA = re.compile(r"(?P<space>\s+)|(?P<compare>==|!=|<=|>=|<|>)|(?P<mark>[-+*/()])|(?P<number>\d+(?:\.\d*)?|\.\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)")
_WORDS = {"and", "or", "in", "not"}


def parse_condition(text: str) -> Node:
    s = _Stream([("word", t) if k == "name" and t in _WORDS else (k, t) for k, t in _lex(text, _CONDITION)])

    def membership() -> Node:
        name = s.need("name")
        op = "not in" if s.take("not") else "in"
        s.need("in")
        s.need("[")
        values: list[str] = []
        if s.peek()[1] != "]":
            values.append(s.need("string")[1:-1])
            while s.take(","):
                values.append(s.need("string")[1:-1])
        s.need("]")
        return Node(op, (name, tuple(values)))

    def chain(word: str, inner: Callable[[], Node]) -> Node:
        node = inner()
        while s.take(word):
            node = Node(word, (node, inner()))
        return node

    return s.finish(chain("or", lambda: chain("and", membership)))


def condition_column(node: Node, value: Callable[[str], Column]) -> Column:
    """The condition as a boolean column that is never null; value(name) gives value structs."""
    if node.op in ("and", "or"):
        left, right = (condition_column(a, value) for a in node.args)
        return left & right if node.op == "and" else left | right
    name, texts = node.args
    v = value(name)
    within = F.coalesce((v["t"] == "string") & v["s"].isin(list(texts)), F.lit(False)) if texts else F.lit(False)
    return within if node.op == "in" else ~within


def evaluate_condition(node: Node, record: dict) -> bool:
    """The same over a nested dict, row at a time (meta checks and body rules)."""
    if node.op == "and":
        return all(evaluate_condition(a, record) for a in node.args)
    if node.op == "or":
        return any(evaluate_condition(a, record) for a in node.args)
    name, texts = node.args
    at: object = record
    for part in name.split("."):
        at = at.get(part) if isinstance(at, dict) else None
    return (isinstance(at, str) and at in texts) == (node.op == "in")


def parse_formula(text: str) -> Node:
    s = _Stream(_lex(text, _FORMULA))

    def primary() -> Node:
        if (n := s.take("number")) is not None:
            return Node("number", (float(n),))
        if (n := s.take("name")) is not None:
            return Node("name", (n,))
        if s.take("("):
            node = comparison()
            s.need(")")
            return node
        raise SyntaxProblem(f"unexpected {s.peek()[1] or 'end'}")

    def unary() -> Node:
        return Node("minus", (primary(),)) if s.take("-") else primary()

    def product() -> Node:
        node = unary()
        while op := s.take("*", "/"):
            node = Node(op, (node, unary()))
        return node

    def total() -> Node:
        node = product()
        while op := s.take("+", "-"):
            node = Node(op, (node, product()))
        return node

    def comparison() -> Node:
        node = total()
        return Node(op, (node, total())) if (op := s.take("compare")) else node

    return s.finish(comparison())


def formula_names(node: Node) -> set[str]:
    return {node.args[0]} if node.op == "name" else {n for a in node.args if isinstance(a, Node) for n in formula_names(a)}


def _divided(a: Column, b: Column) -> Column:
    """a / b as IEEE has it, where Spark would raise or give null."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return (
        F.when(b != 0, a / F.when(b != 0, b).otherwise(1.0))
        .when(F.isnan(a) | (a == 0), nan)
        .otherwise(F.when(a > 0, inf).otherwise(-inf))
    )


def _compared(op: str, a: Column, b: Column) -> Column:
    clear = ~F.isnan(a) & ~F.isnan(b)
    gap = F.abs(a - b)
    found = {
        "==": ~F.isnan(gap) & (gap < TOLERANCE), "!=": ~F.isnan(gap) & (gap >= TOLERANCE),
        "<": clear & (a < b), ">": clear & (a > b), "<=": clear & (a <= b), ">=": clear & (a >= b),
    }
    return found[op]


def formula_number(node: Node, value: Callable[[str], Column]) -> Column:
    """The formula as a double column (a comparison gives 1 or 0); null where a name has no number."""
    if node.op == "number":
        return F.lit(node.args[0])
    if node.op == "name":
        v = value(node.args[0])
        return F.when(v["t"].isin("number", "date"), v["n"]).when(v["t"] == "boolean", (v["s"] == "true").cast("double")).when(v["t"] == "string", F.coalesce(F.when(F.trim(v["s"]) == "", 0.0), v["s"].try_cast("double"), F.lit(float("nan")))).when(v["t"].isNotNull(), F.lit(float("nan")))
    args = [formula_number(a, value) for a in node.args]
    if node.op == "minus":
        return -args[0]
    a, b = args
    if node.op == "/":
        return _divided(a, b)
    if node.op in "+-*":
        return {"+": a + b, "-": a - b, "*": a * b}[node.op]
    return _compared(node.op, a, b).cast("double")


def formula_violated(node: Node, value: Callable[[str], Column]) -> Column:
    """True where a name is missing, or the formula is a comparison that does not hold."""
    missing = F.lit(False)
    for name in sorted(formula_names(node)):
        missing = missing | value(name).isNull()
    if node.op in ("==", "!=", "<", ">", "<=", ">="):
        return missing | (F.coalesce(formula_number(node, value), F.lit(0.0)) == 0.0)
    return missing


def evaluate_formula(node: Node, record: dict) -> float | bool:
    """The same over a dict, row at a time."""

    def num(x) -> float:
        if x is None:
            return 0.0
        if isinstance(x, (bool, int, float)):
            return float(x)
        if isinstance(x, str):
            try:
                return float(x) if x.strip() else 0.0
            except ValueError:
                return float("nan")
        return float("nan")

    if node.op == "number":
        return node.args[0]
    if node.op == "name":
        if node.args[0] not in record:
            raise KeyError(node.args[0])
        return num(record[node.args[0]])
    args = [float(evaluate_formula(a, record)) for a in node.args]
    if node.op == "minus":
        return -args[0]
    a, b = args
    if node.op == "/":
        if b:
            return a / b
        return float("nan") if a == 0 or a != a else float("inf") * (1 if a > 0 else -1)
    return {
        "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "==": lambda: abs(a - b) < TOLERANCE,
        "!=": lambda: abs(a - b) >= TOLERANCE, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
    }[node.op]()
