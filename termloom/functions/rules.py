"""Hard rules, hints, and formulas over metrics."""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HardRule:
    """A rule on output texts; rules that are not enforced are instructions only."""

    id: str
    message: str
    pattern: str
    regex: bool = False
    penalty: float = 0.0
    enforce: bool = True
    freeze: str = ""

    @classmethod
    def of(cls, raw: dict) -> HardRule:
        return cls(str(raw["id"]), str(raw.get("message", "")), str(raw.get("pattern", "")), bool(raw.get("regex", False)), float(raw.get("penalty", 0.0)), bool(raw.get("enforce", True)), str(raw.get("freeze", "")))

    def broken_by(self, text: Column) -> Column:
        if not self.enforce or not self.pattern:
            return F.lit(False)
        return F.coalesce(text.rlike(self.pattern) if self.regex else text.contains(self.pattern), F.lit(False))


def violations(text: Column, rules: Sequence[HardRule]) -> Column:
    """Messages of the enforced rules that the text breaks, in order."""
    found = [F.when(r.broken_by(text), F.lit(f"{r.id}: {r.message}")) for r in rules]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def penalty(text: Column, rules: Sequence[HardRule]) -> Column:
    """Sum of the penalties of the rules that are broken, each id once."""
    total = F.lit(0.0)
    for r in {r.id: r for r in rules}.values():
        total = total + F.when(r.broken_by(text), r.penalty).otherwise(0.0)
    return total


def frozen_block(rules: Sequence[HardRule], title: str = "Do not change") -> str:
    lines = [f"- {r.freeze}" for r in rules if r.freeze]
    return "\n".join([f"## {title}", *lines]) if lines else ""


def hints(term: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Hints whose key is in the lower-case term, in order, each once."""
    low = F.lower(term)
    found = [F.when(low.contains(key.lower()), F.lit(hint)) for key, hint in table]
    return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


class FormulaError(ValueError):
    """An expression that is not allowed, or cannot be computed."""


def _half_even(x: float, digits: float = 0) -> float:
    return float(round(x, int(digits))) if digits else float(round(x))


_DIVIDING = (ast.Div, ast.Mod)
_NUMBERS: dict[type, Callable] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_CALLS: dict[str, Callable] = {"min": min, "max": max, "abs": abs, "round": _half_even}


def _parsed(expression: str) -> ast.expr:
    try:
        return ast.parse(expression.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"not a formula: {e.msg}") from e


def _dotted(node: ast.expr) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _walk(node: ast.expr, name: Callable, number: Callable, binary: Callable, unary: Callable, call: Callable):
    again = lambda n: _walk(n, name, number, binary, unary, call)
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return number(float(node.value))
    if isinstance(node, (ast.Name, ast.Attribute)) and (dotted := _dotted(node)):
        return name(dotted)
    if isinstance(node, ast.BinOp) and type(node.op) in {*_NUMBERS, *_DIVIDING}:
        return binary(type(node.op), again(node.left), again(node.right))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        return unary(isinstance(node.op, ast.USub), again(node.operand))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
        return call(node.func.id, [again(a) for a in node.args])
    raise FormulaError(f"not allowed: {ast.dump(node)[:60]}")


def formula_names(expression: str) -> list[str]:
    """Metric names that the formula reads."""
    found: list[str] = []
    _walk(_parsed(expression), lambda n: found.append(n) or 0, float, lambda *_: 0, lambda *_: 0, lambda *_: 0)
    return list(dict.fromkeys(found))


def evaluate_formula(expression: str, metrics: dict[str, float]) -> float:
    """The value of a formula over a metric vector."""

    def name(n: str) -> float:
        if n not in metrics:
            raise FormulaError(f"unknown metric: {n}")
        return float(metrics[n])

    try:
        value = float(_walk(_parsed(expression), name, float, lambda op, a, b: _NUMBERS[op](a, b), lambda neg, x: -x if neg else x, lambda f, args: _CALLS[f](*args)))
    except (ZeroDivisionError, OverflowError, TypeError) as e:
        raise FormulaError(str(e)) from e
    if math.isnan(value) or math.isinf(value):
        raise FormulaError("the result is not a number")
    return value


def formula_column(expression: str, metrics: dict[str, Column]) -> Column:
    """The formula as a Column; division by zero is null. The remainder takes the divisor's sign, rounding is half to even."""

    def name(n: str) -> Column:
        if n not in metrics:
            raise FormulaError(f"unknown metric: {n}")
        return metrics[n].cast("double")

    def binary(op: type, a: Column, b: Column) -> Column:
        if op is ast.Div:
            return F.try_divide(a, b)
        if op is ast.Mod:
            return a - b * F.floor(F.try_divide(a, b))
        if op is ast.Pow:
            return F.pow(a, b)
        return _NUMBERS[op](a, b)

    def call(f: str, args: list[Column]) -> Column:
        if f == "abs":
            return F.abs(args[0])
        if f == "round":
            return F.rint(args[0]) if len(args) == 1 else F.bround(args[0], 6)
        return (F.least if f == "min" else F.greatest)(*args) if len(args) > 1 else args[0]

    return _walk(_parsed(expression), name, F.lit, binary, lambda neg, x: -x if neg else x, call)
