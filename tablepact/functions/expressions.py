"""Arithmetic over columns for reconciliation rules: ``subtotal + tax - discount``.

Column names, numbers, ``+ - * /`` and parentheses are read into one Spark column, which stays
inside whole-stage code generation. Anything else is refused, never skipped or evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_EXPRESSION_LENGTH = 512  # fixed value

_TOKEN = re.compile(
    r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w.])|(?P<name>[A-Za-z_]\w*)|(?P<sign>[-+*/()]))")


class ExpressionError(ValueError):
    """The expression is empty, too long or uses more than plain arithmetic."""


def _tokens(expression: str) -> list[tuple[str, str]]:
    text = (expression or "").strip()
    if not text:
        raise ExpressionError("a reconciliation expression cannot be empty")
    if len(text) > MAX_EXPRESSION_LENGTH:
        raise ExpressionError(f"expression is longer than {MAX_EXPRESSION_LENGTH} characters")
    found, at = [], 0
    while at < len(text):
        token = _TOKEN.match(text, at)
        if token is None:
            raise ExpressionError(f"only columns, numbers and + - * / ( ) are allowed, not {text[at:]!r}")
        found.append((token.lastgroup, token[token.lastgroup]))
        at = token.end()
    return found


class _Reader:
    """Sums of products of factors, left to right."""

    def __init__(self, expression: str, resolve: Callable, number: Callable = F.lit, divide: Callable = F.try_divide):
        self.expression, self.resolve, self.number, self.divide = expression, resolve, number, divide
        self.tokens = [*_tokens(expression), ("end", "")]

    def _next(self, *signs: str) -> str | None:
        kind, value = self.tokens[0]
        if kind == "sign" and value in signs:
            self.tokens.pop(0)
            return value
        return None

    def whole(self) -> Column:
        value = self.sum()
        if self.tokens[0][0] != "end":
            raise ExpressionError(f"invalid arithmetic at {self.tokens[0][1]!r} in {self.expression!r}")
        return value

    def sum(self) -> Column:
        value = self.product()
        while sign := self._next("+", "-"):
            other = self.product()
            value = value + other if sign == "+" else value - other
        return value

    def product(self) -> Column:
        value = self.factor()
        while sign := self._next("*", "/"):
            other = self.factor()
            value = value * other if sign == "*" else self.divide(value, other)  # by zero: no value
        return value

    def factor(self) -> Column:
        if sign := self._next("+", "-"):
            return self.factor() if sign == "+" else -self.factor()
        if self._next("("):
            value = self.sum()
            if not self._next(")"):
                raise ExpressionError(f"a parenthesis is not closed in {self.expression!r}")
            return value
        kind, value = self.tokens[0]
        if kind not in ("number", "name"):
            raise ExpressionError(f"a column or number is missing in {self.expression!r}")
        self.tokens.pop(0)
        return self.number(float(value)) if kind == "number" else self.resolve(value)


def expression_columns(expression: str) -> list[str]:
    """Column names in order of first use; an expression that cannot be read is refused here, without Spark."""
    _Reader(expression, lambda name: 1.0, float, lambda a, b: 1.0).whole()
    return list(dict.fromkeys(value for kind, value in _tokens(expression) if kind == "name"))


def arithmetic(expression: str, resolve: Callable[[str], Column]) -> Column:
    """The expression as a DOUBLE column; ``resolve`` maps a name to a number column."""
    return _Reader(expression, resolve).whole()
