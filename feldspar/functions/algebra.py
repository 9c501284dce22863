"""Arithmetic that works alike on Spark columns, SQL text and NumPy arrays.

A geometric formula is written once against these functions.  On columns it becomes a Catalyst expression that stays in
generated code, on ``Sql`` the text of the same expression, on arrays a vectorised kernel.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest finite double, which stands for "no value yet".
HUGE = float(np.finfo(np.float64).max)


def _text(v) -> str:
    if isinstance(v, Sql):
        return v.text
    if isinstance(v, (bool, np.bool_)):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    return f"({float(v)!r})" if "e" in repr(float(v)) else f"({float(v)!r}e0)"


class Sql:
    """A SQL expression; operators and comparisons build larger ones."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    def _op(self, sign: str, other, swap: bool = False) -> Sql:
        a, b = _text(self), _text(other)
        return Sql(f"({b} {sign} {a})" if swap else f"({a} {sign} {b})")

    def __add__(self, o):
        return self._op("+", o)

    def __radd__(self, o):
        return self._op("+", o, True)

    def __sub__(self, o):
        return self._op("-", o)

    def __rsub__(self, o):
        return self._op("-", o, True)

    def __mul__(self, o):
        return self._op("*", o)

    def __rmul__(self, o):
        return self._op("*", o, True)

    def __truediv__(self, o):
        return self._op("/", o)

    def __rtruediv__(self, o):
        return self._op("/", o, True)

    def __neg__(self):
        return Sql(f"(-{self.text})")

    def __gt__(self, o):
        return self._op(">", o)

    def __ge__(self, o):
        return self._op(">=", o)

    def __lt__(self, o):
        return self._op("<", o)

    def __le__(self, o):
        return self._op("<=", o)

    def __eq__(self, o):  # noqa: PLW1641
        return self._op("=", o)

    def __and__(self, o):
        return self._op("AND", o)

    def __or__(self, o):
        return self._op("OR", o)

    def __invert__(self):
        return Sql(f"(NOT {self.text})")


def _kind(*values):
    for v in values:
        if isinstance(v, Sql):
            return Sql
        if isinstance(v, Column):
            return Column
    return np.ndarray


def _lit(v):
    return v if isinstance(v, Column) else F.lit(v)


def _unary(sql: str, column, array):
    def apply(v):
        kind = _kind(v)
        return Sql(f"{sql}({_text(v)})") if kind is Sql else column(v) if kind is Column else array(v)

    return apply


sqrt = _unary("sqrt", F.sqrt, np.sqrt)
absolute = _unary("abs", F.abs, np.abs)
exp = _unary("exp", F.exp, np.exp)
log = _unary("ln", F.log, np.log)
sin = _unary("sin", F.sin, np.sin)
cos = _unary("cos", F.cos, np.cos)
arccos = _unary("acos", F.acos, np.arccos)


def floor(v):
    kind = _kind(v)
    return Sql(f"floor({_text(v)})") if kind is Sql else F.floor(v).cast("double") if kind is Column else np.floor(v)


def rounded(v):
    """To the nearest integer, halves away from zero."""
    kind = _kind(v)
    return Sql(f"round({_text(v)})") if kind is Sql else F.round(v) if kind is Column else np.sign(v) * np.floor(np.abs(v) + 0.5)


def least(*values):
    if len(values) == 1:
        return values[0]
    kind = _kind(*values)
    if kind is Sql:
        return Sql(f"least({', '.join(map(_text, values))})")
    return F.least(*map(_lit, values)) if kind is Column else reduce(np.minimum, values)


def greatest(*values):
    if len(values) == 1:
        return values[0]
    kind = _kind(*values)
    if kind is Sql:
        return Sql(f"greatest({', '.join(map(_text, values))})")
    return F.greatest(*map(_lit, values)) if kind is Column else reduce(np.maximum, values)


def where(condition, yes, no):
    kind = _kind(condition, yes, no)
    if kind is Sql:
        return Sql(f"(CASE WHEN {_text(condition)} THEN {_text(yes)} ELSE {_text(no)} END)")
    return F.when(_lit(condition), _lit(yes)).otherwise(_lit(no)) if kind is Column else np.where(condition, yes, no)


def divided(a, b):
    """``a / b`` for a divisor that may be 0, where the result is 0."""
    zero = b == 0.0
    return where(zero, 0.0, a / where(zero, 1.0, b))


def clamp(v, lo, hi):
    return least(greatest(v, lo), hi)


def lookup(table, index):
    """The entry of a list of numbers at a whole number that counts from 0."""
    kind = _kind(index)
    if kind is Sql:
        return Sql(f"[{', '.join(map(str, table))}][CAST({_text(index)} AS INTEGER) + 1]")
    if kind is Column:
        return F.element_at(F.array(*map(F.lit, table)), index.cast("int") + 1)
    return np.asarray(table)[np.asarray(index).astype(np.int64)]


def bits(v, mask: int):
    """The bits of a whole number under ``mask``."""
    kind = _kind(v)
    if kind is Sql:
        return Sql(f"(CAST({_text(v)} AS BIGINT) & {mask})")
    return v.cast("long").bitwiseAND(F.lit(mask)) if kind is Column else np.asarray(v).astype(np.int64) & mask


def dot(a, b):
    return sum((p * q for p, q in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def norm(v):
    return sqrt(dot(v, v))


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
