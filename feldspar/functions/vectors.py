"""Vector algebra on triples (and pairs) of columns, SQL expressions or arrays."""

from __future__ import annotations

from . import algebra as m
from .algebra import cross, dot, norm  # noqa: F401


def add(a, b):
    return tuple(p + q for p, q in zip(a, b, strict=True))


def subtract(a, b):
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a, s):
    return tuple(p * s for p in a)


def multiply(a, b):
    """Component by component."""
    return tuple(p * q for p, q in zip(a, b, strict=True))


def divide(a, b):
    """Component by component; a zero divisor gives 0."""
    return tuple(m.divided(p, q) for p, q in zip(a, b, strict=True))


def negate(a):
    return tuple(-p for p in a)


def length2(a):
    return dot(a, a)


def normalize(a):
    """The unit vector; the zero vector stays."""
    n = norm(a)
    return tuple(m.divided(p, n) for p in a)


def lowest(a, b):
    return tuple(m.least(p, q) for p, q in zip(a, b, strict=True))


def highest(a, b):
    return tuple(m.greatest(p, q) for p, q in zip(a, b, strict=True))


def clamp(a, lo, hi):
    return tuple(m.clamp(p, q, r) for p, q, r in zip(a, lo, hi, strict=True))


def min_axis(a, magnitude: bool = False):
    """The axis of the least component (magnitude); the lowest axis wins ties."""
    x, y, z = (m.absolute(p) if magnitude else p for p in a)
    return m.where((x <= y) & (x <= z), 0, m.where(y <= z, 1, 2))


def max_axis(a, magnitude: bool = False):
    """The axis of the largest component (magnitude); the lowest axis wins ties."""
    x, y, z = (m.absolute(p) if magnitude else p for p in a)
    return m.where((x >= y) & (x >= z), 0, m.where(y >= z, 1, 2))


def all_less(a, b):
    """A partial order: every component is less."""
    (x, y, z), (u, v, w) = a, b
    return (x < u) & (y < v) & (z < w)


def all_less_equal(a, b):
    (x, y, z), (u, v, w) = a, b
    return (x <= u) & (y <= v) & (z <= w)


def equal(a, b):
    (x, y, z), (u, v, w) = a, b
    return (x == u) & (y == v) & (z == w)


def lexicographic_less(a, b):
    """By the first component that differs."""
    (x, y, z), (u, v, w) = a, b
    return (x < u) | ((x == u) & ((y < v) | ((y == v) & (z < w))))


ZERO, ONE = (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)
LOWEST, HIGHEST, INFINITE = (-m.HUGE,) * 3, (m.HUGE,) * 3, (float("inf"),) * 3


def unit(axis: int):
    return tuple(1.0 if i == axis else 0.0 for i in range(3))
