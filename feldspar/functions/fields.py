"""Implicit functions: analytic shapes, transforms and constructive solid geometry.

A field is an immutable expression; ``value(x, y, z)`` evaluates it on columns, SQL text or arrays.  It is negative
inside and positive outside.  Null coordinates give null.  Arguments are checked when a field is made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import algebra as m
from .algebra import HUGE, Sql

Vec = tuple[float, float, float]
TINY = 2.2250738585072014e-308
#: Stencils of more evaluations than this are exploded into rows instead of unrolled.
UNROLL = 800


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _finite(*values: float) -> None:
    _check(all(map(math.isfinite, values)), "values must be finite")


class Field:
    """Base of all implicit functions; subclass it and define ``value`` for one of your own."""

    #: evaluations of the innermost fields that one value takes
    cost = 1

    def value(self, x, y, z):
        raise NotImplementedError

    def column(self, x: str | Column = "x", y: str | Column = "y", z: str | Column = "z") -> Column:
        return self.value(*(F.col(c) if isinstance(c, str) else c for c in (x, y, z)))

    def sql(self, x: str = "x", y: str = "y", z: str = "z") -> str:
        return str(self.value(Sql(x), Sql(y), Sql(z)))

    def evaluate(self, points: DataFrame, name: str = "d") -> DataFrame:
        """``points`` (x, y, z) with the field's value.  A stencil too large to unroll is summed over exploded rows."""
        return points.withColumn(name, self.column())

    def normal(self, x, y, z, delta: float = 1e-6):
        """The unit vector of central differences; zero where they vanish."""
        _check(delta > 0, "delta must be positive")
        g = tuple(self.value(*(c + (delta if i == a else 0.0) for i, c in enumerate((x, y, z)))) - self.value(*(c - (delta if i == a else 0.0) for i, c in enumerate((x, y, z)))) for a in range(3))
        n = m.norm(g)
        return tuple(m.divided(p, n) for p in g)

    def inside(self, points: DataFrame) -> DataFrame:
        return points.where(self.column() < 0)

    def near(self, points: DataFrame, eps: float) -> DataFrame:
        return points.where(F.abs(self.column()) < eps)

    def box(self) -> tuple[Vec, Vec] | None:
        """An axis-aligned box around the inside, if the shape is bounded and has a closed form for it."""
        return None


@dataclass(frozen=True)
class Custom(Field):
    """A field from a function of three columns, SQL expressions or arrays."""

    function: Callable

    def value(self, x, y, z):
        return self.function(x, y, z)


@dataclass(frozen=True)
class Plane(Field):
    point: Vec
    direction: Vec

    def __post_init__(self):
        n = math.sqrt(sum(c * c for c in self.direction))
        _check(n > 0, "a plane needs a direction")
        object.__setattr__(self, "direction", tuple(c / n for c in self.direction))

    def value(self, x, y, z):
        return m.dot(tuple(c - p for c, p in zip((x, y, z), self.point, strict=True)), self.direction)


@dataclass(frozen=True)
class Sphere(Field):
    center: Vec = (0.0, 0.0, 0.0)
    radius: float = 1.0

    def __post_init__(self):
        _finite(*self.center, self.radius)
        _check(self.radius > 0, "the radius must be positive")

    def value(self, x, y, z):
        return m.norm(tuple(c - p for c, p in zip((x, y, z), self.center, strict=True))) - self.radius

    def box(self):
        return tuple(c - self.radius for c in self.center), tuple(c + self.radius for c in self.center)


@dataclass(frozen=True)
class Box(Field):
    low: Vec = (-0.5, -0.5, -0.5)
    high: Vec = (0.5, 0.5, 0.5)

    def __post_init__(self):
        _check(all(a < b for a, b in zip(self.low, self.high, strict=True)), "low must be below high")

    def value(self, x, y, z):
        d = [m.greatest(a - c, c - b) for a, b, c in zip(self.low, self.high, (x, y, z), strict=True)]
        return m.least(0.0, m.greatest(*d)) + m.norm([m.greatest(0.0, c) for c in d])

    def box(self):
        return self.low, self.high


@dataclass(frozen=True)
class Torus(Field):
    """The ring lies in the xy plane."""

    center: Vec = (0.0, 0.0, 0.0)
    major: float = 1.0
    minor: float = 0.5

    def __post_init__(self):
        _check(self.major > 0 and self.minor > 0, "the radii must be positive")

    def value(self, x, y, z):
        x, y, z = (c - p for c, p in zip((x, y, z), self.center, strict=True))
        return m.norm((m.norm((x, y)) - self.major, z)) - self.minor

    def box(self):
        r = (self.major + self.minor, self.major + self.minor, self.minor)
        return tuple(c - d for c, d in zip(self.center, r, strict=True)), tuple(c + d for c, d in zip(self.center, r, strict=True))


@dataclass(frozen=True)
class Cylinder(Field):
    start: Vec = (0.0, 0.0, -1.0)
    end: Vec = (0.0, 0.0, 1.0)
    radius: float = 1.0

    def __post_init__(self):
        _check(self.radius > 0, "the radius must be positive")
        _check(self.start != self.end, "the caps must be apart")

    def value(self, x, y, z):
        span = tuple(b - a for a, b in zip(self.start, self.end, strict=True))
        long = math.sqrt(sum(c * c for c in span))
        axis = tuple(c / long for c in span)
        d = tuple(c - 0.5 * (a + b) for c, a, b in zip((x, y, z), self.start, self.end, strict=True))
        along = m.dot(d, axis)
        out = m.norm(tuple(c - along * a for c, a in zip(d, axis, strict=True))) - self.radius
        over = m.absolute(along) - 0.5 * long
        return m.least(m.greatest(out, over), 0.0) + m.norm((m.greatest(out, 0.0), m.greatest(over, 0.0)))


@dataclass(frozen=True)
class InfiniteCylinder(Field):
    center: Vec = (0.0, 0.0, 0.0)
    radius: float = 1.0
    axis: int = 1

    def __post_init__(self):
        _check(self.radius > 0 and self.axis in (0, 1, 2), "a positive radius and an axis 0, 1 or 2 are needed")

    def value(self, x, y, z):
        return m.norm([c - p for i, (c, p) in enumerate(zip((x, y, z), self.center, strict=True)) if i != self.axis]) - self.radius


@dataclass(frozen=True)
class Capsule(Field):
    """The tips are the outermost points."""

    tip1: Vec = (0.0, 0.0, -2.0)
    tip2: Vec = (0.0, 0.0, 2.0)
    radius: float = 1.0

    def __post_init__(self):
        long = math.dist(self.tip1, self.tip2)
        _check(self.radius > 0 and long > 0, "a positive radius and two tips are needed")
        inward = tuple((b - a) / long * self.radius for a, b in zip(self.tip1, self.tip2, strict=True))
        object.__setattr__(self, "_a", tuple(a + c for a, c in zip(self.tip1, inward, strict=True)))
        object.__setattr__(self, "_b", tuple(b - c for b, c in zip(self.tip2, inward, strict=True)))

    def value(self, x, y, z):
        v = tuple(b - a for a, b in zip(self._a, self._b, strict=True))
        d = tuple(c - a for c, a in zip((x, y, z), self._a, strict=True))
        square = sum(c * c for c in v)
        h = m.clamp(m.dot(d, v) / square, 0.0, 1.0) if square > 0 else 0.0
        return m.norm(tuple(c - h * a for c, a in zip(d, v, strict=True))) - self.radius


@dataclass(frozen=True)
class InfiniteCone(Field):
    """Opens towards -z; angle is the full opening angle in degrees."""

    tip: Vec = (0.0, 0.0, 0.0)
    angle: float = 45.0

    def __post_init__(self):
        _check(0 < self.angle < 180, "the angle must be between 0 and 180 degrees")

    def value(self, x, y, z):
        half = math.radians(self.angle) / 2
        s, c = math.sin(half), math.cos(half)
        x, y, z = (a - p for a, p in zip((x, y, z), self.tip, strict=True))
        q, down = m.norm((x, y)), -z
        t = m.greatest(q * s + down * c, 0.0)
        d = m.norm((q - s * t, down - c * t))
        return d * m.where(q * c - down * s < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Cone(Field):
    """Tip up, opens towards -z over ``height``; angle is the full opening angle in degrees."""

    tip: Vec = (0.0, 0.0, 0.0)
    height: float = 1.0
    angle: float = 45.0

    def __post_init__(self):
        _check(self.height > 0 and 0 < self.angle < 180, "a positive height and an angle between 0 and 180 are needed")

    def value(self, x, y, z):
        base, low = self.height * math.tan(math.radians(self.angle) / 2), -self.height
        x, y, z = (a - p for a, p in zip((x, y, z), self.tip, strict=True))
        w = m.norm((x, y))
        # Nearest points of the slanted side, from the tip down to the rim, and of the base disc.
        t = m.clamp((w * base + z * low) / (base * base + low * low), 0.0, 1.0)
        side = (w - base * t, z - low * t)
        rim = (w - base * m.clamp(w / base, 0.0, 1.0), z - low)
        near = m.sqrt(m.least(m.dot(side, side), m.dot(rim, rim)))
        s = m.greatest(-(w * low - z * base), -(z - low))
        return near * m.where(s > 0, 1.0, m.where(s < 0, -1.0, 0.0))


@dataclass(frozen=True)
class RoundedBox(Field):
    """Dimensions without the rounding, which adds ``curvature`` on each side; the inside saturates there."""

    dimensions: Vec = (1.0, 1.0, 1.0)
    curvature: float = 0.1

    def __post_init__(self):
        _check(all(c > 0 for c in self.dimensions) and self.curvature > 0, "dimensions and curvature must be positive")

    def value(self, x, y, z):
        return m.norm([c - m.clamp(c, -d / 2, d / 2) for c, d in zip((x, y, z), self.dimensions, strict=True)]) - self.curvature


@dataclass(frozen=True)
class RoundedCylinder(Field):
    """About the y axis."""

    radius: float = 1.0
    curvature: float = 0.1
    height: float = 1.0

    def __post_init__(self):
        _check(min(self.radius, self.curvature, self.height) > 0, "radius, curvature and height must be positive")

    def value(self, x, y, z):
        d = (m.norm((x, z)) - (self.radius - self.curvature), m.absolute(y) - (self.height / 2 - self.curvature))
        return m.least(m.greatest(*d), 0.0) + m.norm([m.greatest(c, 0.0) for c in d]) - self.curvature


@dataclass(frozen=True)
class Perlin(Field):
    """Improved gradient noise in octaves; ``permutation`` has 256 entries and is an argument, as shuffles differ."""

    amplitude: float = 1.0
    frequency: Vec = (1.0, 1.0, 1.0)
    persistence: float = 1.0
    octaves: int = 1
    permutation: tuple[int, ...] = (0,) * 256

    def __post_init__(self):
        _check(0 < self.persistence <= 1 and self.octaves >= 1, "persistence in (0, 1] and an octave are needed")
        _check(len(self.permutation) == 256, "the permutation has 256 entries")

    def _noise(self, p):
        cell = [m.floor(c) for c in p]
        u, v, w = p[0] - cell[0], p[1] - cell[1], p[2] - cell[2]
        fade = [t * t * t * (t * (t * 6.0 - 15.0) + 10.0) for t in (u, v, w)]
        table = list(self.permutation)

        def at(i):
            return m.lookup(table, m.bits(i, 255))

        def corner(a, b, c):
            h = m.bits(at(at(at(cell[0] + float(a)) + cell[1] + float(b)) + cell[2] + float(c)), 15)
            x, y, z = u - float(a), v - float(b), w - float(c)
            first = m.where(h < 8, x, y)
            second = m.where(h < 4, y, m.where((h == 12) | (h == 14), x, z))
            return m.where(m.bits(h, 1) == 0, first, -first) + m.where(m.bits(h, 2) == 0, second, -second)

        def mix(t, a, b):
            return a + t * (b - a)

        planes = [mix(fade[1], *(mix(fade[0], corner(0, b, c), corner(1, b, c)) for b in (0, 1))) for c in (0, 1)]
        return mix(fade[2], *planes)

    def value(self, x, y, z):
        total, f, a = 0.0, self.frequency, 1.0
        for _ in range(self.octaves):
            total = 0.5 * a * (1.0 + self._noise([c * g for c, g in zip((x, y, z), f, strict=True)])) + total
            f, a = tuple(g / self.persistence for g in f), a * self.persistence
        return self.amplitude * total


class Wrapped(Field):
    """A field of one child."""

    @property
    def cost(self):
        return self.field.cost


@dataclass(frozen=True)
class Complement(Wrapped):
    field: Field

    def value(self, x, y, z):
        return -self.field.value(x, y, z)


@dataclass(frozen=True)
class Translate(Wrapped):
    field: Field
    shift: Vec

    def value(self, x, y, z):
        return self.field.value(*(c - s for c, s in zip((x, y, z), self.shift, strict=True)))

    def box(self):
        b = self.field.box()
        return b and tuple(tuple(c + s for c, s in zip(p, self.shift, strict=True)) for p in b)


@dataclass(frozen=True)
class Rotate(Wrapped):
    """By an angle in degrees about axis 0, 1 or 2."""

    field: Field
    angle: float
    axis: int

    def __post_init__(self):
        _check(self.axis in (0, 1, 2), "the axis must be 0, 1 or 2")

    def value(self, x, y, z):
        theta = self.angle * math.pi / 180
        c, s = math.cos(theta), math.sin(theta)
        p = [x, y, z]
        i, j = (self.axis + 1) % 3, (self.axis + 2) % 3
        p[i], p[j] = p[i] * c + p[j] * s, p[j] * c - p[i] * s
        return self.field.value(*p)


@dataclass(frozen=True)
class Scale(Wrapped):
    field: Field
    factor: float

    def __post_init__(self):
        _check(self.factor != 0, "the factor must not be 0")

    def value(self, x, y, z):
        return self.field.value(x / self.factor, y / self.factor, z / self.factor) * self.factor


@dataclass(frozen=True)
class Offset(Wrapped):
    field: Field
    distance: float

    def value(self, x, y, z):
        return self.field.value(x, y, z) - self.distance


@dataclass(frozen=True)
class Annular(Wrapped):
    field: Field
    delta: float

    def value(self, x, y, z):
        return m.absolute(self.field.value(x, y, z)) - self.delta


@dataclass(frozen=True)
class Elongate(Wrapped):
    field: Field
    extent: Vec

    def value(self, x, y, z):
        return self.field.value(*(c - m.clamp(c, -e, e) for c, e in zip((x, y, z), self.extent, strict=True)))


@dataclass(frozen=True)
class Reflect(Wrapped):
    """Negates coordinate ``plane``; a plane above 2 changes nothing."""

    field: Field
    plane: int

    def value(self, x, y, z):
        return self.field.value(*(-c if i == self.plane else c for i, c in enumerate((x, y, z))))


class Stencil(Wrapped):
    """A weighted sum of a child over offsets."""

    def offsets(self) -> list[tuple[float, Vec]]:
        raise NotImplementedError

    @property
    def cost(self):
        return self.field.cost * len(self.offsets())

    def value(self, x, y, z):
        total = None
        for w, (a, b, c) in self.offsets():
            term = w * self.field.value(x - a, y - b, z - c)
            total = term if total is None else total + term
        return total

    def evaluate(self, points: DataFrame, name: str = "d") -> DataFrame:
        """Beyond ``UNROLL`` evaluations, offsets become an array that a higher-order function walks, row by row."""
        if self.cost <= UNROLL:
            return super().evaluate(points, name)
        shifts = F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip("wabc", (w, *o), strict=True))) for w, o in self.offsets()])

        def term(total, o):
            return total + o["w"] * self.field.value(F.col("x") - o["a"], F.col("y") - o["b"], F.col("z") - o["c"])

        return points.withColumn(name, F.aggregate(shifts, F.lit(0.0), term))


@dataclass(frozen=True)
class Blur(Stencil):
    """27 points at ``distance``; ``alpha`` is the centre's share along each axis."""

    field: Field
    distance: float
    alpha: float = 0.5

    def __post_init__(self):
        _check(self.distance >= 0 and 0 <= self.alpha <= 1, "a distance >= 0 and alpha in [0, 1] are needed")

    def offsets(self):
        side = (1 - self.alpha) / 2
        steps = [(-1, side), (0, self.alpha), (1, side)]
        return [(u * v * w, (i * self.distance, j * self.distance, k * self.distance)) for i, u in steps for j, v in steps for k, w in steps]


@dataclass(frozen=True)
class Mollify(Stencil):
    """n^3 points of [-distance, distance]^3, weighted by a field (a sphere of that radius) normalised to a sum of 1."""

    field: Field
    distance: float
    points: int = 2
    mollifier: Field | None = None

    def offsets(self):
        d, n = abs(self.distance), self.points
        if d == 0 or n <= 1:
            return [(1.0, (0.0, 0.0, 0.0))]
        weight = self.mollifier or Sphere(radius=d)
        at = [-d + i * 2 * d / (n - 1) for i in range(n)]
        found = [(float(weight.value(a, b, c)), (a, b, c)) for a in at for b in at for c in at]
        total = sum(w for w, _ in found)
        _check(total != 0, "the mollifier's weights must not sum to 0")
        return [(w / total, o) for w, o in found]


def _step(a, b, s):
    return m.greatest(s - m.absolute(a - b), 0.0) / s


def smooth_min(a, b, s: float):
    h = _step(a, b, max(s, TINY))
    return m.least(a, b) - 0.25 * h * h * max(s, TINY)


def smooth_max(a, b, s: float):
    h = _step(a, b, max(s, TINY))
    return m.greatest(a, b) + 0.25 * h * h * max(s, TINY)


def exp_min(a, b, s: float):
    """-s ln(exp(-a/s) + exp(-b/s)), shifted so that nothing overflows."""
    s = max(s, TINY)
    return m.least(a, b) - s * m.log(1.0 + m.exp(-m.absolute(a - b) / s))


class Combined(Field):
    @property
    def cost(self):
        return sum(f.cost for f in self.fields)

    def _values(self, x, y, z):
        return [f.value(x, y, z) for f in self.fields]


def _two(values, first, second, start):
    """The two extreme values of a list: ``first`` picks the most extreme of two, ``second`` the other."""
    a, b = values[0], start
    for v in values[1:]:
        b, a = first(b, second(a, v)), first(a, v)
    return a, b


@dataclass(frozen=True)
class Union(Combined):
    """The least value; of no fields +infinity."""

    fields: tuple[Field, ...]

    def value(self, x, y, z):
        return m.least(*self._values(x, y, z)) if self.fields else x * 0.0 + float("inf")


@dataclass(frozen=True)
class Intersection(Combined):
    """The largest value; of no fields -infinity."""

    fields: tuple[Field, ...]

    def value(self, x, y, z):
        return m.greatest(*self._values(x, y, z)) if self.fields else x * 0.0 - float("inf")


@dataclass(frozen=True)
class SmoothUnion(Combined):
    """Blends the two least values only."""

    fields: tuple[Field, ...]
    length: float
    blend: Callable = smooth_min

    def value(self, x, y, z):
        if not self.fields:
            return x * 0.0 + float("inf")
        values = self._values(x, y, z)
        return values[0] if len(values) == 1 else self.blend(*_two(values, m.least, m.greatest, HUGE), max(self.length, TINY))


@dataclass(frozen=True)
class SmoothIntersection(Combined):
    """Blends the two largest values only."""

    fields: tuple[Field, ...]
    length: float
    blend: Callable = smooth_max

    def value(self, x, y, z):
        if not self.fields:
            return x * 0.0 + float("inf")
        values = self._values(x, y, z)
        return values[0] if len(values) == 1 else self.blend(*_two(values, m.greatest, m.least, -HUGE), max(self.length, TINY))


def difference(field: Field, *others: Field) -> Field:
    """What is in ``field`` and in none of the others."""
    return Intersection((field, *(Complement(o) for o in others)))


def smooth_difference(field: Field, others: Sequence[Field], length: float, blend: Callable = smooth_max) -> Field:
    return SmoothIntersection((field, *(Complement(o) for o in others)), length, blend)


def blended(a: Field, b: Field, length: float, blend: Callable) -> Field:
    """Two fields under a blend function of their values."""
    return SmoothUnion((a, b), length, blend)


@dataclass(frozen=True)
class FiniteRepetition(Wrapped):
    """Copies at whole multiples of ``period``, from -low to high on each axis, at the cost of one."""

    field: Field
    period: Vec
    low: Vec
    high: Vec

    def __post_init__(self):
        _check(all(p > 0 for p in self.period), "periods must be positive")

    def value(self, x, y, z):
        moved = (c - p * m.rounded(m.clamp(c / p, -a, b)) for c, p, a, b in zip((x, y, z), self.period, self.low, self.high, strict=True))
        return self.field.value(*moved)


def simplify(field: Field) -> Field:
    """Rewrites that keep values: double complements, nested translations, unions in unions."""
    if isinstance(field, Complement) and isinstance(field.field, Complement):
        return simplify(field.field.field)
    if isinstance(field, Translate) and isinstance(field.field, Translate):
        return simplify(Translate(field.field.field, tuple(a + b for a, b in zip(field.shift, field.field.shift, strict=True))))
    if type(field) in (Union, Intersection):
        flat = [g for f in map(simplify, field.fields) for g in (f.fields if type(f) is type(field) else (f,))]
        return type(field)(tuple(flat))
    return field
