"""The registered queries of the geometry engine and their SQL.

Geometry columns are derived from the business tables: points from ``embeddings`` (three coordinates times ten), a large
point set from ``lineitem``, spheres from ``supplier``, boxes from ``part``.  Floats are rounded to six places.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.functions import fields as f
from feldspar.functions import vectors as v
from feldspar.operators import cloud, mesh, scene, spatial
from feldspar.operators.bvh import BUILDS
from feldspar.sources import mesh_files

from . import file_queries, fixtures  # noqa: F401
from .registry import ORACLE, QUERIES, Query, register

POINTS_SQL = "(SELECT vec_id, 10e0 * CAST(embedding[1] AS DOUBLE) AS x, 10e0 * CAST(embedding[2] AS DOUBLE) AS y, 10e0 * CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
ITEMS_SQL = "(SELECT l_quantity / 10 AS x, l_extendedprice / 10000 AS y, l_discount * 50 AS z FROM lineitem)"
SPHERES_SQL = "(SELECT s_suppkey AS prim_id, CAST(s_suppkey % 10 AS DOUBLE) - 4.5e0 AS cx, CAST(s_nationkey % 5 AS DOUBLE) - 2e0 AS cy, CAST((s_suppkey * 7) % 11 AS DOUBLE) / 2e0 - 2.5e0 AS cz, 0.3e0 + CAST(s_suppkey % 7 AS DOUBLE) * 0.05e0 AS r FROM supplier)"
BOXES_SQL = "(SELECT p_partkey AS id, CAST(p_partkey % 97 AS DOUBLE) AS lox, CAST((p_partkey * 13) % 89 AS DOUBLE) AS loy, 0e0 AS loz, CAST(p_partkey % 97 AS DOUBLE) + 1.5e0 AS hix, CAST((p_partkey * 13) % 89 AS DOUBLE) + 1.5e0 AS hiy, CAST(p_size AS DOUBLE) / 5e0 AS hiz FROM part)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", *[(10.0 * e[i].cast("double")).alias(a) for i, a in enumerate("xyz")])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("y"), (F.col("l_discount") * 50).alias("z"))


def spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("prim_id"),
        ((k % 10).cast("double") - 4.5).alias("cx"),
        ((n % 5).cast("double") - 2.0).alias("cy"),
        (((k * 7) % 11).cast("double") / 2.0 - 2.5).alias("cz"),
        (F.lit(0.3) + (k % 7).cast("double") * 0.05).alias("r"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k % 97).cast("double"), ((k * 13) % 89).cast("double")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), x.alias("lox"), y.alias("loy"), F.lit(0.0).alias("loz"), (x + 1.5).alias("hix"), (y + 1.5).alias("hiy"), (F.col("p_size").cast("double") / 5.0).alias("hiz")
    )


def r6(c):
    """Six places, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _field(name: str, field: f.Field, sql: str, big: bool = False) -> None:
    """A field over the points; ``sql`` is a formula in x, y, z written by hand."""
    if big:

        def query(spark, sf_dir):
            return field.evaluate(items(spark, sf_dir)).select("x", "y", "z", r6("d").alias("d"))

        register(name, query, f"SELECT x, y, z, round({sql}, 6) + 0e0 AS d FROM {ITEMS_SQL}")
    else:

        def query(spark, sf_dir):
            return field.evaluate(points(spark, sf_dir)).select("vec_id", r6("d").alias("d"))

        register(name, query, f"SELECT vec_id, round({sql}, 6) + 0e0 AS d FROM {POINTS_SQL}")


# Analytic shapes; their SQL is written by hand, apart from Perlin noise.
_box = "greatest(-1.5e0 - x, x - 1.5e0)", "greatest(-1e0 - y, y - 1e0)", "greatest(-0.5e0 - z, z - 0.5e0)"
_field("sdf_sphere", f.Sphere(), "sqrt(x*x + y*y + z*z) - 1e0")
_field("sdf_plane", f.Plane((0.5, 0.0, 0.0), (1.0, 2.0, 2.0)), "((x - 0.5e0) + 2e0*y + 2e0*z) / 3e0")
_field("sdf_box", f.Box((-1.5, -1.0, -0.5), (1.5, 1.0, 0.5)), f"least(0e0, greatest({', '.join(_box)})) + sqrt({' + '.join(f'power(greatest(0e0, {b}), 2)' for b in _box)})")
_field("sdf_torus", f.Torus(major=2.0, minor=0.5), "sqrt(power(sqrt(x*x + y*y) - 2e0, 2) + z*z) - 0.5e0")
_field(
    "sdf_cylinder",
    f.Cylinder((0.0, 0.0, -1.0), (0.0, 0.0, 2.0), 0.75),
    "CASE WHEN sqrt(x*x + y*y) <= 0.75e0 AND abs(z - 0.5e0) <= 1.5e0 THEN greatest(sqrt(x*x + y*y) - 0.75e0, abs(z - 0.5e0) - 1.5e0) ELSE sqrt(power(greatest(sqrt(x*x + y*y) - 0.75e0, 0e0), 2) + power(greatest(abs(z - 0.5e0) - 1.5e0, 0e0), 2)) END",
)
_field("sdf_infinite_cylinder", f.InfiniteCylinder((0.5, 0.0, 0.0), 0.5, 1), "sqrt((x - 0.5e0)*(x - 0.5e0) + z*z) - 0.5e0")
_field("sdf_capsule", f.Capsule((0.0, 0.0, -2.0), (0.0, 0.0, 2.0), 0.5), "sqrt(x*x + y*y + power(z - greatest(-1.5e0, least(1.5e0, z)), 2)) - 0.5e0")
_half = math.radians(30.0)
_s, _c = f"{math.sin(_half)!r}e0", f"{math.cos(_half)!r}e0"
_t = f"greatest(sqrt(x*x + y*y) * {_s} - z * {_c}, 0e0)"
_field(
    "sdf_infinite_cone",
    f.InfiniteCone((0.0, 0.0, 0.0), 60.0),
    f"sqrt(power(sqrt(x*x + y*y) - {_s} * {_t}, 2) + power(-z - {_c} * {_t}, 2)) * CASE WHEN sqrt(x*x + y*y) * {_c} + z * {_s} < 0 THEN -1e0 ELSE 1e0 END",
)
_b = f"{2.0 * math.tan(_half)!r}e0"
_w = "sqrt(x*x + y*y)"
_u = f"greatest(0e0, least(1e0, ({_w} * {_b} - 2e0 * z) / ({_b} * {_b} + 4e0)))"
_side = f"(power({_w} - {_b} * {_u}, 2) + power(z + 2e0 * {_u}, 2))"
_rim = f"(power({_w} - least({_w}, {_b}), 2) + power(z + 2e0, 2))"
_sign = f"greatest(2e0 * {_w} + z * {_b}, -z - 2e0)"
_field("sdf_cone", f.Cone((0.0, 0.0, 0.0), 2.0, 60.0), f"sqrt(least({_side}, {_rim})) * CASE WHEN {_sign} > 0 THEN 1e0 WHEN {_sign} < 0 THEN -1e0 ELSE 0e0 END")
_field("sdf_rounded_box", f.RoundedBox((2.0, 1.0, 1.5), 0.2), "sqrt(" + " + ".join(f"power(greatest(abs({a}) - {h}, 0e0), 2)" for a, h in (("x", "1e0"), ("y", "0.5e0"), ("z", "0.75e0"))) + ") - 0.2e0")
_field(
    "sdf_rounded_cylinder",
    f.RoundedCylinder(1.0, 0.25, 2.0),
    "least(greatest(sqrt(x*x + z*z) - 0.75e0, abs(y) - 0.75e0), 0e0) + sqrt(power(greatest(sqrt(x*x + z*z) - 0.75e0, 0e0), 2) + power(greatest(abs(y) - 0.75e0, 0e0), 2)) - 0.25e0",
)


def _perlin_sql(octaves: int) -> str:
    """Noise by its gradients: at each corner of a cell the product with one of sixteen, faded between corners."""
    gradients = "[[1,1,0],[-1,1,0],[1,-1,0],[-1,-1,0],[1,0,1],[-1,0,1],[1,0,-1],[-1,0,-1],[0,1,1],[0,-1,1],[0,1,-1],[0,-1,-1],[1,1,0],[0,-1,1],[-1,1,0],[0,-1,-1]]"
    hashed = lambda i: f"((({i}) & 255) * 167 + 13) % 256"
    h = hashed(f"{hashed(f'{hashed("i + a")} + j + b')} + k + c")
    fade = lambda u: f"({u}*{u}*{u}*({u}*({u}*6e0 - 15e0) + 10e0))"
    weight = " * ".join(f"(CASE WHEN {s} = 1 THEN {fade(u)} ELSE 1e0 - {fade(u)} END)" for s, u in zip("abc", "uvw", strict=True))
    dot = " + ".join(f"g[{n}] * ({u} - {s})" for n, u, s in ((1, "u", "a"), (2, "v", "b"), (3, "w", "c")))
    return f"""SELECT vec_id, round(1.5e0 * sum(share), 6) + 0e0 AS d FROM (
      SELECT vec_id, o, 0.5e0 * power(0.5e0, o) * (1e0 + sum({weight} * ({dot}))) AS share FROM (
        SELECT *, {gradients}[({h}) % 16 + 1] AS g FROM (
          SELECT vec_id, o, CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j, CAST(floor(z) AS BIGINT) AS k, x - floor(x) AS u, y - floor(y) AS v, z - floor(z) AS w
          FROM (SELECT vec_id, o, x * 0.7e0 * power(2e0, o) AS x, y * 0.9e0 * power(2e0, o) AS y, z * 1.1e0 * power(2e0, o) AS z FROM {POINTS_SQL}, range({octaves}) r(o)))
        , (VALUES (0), (1)) ta(a), (VALUES (0), (1)) tb(b), (VALUES (0), (1)) tc(c))
      GROUP BY vec_id, o)
    GROUP BY vec_id"""


_shuffled = tuple((i * 167 + 13) % 256 for i in range(256))
for _name, _octaves in (("perlin", 1), ("perlin_octaves", 3)):
    _noise = f.Perlin(1.5, (0.7, 0.9, 1.1), 0.5, _octaves, _shuffled)
    register(_name, lambda s, d, noise=_noise: noise.evaluate(points(s, d)).select("vec_id", r6("d").alias("d")), _perlin_sql(_octaves))
_field("sdf_sphere_items", f.Sphere((2.5, 4.0, 2.5), 1.5), "sqrt((x - 2.5e0)*(x - 2.5e0) + (y - 4e0)*(y - 4e0) + (z - 2.5e0)*(z - 2.5e0)) - 1.5e0", big=True)

# Transforms and combinations.
_cell = f.Box((-1.0, -0.5, -0.75), (1.0, 0.5, 0.75))
_ball, _other = f.Sphere((0.5, 0.0, 0.0), 1.0), f.Sphere((-0.5, 0.25, 0.0), 1.25)


def _cell_sql(x: str = "x", y: str = "y", z: str = "z") -> str:
    """The box of half widths 1, 0.5 and 0.75 around the origin."""
    d = [f"(abs({c}) - {h}e0)" for c, h in ((x, 1.0), (y, 0.5), (z, 0.75))]
    return f"(sqrt({' + '.join(f'power(greatest({c}, 0e0), 2)' for c in d)}) + least(greatest({', '.join(d)}), 0e0))"


def _ball_sql(cx: str, cy: str, cz: str, r: str) -> str:
    return f"(sqrt(power(x - {cx}, 2) + power(y - {cy}, 2) + power(z - {cz}, 2)) - {r})"


def _blend_sql(values: list[str], s: str, least: bool = True) -> str:
    """The two least (largest) of some values, blended over a width of ``s``."""
    two = f"list_sort([{', '.join(values)}], '{'ASC' if least else 'DESC'}')[1:2]"
    inner = "power(greatest({s} - abs(t[1] - t[2]), 0e0), 2) / (4e0 * {s})".replace("{s}", s)
    return f"(list_transform([{two}], lambda t: t[1] {'-' if least else '+'} {inner})[1])"


_A, _B, _C = _ball_sql("0.5e0", "0e0", "0e0", "1e0"), _ball_sql("(-0.5e0)", "0.25e0", "0e0", "1.25e0"), _cell_sql()
_cos, _sin = f"{math.cos(math.pi / 6)!r}e0", "0.5e0"
_blurred = " + ".join(f"{u * v * w!r}e0 * {_cell_sql(f'(x - {i * 0.2!r}e0)', f'(y - {j * 0.2!r}e0)', f'(z - {k * 0.2!r}e0)')}" for i, u in ((-1, 0.3), (0, 0.4), (1, 0.3)) for j, v in ((-1, 0.3), (0, 0.4), (1, 0.3)) for k, w in ((-1, 0.3), (0, 0.4), (1, 0.3)))
_sphere_weight = {0: -0.25, 1: 0.0, 2: 0.25 * (2**0.5 - 1), 3: 0.25 * (3**0.5 - 1)}
_weights = -0.25 + 12 * _sphere_weight[2] + 8 * _sphere_weight[3]
_mollified = " + ".join(
    f"({_sphere_weight[sum(map(abs, (i, j, k)))] / _weights!r}) * {_cell_sql(f'(x - {i * 0.25!r}e0)', f'(y - {j * 0.25!r}e0)', f'(z - {k * 0.25!r}e0)')}" for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if sum(map(abs, (i, j, k))) != 1
)
_field("xf_complement", f.Complement(f.Sphere()), "1e0 - sqrt(x*x + y*y + z*z)")
_field("xf_translate", f.Translate(f.Sphere(), (1.0, -0.5, 0.25)), "sqrt((x - 1e0)*(x - 1e0) + (y + 0.5e0)*(y + 0.5e0) + (z - 0.25e0)*(z - 0.25e0)) - 1e0")
_field("xf_rotate", f.Rotate(_cell, 30.0, 2), _cell_sql(f"(x * {_cos} + y * {_sin})", f"(y * {_cos} - x * {_sin})"))
_field("xf_scale", f.Scale(_cell, 2.0), f"2e0 * {_cell_sql('(x / 2e0)', '(y / 2e0)', '(z / 2e0)')}")
_field("xf_offset", f.Offset(f.Sphere(), 0.5), "sqrt(x*x + y*y + z*z) - 1.5e0")
_field("xf_annular", f.Annular(f.Sphere(), 0.25), "abs(sqrt(x*x + y*y + z*z) - 1e0) - 0.25e0")
_field("xf_blur", f.Blur(_cell, 0.2, 0.4), _blurred)
_field("xf_mollify", f.Mollify(_cell, 0.25, 3), _mollified)
_field("xf_elongate", f.Elongate(f.Sphere(), (0.5, 0.25, 0.0)), "sqrt(power(greatest(abs(x) - 0.5e0, 0e0), 2) + power(greatest(abs(y) - 0.25e0, 0e0), 2) + z*z) - 1e0")
_field("xf_reflect", f.Reflect(f.Sphere((0.5, 1.0, 0.0), 1.0), 1), "sqrt((x - 0.5e0)*(x - 0.5e0) + (y + 1e0)*(y + 1e0) + z*z) - 1e0")
_three = (_ball, _other, _cell)
_field("csg_union", f.Union(_three), f"list_min([{_A}, {_B}, {_C}])")
_field("csg_intersection", f.Intersection(_three), f"list_max([{_A}, {_B}, {_C}])")
_field("csg_difference", f.difference(_cell, _ball, _other), f"list_max([{_C}, -{_A}, -{_B}])")
_field("csg_smooth_union", f.SmoothUnion(_three, 0.5), _blend_sql([_A, _B, _C], "0.5e0"))
_field("csg_smooth_intersection", f.SmoothIntersection(_three, 0.5), _blend_sql([_A, _B, _C], "0.5e0", False))
_field("csg_smooth_difference", f.smooth_difference(_cell, (_ball,), 0.5), _blend_sql([_C, f"-{_A}"], "0.5e0", False))
_field("csg_exp_min", f.blended(_ball, _other, 0.5, f.exp_min), f"-0.5e0 * ln(exp(-2e0 * {_A}) + exp(-2e0 * {_B}))")
_field("csg_smooth_min", f.blended(_ball, _other, 0.5, f.smooth_min), _blend_sql([_A, _B], "0.5e0"))
_field("csg_smooth_max", f.SmoothIntersection((_ball, _other), 0.5, f.smooth_max), _blend_sql([_A, _B], "0.5e0", False))


def _mean(a, b, length):
    """A blend of the caller's own: the mean of the two least values."""
    return (a + b) * 0.5


_field("csg_user_blend", f.SmoothUnion(_three, 0.5, _mean), f"list_sum(list_sort([{_A}, {_B}, {_C}])[1:2]) / 2e0")
_field(
    "repeat",
    f.FiniteRepetition(f.Sphere((0.0, 0.0, 0.0), 0.3), (1.0, 1.5, 2.0), (2.0, 2.0, 1.0), (2.0, 1.0, 1.0)),
    "sqrt(power(x - least(greatest(floor(x + 0.5e0), -2e0), 2e0), 2) + power(y - 1.5e0 * least(greatest(floor(y / 1.5e0 + 0.5e0), -2e0), 1e0), 2) + power(z - 2e0 * least(greatest(floor(z / 2e0 + 0.5e0), -1e0), 1e0), 2)) - 0.3e0",
)
_tower = "(sqrt(" + " + ".join(f"power(greatest(abs({c} - {m_}e0) - {h}e0, 0e0), 2)" for c, m_, h in (("x", 1.25, 0.75), ("y", 2.0, 1.0), ("z", 2.0, 2.0))) + ") + least(greatest(" + ", ".join(f"abs({c} - {m_}e0) - {h}e0" for c, m_, h in (("x", 1.25, 0.75), ("y", 2.0, 1.0), ("z", 2.0, 2.0))) + "), 0e0))"
_round = "sqrt(power(x - 3e0, 2) + power(y - 4e0, 2)) - 0.5e0"
_silo = f"(least(greatest({_round}, abs(z - 2.5e0) - 2.5e0), 0e0) + sqrt(power(greatest({_round}, 0e0), 2) + power(greatest(abs(z - 2.5e0) - 2.5e0, 0e0), 2)))"
_field(
    "csg_city_items",
    f.SmoothUnion((f.Box((0.5, 1.0, 0.0), (2.0, 3.0, 4.0)), f.Cylinder((3.0, 4.0, 0.0), (3.0, 4.0, 5.0), 0.5), f.Sphere((4.0, 8.0, 2.0), 1.0)), 0.5),
    _blend_sql([_tower, _silo, _ball_sql("4e0", "8e0", "2e0", "1e0")], "0.5e0"),
    big=True,
)


def _normal_sphere(spark, sf_dir):
    n = f.Sphere().normal(*(F.col(a) for a in "xyz"), delta=1e-3)
    return points(spark, sf_dir).select("vec_id", *[r6(c).alias(f"n{a}") for c, a in zip(n, "xyz", strict=True)])


_slope = {a: "(sqrt(" + " + ".join(f"({b} + 0.001e0)*({b} + 0.001e0)" if a == b else f"{b}*{b}" for b in "xyz") + ") - sqrt(" + " + ".join(f"({b} - 0.001e0)*({b} - 0.001e0)" if a == b else f"{b}*{b}" for b in "xyz") + "))" for a in "xyz"}
register(
    "normal_sphere",
    _normal_sphere,
    f"SELECT vec_id, {', '.join(f'round(g{a} / sqrt(gx*gx + gy*gy + gz*gz), 6) + 0e0 AS n{a}' for a in 'xyz')} FROM (SELECT vec_id, {', '.join(f'{_slope[a]} AS g{a}' for a in 'xyz')} FROM {POINTS_SQL})",
)


def _vectors(spark, sf_dir):
    a, b = tuple(F.col(c) for c in "xyz"), (F.lit(0.5), F.lit(-1.0), F.lit(2.0))
    u = v.cross(a, b)
    return points(spark, sf_dir).select(
        "vec_id", r6(v.dot(a, b)).alias("dot"), *[r6(c).alias(f"cross_{n}") for c, n in zip(u, "xyz", strict=True)], r6(v.norm(a)).alias("length"), r6(v.length2(a)).alias("length2"),
        v.min_axis(a).alias("min_axis"), v.max_axis(a, True).alias("max_axis"), v.all_less(a, b).alias("less"), v.lexicographic_less(a, b).alias("lex"),
        *[r6(c).alias(f"clamp_{n}") for c, n in zip(v.clamp(a, (F.lit(-1.0),) * 3, (F.lit(1.0),) * 3), "xyz", strict=True)],
    )


register(
    "vector_algebra",
    _vectors,
    f"""SELECT vec_id, round(0.5e0*x - y + 2e0*z, 6) + 0e0 AS dot, round(2e0*y + z, 6) + 0e0 AS cross_x, round(0.5e0*z - 2e0*x, 6) + 0e0 AS cross_y, round(-x - 0.5e0*y, 6) + 0e0 AS cross_z,
    round(sqrt(x*x + y*y + z*z), 6) AS length, round(x*x + y*y + z*z, 6) AS length2,
    CASE WHEN x <= y AND x <= z THEN 0 WHEN y <= z THEN 1 ELSE 2 END AS min_axis, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN 0 WHEN abs(y) >= abs(z) THEN 1 ELSE 2 END AS max_axis,
    x < 0.5e0 AND y < -1e0 AND z < 2e0 AS less, x < 0.5e0 OR (x = 0.5e0 AND (y < -1e0 OR (y = -1e0 AND z < 2e0))) AS lex,
    round(least(greatest(x, -1e0), 1e0), 6) + 0e0 AS clamp_x, round(least(greatest(y, -1e0), 1e0), 6) + 0e0 AS clamp_y, round(least(greatest(z, -1e0), 1e0), 6) + 0e0 AS clamp_z FROM {POINTS_SQL}""",
)


# Scenes.


def _asked(spark, sf_dir):
    return points(spark, sf_dir).withColumnRenamed("vec_id", "qid")


def _scene(spark, sf_dir):
    return scene.spheres(spheres(spark, sf_dir))


_ALL = f"(SELECT vec_id, prim_id, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)) - r AS d FROM {POINTS_SQL} p CROSS JOIN {SPHERES_SQL} s)"


def _smooth_sql(order: str, sign: str) -> str:
    ranked = f"(SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d {order}) AS k FROM {_ALL})"
    two = f"(SELECT vec_id, max(CASE WHEN k = 1 THEN d END) AS a, max(CASE WHEN k = 2 THEN d END) AS b FROM {ranked} WHERE k <= 2 GROUP BY vec_id)"
    pick = "least" if sign == "-" else "greatest"
    return f"SELECT vec_id, round({pick}(a, b) {sign} 0.25e0 * power(greatest(0.4e0 - abs(a - b), 0e0) / 0.4e0, 2) * 0.4e0, 6) + 0e0 AS d FROM {two}"


register("scene_union", lambda s, d: scene.union(_asked(s, d), _scene(s, d)).select(F.col("qid").alias("vec_id"), r6("d").alias("d")), f"SELECT vec_id, round(min(d), 6) + 0e0 AS d FROM {_ALL} GROUP BY vec_id")
for _build in BUILDS:
    register(f"scene_union_{_build}", lambda s, d, build=_build: scene.union(_asked(s, d), _scene(s, d), build=build).select(F.col("qid").alias("vec_id"), r6("d").alias("d")), ORACLE["scene_union"])
register("scene_union_scan", lambda s, d: scene.union(_asked(s, d), _scene(s, d), pruned=False).select(F.col("qid").alias("vec_id"), r6("d").alias("d")), ORACLE["scene_union"])
register("scene_smooth_union", lambda s, d: scene.smooth_union(_asked(s, d), _scene(s, d), 0.4).select(F.col("qid").alias("vec_id"), r6("d").alias("d")), _smooth_sql("ASC", "-"))
register("scene_intersection", lambda s, d: scene.intersection(_asked(s, d), _scene(s, d)).select(F.col("qid").alias("vec_id"), r6("d").alias("d")), f"SELECT vec_id, round(max(d), 6) + 0e0 AS d FROM {_ALL} GROUP BY vec_id")
register("scene_smooth_intersection", lambda s, d: scene.smooth_intersection(_asked(s, d), _scene(s, d), 0.4).select(F.col("qid").alias("vec_id"), r6("d").alias("d")), _smooth_sql("DESC", "+"))
register(
    "scene_difference",
    lambda s, d: scene.difference(_asked(s, d), f.Sphere((0.0, 0.0, 0.0), 3.0), _scene(s, d)).select(F.col("qid").alias("vec_id"), r6("d").alias("d")),
    f"SELECT vec_id, round(greatest(max(f), -min(d)), 6) + 0e0 AS d FROM (SELECT vec_id, d, f FROM {_ALL} JOIN (SELECT vec_id, sqrt(x*x + y*y + z*z) - 3e0 AS f FROM {POINTS_SQL}) USING (vec_id)) GROUP BY vec_id",
)
register("inside_any", lambda s, d: scene.inside_any(_asked(s, d), _scene(s, d)).select(F.col("qid").alias("vec_id")), f"SELECT vec_id FROM {_ALL} GROUP BY vec_id HAVING min(d) < 0")
register("outside_all", lambda s, d: scene.outside_all(_asked(s, d), _scene(s, d)).select(F.col("qid").alias("vec_id")), f"SELECT vec_id FROM {_ALL} GROUP BY vec_id HAVING min(d) >= 0")
_CITY = f"""(SELECT vec_id, least(0e0, greatest(lox - x, x - hix, loy - y, y - hiy, loz - z, z - hiz)) + sqrt(power(greatest(0e0, lox - x, x - hix), 2) + power(greatest(0e0, loy - y, y - hiy), 2) + power(greatest(0e0, loz - z, z - hiz), 2)) AS d
  FROM (SELECT vec_id, x * 10e0 + 48e0 AS x, y * 10e0 + 44e0 AS y, z * 2e0 + 4e0 AS z FROM {POINTS_SQL}) CROSS JOIN {BOXES_SQL})"""


def _city(spark, sf_dir):
    q = _asked(spark, sf_dir).select("qid", (F.col("x") * 10.0 + 48.0).alias("x"), (F.col("y") * 10.0 + 44.0).alias("y"), (F.col("z") * 2.0 + 4.0).alias("z"))
    return scene.union(q, scene.boxes(boxes(spark, sf_dir).withColumnRenamed("id", "prim_id"))).select(F.col("qid").alias("vec_id"), r6("d").alias("d"))


register("scene_city", _city, f"SELECT vec_id, round(min(d), 6) + 0e0 AS d FROM {_CITY} GROUP BY vec_id")
register(
    "scene_box",
    lambda s, d: scene.bounding_box(_scene(s, d)).select(*[r6(c).alias(c) for c in (*spatial.LOW, *spatial.HIGH)]),
    "SELECT " + ", ".join([f"round(min({c} - r), 6) + 0e0 AS lo{a}, round(max({c} + r), 6) + 0e0 AS hi{a}" for c, a in zip(("cx", "cy", "cz"), "xyz", strict=True)]) + f" FROM {SPHERES_SQL}",
)

# Nearest neighbours.


def _cloud(spark, sf_dir):
    return points(spark, sf_dir).withColumnRenamed("vec_id", "pid")


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), *[c.alias(a) for c, a in zip(_centers(), "xyz", strict=True)])


def _centers():
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return (k % 10).cast("double") - 4.5, (n % 5).cast("double") - 2.0, ((k * 7) % 11).cast("double") / 2.0 - 2.5


def _knn_sql(queries: str, k: int, itself: bool) -> str:
    pairs = f"SELECT qid, c.vec_id AS pid, (q.x-c.x)*(q.x-c.x) + (q.y-c.y)*(q.y-c.y) + (q.z-c.z)*(q.z-c.z) AS d2 FROM {queries} q JOIN {POINTS_SQL} c ON {'c.vec_id <> q.qid' if itself else 'TRUE'}"
    return f"SELECT qid, CAST(rank AS INTEGER) AS rank, pid, round(d2, 6) + 0e0 AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, pid) AS rank FROM ({pairs})) WHERE rank <= {k}"


_FROM_SUPPLIER = f"(SELECT prim_id AS qid, cx AS x, cy AS y, cz AS z FROM {SPHERES_SQL})"
_SELF = f"(SELECT vec_id AS qid, x, y, z FROM {POINTS_SQL})"
_tidy = ("qid", "rank", "pid")
register("closest_point", lambda s, d: cloud.closest_point(_queries(s, d), _cloud(s, d)).select(*_tidy, r6("d2").alias("d2")), _knn_sql(_FROM_SUPPLIER, 1, False))
register("knn_k5", lambda s, d: cloud.nearest(_queries(s, d), _cloud(s, d), 5).select(*_tidy, r6("d2").alias("d2")), _knn_sql(_FROM_SUPPLIER, 5, False))
register("nn_self", lambda s, d: cloud.graph(_cloud(s, d), 1).select(*_tidy, r6("d2").alias("d2")), _knn_sql(_SELF, 1, True))
register("knn_graph", lambda s, d: cloud.graph(_cloud(s, d), 4).select(*_tidy, r6("d2").alias("d2")), _knn_sql(_SELF, 4, True))

# Boxes, overlaps, curves, octree.
_UNIT = "lox < 40e0 AND hix > 30e0 AND loy < 50e0 AND hiy > 20e0 AND loz < 6e0 AND hiz > 2e0"


def _box_ops(spark, sf_dir):
    own = (tuple(F.col(c) for c in spatial.LOW), tuple(F.col(c) for c in spatial.HIGH))
    other = ((F.lit(30.0), F.lit(20.0), F.lit(2.0)), (F.lit(40.0), F.lit(50.0), F.lit(6.0)))
    p = (F.lit(35.0), F.lit(30.0), F.lit(4.0))
    center = spatial.box_centroid(own)
    return boxes(spark, sf_dir).select(
        "id", spatial.boxes_intersect(own, other).alias("meets"), r6(spatial.box_overlap(own, other)).alias("overlap"), r6(spatial.box_distance(own, p)).alias("distance"),
        r6(spatial.box_volume(own)).alias("volume"), r6(spatial.box_area(own)).alias("area"), *[r6(c).alias(f"c{a}") for c, a in zip(center, "xyz", strict=True)],
    )


register(
    "aabb_ops",
    _box_ops,
    f"""SELECT id, {_UNIT} AS meets,
    round(greatest(least(hix, 40e0) - greatest(lox, 30e0), 0e0) * greatest(least(hiy, 50e0) - greatest(loy, 20e0), 0e0) * greatest(least(hiz, 6e0) - greatest(loz, 2e0), 0e0), 6) + 0e0 AS overlap,
    round(sqrt(power(greatest(lox - 35e0, 35e0 - hix, 0e0), 2) + power(greatest(loy - 30e0, 30e0 - hiy, 0e0), 2) + power(greatest(loz - 4e0, 4e0 - hiz, 0e0), 2)), 6) + 0e0 AS distance,
    round((hix - lox) * (hiy - loy) * (hiz - loz), 6) + 0e0 AS volume, round(2e0 * ((hix - lox) * (hiy - loy) + (hiy - loy) * (hiz - loz) + (hiz - loz) * (hix - lox)), 6) + 0e0 AS area,
    {', '.join(f'round(0.5e0 * (lo{a} + hi{a}), 6) + 0e0 AS c{a}' for a in 'xyz')} FROM {BOXES_SQL}""",
)
register(
    "aabb_points",
    lambda s, d: spatial.box_of_points(points(s, d)).select(*[r6(c).alias(c) for c in (*spatial.LOW, *spatial.HIGH)]),
    "SELECT " + ", ".join(f"round(min({a}), 6) + 0e0 AS lo{a}, round(max({a}), 6) + 0e0 AS hi{a}" for a in "xyz") + f" FROM {POINTS_SQL}",
)
register(
    "overlap_join",
    lambda s, d: spatial.overlap_join(boxes(s, d), boxes(s, d), 4.0).where("left_id < right_id"),
    f"SELECT a.id AS left_id, b.id AS right_id FROM {BOXES_SQL} a JOIN {BOXES_SQL} b ON a.id < b.id AND a.lox < b.hix AND b.lox < a.hix AND a.loy < b.hiy AND b.loy < a.hiy AND a.loz < b.hiz AND b.loz < a.hiz",
)


def _sphere_ops(spark, sf_dir):
    own = (tuple(F.col(c) for c in ("cx", "cy", "cz")), F.col("r"))
    other = ((F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.lit(2.0))
    p = (F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return spheres(spark, sf_dir).select(
        "prim_id", spatial.spheres_intersect(own, other).alias("meets"), r6(spatial.sphere_overlap(own, other, math.pi)).alias("overlap"),
        r6(spatial.sphere_distance(own, p)).alias("distance"), r6(spatial.sphere_volume(F.col("r"))).alias("volume"), r6(spatial.sphere_area(F.col("r"))).alias("area"),
    )


_D = "sqrt(cx*cx + cy*cy + cz*cz)"
register(
    "sphere_ops",
    _sphere_ops,
    f"""SELECT prim_id, {_D} < r + 2e0 AS meets, round(CASE WHEN {_D} >= r + 2e0 THEN 0e0 WHEN {_D} <= abs(r - 2e0) THEN 4e0 / 3e0 * pi() * power(least(r, 2e0), 3)
      ELSE pi() * power(r + 2e0 - {_D}, 2) * ({_D} * {_D} + 2e0 * {_D} * (r + 2e0) - 3e0 * power(r - 2e0, 2)) / (12e0 * {_D}) END, 6) + 0e0 AS overlap,
    round(greatest(sqrt(power(1e0 - cx, 2) + power(2e0 - cy, 2) + power(3e0 - cz, 2)) - r, 0e0), 6) + 0e0 AS distance, round(4e0 / 3e0 * pi() * r * r * r, 6) AS volume, round(4e0 * pi() * r * r, 6) AS area FROM {SPHERES_SQL}""",
)
_CELLS_SQL = f"(SELECT vec_id, {', '.join(f'CAST(least(floor(({a} - lo{a}) / CASE WHEN hi{a} > lo{a} THEN (hi{a} - lo{a}) / 2097152e0 ELSE 1e0 END), 2097151) AS BIGINT) AS i{a}' for a in 'xyz')} FROM {POINTS_SQL} CROSS JOIN (SELECT {', '.join(f'min({a}) AS lo{a}, max({a}) AS hi{a}' for a in 'xyz')} FROM {POINTS_SQL}))"
register(
    "morton",
    lambda s, d: spatial.bins(points(s, d)).select("vec_id", spatial.morton(F.col("ix"), F.col("iy"), F.col("iz")).alias("code")),
    f"SELECT vec_id, CAST(sum(((ix >> b) & 1) * (1::BIGINT << (3*b)) + ((iy >> b) & 1) * (1::BIGINT << (3*b + 1)) + ((iz >> b) & 1) * (1::BIGINT << (3*b + 2))) AS BIGINT) AS code FROM (SELECT vec_id, ix, iy, iz, CAST(unnest(range(21)) AS INTEGER) AS b FROM {_CELLS_SQL}) GROUP BY vec_id",
)
register(
    "nested",
    lambda s, d: spatial.bins(points(s, d)).select("vec_id", spatial.nested(F.col("ix"), F.col("iy"), F.col("iz")).alias("code")),
    f"SELECT vec_id, ix + iy * 2097152 + iz * 4398046511104 AS code FROM {_CELLS_SQL}",
)

#: Bits of the cells from the top: where one is set, the lower bits of x are turned, else swapped with its own; then a
#: Gray code over the axes; the bits of the three, interleaved, are the code.
_HILBERT_SQL = f"""WITH RECURSIVE turned AS (
  SELECT vec_id, 20 AS level, ix, iy, iz FROM {_CELLS_SQL}
  UNION ALL
  SELECT vec_id, level - 1, CASE WHEN (iz >> level) & 1 = 1 THEN xor(ix, low) ELSE xor(ix, xor(ix, iz) & low) END, iy, CASE WHEN (iz >> level) & 1 = 1 THEN iz ELSE xor(iz, xor(ix, iz) & low) END FROM (
    SELECT vec_id, level, low, CASE WHEN (iy >> level) & 1 = 1 THEN xor(ix, low) ELSE xor(ix, xor(ix, iy) & low) END AS ix, CASE WHEN (iy >> level) & 1 = 1 THEN iy ELSE xor(iy, xor(ix, iy) & low) END AS iy, iz FROM (
      SELECT vec_id, level, low, CASE WHEN (ix >> level) & 1 = 1 THEN xor(ix, low) ELSE ix END AS ix, iy, iz FROM (SELECT *, (1::BIGINT << level) - 1 AS low FROM turned WHERE level > 0)))),
gray AS (SELECT vec_id, ix, xor(iy, ix) AS iy, xor(iz, xor(iy, ix)) AS iz FROM turned WHERE level = 0),
flipped AS (SELECT vec_id, ix, iy, iz, (SELECT bit_xor(CASE WHEN (iz >> CAST(l AS INTEGER)) & 1 = 1 THEN (1::BIGINT << CAST(l AS INTEGER)) - 1 ELSE 0 END) FROM range(1, 21) r(l)) AS t FROM gray)
SELECT vec_id, CAST((SELECT sum((((xor(ix, t) >> CAST(b AS INTEGER)) & 1) * 4 + ((xor(iy, t) >> CAST(b AS INTEGER)) & 1) * 2 + ((xor(iz, t) >> CAST(b AS INTEGER)) & 1)) * (1::BIGINT << CAST(3 * b AS INTEGER))) FROM range(21) r(b)) AS BIGINT) AS code FROM flipped"""
register("hilbert", lambda s, d: spatial.bins(points(s, d)).select("vec_id", spatial.hilbert("ix", "iy", "iz").alias("code")), _HILBERT_SQL)


def _decoded(encode, decode) -> Query:
    """The cells read back from their codes."""

    def query(s, d):
        coded = spatial.bins(points(s, d)).select("vec_id", encode(*(F.col(c) for c in ("ix", "iy", "iz"))).alias("code"))
        return coded.select("vec_id", *[c.cast("long").alias(n) for c, n in zip(decode(F.col("code")), ("ix", "iy", "iz"), strict=True)])

    return query


def _hilbert_cell(code):
    found = spatial.hilbert_cell(code)
    return tuple(found[i] for i in range(3))


for _curve, _pair in (("morton", (spatial.morton, spatial.morton_cell)), ("nested", (spatial.nested, spatial.nested_cell)), ("hilbert", (spatial.hilbert, _hilbert_cell))):
    register(f"{_curve}_cell", _decoded(*_pair), f"SELECT vec_id, ix, iy, iz FROM {_CELLS_SQL}")
register(
    "sfc_order",
    lambda s, d: spatial.curve_order(_cloud(s, d), "nested").select("pid", "place"),
    f"SELECT vec_id AS pid, row_number() OVER (ORDER BY ix + iy * 2097152 + iz * 4398046511104, vec_id) - 1 AS place FROM {_CELLS_SQL}",
)

_FAR2 = "power(p.x - s.cx, 2) + power(p.y - s.cy, 2) + power(p.z - s.cz, 2)"
register(
    "bounding_sphere",
    lambda s, d: spatial.bounding_spheres(_cloud(s, d).withColumn("g", F.col("pid") % 8), "g").select("g", *[r6(c).alias(c) for c in ("cx", "cy", "cz", "r")]),
    f"""WITH RECURSIVE p AS (SELECT vec_id % 8 AS g, x, y, z, row_number() OVER (PARTITION BY vec_id % 8 ORDER BY vec_id) AS k FROM {POINTS_SQL}),
    ends AS (SELECT g, n, a, b, power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) AS d2 FROM (
      {' UNION ALL '.join(f"SELECT g, {n} AS n, arg_min({{'x': x, 'y': y, 'z': z}}, {a}) AS a, arg_max({{'x': x, 'y': y, 'z': z}}, {a}) AS b FROM p GROUP BY g" for n, a in enumerate("xyz"))})),
    s AS (
      SELECT g, CAST(0 AS BIGINT) AS k, (a.x + b.x) / 2 AS cx, (a.y + b.y) / 2 AS cy, (a.z + b.z) / 2 AS cz, sqrt(d2) / 2 AS r FROM (SELECT g, unnest(arg_max({{'a': a, 'b': b, 'd2': d2}}, d2)) FROM ends GROUP BY g)
      UNION ALL
      SELECT g, k, CASE WHEN d > r THEN cx + (x - cx) * (d - r) / (2 * d) ELSE cx END, CASE WHEN d > r THEN cy + (y - cy) * (d - r) / (2 * d) ELSE cy END, CASE WHEN d > r THEN cz + (z - cz) * (d - r) / (2 * d) ELSE cz END, greatest(r, (r + d) / 2)
      FROM (SELECT s.g, p.k, s.cx, s.cy, s.cz, s.r, p.x, p.y, p.z, sqrt({_FAR2}) AS d FROM s JOIN p ON p.g = s.g AND p.k = s.k + 1))
    SELECT g, {', '.join(f'round({c}, 6) + 0e0 AS {c}' for c in ('cx', 'cy', 'cz'))}, round(1.01e0 * r, 6) + 0e0 AS r FROM (SELECT g, arg_max({{'cx': cx, 'cy': cy, 'cz': cz, 'r': r}}, k) AS e FROM s GROUP BY g) t, LATERAL (SELECT e.cx, e.cy, e.cz, e.r)""",
)
register(
    "octree_aabb",
    lambda s, d: spatial.octree_box(s, f.Sphere(), (-2.0, -2.0, -2.0), (2.0, 2.0, 2.0), 5).select(*[r6(c).alias(c) for c in (*spatial.LOW, *spatial.HIGH)]),
    """WITH RECURSIVE cells AS (
      SELECT 0 AS level, -2e0 AS lox, -2e0 AS loy, -2e0 AS loz, 2e0 AS hix, 2e0 AS hiy, 2e0 AS hiz
      UNION ALL
      SELECT * FROM (
        SELECT level + 1 AS level, CASE WHEN o & 1 = 1 THEN (lox+hix)/2 ELSE lox END AS lox, CASE WHEN o & 2 = 2 THEN (loy+hiy)/2 ELSE loy END AS loy, CASE WHEN o & 4 = 4 THEN (loz+hiz)/2 ELSE loz END AS loz,
               CASE WHEN o & 1 = 1 THEN hix ELSE (lox+hix)/2 END AS hix, CASE WHEN o & 2 = 2 THEN hiy ELSE (loy+hiy)/2 END AS hiy, CASE WHEN o & 4 = 4 THEN hiz ELSE (loz+hiz)/2 END AS hiz
        FROM cells, range(8) t(o) WHERE level < 5)
      WHERE abs(sqrt(power((lox+hix)/2, 2) + power((loy+hiy)/2, 2) + power((loz+hiz)/2, 2)) - 1e0) <= 0.5e0 * sqrt(power(hix-lox, 2) + power(hiy-loy, 2) + power(hiz-loz, 2)))
    SELECT min(lox) AS lox, min(loy) AS loy, min(loz) AS loz, max(hix) AS hix, max(hiy) AS hiy, max(hiz) AS hiz FROM cells WHERE level = 5""",
)


def _surface(spark, sf_dir):
    cells = spatial.surface_cells(spark, f.Sphere((0.1, 0.0, 0.0), 1.0), (-2.0, -2.0, -2.0), (2.0, 2.0, 2.0), 4)
    return cells.select(F.array_join("path", "").alias("path"), "level", *[r6(c).alias(c) for c in (*spatial.LOW, *spatial.HIGH)])


register(
    "octree_cells",
    _surface,
    """WITH RECURSIVE cells AS (
      SELECT '' AS path, 0 AS level, -2e0 AS lox, -2e0 AS loy, -2e0 AS loz, 4e0 AS w
      UNION ALL
      SELECT * FROM (SELECT path || CAST(o AS VARCHAR), level + 1, lox + (o & 1) * w / 2, loy + ((o >> 1) & 1) * w / 2, loz + (o >> 2) * w / 2, w / 2 AS w FROM cells, (SELECT CAST(range AS INTEGER) AS o FROM range(8)) WHERE level < 4) t(path, level, lox, loy, loz, w)
      WHERE abs(sqrt(power(lox + w/2 - 0.1e0, 2) + power(loy + w/2, 2) + power(loz + w/2, 2)) - 1e0) <= w / 2 * sqrt(3e0))
    SELECT path, level, round(lox, 6) + 0e0 AS lox, round(loy, 6) + 0e0 AS loy, round(loz, 6) + 0e0 AS loz, round(lox + w, 6) + 0e0 AS hix, round(loy + w, 6) + 0e0 AS hiy, round(loz + w, 6) + 0e0 AS hiz FROM cells WHERE level = 4""",
)
_GRID_SQL = "(SELECT range AS qid, -2e0 + (range % 128 + 0.5e0) / 32e0 AS x, -2e0 + ((range // 128) % 128 + 0.5e0) / 32e0 AS y, -2e0 + (range // 16384 + 0.5e0) / 32e0 AS z FROM range(2097152))"
register(
    "boundary_cells",
    lambda s, d: f.Union((f.Torus(major=1.0, minor=0.4), f.Box((-0.3, -0.3, -1.2), (0.3, 0.3, 1.2)))).evaluate(scene.grid(s, (-2.0, -2.0, -2.0), (2.0, 2.0, 2.0), 128)).where(F.abs("d") <= 1.0 / 64.0).select("qid", r6("d").alias("d")),
    f"SELECT qid, round(d, 6) + 0e0 AS d FROM (SELECT qid, least(sqrt(power(sqrt(x*x + y*y) - 1e0, 2) + z*z) - 0.4e0, least(greatest(abs(x) - 0.3e0, abs(y) - 0.3e0, abs(z) - 1.2e0), 0e0) + sqrt(power(greatest(abs(x) - 0.3e0, 0e0), 2) + power(greatest(abs(y) - 0.3e0, 0e0), 2) + power(greatest(abs(z) - 1.2e0, 0e0), 2))) AS d FROM {_GRID_SQL}) WHERE abs(d) <= 1e0 / 64e0",
)
register(
    "grid_field",
    lambda s, d: f.Torus(major=1.0, minor=0.4).evaluate(scene.grid(s, (-2.0, -2.0, -2.0), (2.0, 2.0, 2.0), 32)).select("qid", r6("d").alias("d")),
    "SELECT qid, round(sqrt(power(sqrt(x*x + y*y) - 1e0, 2) + z*z) - 0.4e0, 6) + 0e0 AS d FROM (SELECT range AS qid, -2e0 + (range % 32 + 0.5e0) * 0.125e0 AS x, -2e0 + ((range // 32) % 32 + 0.5e0) * 0.125e0 AS y, -2e0 + (range // 1024 + 0.5e0) * 0.125e0 AS z FROM range(32768))",
)

# Meshes: fixtures as literals, so that both engines see the same data.


def _soup(spark: SparkSession, which: str) -> tuple[DataFrame, DataFrame]:
    vertices, facets = fixtures.MESHES[which]
    v_rows = [(which, i, *map(float, p)) for i, p in enumerate(vertices)]
    f_rows = [(which, i, list(ids), 7 * i + 3) for i, ids in enumerate(facets)]
    return (
        spark.createDataFrame(v_rows, "mesh_id string, vid int, x double, y double, z double"),
        spark.createDataFrame(f_rows, "mesh_id string, fid int, vids array<int>, meta long"),
    )


def _vertices_sql(which: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {float(x)!r}e0, {float(y)!r}e0, {float(z)!r}e0)" for i, (x, y, z) in enumerate(fixtures.MESHES[which][0])) + ") t(vid, x, y, z))"


def _corners_sql(which: str) -> str:
    rows = [f"({fid}, {i}, {vid}, {ids[(i + 1) % len(ids)]})" for fid, ids in enumerate(fixtures.MESHES[which][1]) for i, vid in enumerate(ids)]
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + ") t(fid, place, src, dst))"


def _facets_sql(which: str) -> str:
    """(fid, face, and the corners a, b, c of each triangle of each facet's fan)."""
    vertices, facets = fixtures.MESHES[which]
    rows = []
    for fid, ids in enumerate(facets):
        for i in range(1, len(ids) - 1):
            corners = [f"{float(c)!r}e0" for v in (ids[0], ids[i], ids[i + 1]) for c in vertices[v]]
            rows.append(f"({fid}, {', '.join(corners)})")
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + f") t(fid, {', '.join(f'c{s}{c}' for s in 'abc' for c in 'xyz')}))"


def _solid_sql(which: str, points: str = POINTS_SQL) -> str:
    """(vec_id, fid, d2, outside): a point's squared distance to each facet of a convex solid, by barycentric coordinates,
    and how far it lies outside the facet's plane."""
    minus = lambda p, q: [f"({a} - {b})" for a, b in zip(p, q, strict=True)]
    dot = lambda p, q: "(" + " + ".join(f"{a}*{b}" for a, b in zip(p, q, strict=True)) + ")"
    p, a, b, c = list("xyz"), *([f"c{s}{k}" for k in "xyz"] for s in "abc")

    def segment(q, r):
        u = f"least(greatest({dot(minus(p, q), minus(r, q))} / {dot(minus(r, q), minus(r, q))}, 0e0), 1e0)"
        return "(" + " + ".join(f"power({k} - {s} - {u} * ({e} - {s}), 2)" for k, s, e in zip(p, q, r, strict=True)) + ")"

    e, g, v = minus(b, a), minus(c, a), minus(p, a)
    n = [f"({e[i]}*{g[j]} - {e[j]}*{g[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    inner = f"SELECT *, {dot(e, e)} AS ee, {dot(e, g)} AS eg, {dot(g, g)} AS gg, {dot(v, e)} AS ve, {dot(v, g)} AS vg, {dot(v, n)} / sqrt({dot(n, n)}) AS plane, least({segment(a, b)}, {segment(b, c)}, {segment(c, a)}) AS edge FROM {points} CROSS JOIN {_facets_sql(which)}"
    over = "gg*ve - eg*vg >= 0 AND ee*vg - eg*ve >= 0 AND gg*ve - eg*vg + ee*vg - eg*ve <= ee*gg - eg*eg"
    return f"(SELECT vec_id, fid, min(CASE WHEN {over} THEN plane*plane ELSE edge END) AS d2, max(plane) AS outside FROM ({inner}) GROUP BY vec_id, fid)"


register(
    "mesh_compress",
    lambda s, d: mesh.compress(*_soup(s, "soup"))[0].select("vid", "x", "y", "z"),
    f"SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY x, y, z) - 1 AS INTEGER) AS vid, x, y, z FROM {_vertices_sql('soup')}",
)
register(
    "mesh_compress_facets",
    lambda s, d: mesh.compress(*_soup(s, "soup"))[1].select("fid", F.array_join("vids", "-").alias("vids")),
    f"SELECT fid, string_agg(CAST(n AS VARCHAR), '-' ORDER BY place) AS vids FROM {_corners_sql('soup')} JOIN (SELECT vid, dense_rank() OVER (ORDER BY x, y, z) - 1 AS n FROM {_vertices_sql('soup')}) ON vid = src GROUP BY fid",
)


def _every_soup(s):
    parts = [_soup(s, w) for w in ("tetra", "dodeca", "pentagons", "soup", "bad")]
    return reduce(DataFrame.union, [p[0] for p in parts]), reduce(DataFrame.union, [p[1] for p in parts])


def _all_corners_sql() -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{w}' AS mesh_id, c.*, v.x, v.y, v.z FROM {_corners_sql(w)} c JOIN {_vertices_sql(w)} v ON vid = src" for w in ("tetra", "dodeca", "pentagons", "soup", "bad")) + ")"


register(
    "mesh_degenerate",
    lambda s, d: mesh.degenerate(*_every_soup(s)).select("mesh_id", "degenerate"),
    f"SELECT mesh_id, bool_or(bad) AS degenerate FROM (SELECT mesh_id, fid, count(*) < 3 OR count(DISTINCT (x, y, z)) < count(*) AS bad FROM {_all_corners_sql()} GROUP BY mesh_id, fid) GROUP BY mesh_id",
)
register(
    "mesh_pairs",
    lambda s, d: mesh.half_edges(_soup(s, "dodeca")[1]).select("eid", "fid", "src", "dst", "next_eid", "pair_eid"),
    f"""WITH e AS (SELECT CAST(row_number() OVER (ORDER BY fid, place) - 1 AS BIGINT) AS eid, fid, place, src, dst FROM {_corners_sql('dodeca')})
    SELECT a.eid, a.fid, a.src, a.dst, CAST(CASE WHEN a.place = 2 THEN a.eid - 2 ELSE a.eid + 1 END AS BIGINT) AS next_eid, (SELECT min(b.eid) FROM e b WHERE b.src = a.dst AND b.dst = a.src) AS pair_eid FROM e a""",
)
_FACES_SQL = f"""(SELECT fid, (b.y-a.y)*(c.z-a.z) - (b.z-a.z)*(c.y-a.y) AS mx, (b.z-a.z)*(c.x-a.x) - (b.x-a.x)*(c.z-a.z) AS my, (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) AS mz,
  (a.x+b.x+c.x)/3 AS cx, (a.y+b.y+c.y)/3 AS cy, (a.z+b.z+c.z)/3 AS cz, a.vid AS v0, b.vid AS v1, c.vid AS v2
  FROM (SELECT fid, max(CASE WHEN place = 0 THEN src END) AS i, max(CASE WHEN place = 1 THEN src END) AS j, max(CASE WHEN place = 2 THEN src END) AS k FROM {_corners_sql('dodeca')} GROUP BY fid)
  JOIN {_vertices_sql('dodeca')} a ON a.vid = i JOIN {_vertices_sql('dodeca')} b ON b.vid = j JOIN {_vertices_sql('dodeca')} c ON c.vid = k)"""
register(
    "mesh_faces",
    lambda s, d: mesh.faces(*_soup(s, "dodeca")).select("fid", *[r6(c).alias(c) for c in ("nx", "ny", "nz", "cx", "cy", "cz", "area")]),
    "SELECT fid, " + ", ".join(f"round(m{a} / sqrt(mx*mx + my*my + mz*mz), 6) + 0e0 AS n{a}, round(c{a}, 6) + 0e0 AS c{a}" for a in "xyz") + f", round(0.5e0 * sqrt(mx*mx + my*my + mz*mz), 6) + 0e0 AS area FROM {_FACES_SQL}",
)


def _edge_normals(s, d):
    vertices, facets = _soup(s, "dodeca")
    return mesh.edge_normals(mesh.half_edges(facets), mesh.faces(vertices, facets)).select("fid", "src", "dst", *[r6(c).alias(c) for c in ("nx", "ny", "nz")])


register(
    "mesh_edge_normals",
    _edge_normals,
    f"""WITH f AS (SELECT fid, {', '.join(f'm{a} / sqrt(mx*mx + my*my + mz*mz) AS n{a}' for a in 'xyz')} FROM {_FACES_SQL}), e AS (SELECT * FROM {_corners_sql('dodeca')}),
    t AS (SELECT e.fid, e.src, e.dst, {', '.join(f'f.n{a} + g.n{a} AS s{a}' for a in 'xyz')} FROM e JOIN e o ON o.src = e.dst AND o.dst = e.src JOIN f ON f.fid = e.fid JOIN f g ON g.fid = o.fid)
    SELECT fid, src, dst, {', '.join(f'round(s{a} / sqrt(sx*sx + sy*sy + sz*sz), 6) + 0e0 AS n{a}' for a in 'xyz')} FROM t""",
)


def _vertex_normals(weight: str) -> Query:
    def query(s, d):
        vertices, facets = _soup(s, "dodeca")
        return mesh.vertex_normals(vertices, facets, mesh.faces(vertices, facets), weight).select("vid", *[r6(c).alias(c) for c in ("nx", "ny", "nz")])

    return query


def _vertex_sql(weight: str) -> str:
    return f"""WITH f AS (SELECT v0, v1, v2, {', '.join(f'm{a} / sqrt(mx*mx + my*my + mz*mz) AS n{a}' for a in 'xyz')} FROM {_FACES_SQL}), p AS (SELECT * FROM {_vertices_sql('dodeca')}),
    c AS (SELECT v0 AS v, v1 AS a, v2 AS b, nx, ny, nz FROM f UNION ALL SELECT v1, v2, v0, nx, ny, nz FROM f UNION ALL SELECT v2, v0, v1, nx, ny, nz FROM f),
    w AS (SELECT v, nx, ny, nz, {weight} AS w FROM c JOIN p o ON o.vid = v JOIN p q ON q.vid = a JOIN p r ON r.vid = b),
    t AS (SELECT v, sum(w*nx) AS x, sum(w*ny) AS y, sum(w*nz) AS z FROM w GROUP BY v)
    SELECT v AS vid, {', '.join(f'round({a} / sqrt(x*x + y*y + z*z), 6) + 0e0 AS n{a}' for a in 'xyz')} FROM t"""


_DOT = "((q.x-o.x)*(r.x-o.x) + (q.y-o.y)*(r.y-o.y) + (q.z-o.z)*(r.z-o.z))"
_LEN = {s: f"sqrt(power({s}.x-o.x, 2) + power({s}.y-o.y, 2) + power({s}.z-o.z, 2))" for s in "qr"}
register("mesh_vertex_normals", _vertex_normals("angle"), _vertex_sql(f"acos(least(1e0, greatest(-1e0, {_DOT} / ({_LEN['q']} * {_LEN['r']}))))"))
register("mesh_vertex_normals_plain", _vertex_normals("none"), _vertex_sql("1e0"))
_COUNTS = ("faces", "small_facets", "degenerate_faces", "vertices", "unused_vertices", "edges", "degenerate_edges", "border_edges", "repeated_edges")
register(
    "mesh_sanity",
    lambda s, d: mesh.sanity(*_every_soup(s)).select("mesh_id", *_COUNTS, "watertight"),
    f"""WITH corners AS (SELECT * FROM {_all_corners_sql()}),
    v AS ({' UNION ALL '.join(f"SELECT '{w}' AS mesh_id, vid FROM {_vertices_sql(w)}" for w in ("tetra", "dodeca", "pentagons", "soup", "bad"))}),
    f AS (SELECT mesh_id, fid, count(*) AS n, count(DISTINCT src) AS m FROM corners GROUP BY mesh_id, fid),
    e AS (SELECT c.* FROM corners c JOIN f USING (mesh_id, fid) WHERE f.n >= 3),
    ec AS (SELECT mesh_id, count(*) AS edges, count(*) FILTER (src = dst) AS degenerate_edges, count(*) FILTER (NOT EXISTS (SELECT 1 FROM e o WHERE o.mesh_id = e.mesh_id AND o.src = e.dst AND o.dst = e.src)) AS border_edges, count(*) - count(DISTINCT (src, dst)) AS repeated_edges FROM e GROUP BY mesh_id),
    fc AS (SELECT mesh_id, count(*) FILTER (n >= 3) AS faces, count(*) FILTER (n < 3) AS small_facets, count(*) FILTER (m < n) AS degenerate_faces FROM f GROUP BY mesh_id),
    vc AS (SELECT mesh_id, count(*) AS vertices, count(*) FILTER (NOT EXISTS (SELECT 1 FROM corners c WHERE c.mesh_id = v.mesh_id AND c.src = vid)) AS unused_vertices FROM v GROUP BY mesh_id)
    SELECT mesh_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _COUNTS)}, border_edges = 0 AND faces > 0 AS watertight FROM fc JOIN vc USING (mesh_id) JOIN ec USING (mesh_id)""",
)


def _mesh_triangles(s: SparkSession, which: str) -> DataFrame:
    return mesh.triangles(*_soup(s, which))


def _polygons(s: SparkSession, which: str) -> DataFrame:
    return mesh.polygons(*_soup(s, which))


def _signed_sql(which: str, points: str = POINTS_SQL) -> str:
    return f"SELECT vec_id, round(CASE WHEN max(outside) < 0 THEN -1e0 ELSE 1e0 END * sqrt(min(d2)), 6) + 0e0 AS d FROM {_solid_sql(which, points)} GROUP BY vec_id"


def _d(found: DataFrame) -> DataFrame:
    return found.select(F.col("qid").alias("vec_id"), r6("d").alias("d"))


def _sure(found: DataFrame, name: str) -> DataFrame:
    """The nearest facet and its meta, where the second is clearly farther."""
    near = found.groupBy("qid").agg(F.min_by(F.struct(name, "meta"), "rank").alias("f"), F.min(F.abs("d")).alias("a"), F.max(F.abs("d")).alias("b"))
    return near.where(F.col("b") - F.col("a") > 1e-6).select(F.col("qid").alias("vec_id"), F.col("f")[name].cast("long").alias("fid"), F.col("f.meta").alias("meta"))


def _sure_sql(which: str) -> str:
    return f"SELECT vec_id, CAST(fid AS BIGINT) AS fid, CAST(7 * fid + 3 AS BIGINT) AS meta FROM (SELECT vec_id, arg_min(fid, d2) AS fid, min(d2, 2) AS two FROM {_solid_sql(which)} GROUP BY vec_id) WHERE sqrt(two[2]) - sqrt(two[1]) > 1e-6"


def _ranked_sql(which: str, k: int) -> str:
    return f"SELECT vec_id, CAST(k AS INTEGER) AS rank, round(sqrt(d2), 6) + 0e0 AS d FROM (SELECT vec_id, d2, row_number() OVER (PARTITION BY vec_id ORDER BY d2, fid) AS k FROM {_solid_sql(which)}) WHERE k <= {k}"


register("mesh_sdf", lambda s, d: _d(mesh.distance(_asked(s, d), _mesh_triangles(s, "dodeca"))), _signed_sql("dodeca"))
register("mesh_sdf_tetra", lambda s, d: _d(mesh.distance(_asked(s, d), _mesh_triangles(s, "tetra"), build="cluster_sah")), _signed_sql("tetra"))
register("mesh_sdf_scan", lambda s, d: _d(mesh.distance(_asked(s, d), _mesh_triangles(s, "tetra"), pruned=False)), _signed_sql("tetra"))
register("closest_triangle", lambda s, d: _sure(mesh.distance(_asked(s, d), _mesh_triangles(s, "dodeca"), 2), "tid"), _sure_sql("dodeca"))
register("closest_triangle_distances", lambda s, d: mesh.distance(_asked(s, d), _mesh_triangles(s, "dodeca"), 4).select(F.col("qid").alias("vec_id"), "rank", r6(F.abs("d")).alias("d")), _ranked_sql("dodeca", 4))
register("mesh_polygon_sdf", lambda s, d: _d(mesh.polygon_distance(_asked(s, d), _polygons(s, "pentagons"))), _signed_sql("pentagons"))
register("mesh_closest_face", lambda s, d: _sure(mesh.polygon_distance(_asked(s, d), _polygons(s, "pentagons"), 2), "fid"), _sure_sql("pentagons"))
register("mesh_closest_faces", lambda s, d: mesh.polygon_distance(_asked(s, d), _polygons(s, "pentagons"), 5).select(F.col("qid").alias("vec_id"), "rank", r6(F.abs("d")).alias("d")), _ranked_sql("pentagons", 5))
register("mesh_polygon_scan", lambda s, d: _d(mesh.polygon_scan_distance(_asked(s, d), *_soup(s, "pentagons"))), _signed_sql("pentagons"))
register("mesh_polygon_scan_squared", lambda s, d: _d(mesh.polygon_scan_distance(_asked(s, d), *_soup(s, "dodeca"), signed=False)), f"SELECT vec_id, round(min(d2), 6) + 0e0 AS d FROM {_solid_sql('dodeca')} GROUP BY vec_id")
register("mesh_paint", lambda s, d: _d(mesh.distance(_asked(s, d), _mesh_triangles(s, "dodeca")).where(F.abs("d") <= 0.25)), f"SELECT * FROM ({_signed_sql('dodeca')}) WHERE abs(d) <= 0.25")
_COARSE_SQL = "(SELECT range AS vec_id, -2e0 + (range % 32 + 0.5e0) / 8e0 AS x, -2e0 + ((range // 32) % 32 + 0.5e0) / 8e0 AS y, -2e0 + (range // 1024 + 0.5e0) / 8e0 AS z FROM range(32768))"


def _painted(spark, sf_dir):
    cells = scene.grid(spark, (-2.0, -2.0, -2.0), (2.0, 2.0, 2.0), 32)
    near = mesh.polygon_distance(cells, _polygons(spark, "pentagons")).select("qid", "d", F.col("fid").alias("prim_id"))
    return scene.paint(cells, near, 0.0625).select(F.col("qid").alias("vec_id"), r6("d").alias("d"))


register("painted_cells", _painted, f"SELECT * FROM ({_signed_sql('pentagons', _COARSE_SQL)}) WHERE abs(d) <= 0.0625e0")
register("mesh_flip", lambda s, d: _d(mesh.distance(_asked(s, d), mesh.flip(_mesh_triangles(s, "tetra")))), f"SELECT vec_id, -d + 0e0 AS d FROM ({_signed_sql('tetra')})")
register("mesh_file_sdf", lambda s, d: _d(mesh.distance(_asked(s, d), mesh_files.read_triangles(s, *file_queries.written(s, "binary.vtk")))), _signed_sql("dodeca"))
register("mesh_file_polygon_sdf", lambda s, d: _d(mesh.polygon_distance(_asked(s, d), mesh_files.read_polygons(s, *file_queries.written(s, "text.obj", which="pentagons")))), _signed_sql("pentagons"))


def city(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The boxes of ``part`` as one mesh: eight corners and six quads each."""
    b = boxes(spark, sf_dir)
    corner = F.explode(F.sequence(F.lit(0), F.lit(7)))
    at = [F.when(F.col("o").bitwiseAND(F.lit(1 << i)) > 0, F.col(hi)).otherwise(F.col(lo)).alias(a) for i, (a, lo, hi) in enumerate(zip("xyz", spatial.LOW, spatial.HIGH, strict=True))]
    vertices = b.withColumn("o", corner).select(F.lit("city").alias("mesh_id"), (F.col("id") * 8 + F.col("o")).cast("int").alias("vid"), *at)
    quads = [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)]
    rings = F.posexplode(F.array(*[F.array(*map(F.lit, q)) for q in quads])).alias("n", "ring")
    facets = b.select("id", rings).select(F.lit("city").alias("mesh_id"), (F.col("id") * 6 + F.col("n")).cast("int").alias("fid"), F.transform("ring", lambda o: (F.col("id") * 8 + o).cast("int")).alias("vids"), F.col("id").cast("long").alias("meta"))
    return vertices, facets


def _over_city(spark, sf_dir):
    return _asked(spark, sf_dir).select("qid", (F.col("x") * 10.0 + 48.0).alias("x"), (F.col("y") * 10.0 + 44.0).alias("y"), (F.col("z") * 2.0 + 4.0).alias("z"))


register("mesh_city", lambda s, d: mesh.polygon_distance(_over_city(s, d), mesh.polygons(*city(s, d))).select(F.col("qid").alias("vec_id"), r6(F.abs("d")).alias("d")), f"SELECT vec_id, round(min(abs(d)), 6) + 0e0 AS d FROM {_CITY} GROUP BY vec_id")
register("mesh_city_triangles", lambda s, d: mesh.distance(_over_city(s, d), _city_triangles(s, d)).select(F.col("qid").alias("vec_id"), r6(F.abs("d")).alias("d")), ORACLE["mesh_city"])
register("mesh_city_sanity", lambda s, d: mesh.sanity(*city(s, d)).select(*_COUNTS, "watertight"), "SELECT 6 * n AS faces, 0 AS small_facets, 0 AS degenerate_faces, 8 * n AS vertices, 0 AS unused_vertices, 24 * n AS edges, 0 AS degenerate_edges, 0 AS border_edges, 0 AS repeated_edges, TRUE AS watertight FROM (SELECT count(*) AS n FROM part)")


def _city_triangles(spark, sf_dir):
    vertices, facets = city(spark, sf_dir)
    return mesh.triangles(vertices, mesh.triangulate(facets))


register(
    "mesh_extent",
    lambda s, d: spatial.box_of_points(_soup(s, "dodeca")[0]).select(*[r6(c).alias(c) for c in (*spatial.LOW, *spatial.HIGH)]),
    "SELECT " + ", ".join(f"round(min({a}), 6) + 0e0 AS lo{a}, round(max({a}), 6) + 0e0 AS hi{a}" for a in "xyz") + f" FROM {_vertices_sql('dodeca')}",
)


def _polygon_query(algorithm: str) -> Query:
    def query(s, d):
        at = [(x, y, 0.0) for x, y in fixtures.NOTCHED]
        polygons = s.createDataFrame([("notched", 0.0, 0.0, 1.0, at)], "poly_id string, nx double, ny double, nz double, pts array<struct<x: double, y: double, z: double>>")
        q = points(s, d).select(F.lit("notched").alias("poly_id"), F.col("vec_id").alias("qid"), (F.col("x") / 3.0 + 0.5).alias("x"), (F.col("y") / 3.0 + 0.5).alias("y"), F.lit(0.0).alias("z"))
        return mesh.points_in_polygons(polygons, q, algorithm).select(F.col("qid").alias("vec_id"), "inside")

    return query


_SHIFTED = f"(SELECT vec_id, x / 3e0 + 0.5e0 AS u, y / 3e0 + 0.5e0 AS v FROM {POINTS_SQL})"
for _name in ("winding", "crossing", "angle"):
    register(f"poly_{_name}", _polygon_query(_name), f"SELECT vec_id, (u BETWEEN 0 AND 0.5e0 AND v BETWEEN 0 AND 1e0) OR (u BETWEEN 0 AND 1e0 AND v BETWEEN 0 AND 0.5e0) AS inside FROM {_SHIFTED}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
