import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from feldspar.functions import algebra as m
from feldspar.functions import fields as f
from feldspar.functions import vectors as v

RNG = np.random.default_rng(1)
P = RNG.uniform(-3, 3, (400, 3))
X, Y, Z = P.T
SHAPES = [
    f.Plane((0.5, 0.0, 0.0), (1.0, 2.0, 2.0)), f.Sphere((0.5, 0.0, -1.0), 1.5), f.Box((-1.0, -2.0, -0.5), (1.0, 0.5, 0.5)), f.Torus((0.0, 0.5, 0.0), 2.0, 0.5),
    f.Cylinder((0.0, -1.0, 0.0), (1.0, 1.0, 1.0), 0.75), f.InfiniteCylinder((0.5, 0.0, 0.0), 0.5, 2), f.Capsule((0.0, 0.0, -2.0), (1.0, 1.0, 1.0), 0.4),
    f.InfiniteCone((0.0, 0.0, 1.0), 50.0), f.Cone((0.0, 0.5, 1.0), 2.0, 70.0), f.RoundedBox((2.0, 1.0, 1.0), 0.2), f.RoundedCylinder(1.0, 0.2, 2.0),
]


def at(field, *p):
    return float(field.value(*map(np.float64, p)))


@pytest.mark.parametrize(
    ("field", "point", "expected"),
    [
        (f.Sphere(), (0, 0, 0), -1), (f.Sphere((1, 0, 0), 2), (4, 0, 0), 1), (f.Box(), (0, 0, 0), -0.5), (f.Box(), (1.5, 1.5, 0.5), math.sqrt(2)), (f.Plane((0, 0, 1), (0, 0, 2)), (5, 5, 3), 2),
        (f.Torus(), (1, 0, 0), -0.5), (f.Torus(), (0, 0, 0), 0.5), (f.Cylinder(), (0, 0, 0), -1), (f.Cylinder(), (0, 0, 3), 2), (f.Cylinder(), (4, 0, 5), 5),
        (f.InfiniteCylinder(), (3, 99, 0), 2), (f.Capsule(), (0, 0, 3), 1), (f.Capsule(), (2, 0, 0), 1), (f.Capsule(), (0, 0, 0), -1),
        (f.Cone((0, 0, 0), 1.0, 90.0), (0, 0, 1), 1), (f.Cone((0, 0, 0), 1.0, 90.0), (0, 0, -2), 1), (f.Cone((0, 0, 0), 1.0, 90.0), (0, 0, -0.9), -0.1), (f.Cone((0, 0, 0), 1.0, 90.0), (0, 0, 0), 0),
        (f.InfiniteCone((0, 0, 0), 90.0), (0, 0, -1), -math.sqrt(0.5)), (f.InfiniteCone((0, 0, 0), 90.0), (0, 0, 2), 2),
        (f.RoundedBox((2.0, 2.0, 2.0), 0.5), (0, 0, 0), -0.5), (f.RoundedBox((2.0, 2.0, 2.0), 0.5), (3, 0, 0), 1.5), (f.RoundedCylinder(1.0, 0.25, 2.0), (0, 3, 0), 2), (f.RoundedCylinder(1.0, 0.25, 2.0), (3, 0, 0), 2),
    ],
)
def test_values_by_hand(field, point, expected):
    assert at(field, *point) == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("field", SHAPES, ids=lambda s: type(s).__name__)
def test_columns_sql_and_arrays_agree(spark, field):
    df = spark.createDataFrame(P.tolist(), "x double, y double, z double")
    rows = df.select(field.column().alias("a"), F.expr(field.sql().replace("e0", "D")).alias("b")).collect()
    assert np.allclose([r.a for r in rows], field.value(X, Y, Z), atol=1e-12)
    assert [r.a for r in rows] == pytest.approx([r.b for r in rows], abs=1e-12)


@pytest.mark.parametrize("field", SHAPES, ids=lambda s: type(s).__name__)
def test_distances_change_no_faster_than_the_point(field):
    d = field.value(X, Y, Z)
    e = field.value(X + 1e-3, Y - 2e-3, Z + 2e-3)
    assert (np.abs(d - e) <= 3e-3 + 1e-12).all()


def test_transforms():
    box = f.Box((-1.0, -2.0, -0.5), (1.0, 0.5, 0.75))
    d = box.value(X, Y, Z)
    assert np.allclose(f.Complement(f.Complement(box)).value(X, Y, Z), d)
    assert np.allclose(f.Translate(box, (1.0, 2.0, 3.0)).value(X + 1, Y + 2, Z + 3), d)
    for axis in range(3):
        assert np.allclose(f.Rotate(box, 360.0, axis).value(X, Y, Z), d)
        assert np.allclose(f.Rotate(f.Rotate(box, 33.0, axis), -33.0, axis).value(X, Y, Z), d)
        assert np.allclose(f.Reflect(f.Reflect(box, axis), axis).value(X, Y, Z), d)
    assert np.allclose(f.Rotate(f.Sphere((1.0, 0.0, 0.0), 0.5), 90.0, 2).value(0.0, 1.0, 0.0), -0.5)
    assert np.allclose(f.Reflect(box, 5).value(X, Y, Z), d)
    assert np.allclose(f.Scale(f.Sphere(), 2.0).value(X, Y, Z), f.Sphere(radius=2.0).value(X, Y, Z))
    assert np.allclose(f.Annular(f.Offset(box, 0.1), 0.2).value(X, Y, Z), np.abs(d - 0.1) - 0.2)
    assert np.allclose(f.Elongate(f.Sphere(), (0.0, 0.0, 1.0)).value(X, Y, Z), f.Capsule((0.0, 0.0, -2.0), (0.0, 0.0, 2.0), 1.0).value(X, Y, Z))


def test_stencils(spark):
    plane = f.Plane((0.0, 0.0, 0.0), (1.0, 1.0, 0.0))
    for field in (f.Blur(plane, 0.3, 0.4), f.Mollify(plane, 0.3, 2), f.Mollify(plane, 0.3, 4)):
        assert sum(w for w, _ in field.offsets()) == pytest.approx(1.0)
        assert np.allclose(field.value(X, Y, Z), plane.value(X, Y, Z))  # linear fields stay
    assert len(f.Blur(plane, 0.3).offsets()) == 27 and f.Mollify(plane, 0.0, 9).offsets() == [(1.0, (0.0, 0.0, 0.0))]
    nested = f.Blur(f.Blur(f.Sphere(), 0.2), 0.1)
    df = spark.createDataFrame(P[:20].tolist(), "x double, y double, z double")
    unrolled = [r.d for r in nested.evaluate(df).collect()]
    assert np.allclose(unrolled, nested.value(*P[:20].T))
    big = f.Mollify(f.Blur(f.Sphere(), 0.2), 0.1, 4)
    assert big.cost > f.UNROLL and np.allclose([r.d for r in big.evaluate(df).collect()], big.value(*P[:20].T))


def test_csg():
    a, b, c = SHAPES[1:4]
    da, db, dc = (s.value(X, Y, Z) for s in (a, b, c))
    assert np.allclose(f.Union((a, b, c)).value(X, Y, Z), np.minimum(np.minimum(da, db), dc))
    assert np.allclose(f.Intersection((a, b, c)).value(X, Y, Z), np.maximum(np.maximum(da, db), dc))
    assert np.allclose(f.difference(a, b, c).value(X, Y, Z), np.maximum(da, -np.minimum(db, dc)))
    low = np.sort(np.stack([da, db, dc]), axis=0)
    assert np.allclose(f.SmoothUnion((a, b, c), 0.5).value(X, Y, Z), f.smooth_min(low[0], low[1], 0.5))
    assert np.allclose(f.SmoothIntersection((a, b, c), 0.5).value(X, Y, Z), f.smooth_max(low[2], low[1], 0.5))
    assert (f.smooth_min(da, db, 0.5) <= np.minimum(da, db)).all() and (f.smooth_max(da, db, 0.5) >= np.maximum(da, db)).all()
    assert np.allclose(f.smooth_min(da, db, 0.0), np.minimum(da, db))
    assert np.allclose(f.exp_min(da, db, 0.5), -0.5 * np.log(np.exp(-da / 0.5) + np.exp(-db / 0.5)))
    assert np.isfinite(f.exp_min(np.float64(-1e4), np.float64(3.0), 0.1))
    assert at(f.Union(()), 0, 0, 0) == at(f.SmoothUnion((), 0.1), 0, 0, 0) == at(f.SmoothIntersection((), 0.1), 0, 0, 0) == math.inf and at(f.Intersection(()), 0, 0, 0) == -math.inf
    assert np.allclose(f.SmoothUnion((a,), 0.5).value(X, Y, Z), da)


def test_repetition_is_periodic_and_bounded():
    rep = f.FiniteRepetition(f.Sphere(radius=0.3), (1.0, 1.0, 1.0), (2.0, 2.0, 2.0), (3.0, 3.0, 3.0))
    copies = f.Union(tuple(f.Sphere(tuple(map(float, c)), 0.3) for c in itertools.product(range(-2, 4), repeat=3)))
    assert np.allclose(rep.value(X, Y, Z), copies.value(X, Y, Z))


def test_perlin(spark):
    table = tuple(int(i) for i in np.random.default_rng(0).permutation(256))
    noise = f.Perlin(1.0, (1.0, 1.0, 1.0), 0.5, 2, table)
    assert np.allclose(noise.value(np.arange(5.0), np.arange(5.0), np.arange(5.0)), 0.75)  # noise is 0 on the lattice
    df = spark.createDataFrame(P[:30].tolist(), "x double, y double, z double")
    assert np.allclose([r.d for r in noise.evaluate(df).collect()], noise.value(*P[:30].T))
    assert noise.value(X, Y, Z).std() > 0.05


def test_normals_and_simplification():
    n = f.Sphere().normal(X, Y, Z, 1e-4)
    r = np.sqrt(X * X + Y * Y + Z * Z)
    assert np.allclose(np.stack(n), P.T / r, atol=1e-6)
    tree = f.Union((f.Complement(f.Complement(f.Sphere())), f.Union((f.Translate(f.Translate(f.Box(), (1.0, 0.0, 0.0)), (0.0, 2.0, 0.0)), f.Torus()))))
    short = f.simplify(tree)
    assert len(short.fields) == 3 and np.allclose(short.value(X, Y, Z), tree.value(X, Y, Z))


@pytest.mark.parametrize(
    "make",
    [lambda: f.Sphere(radius=0.0), lambda: f.Box((0.0,) * 3, (0.0,) * 3), lambda: f.Torus(minor=-1.0), lambda: f.Scale(f.Sphere(), 0.0), lambda: f.Rotate(f.Sphere(), 1.0, 3), lambda: f.Cone(angle=180.0), lambda: f.Blur(f.Sphere(), -1.0), lambda: f.Perlin(persistence=2.0), lambda: f.Plane((0.0,) * 3, (0.0,) * 3), lambda: f.Sphere((math.nan, 0.0, 0.0))],
)
def test_arguments_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_nulls_and_custom_fields(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (1.0, 1.0, 1.0)], "x double, y double, z double")
    assert [r.d for r in f.Sphere().evaluate(df).collect()] == [None, pytest.approx(math.sqrt(3) - 1)]
    gyroid = f.Custom(lambda x, y, z: m.sin(x) * m.cos(y) + m.sin(y) * m.cos(z) + m.sin(z) * m.cos(x))
    assert gyroid.evaluate(df).collect()[1].d == pytest.approx(at(gyroid, 1, 1, 1))
    assert f.Sphere(radius=2.0).inside(df).count() == 1 and f.Sphere(radius=math.sqrt(3)).near(df, 1e-9).count() == 1


def test_plans_stay_in_generated_code(spark, tmp_path):
    spark.createDataFrame(P.tolist(), "x double, y double, z double").withColumn("other", F.lit("w")).write.parquet(str(tmp_path / "p"))
    df = f.Union(tuple(SHAPES)).evaluate(spark.read.parquet(str(tmp_path / "p"))).where("x > 0").select("d")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "GreaterThan(x,0.0)" in plan and "other" not in plan


def test_vectors():
    a, b = (3.0, -4.0, 0.0), (1.0, 2.0, 3.0)
    assert v.dot(a, b) == -5 and v.cross(a, b) == (-12.0, -9.0, 10.0) and v.norm(a) == 5 and v.length2(b) == 14
    assert v.add(a, b) == (4, -2, 3) and v.subtract(a, b) == (2, -6, -3) and v.multiply(a, b) == (3, -8, 0) and v.negate(a) == (-3, 4, 0) and v.scale(b, 2.0) == (2, 4, 6)
    assert tuple(map(float, v.divide(a, (2.0, 2.0, 0.0)))) == (1.5, -2.0, 0.0)
    assert int(v.min_axis(a)) == 1 and int(v.max_axis(a)) == 0 and int(v.max_axis(a, True)) == 1 and int(v.min_axis((1.0, 1.0, 1.0))) == 0
    assert v.clamp(a, (0.0,) * 3, (1.0,) * 3) == (1, 0, 0) and v.unit(2) == (0, 0, 1) and v.lowest(a, b) == (1, -4, 0) and v.highest(a, b) == (3, 2, 3)
    assert not v.all_less(a, b) and v.all_less_equal((1, 1, 1), (1, 1, 2)) and v.lexicographic_less((1, 5, 5), (1, 5, 6)) and v.equal(a, a)
    assert tuple(map(float, v.normalize((0.0, 3.0, 4.0)))) == (0.0, 0.6, 0.8) and tuple(map(float, v.normalize((0.0, 0.0, 0.0)))) == (0, 0, 0)
