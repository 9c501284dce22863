import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from feldspar.functions import algebra as m
from feldspar.functions.fields import Box, Sphere, Translate
from feldspar.operators import blocks, bvh, cloud, scene, spatial
from feldspar.streaming import field as stream_field
from feldspar.streaming import nearest as stream_nearest

RNG = np.random.default_rng(7)


def table(spark, points, key="pid"):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], f"{key} long, x double, y double, z double")


def brute(queries, points, k, itself=False):
    out = []
    for q, p in enumerate(queries):
        d2 = ((points - p) ** 2) @ np.ones(3)
        order = [i for i in np.lexsort((np.arange(len(points)), d2)) if not (itself and i == q)][:k]
        out += [(q, r + 1, int(i), pytest.approx(d2[i], abs=1e-12)) for r, i in enumerate(order)]
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


CLOUDS = {
    "uniform": RNG.random((500, 3)),
    "line": np.stack([np.linspace(0, 1, 80), np.zeros(80), np.zeros(80)], axis=1),
    "coincident": np.full((12, 3), 0.25),
    "lattice": np.array(np.meshgrid(*[np.arange(5.0)] * 3)).reshape(3, -1).T,
    "outlier": np.concatenate([RNG.random((150, 3)) * 1e-3, [[100.0, -50.0, 3.0]]]),
    "single": np.array([[1.0, 2.0, 3.0]]),
}


@pytest.mark.parametrize("name", CLOUDS)
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_equals_brute_force(spark, name, k):
    points = CLOUDS[name]
    queries = np.concatenate([RNG.random((15, 3)), points[:5], [[50.0, 50.0, 50.0], [-9.0, 0.5, 0.5]]])
    assert rows(cloud.nearest(table(spark, queries, "qid"), table(spark, points), k)) == brute(queries, points, k)
    if len(points) < 200:
        assert rows(cloud.graph(table(spark, points), k)) == brute(points, points, k, True)


@pytest.mark.parametrize("name", ["uniform", "coincident", "outlier"])
def test_nearest_in_several_blocks(spark, monkeypatch, name):
    """Blocks of a few points, of which each task takes a few queries."""
    monkeypatch.setattr(blocks, "BLOCK", 40 if name != "coincident" else 3)
    monkeypatch.setattr(blocks, "SHARE", 9)
    points = CLOUDS[name]
    queries = np.concatenate([RNG.random((15, 3)), points[:5], [[50.0, 50.0, 50.0], [-9.0, 0.5, 0.5]]])
    for k in (1, 5):
        assert rows(cloud.nearest(table(spark, queries, "qid"), table(spark, points), k)) == brute(queries, points, k)
    assert rows(cloud.graph(table(spark, points[:150]), 3)) == brute(points[:150], points[:150], 3, True)


def test_points_meet_few_blocks():
    rng = np.random.default_rng(1)
    corner = np.array(np.meshgrid(*[np.arange(10.0)] * 3)).reshape(3, -1).T
    met = blocks.candidates(rng.random((200, 3)) * 10, corner, corner + 1, np.full(1000, 50), 4)
    assert met.any(axis=1).all() and met.sum(axis=1).mean() < 60


def test_nearest_without_points_or_coordinates(spark):
    q = spark.createDataFrame([(1, None, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, math.nan, 0.0, 0.0)], "qid long, x double, y double, z double")
    assert cloud.nearest(q, table(spark, []), 3).collect() == []
    assert rows(cloud.nearest(q, table(spark, [[1, 1, 1]]), 3)) == [(2, 1, 0, 3.0)]
    assert rows(cloud.scan(q.where("qid = 2"), table(spark, [[1, 1, 1], [2, 0, 0]]), 1)) == [(2, 1, 0, 3.0)]
    assert rows(cloud.distances(q.where("qid = 2"), table(spark, [[1, 0, 0], [2, 0, 0]]))) == [(2, 1.0, 2.0)]


@pytest.mark.parametrize("build", bvh.BUILDS)
def test_hierarchies_never_change_results(spark, build):
    centers, q = RNG.random((300, 3)), RNG.random((60, 3)) * 1.4 - 0.2
    prims = scene.spheres(table(spark, centers, "prim_id").selectExpr("prim_id", "x as cx", "y as cy", "z as cz", "0.02 + prim_id % 5 * 0.01 as r"))
    d = np.linalg.norm(q[:, None] - centers, axis=2) - (0.02 + np.arange(300) % 5 * 0.01)
    found = sorted(scene.union(table(spark, q, "qid"), prims, build=build).collect())
    assert np.allclose([r.d for r in found], d.min(1)) and [r.prim_id for r in found] == d.argmin(1).tolist()


def test_trees_hold_every_primitive_once_and_refit():
    lo = RNG.random((333, 3))
    hi = lo + RNG.random((333, 3)) * 0.1
    for build in bvh.BUILDS:
        tree = bvh.Bvh(lo, hi, build)
        assert sorted(tree.ids.tolist()) == list(range(333)) and np.allclose(tree.lo[0], lo.min(0)) and np.allclose(tree.hi[0], hi.max(0))
        tree.refit(lo + 1, hi + 1)
        assert np.allclose(tree.lo[0], lo.min(0) + 1)
        bvh.Bvh(np.zeros((40, 3)), np.zeros((40, 3)), build)  # all alike
    assert len(bvh.Bvh(np.empty((0, 3)), np.empty((0, 3))).children) == 0
    with pytest.raises(ValueError):
        bvh.Bvh(lo, hi, "other")
    assert [len(c) for c in bvh.equal_counts(np.arange(11), 4)] == [3, 3, 3, 2]


def test_scenes(spark, monkeypatch):
    q = RNG.random((80, 3)) * 3 - 1
    points = table(spark, q, "qid")
    lows = RNG.random((40, 3))
    boxed = spark.createDataFrame([(i, *map(float, a), *map(float, a + 0.2)) for i, a in enumerate(lows)], "prim_id long, lox double, loy double, loz double, hix double, hiy double, hiz double")
    balls = scene.spheres(table(spark, RNG.random((30, 3)), "prim_id").selectExpr("prim_id + 100 as prim_id", "x as cx", "y as cy", "z as cz", "0.1 as r"))
    both = scene.boxes(boxed).union(balls)
    fields = [Box(tuple(map(float, a)), tuple(map(float, a + 0.2))) for a in lows] + [Sphere((r.p[0], r.p[1], r.p[2]), 0.1) for r in balls.orderBy("prim_id").collect()]
    d = np.sort(np.stack([g.value(*q.T) for g in fields]), axis=0)
    for block in (scene.BLOCK, 17):
        monkeypatch.setattr(scene, "BLOCK", block)
        assert np.allclose([r.d for r in sorted(scene.union(points, both).collect())], d[0])
        h = np.maximum(0.3 - np.abs(d[0] - d[1]), 0) / 0.3
        assert np.allclose([r.d for r in sorted(scene.smooth_union(points, both, 0.3).collect())], d[0] - 0.25 * h * h * 0.3)
        assert np.allclose([r.d for r in sorted(scene.intersection(points, both).collect())], d[-1])
        h = np.maximum(0.3 - np.abs(d[-1] - d[-2]), 0) / 0.3
        assert np.allclose([r.d for r in sorted(scene.smooth_intersection(points, both, 0.3).collect())], d[-1] + 0.25 * h * h * 0.3)
    inside = {int(i) for i in np.flatnonzero(d[0] < 0)}
    assert {r.qid for r in scene.inside_any(points, both).collect()} == inside
    assert {r.qid for r in scene.outside_all(points, both).collect()} == set(range(80)) - inside
    solid = Sphere(radius=1.0)
    assert np.allclose([r.d for r in sorted(scene.difference(points, solid, both).collect())], np.maximum(solid.value(*q.T), -d[0]))
    none = both.where("false")
    assert {r.d for r in scene.union(points, none).collect()} == {math.inf} and {r.d for r in scene.intersection(points, none).collect()} == {-math.inf}
    assert {r.d for r in scene.smooth_union(points, none, 0.1).collect()} == {r.d for r in scene.smooth_intersection(points, none, 0.1).collect()} == {math.inf}
    unknown = spark.createDataFrame([(1, None, 1.0, 1.0)], "qid long, x double, y double, z double")
    assert scene.union(unknown, both).collect()[0].d is None


def test_boxes_and_spheres():
    a, b = ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), ((1.0, 0.0, 0.0), (2.0, 1.0, 1.0))
    assert not spatial.boxes_intersect(a, b) and spatial.boxes_intersect(a, ((0.9, 0.5, 0.5), (2.0, 2.0, 2.0)))
    assert spatial.box_overlap(a, ((0.5, 0.5, 0.5), (2.0, 2.0, 2.0))) == pytest.approx(0.125) and spatial.box_distance(a, (0.5, 0.5, 0.5)) == 0 and spatial.box_distance(a, (2.0, 0.5, 2.0)) == pytest.approx(math.sqrt(2))
    assert spatial.box_volume(b) == 1 and spatial.box_area(b) == 6 and spatial.box_centroid(b) == (1.5, 0.5, 0.5)
    s, t = ((0.0, 0.0, 0.0), 1.0), ((2.0, 0.0, 0.0), 1.0)
    assert not spatial.spheres_intersect(s, t) and float(spatial.sphere_overlap(s, t)) == 0 and float(spatial.sphere_overlap(s, s)) == pytest.approx(4 / 3 * math.pi)
    assert float(spatial.sphere_overlap(s, ((1.0, 0.0, 0.0), 1.0))) == pytest.approx(5 * math.pi / 12) and spatial.sphere_distance(s, (3.0, 0.0, 0.0)) == 2
    p = RNG.normal(size=(200, 3))
    c, r = spatial.ritter(p)
    assert (np.linalg.norm(p - c, axis=1) <= r).all() and r < 1.6 * np.linalg.norm(p - p.mean(0), axis=1).max()
    c, r = spatial.sphere_of_spheres(np.array([[0.0, 0, 0, 1], [5, 0, 0, 1]]))
    assert r >= 3.5


def test_overlap_join_equals_brute_force(spark):
    lo = RNG.random((120, 3)) * 10 - 5
    hi = lo + RNG.random((120, 3)) * 3
    boxes = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(lo, hi, strict=True))], "id long, lox double, loy double, loz double, hix double, hiy double, hiz double")
    expected = sorted((i, j) for i in range(120) for j in range(120) if (lo[i] < hi[j]).all() and (lo[j] < hi[i]).all())
    assert rows(spatial.overlap_join(boxes, boxes, 1.7)) == expected


def test_overlap_join_of_boxes_of_all_sizes(spark):
    """Sizes from nothing to a million cells: each box touches few cells of its own grid."""
    lo = RNG.random((150, 3)) * 1000 - 500
    hi = lo + 10.0 ** RNG.uniform(-3, 6, (150, 1)) * RNG.random((150, 3))
    hi[:5] = lo[:5]
    boxes = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(lo, hi, strict=True))], "id long, lox double, loy double, loz double, hix double, hiy double, hiz double")
    expected = sorted((i, j) for i in range(150) for j in range(150) if (lo[i] < hi[j]).all() and (lo[j] < hi[i]).all())
    assert rows(spatial.overlap_join(boxes, boxes, 1.0)) == expected
    assert spatial.overlap_join(boxes.where("false"), boxes, 1.0).collect() == []


def test_overlap_join_of_narrow_tall_boxes(spark):
    """Each axis has cells of its own: tall boxes don't meet all that are near in units of their height."""
    lo = np.stack([RNG.integers(0, 40, 150), RNG.integers(0, 40, 150), np.zeros(150, int)], axis=1).astype(float)
    hi = lo + np.stack([np.full(150, 1.5), np.full(150, 1.5), RNG.integers(1, 51, 150) / 5], axis=1)
    boxes = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(lo, hi, strict=True))], "id long, lox double, loy double, loz double, hix double, hiy double, hiz double")
    expected = sorted((i, j) for i in range(150) for j in range(150) if (lo[i] < hi[j]).all() and (lo[j] < hi[i]).all())
    assert rows(spatial.overlap_join(boxes, boxes, 4.0)) == expected
    finest, _, grids = spatial._grids(boxes, boxes, 4.0)
    assert finest == [-1, -1, 0] and {g[:2] for g in grids} == {(0, 0)}  # cells of 2 x 2, whatever the height
    sizes = spark.createDataFrame([(i, 0.0, 0.0, 0.0, *(2.0 ** int(n) for n in RNG.integers(-40, 41, 3))) for i in range(300)], boxes.schema)
    assert 1 < len(spatial._grids(sizes, sizes, 1.0)[2]) <= spatial.GRIDS  # 300 shapes, still few grids for a box


def test_octree_orders_and_inherited_columns(spark):
    def keep(cells):
        return cells.withColumn("flag", F.col("lox") + F.col("loy") < 1.0).withColumn("born", F.coalesce("born", F.col("level"))) if "born" in cells.columns else cells.withColumn("flag", F.lit(True)).withColumn("born", F.lit(0))

    cells = spatial.octree(spark, (0.0,) * 3, (2.0,) * 3, 3, keep, meta=("born",))
    found = [(r.path, r.lox, r.loy, r.loz) for r in cells.orderBy("path").collect()]
    assert {r.born for r in cells.collect()} == {0} and all(len(p) == 3 for p, *_ in found)

    def walk(path, low, size):  # depth first
        if sum(low[:2]) >= 1.0 and path:
            return
        if len(path) == 3:
            yield (path, *low)
            return
        for o in range(8):
            yield from walk([*path, o], tuple(c + size / 2 * (o >> i & 1) for i, c in enumerate(low)), size / 2)

    assert found == list(walk([], (0.0, 0.0, 0.0), 2.0))
    turned = spatial.octree(spark, (0.0,) * 3, (2.0,) * 3, 1, lambda c: c.withColumn("flag", F.lit(True)), children=lambda o: 7 - o).orderBy("path").collect()
    assert [(r.path, r.lox) for r in turned][0] == ([0], 1.0) and len(turned) == 8


def test_hierarchies_by_the_caller_s_rules():
    lo = RNG.random((200, 3))
    hi = lo + 0.05
    for build in bvh.BUILDS:
        tree = bvh.Bvh(lo, hi, build, leaf=lambda own: len(own) < 5)
        leaves = [n for n in range(len(tree.children)) if tree.is_leaf(n)]
        assert sorted(np.concatenate([tree.primitives(n) for n in leaves]).tolist()) == list(range(200))
        assert build == "cluster_sah" or max(len(tree.primitives(n)) for n in leaves) < 5
        assert (tree.box()[0] == lo.min(0)).all() and (tree.box()[1] == hi.max(0)).all()
        packed = tree.packed(lambda own: lo[own].sum(0))
        assert np.allclose(sum(p for p in packed if p is not None), lo.sum(0)) and all((p is None) != tree.is_leaf(n) for n, p in enumerate(packed))
        p, best, seen = np.array([0.3, 0.6, 0.2]), [np.inf, -1], []

        def evaluate(node, own):
            seen.append(node)
            d = np.linalg.norm(np.maximum(np.maximum(lo[own] - p, p - hi[own]), 0), axis=1)
            if d.min() < best[0]:
                best[:] = [d.min(), own[d.argmin()]]

        tree.traverse(evaluate, lambda node, d: d < best[0], lambda node: tree.distance2(node, p[None])[0] ** 0.5, lambda pairs: sorted(pairs, key=lambda c: c[1]))
        every = np.linalg.norm(np.maximum(np.maximum(lo - p, p - hi), 0), axis=1)
        assert best[0] == every.min() and len(seen) < len(leaves) / 2


def test_curves(spark):
    cells = np.concatenate([RNG.integers(0, spatial.SPAN + 1, (300, 3)), [[0, 0, 0], [spatial.SPAN] * 3]])
    assert (spatial.hilbert_cells(spatial.hilbert_codes(cells)) == cells).all()
    walk = spatial.hilbert_cells(np.arange(8192))
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all() and len({tuple(c) for c in walk}) == 8192
    df = spark.createDataFrame([tuple(map(int, c)) for c in cells], "ix long, iy long, iz long")
    x = [F.col(c) for c in ("ix", "iy", "iz")]
    for encode, decode in ((spatial.morton, spatial.morton_cell), (spatial.nested, spatial.nested_cell)):
        back = df.withColumn("code", encode(*x)).select(*x, "code", *[c.alias(n) for c, n in zip(decode(F.col("code")), "abc", strict=True)]).collect()
        assert all((r.ix, r.iy, r.iz) == (r.a, r.b, r.c) for r in back) and len({r.code for r in back}) == len({tuple(c) for c in cells})
    code = df.select(spatial.hilbert("ix", "iy", "iz").alias("h"), spatial.morton(*x).alias("m")).collect()
    assert [r.h for r in code] == spatial.hilbert_codes(cells).tolist() and min(r.m for r in code) == 0
    assert spark.createDataFrame([(5,)], "code long").select(spatial.hilbert_cell("code").alias("c")).first().c == walk[5].tolist()


def test_bins_and_order(spark):
    points = table(spark, np.concatenate([RNG.random((60, 3)), [[0.5, 0.5, 0.5]] * 3]))
    binned = spatial.bins(points).collect()
    assert max(r.ix for r in binned) == spatial.SPAN and min(r.iz for r in binned) == 0
    for curve in ("morton", "nested", "hilbert"):
        found = spatial.curve_order(points, curve).orderBy("place").collect()
        assert [r.place for r in found] == list(range(63)) and [(r.code, r.pid) for r in found] == sorted((r.code, r.pid) for r in found)
    flat = spatial.bins(table(spark, [[1, 2, 3], [1, 5, 3]])).collect()
    assert [(r.ix, r.iz) for r in flat] == [(0, 0), (0, 0)]


def test_octree_boxes_shrink_around_the_surface(spark):
    sizes = []
    for depth in (2, 4, 6):
        r = spatial.octree_box(spark, Sphere(), (-2.0,) * 3, (2.0,) * 3, depth).first()
        assert max(r[:3]) <= -1 and min(r[3:]) >= 1
        sizes.append(r.hix)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < 1.2
    for low, high, field in (((2.0,) * 3, (-2.0,) * 3, Sphere()), ((-2.0,) * 3, (2.0,) * 3, Translate(Sphere(), (50.0, 0.0, 0.0)))):
        assert tuple(spatial.octree_box(spark, field, low, high, 3).first()) == (-m.HUGE,) * 3 + (m.HUGE,) * 3


def test_streams(spark, tmp_path):
    table(spark, RNG.random((50, 3)), "qid").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, x double, y double, z double").parquet(str(tmp_path / "in"))
    q = stream_field(stream, Sphere()).writeStream.format("memory").queryName("fields").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fields").where("d is not null").count() == 50
    seen = []
    q = stream_nearest(stream, table(spark, RNG.random((20, 3))), 2, lambda batch, n: seen.append(batch.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [100]
