import random

from feldspar.llm import common


def test_components_match_union_find(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_folds(spark):
    rows = spark.range(200).selectExpr("id", "id as doc_id").select("id", common.held_out(common.F.col("id")).alias("h")).collect()
    assert all(r.h == common.is_held_out(r.id) for r in rows) and 40 < sum(r.h for r in rows) < 100
    assert spark.sql("select cast(null as long) as i").select(common.held_out(common.F.col("i"))).first()[0] is False


def test_the_driver_s_garbage_goes_between_steps(spark, monkeypatch):
    released = []
    monkeypatch.setattr(common, "release", released.append)
    monkeypatch.setattr(common, "HEAP_SHARE", 1.0)
    assert common.sized(spark.range(3)).count() == 3 and not released
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0)
    assert common.sized(spark.range(3)).count() == 3 and len(released) == 1


def test_a_broadcast_counts_what_the_driver_hashes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.broadcast_hashed(spark.range(200_000), 64)) and not hinted(common.broadcast_hashed(spark.range(1_000_000), 64))
