import random

import numpy as np
import pytest
from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from feldspar.llm import common, simhash
from feldspar.llm.words import shingles


def brute(rows):
    """component by doc_id, by comparing all fingerprints."""
    fps = [fp & (2**64 - 1) for _, fp in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            least = min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3)
            if least < label[i]:
                label[i], changed = least, True
    least = {}
    for (d, _), g in zip(rows, label, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, least.get(g)) for (d, _), g in zip(rows, label, strict=True)), key=str)


def test_components_match_brute_force(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(1, 5))) for b in base * 4]
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in set(fps)], "fp long")
    found = {tuple(r) for r in simhash.links(df).collect()}
    signed = sorted(int(np.uint64(x).view(np.int64)) for x in set(fps))
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert found == expected
    label = {x: x for x in signed}
    for _ in signed:
        for a, b in expected:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for pair in expected for x in pair}
    assert {tuple(r) for r in simhash.similar_fingerprints(df).collect()} == {(x, label[x]) for x in linked}


def test_a_dense_ball_of_fingerprints_is_one_component(spark):
    rnd = random.Random(5)
    center = rnd.getrandbits(64)
    ball = {center ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(1500)}
    far = {rnd.getrandbits(64) for _ in range(50)}
    signed = lambda x: int(np.uint64(x).view(np.int64))
    rows = simhash.similar_fingerprints(spark.createDataFrame([(signed(x),) for x in ball | far], "fp long")).collect()
    assert {r.node for r in rows} == set(map(signed, ball)) and {r.root for r in rows} == {min(map(signed, ball))}


def test_fingerprint_by_definition():
    import xxhash

    text = "The Quick\tbrown fox, the quick brown FOX"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    expected = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == expected == simhash.fingerprint(text, block=2)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("one TWO") == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint("É a b") != simhash.fingerprint("é a b")


def test_a_very_long_text_is_read_whole():
    words = [str(i % 977) for i in range(400_000)]
    whole = simhash.fingerprint(" ".join(words))
    assert whole == simhash.fingerprint(" ".join(words), block=1000)
    assert whole != simhash.fingerprint(" ".join(words[:100_000] + ["other"] * 300_000))


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD + AWKWARD, [*range(9), None, 1, 1, *range(30, 36)])
    rows = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(rows) == 18
    assert sorted(((d, c) for d, _, c in rows), key=str) == brute([(d, fp) for d, fp, _ in rows])
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def jaccard(a, b):
    x, y = ({j[s:e] for s, e in p} for j, p in (shingles(a, 5), shingles(b, 5)))
    return len(x & y) / len(x | y) if x or y else 1.0


def test_near_copies_are_caught_and_others_left(spark):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(900)]
    texts = []
    for _ in range(25):
        words = rnd.choices(vocabulary, k=rnd.randint(150, 400))
        texts.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            for i in rnd.sample(range(len(copy)), rnd.randint(1, max(1, len(copy) // 90))):
                copy[i] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    group = {r.doc_id: r.group for r in simhash.near_copies(documents(spark, texts)).collect()}
    for i in range(len(texts)):
        for j in range(i):
            s = jaccard(texts[i], texts[j])
            if s >= 0.8:
                assert group[i] == group[j]
            if s < 0.2:
                assert group[i] != group[j]
    kept = simhash.one_of_each(documents(spark, texts + texts[:5], [*range(len(texts)), *range(5)]))
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(group.values())) and set(ids) == {min(d for d in group if group[d] == g) for g in group.values()}
    assert kept.columns == documents(spark, []).columns
    assert simhash.one_of_each(documents(spark, [])).collect() == []


def test_a_word_repeated_often_hides_no_copy(spark):
    rnd = random.Random(6)
    texts = []
    for _ in range(10):
        words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(200)]
        texts += [" ".join(words), " ".join(words + ["again"] * 300)]
    group = {r.doc_id: r.group for r in simhash.near_copies(documents(spark, texts)).collect()}
    apart = [(simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[i + 1], 5)).bit_count() for i in range(0, 20, 2)]
    assert max(apart) > 24 and all(jaccard(texts[i], texts[i + 1]) >= 0.95 for i in range(0, 20, 2))
    assert all(group[i] == group[i + 1] for i in range(0, 20, 2)) and len(set(group.values())) == 10


def brute_groups(texts):
    """The least index linked by similarities of 0.8 or more, by comparing all pairs."""
    label = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    for _ in texts:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label


def test_a_large_group_of_near_copies_equals_brute_force(spark):
    """One text and copies of it with 0 to 40 words changed: many pairs lie close to the threshold on either side."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(3000)]
    words = rnd.choices(vocabulary, k=140)
    texts = []
    for _ in range(350):
        copy = list(words)
        for i in rnd.sample(range(len(copy)), rnd.randint(0, 9)):
            copy[i] = rnd.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(rnd.choices(vocabulary, k=100) + words[:60]) for _ in range(50)]  # a passage that many share
    texts += ["short text of six words here", "Short text of six words here", "short text of six words there"]
    group = {r.doc_id: r.group for r in simhash.near_copies(documents(spark, texts)).collect()}
    expected = brute_groups(texts)
    assert len(set(expected)) > 60
    assert {frozenset(i for i in group if group[i] == g) for g in group.values()} == {frozenset(i for i in group if expected[i] == e) for e in expected}


def test_the_prefix_join_finds_every_pair(spark):
    rnd = random.Random(9)
    sets = []
    for _ in range(60):
        base = rnd.sample(range(400), rnd.randint(1, 60))
        sets += [base, *([*base[rnd.randint(0, len(base) // 5) :], *rnd.sample(range(400, 2000), rnd.randint(0, len(base) // 5))] for _ in range(3))]
    sets = [sorted(set(s)) for s in sets]
    df = spark.createDataFrame([(bytes([i]), s) for i, s in enumerate(sets)], "h binary, s array<long>")
    roots = spark.createDataFrame([(bytes([i]), bytes([i if i % 7 else 0])) for i in range(len(sets))], "h binary, root binary")
    found = {(r.a[0], r.b[0]) for r in simhash.similar_pairs(df, roots, 0.8).collect()}
    expected = {(i, j) for j in range(len(sets)) for i in range(j) if (i % 7 or j % 7) and 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
    assert found == expected and len(found) > 50


def test_one_of_each_of_awkward_rows(spark):
    docs = documents(spark, AWKWARD + AWKWARD, [*range(9), None, 1, 1, *range(30, 36)])
    kept = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    # no words: 0; then one of each text
    assert kept == [0, 1, 3, 4, 5, 7] or kept == [0, 3, 4, 5, 7, 8] or kept == [0, 3, 4, 5, 7]


def test_same_text_in_many_rows(spark):
    kept = simhash.one_of_each(documents(spark, ["some words that are the same in all rows"] * 7, [None, None, 5, 5, 6, 7, None]))
    assert [r.doc_id for r in kept.collect()] == [5]


def test_joins_that_are_too_large_to_broadcast(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "eps"], k=rnd.randint(1, 12))) for _ in range(60)]
    docs = documents(spark, texts + [t + " end" for t in texts] + [None, ""])

    def found():
        return sorted(simhash.near_duplicates(docs).collect()), sorted((r.doc_id, r.text or "") for r in simhash.one_of_each(docs, 2, 0.6).collect())

    expected = found()
    monkeypatch.setattr(common, "HASHED_BYTES", -1)
    assert found() == expected


def test_exploded_keys_are_never_broadcast(spark, monkeypatch):
    """Spark takes exploded rows to be as large as before the explode, and would have the driver hash all of them."""

    class Planned(Exception):
        pass

    def planned(df):
        raise Planned(df._jdf.queryExecution().executedPlan().toString())

    def first_plan(run, *args):
        with pytest.raises(Planned) as e:
            run(*args)
        return str(e.value)

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 20")
    fps = docs.select(F.col("doc_id").alias("fp"))
    monkeypatch.setattr(simhash, "sized", planned)
    plans = [simhash.links(fps)._jdf.queryExecution().executedPlan().toString(), first_plan(simhash.similar_fingerprints, fps)]
    assert all("SortMergeJoin [key" in p and "BroadcastHashJoin" not in p for p in plans)
    monkeypatch.setattr(simhash, "similar_fingerprints", lambda distinct: distinct.select(F.col("fp").alias("node"), F.col("fp").alias("root")))
    assert "SortMergeJoin [band" in first_plan(simhash.near_copies, docs)
