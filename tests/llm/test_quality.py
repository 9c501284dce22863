import random

import numpy as np
from helpers import AWKWARD, documents

from feldspar.llm import common, quality, queries


def rows(n=500, seed=2):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefghilmnorst", k=rnd.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words, good = rnd.choices(vocabulary, k=rnd.randint(5, 150)), i % 4 > 0
        if not good:
            words = rnd.choice([lambda w: [x.upper() + "!!" for x in w], lambda w: [x + rnd.choice(["***", "%%%", "$$$"]) for x in w], lambda w: [w[0]] * len(w)])(words)
        out.append((i, " ".join(words), int(good)))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    out = [((scores[i] >= 0.5), bool(q)) for i, _, q in data if common.is_held_out(i)]
    assert len(out) > 100 and sum(a == b for a, b in out) >= 0.97 * len(out)


def test_missing_rows_and_labels(spark):
    docs = documents(spark, AWKWARD, [None, 1, 1, *range(3, 9)])
    for labels in ([], [(2, 1, 0), (None, 0, 0), (3, None, 1)]):
        model = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        found = quality.score(docs, model).collect()
        assert len(found) == 9 and all(0 <= r.score <= 1 for r in found)
    assert quality.score(documents(spark, []), model).collect() == []


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (rng.random(2000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    weights, t = quality.train(x, y)
    p = 1 / (1 + np.exp(-quality.forward(x, weights)[1] / t))
    assert np.mean((p > 0.5) == (y > 0.5)) > 0.65 and 0.25 < t <= 16
    y = (rng.random(2000) < 0.9 / (1 + np.exp(-3 * x[:, 0] - 3))).astype(float)  # uneven labels
    weights, t = quality.train(x, y)
    p = 1 / (1 + np.exp(-quality.forward(x, weights)[1] / t))
    assert abs(p.mean() - y.mean()) < 0.03
    for lo, hi in ((0.2, 0.6), (0.6, 0.8), (0.8, 1.0)):
        own = (p >= lo) & (p < hi)
        assert own.sum() < 50 or abs(p[own].mean() - y[own].mean()) < 0.15


def test_held_out_rows_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_quality(spark, sf).join(common.read(spark, sf, "labels"), "doc_id").where("held_out and quality is not null").collect()
    assert len(rows) > 100 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.quality for r in rows])) < 0.05


def test_a_very_long_text_is_read_whole():
    texts = [t for _, t, _ in rows(60)]
    index, v = quality.word_vectors(texts)
    words = " ".join(texts).split()
    long = quality.pool(" ".join(words * 40), index, v, {})
    assert np.allclose(long[: quality.SIZE], quality.pool(" ".join(words), index, v, {})[: quality.SIZE], atol=1e-3)
    other = quality.pool(" ".join(words * 40 + ["%%%%"] * 20_000), index, v, {})
    assert not np.allclose(long[: quality.SIZE], other[: quality.SIZE], atol=1e-3)


def test_vectors_follow_use():
    texts = ["red big house"] * 5 + ["red tall house"] * 5 + ["sing loud now"] * 5
    index, v = quality.word_vectors(texts)
    near = v[index["big"]] @ v[index["tall"]] / np.linalg.norm(v[index["big"]]) / np.linalg.norm(v[index["tall"]])
    far = v[index["big"]] @ v[index["loud"]] / np.linalg.norm(v[index["big"]]) / np.linalg.norm(v[index["loud"]])
    assert near > far


def test_every_token_counts():
    texts = ["red big house"] * 5 + ["sing loud now"]
    index, v = quality.word_vectors(texts)
    assert "loud" not in index
    new = quality.pool("loud", index, v, {})[: quality.SIZE]
    assert np.allclose(new, (quality.index_vector("loud") + v[index["=a"]]) / 2)
    assert not np.array_equal(new, quality.pool("unseen", index, v, {})[: quality.SIZE])
    common = [f"w{i}" for i in range(31_000)]
    assert set(common) <= set(quality.word_vectors([" ".join(common)] * 2)[0])


def test_stores_don_t_change_results(monkeypatch):
    texts = [t for _, t, _ in rows(40)]
    index, v = quality.word_vectors(texts)
    whole = [quality.pool(t, index, v, {}) for t in texts]
    monkeypatch.setattr(quality, "_STORE", 10)
    known = {}
    assert all(np.array_equal(a, quality.pool(t, index, v, known)) for a, t in zip(whole, texts, strict=True))
