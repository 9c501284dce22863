import random
import time

import pytest
from helpers import AWKWARD, PASSAGE, documents

from feldspar.llm import suffix


def brute(rows, length):
    """(doc_id, kept bytes) for rows (doc_id, text), window by window."""
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if d is not None and d < first.get(w, d + 1):
                first[w] = d
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if d is not None and first[b[s : s + length]] < d:
                gone[s : s + length] = b"\1" * length
        out.append((d, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def check(spark, texts, ids=None, length=suffix.LENGTH):
    ids = list(range(len(texts))) if ids is None else ids
    rows = suffix.remove_repeats(documents(spark, texts, ids), length).collect()
    assert sorted(((r.doc_id, bytes(r.kept)) for r in rows), key=str) == brute(list(zip(ids, texts, strict=True)), length)
    return rows


def test_awkward_rows(spark):
    check(spark, AWKWARD + AWKWARD, [*range(9), None, 1, 1, 1, *range(30, 35)])
    assert suffix.remove_repeats(documents(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdé", k=rnd.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rnd.choices(words, k=rnd.randint(5, 40))) for _ in range(25)]
    texts = [" ".join(rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(words, k=8)) for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    rows = check(spark, texts, rnd.sample(range(1000), 60))
    assert any(r.removed for r in rows)


@pytest.mark.parametrize("held", [1, 7])
def test_seeds_of_more_rows_than_are_held(spark, monkeypatch, held):
    """Runs of one seed in many documents, read on in small Arrow batches."""
    monkeypatch.setattr(suffix, "HELD", held)
    monkeypatch.setattr(suffix, "CROWD", held - 1.0)
    monkeypatch.setattr(suffix, "PART", 200)
    rnd = random.Random(4)
    passage = "".join(rnd.choices("abcdefgh ", k=80))
    texts = ["".join(rnd.choices("abcd", k=rnd.randint(0, 60))) + passage[rnd.randint(0, 20) :] + "".join(rnd.choices("abcd", k=rnd.randint(0, 60))) for _ in range(80)]
    texts += ["ab" * rnd.randint(20, 200) for _ in range(20)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        check(spark, texts, rnd.sample(range(1000), 100))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_plain_doubling_equals_brute_force(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abé", k=rnd.randint(1, 5))) for _ in range(20)]
    passages = [" ".join(rnd.choices(words, k=rnd.randint(3, 9))) for _ in range(8)]
    texts = [" ".join(rnd.choice(passages) for _ in range(rnd.randint(1, 6))) for _ in range(30)] + [None, "", "ab" * 40, "ba" * 30]
    ids = rnd.sample(range(100), len(texts))
    for length in (13, 16, 50):
        first = {}
        for d, x in zip(ids, texts, strict=True):
            b = (x or "").encode()
            for s in range(len(b) - length + 1):
                first[b[s : s + length]] = min(d, first.get(b[s : s + length], d))
        expected = {(d, s) for d, x in zip(ids, texts, strict=True) for b in [(x or "").encode()] for s in range(len(b) - length + 1) if first[b[s : s + length]] < d}
        assert {tuple(r) for r in suffix.double(documents(spark, texts, ids), length).collect()} == expected and expected
    assert suffix.double(documents(spark, []), 16).collect() == []


def test_periods_edits_and_borders(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 64)
    monkeypatch.setattr(suffix, "PART", 300)
    rnd = random.Random(9)
    base = "".join(rnd.choices("abcdefgh ", k=900))
    texts = ["ab" * 200, "ab" * 90, "ba" * 26, "a" * 700, "a" * 49, "a" * 50, base, base[:430] + "X" + base[430:], base[100:149], base[100:150], base[100:151], base[850:] + base[:60], base[::-1]]
    check(spark, texts, [5, 3, 9, 12, 1, 2, 40, 30, 50, 51, 52, 20, 7])


def test_texts_without_repeats(spark):
    p = "a passage of more than fifty bytes, with an é, that stands in two documents"
    docs = documents(spark, [p + " first", "before " + p + " after", p, None, "", "é" * 60, "x" + "é" * 40])
    rows = {r.doc_id: r for r in suffix.without_repeats(docs).collect()}
    assert set(rows) == {0, 1, 3, 4, 5} | ({6} if 6 in rows else set()) and rows[0].text == p + " first" and rows[3].text is None and rows[4].text == ""
    assert rows[1].text.startswith("before") and rows[1].text.endswith("after") and rows[1].n_chars == len(rows[1].text) and "passage" not in rows[1].text
    assert suffix.without_repeats(docs).columns == docs.columns


def test_windows_share_their_seed():
    import numpy as np

    rnd = np.random.default_rng(0)
    data = rnd.integers(97, 101, 4000).astype(np.uint8).tobytes()
    value, start, count, before, after = suffix.runs(data)
    assert count.sum() == len(data) - suffix.LENGTH + 1 and (start == np.concatenate(([0], np.cumsum(count)[:-1]))).all()
    assert ((before == 0) | (before <= suffix._CODE_MAX)).all() and (before + after > 0).any()


def test_late_windows_and_merged_spans_without_spark(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(13)
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(suffix, "ranks", lambda data, size: np.zeros(len(data) - size + 1, np.uint64))
        runs = [(rnd.randrange(9), 100 * i, bytes(rnd.choices(b"ab", k=rnd.randint(6, 15)))) for i in range(60)]
        first = {}
        for d, _, b in runs:
            for s in range(len(b) - 5):
                first[b[s : s + 6]] = min(d, first.get(b[s : s + 6], d))
        expected = {}
        for d, a, b in runs:
            expected.setdefault(d, []).extend((a + s, a + s + 6) for s in range(len(b) - 5) if first[b[s : s + 6]] < d)
        doc, start = (np.array([r[i] for r in runs]) for i in (0, 1))
        text = pa.array([b"skipped", *(r[2] for r in runs)], pa.binary()).slice(1)
        found = {}
        for d, _, a, b in zip(*(c.tolist() for c in suffix._late_windows(doc, doc, start, text, 6)), strict=True):
            found.setdefault(d, []).append((a, b))
        assert {d: suffix.merge(x) for d, x in found.items()} == {d: suffix.merge(x) for d, x in expected.items() if x} and found
    kind = pa.list_(pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64())])))
    rows = [[[(a, a + rnd.randint(1, 9)) for a in rnd.choices(range(60), k=rnd.randint(0, 5))] for _ in range(rnd.randint(0, 3))] for _ in range(40)]
    as_arrow = pa.array([[[{"start": a, "until": b} for a, b in part] for part in row] for row in rows], kind)
    for cut in (0, 7, 40):
        found = [[(x["start"], x["until"]) for x in row] for row in suffix._merged(as_arrow.slice(cut)).to_pylist()]
        assert found == [suffix.merge([x for part in row for x in part]) for row in rows[cut:]]


def test_a_code_tells_most_of_a_common_seed_s_runs_apart():
    """Runs of one seed go to round 3 only if another document shares a code; few do by chance."""
    import numpy as np

    n, rnd = 4000, np.random.default_rng(5)
    rank = rnd.integers(0, 1 << 63, (4, n)).astype(np.uint64)
    rows = [suffix._pack(np.full(n, 1 << 40, np.uint64), suffix._codes(rank[0])), suffix._pack(rank[1], suffix._codes(rank[2])), np.arange(n), np.zeros(n, np.int64), np.full(n, 5)]
    assert len(suffix._rank(rows, suffix.LENGTH)[0]) < n // 4


def test_shuffle_files_of_finished_rounds_go_though_their_plans_are_kept(spark, monkeypatch):
    """Nothing that still refers to a round's plan keeps its exchange on disk."""
    plans, frame = [], type(spark.range(1))
    checkpoint = frame.checkpoint

    def kept(self, *args, **options):
        plans.append(self)
        return checkpoint(self, *args, **options)

    monkeypatch.setattr(frame, "checkpoint", kept)
    rows = check(spark, [PASSAGE, "before " + PASSAGE, PASSAGE + " after", "another text of the same doc_id"], [1, 2, 3, 3])
    assert sum(bool(r.removed) for r in rows) == 2
    plans = [p._jdf.queryExecution().executedPlan() for p in plans]
    ids = {i for p in plans if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec" for i in p.context().shuffleIds()}
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def left():
        names = [f.rsplit("/", 1)[-1].split("_") for f in disk.getAllFiles().mkString("\n").split("\n")]
        return {int(n[1]) for n in names if n[0] == "shuffle"} & ids

    until = time.time() + 20
    while left() and time.time() < until:
        time.sleep(0.2)
    assert len(ids) > 4 and not left()
