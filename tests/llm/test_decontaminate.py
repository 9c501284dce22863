import random
import re

import pytest
from helpers import AWKWARD, PASSAGE, documents

from feldspar.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[s : s + 8]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, owners = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    owners |= windows[k] - {None}
        out.append((str(i), len(w), len(hit), sorted(map(str, owners)), len(owners) >= 2))
    return sorted(out)


def test_matches_brute_force(spark):
    items = [(1, PASSAGE), (2, "Potion, of QUIET thunder!"), (10, "quick brown fox jumps over the lazy dog while"), (9, None), (4, " ,. "), (5, "ΑΣ'Σ é É x"), (None, "words follow here to the"), (1, "seven wizards")]
    texts = [*AWKWARD, PASSAGE.upper(), "ασ ΑΣ'Σ é É X! and more", "potion of quiet thunder potion of quiet thunder", "x" + PASSAGE, PASSAGE.replace(" ", "--")]
    ids = [None, 7, 7, *range(20, 20 + len(texts) - 3)]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as word", "2 as w", "3 as n")
    found = d.decontaminate(documents(spark, texts, ids), table).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in found) == brute(list(zip(ids, texts, strict=True)), items)
    assert all(r.n_items == len(r.item_ids) for r in found)


@pytest.mark.parametrize("limit", [0, 900])
def test_windows_that_are_not_broadcast(spark, monkeypatch, limit):
    """Neither the windows nor their words fit, or only the words do."""
    rnd = random.Random(3)
    vocabulary = [c + str(i) for i in range(3) for c in ("a", "B", "é")]
    items = [(i, " ".join(PASSAGE.split()[i : i + 10])) for i in range(9)] + [(20 + i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 14)))) for i in range(20)]
    texts = [*AWKWARD, *(" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 80))) for _ in range(60))]
    monkeypatch.setattr(d, "LIMIT", limit)
    found = d.decontaminate(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in found) == brute(list(enumerate(texts)), items)


def test_a_very_long_text_is_read_whole(spark):
    text = "word " * 150_000 + PASSAGE + " word" * 150_000
    (row,) = d.decontaminate(documents(spark, [text]), spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")).collect()
    assert (row.n_words, row.n_hit, row.n_items) == (300_000 + len(PASSAGE.split()), len(PASSAGE.split()), 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in d.decontaminate(documents(spark, AWKWARD), none).collect()] == [0] * len(AWKWARD)
    assert d.decontaminate(documents(spark, []), none).collect() == []


def test_clean_rows_stay(spark):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    docs = documents(spark, [*AWKWARD, PASSAGE[40:]], [None, *range(1, len(AWKWARD) + 1)])
    kept = d.clean(docs, items, least_items=1)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "1", "2", "3", "4", "7"])


def test_main_path_is_native(spark):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    plan = d.decontaminate(documents(spark, AWKWARD), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
