"""The whole pipeline over the small tables against a plain Python version of each stage."""

import itertools
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feldspar.llm import toxicity
from feldspar.llm.common import read
from feldspar.llm.words import shingles


def grams(text):
    joined, bounds = shingles(text, 5)
    return {joined[s:e] for s, e in bounds}


def one_of_each(rows):
    sets = [(d, grams(t)) for d, t in rows]
    label = {d: d for d, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if (len(x & y) >= 0.8 * len(x | y)) if x or y else True:
            p, q = find(a), find(b)
            label[max(p, q)] = min(p, q)
    return [(d, t) for d, t in rows if find(d) == d]


def without_repeats(rows):
    first, out = {}, []
    for d, t in sorted(rows):
        b = t.encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], d)
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < d:
                gone[s : s + 50] = b"\1" * 50
        if not any(gone):
            out.append((d, t))
            continue
        parts = "".join(b[m.start() : m.end()].decode("utf-8", "ignore") for m in re.finditer(rb"\0+", bytes(gone)))
        if parts:
            out.append((d, parts))
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def clean(rows, items):
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[s : s + 8]) for s in range(max(1, len(w) - 7))} if w else set()
    sizes = {len(w) for w in windows}
    return [(d, t) for d, t in rows if not any(tuple(w[s : s + n]) in windows for w in [words(t)] for n in sizes for s in range(len(w) - n + 1))]


def crowd(n=2_000):
    """Copies of one text with up to 9 of its 140 words changed: very many pairs lie close to the threshold."""
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(3000)]
    base = rnd.choices(words, k=140)
    out = []
    for _ in range(n):
        copy = list(base)
        for i in rnd.sample(range(len(copy)), rnd.randint(0, 9)):
            copy[i] = rnd.choice(words)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("copies", [0, 2_000])
def test_pipeline_equals_its_plain_form(spark, tmp_path, copies):
    sf = str(tmp_path)
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    group = spark.createDataFrame([(10**6 + i, t, "en", "s", len(t)) for i, t in enumerate(crowd(copies))], "doc_id long, text string, lang string, source string, n_chars int")
    docs.unionByName(group.select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])).write.parquet(f"{sf}/documents.parquet")
    for table in ("labels", "benchmark"):
        read(spark, SF, table).write.parquet(f"{sf}/{table}.parquet")
    docs = read(spark, sf, "documents")
    grammar = toxicity.learn(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    rows = [(d, t) for d, t in rows if grammar.score(t) < corpus_pipeline.TOXIC]
    rows = clean(without_repeats(one_of_each(rows)), [r.text for r in read(spark, sf, "benchmark").collect()])
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    encoded = library.encode_batch([t for _, t in rows], add_special_tokens=False)
    expected = {d: e.ids for (d, _), e in zip(rows, encoded, strict=True)}
    found = corpus_pipeline.run(spark, sf).collect()
    assert len(found) == len(expected) and {r.doc_id: list(r.ids) for r in found} == expected
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in found)
