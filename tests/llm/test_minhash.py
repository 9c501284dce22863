import hashlib
import random

import numpy as np
import xxhash
from helpers import AWKWARD, documents

from feldspar.llm import minhash
from feldspar.llm.words import shingles


def jaccard(a, b):
    x, y = ({j[s:e] for s, e in p} for j, p in (shingles(a, 5), shingles(b, 5)))
    return len(x & y) / len(x | y) if x or y else 1.0


def test_likeness_estimates_jaccard():
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choices("abcdefg", k=5)) for _ in range(800)]
    pairs = []
    for n in (6, 12, 60, 300, 2000):
        for _ in range(30):
            w = rnd.choices(vocabulary, k=n)
            cut = rnd.randint(0, n)
            pairs.append((" ".join(w), " ".join(w[:cut] + rnd.choices(vocabulary, k=n - cut))))
    a, b = (minhash.signatures([p[i] for p in pairs]) for i in (0, 1))
    error = minhash.likeness(a, b) - np.array([jaccard(*p) for p in pairs])
    assert abs(error.mean()) < 0.02 and error.std() < 0.06


def test_equal_texts_and_texts_without_words():
    texts = ["", None, " \n", "one", "one", "a b c d e f g"]
    p = minhash.signatures(texts)
    assert (p[3] == p[4]).all() and not p[:3].any()
    assert minhash.likeness(p[[0, 0, 3, 3]], p[[1, 3, 4, 5]]).tolist()[:3] == [1.0, 0.0, 1.0]
    assert (minhash.signatures(texts * 200)[1195] == p[1]).all()  # batches don't matter


def test_densification_fills_alike():
    rng = np.random.default_rng(0)
    bins = np.full((4, minhash.BINS), minhash._EMPTY)
    bins[0, 5] = 7
    bins[1, [3, 400]] = 1, 2
    bins[2] = rng.integers(0, 2**63, minhash.BINS)
    filled = minhash.densify(bins)
    assert (filled[0] == 7).all() and set(filled[1].tolist()) == {1, 2} and 100 < (filled[1] == 1).sum() < 412
    assert (filled[2] == bins[2]).all() and (filled[3] == minhash._EMPTY).all()


def plain(text):
    """The fingerprint's low bits, bin by bin, with nothing of the module but its constants."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return [0] * minhash.BINS
    grams = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    least = {}
    for g in grams:
        h = xxhash.xxh3_64_intdigest(g)
        least[h >> 55] = min(h, least.get(h >> 55, h))
    out = []
    for i in range(minhash.BINS):
        draws = sorted(range(minhash.BINS), key=lambda j: xxhash.xxh64_intdigest(f"{i}:{j}", 7))
        value = least[i] if i in least else least[next(j for j in draws if j in least)]
        mixed = (value + i * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 % 2**64
        out.append((mixed ^ mixed >> 32) & 15)
    return out


def test_fingerprints_equal_a_plain_form():
    rnd = random.Random(2)
    texts = [None, "", "one", "A b\tC é 漢字 ß", "x " * 3000, " ".join(rnd.choices(["ab", "CD", "é"], k=40)), " ".join(str(rnd.randrange(10**6)) for _ in range(4000))]
    for text, packed in zip(texts, minhash.signatures(texts), strict=True):
        assert [b for byte in packed.tolist() for b in (byte >> 4, byte & 15)] == plain(text)


def test_a_very_long_text_is_read_whole(spark):
    long = " ".join(map(str, range(400_000)))
    rows = minhash.compare_edited(documents(spark, [long, long[: len(long) // 2], "x"], [3, 2, 1])).collect()
    by = {r.doc_id: r for r in rows}
    assert by[3].n_chars == len(long) and 0.3 < by[3].near_next < 0.7 and by[3].near_edited > 0.4
    assert bytes(by[3].fingerprint) == minhash.signatures([long], block=1 << 10)[0].tobytes()


def test_parts_fill_their_partitions(spark):
    spread = minhash.with_next(documents(spark, [str(i) for i in range(4000)])).groupBy(minhash.F.spark_partition_id().alias("p")).count().collect()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(spread) == n and max(r["count"] for r in spread) < 2 * 4000 / n


def check_edited(spark, texts, ids, **options):
    found = minhash.compare_edited(documents(spark, texts, ids), **options).collect()
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (-(2**63) if r[0] is None else r[0], ), reverse=True)
    rows = sorted(rows, key=lambda r: (2**63 if r[0] is None else -r[0], r[1] or ""))
    expected = []
    for i, (d, t) in enumerate(rows):
        t, f = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + f[:k]
        own, other, follow = (minhash.signatures([x]) for x in (t, e, f))
        expected.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), own.tobytes(), other.tobytes(), minhash.likeness(own, other)[0], minhash.likeness(own, follow)[0]))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, bytes(r.fingerprint), bytes(r.edited_fingerprint), r.near_edited, r.near_next) for r in found]
    assert sorted(got) == sorted(expected)


def test_edited_texts(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(["ab", "cd é", "漢字", "xyz"], k=rnd.randint(0, 60))) for _ in range(90)] + AWKWARD
    ids = rnd.sample(range(-500, 5000), len(texts) - 3) + [None, 5001, 5001]
    check_edited(spark, texts, ids, chunk_chars=300)
    check_edited(spark, texts[:4], [9, 2, 7, 7])
    check_edited(spark, ["only one row of text here"], [4])
    check_edited(spark, [None, "a b c d e f g h"], [None, None])
    assert minhash.compare_edited(documents(spark, [])).collect() == []


def test_fingerprint_rows(spark):
    rows = minhash.fingerprint(documents(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD) and rows[5].fingerprint == rows[6].fingerprint and len(rows[5].fingerprint) == 256
