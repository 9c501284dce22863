"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Each token has a sparse ternary index vector drawn from its hash.  Its word vector is its own index vector plus those
of its neighbours in the training texts, so tokens that are used alike have like vectors; any other token, new or seen in
one training text only, keeps its index vector alone.  Tokens are words, and what surrounds and repeats them:
case, marks before and after a word, and whether it repeats the word before.  A document is the mean of its tokens'
vectors.  The network (numpy, one hidden layer) is trained with Adam, and its temperature is set on rows kept aside.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, training_rows

#: Labelled rows learnt from, at most; size of the word vectors; index entries that aren't 0.
TRAINING_ROWS, SIZE, ENTRIES = 3_000, 64, 4
_HIDDEN, _STEPS, _KEPT_ASIDE = 24, 400, 5
_PARTS = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)
#: Words' tokens kept per worker; a full store is emptied, so results don't depend on it.
_STORE = 200_000


def tokens(word: str) -> tuple[str, ...]:
    """The tokens of a word that stands between white space: its letters in lower case, and its shape."""
    before, core, after = _PARTS.match(word).groups()
    if not core:
        return (f"={word[:4]}",)
    case = "A" if core.isupper() and len(core) > 1 else "Aa" if core[:1].isupper() else "a" if core.islower() else "0" if core.isdigit() else "?"
    return (core.lower(), f"={before[-3:]}{case}{after[:3]}")


#: Stands for a word that repeats the one before it.
AGAIN = ("=again",)


def index_entries(token: str) -> list[tuple[int, int]]:
    """(place, 0 for +1 or 1 for -1) of each entry of the token's index vector."""
    h = xxhash.xxh64_intdigest(token, 11)
    return [((h >> (7 * i)) % SIZE, 1 - (h >> (40 + i) & 1)) for i in range(ENTRIES)]


def index_vector(token: str) -> np.ndarray:
    v = np.zeros(SIZE, np.float32)
    for place, minus in index_entries(token):
        v[place] += 1 - 2 * minus
    return v


@dataclass
class Model:
    #: token -> row of ``vectors``
    rows: dict[str, int]
    vectors: np.ndarray
    weights: tuple[np.ndarray, ...]
    temperature: float
    _known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.rows, self.vectors, self.weights, self.temperature

    def __setstate__(self, state):
        self.rows, self.vectors, self.weights, self.temperature = state
        self._known = {}

    def pooled(self, text: str | None) -> np.ndarray:
        """Mean token vector, share of repeated words, and log length; zeros for a text without words."""
        return pool(text, self.rows, self.vectors, self._known)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        z = forward(np.stack([self.pooled(t) for t in texts]), self.weights)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pool(text: str | None, rows: dict[str, int], vectors: np.ndarray, known: dict) -> np.ndarray:
    words, ids, get, before, n = (text or "").split(), [], known.get, None, 0
    learnt = len(vectors)

    def places(found: tuple[str, ...]) -> tuple[int, tuple[int, ...]]:
        """How many tokens, and their rows; those without a vector have the entries of their index vectors instead,
        which follow the rows."""
        ids = []
        for t in found:
            ids += [rows[t]] if t in rows else [learnt + 2 * place + minus for place, minus in index_entries(t)]
        return len(found), tuple(ids)

    again = places(AGAIN)
    for w in words:
        if w == before:
            n += again[0]
            ids += again[1]
            continue
        before, i = w, get(w)
        if i is None:
            if len(known) >= _STORE:
                known.clear()
            i = known[w] = places(tokens(w))
        n += i[0]
        ids += i[1]
    out = np.zeros(SIZE + 2)
    if ids:
        counts = np.bincount(ids, minlength=learnt + 2 * SIZE)
        at, entries = np.flatnonzero(counts[:learnt]), counts[learnt:]
        out[:SIZE] = (counts[at] @ vectors[at] + entries[0::2] - entries[1::2]) / n
    if words:
        out[SIZE] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        out[SIZE + 1] = np.log1p(len(words)) / 10
    return out


def forward(x: np.ndarray, weights: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    center, scale, w1, b1, w2, b2 = weights
    hidden = np.tanh((x - center) / scale @ w1 + b1)
    return hidden, hidden @ w2 + b2


def word_vectors(texts: list[str], least: int = 2, window: int = 2) -> tuple[dict[str, int], np.ndarray]:
    """The tokens found in at least ``least`` of the texts, and their vectors."""
    split = [[t for a, w in zip(["", *words], words) for t in (AGAIN if a == w else tokens(w))] for words in map(str.split, texts)]
    seen: dict[str, int] = {}
    for s in split:
        for t in set(s):
            seen[t] = seen.get(t, 0) + 1
    chosen = sorted((t for t, n in seen.items() if n >= least), key=lambda t: (-seen[t], t))
    rows = {t: i for i, t in enumerate(chosen)}
    if not rows:
        return rows, np.zeros((0, SIZE), np.float32)
    own = np.stack([index_vector(t) for t in chosen])
    around = np.zeros_like(own)
    for s in split:
        ids = np.array([rows[t] for t in s if t in rows])
        for o in range(1, window + 1):
            if len(ids) > o:
                np.add.at(around, ids[:-o], own[ids[o:]])
                np.add.at(around, ids[o:], own[ids[:-o]])
    norm = np.linalg.norm(around, axis=1, keepdims=True)
    return rows, own + around / np.maximum(norm, 1e-6)


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> tuple[tuple[np.ndarray, ...], float]:
    """Weights of the network and its temperature; every fifth row is kept aside for the latter, and for an offset that the
    output bias takes, as a temperature alone would draw uneven labels' probabilities to a half."""
    rng = np.random.default_rng(seed)
    aside = np.arange(len(x)) % _KEPT_ASIDE == _KEPT_ASIDE - 1
    center, scale = x[~aside].mean(0), x[~aside].std(0) + 1e-3
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], _HIDDEN)), np.zeros(_HIDDEN), rng.normal(0, _HIDDEN**-0.5, _HIDDEN), np.zeros(1)]
    a, t = x[~aside], y[~aside]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    z0 = (a - center) / scale
    for step in range(1, _STEPS + 1):
        h, z = forward(a, (center, scale, *w))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) / len(t)
        back = np.outer(d, w[2]) * (1 - h * h)
        grads = [z0.T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            w[i] = w[i] - 0.02 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    weights = (center, scale, *w)
    if not aside.any():
        return weights, 1.0
    z, t = forward(x[aside], weights)[1], y[aside]
    choices, offset = np.exp(np.linspace(np.log(0.25), np.log(16), 121)), 0.0
    for _ in range(4):
        loss = [np.mean(np.logaddexp(0, -np.clip((2 * t - 1) * (z / c + offset), -50, 50))) for c in choices]
        temperature = float(choices[int(np.argmin(loss))])
        for _ in range(20):  # the offset that gives the rows' mean probability their share of labels
            p = 1 / (1 + np.exp(-np.clip(z / temperature + offset, -50, 50)))
            offset = float(np.clip(offset + (np.sum(t - p) - 0.1 * offset) / (np.sum(p * (1 - p)) + 0.1), -3, 3))
    w[3] = w[3] + offset * temperature
    return (center, scale, *w), temperature


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Model:
    """A model of at most ``bound`` labelled rows outside the evaluation fold, whose whole texts it is fitted on, on the
    driver.  Without labels of both kinds it scores every text 0.5."""
    rows = training_rows(docs, labels, "quality", bound).select("doc_id", "text", "label").toPandas()
    rows = rows.sort_values(["doc_id", "text"], na_position="first", kind="stable")
    texts, y = [t or "" for t in rows["text"]], (rows["label"].to_numpy() > 0).astype(float)
    index, vectors = word_vectors(texts)
    if len(set(y.tolist())) < 2:
        n = SIZE + 2
        return Model(index, vectors, (np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), np.zeros(1)), 1.0)
    known: dict = {}
    weights, temperature = train(np.stack([pool(t, index, vectors, known) for t in texts]), y)
    return Model(index, vectors, weights, temperature)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs``, scored on its whole text alone, of whatever length; null texts count as
    empty, rows are scored each on their own, repeated or not, and other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores([t.as_py() for t in batch.column(1)]), pa.float64())], names=["doc_id", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
