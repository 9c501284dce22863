"""Toxicity by a weighted finite-state pattern grammar.

A clause's words are read as a string of classes: insult (I), threat (H), target (T), negation (N), report (R), other
(O).  Five small transducers read that string side by side, and their composition is built once as one machine:

* insult: accepts a clause that has an insult word, which it emits;
* threat: accepts only with the target machine: a threat word is a match if somebody is threatened;
* target: whether someone is addressed or named in the clause, before or after the word;
* negation: emits a mark on words within its reach, the three words after a negation;
* report: emits a mark on all words after a verb of saying.

A clause that no path accepts gives nothing.  A path that does gives, for each insult or threat on it, the word's
lexical weight in the pattern that the path spells: (insult or threat, asserted, negated or reported, aimed or not).
Each pattern has an arc weight; these are fitted on labelled texts, starting from ``ARCS``, where an insult that is
negated or only reported counts for next to nothing and one that is aimed at someone counts for more.

Targets, negations, reporting verbs and threats are short fixed lists.  Insults are learnt: the words and stems that
stand in toxic training texts, in varied contexts, and next to never in others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, training_rows

#: Labelled rows learnt from, at most.
TRAINING_ROWS = 20_000
#: A stem is kept if its share of toxic training texts is this many times its share of the others.
ODDS = 20.0
_PREFIXES = range(4, 8)

# The closed classes of the grammar.
TARGETS = "you your yours yourself he she they him her them du dich dir dein ihr euch sie er tu toi ton vous votre il elle ils usted tú te ti vosotros ustedes él ella ellos"
NEGATIONS = "not no never neither nor isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún tampoco"
REPORTS = "said says saying wrote writes quoted quote claimed reported called sagte sagt schrieb dit disait écrit dijo dice escribió"
THREATS = "kill hurt destroy beat shoot stab burn murder"
SEEDS = "idiot idiots moron morons imbecile"

#: A word is its letters; what is elided before an apostrophe is a word of its own, but for the t of isn't.
_WORD = re.compile(r"[^\W\d_]+(?:['’]t(?![^\W\d_]))?")
_CLAUSE_END = re.compile(r"[.!?;\n]")
I, H, T, N, R, O = range(6)
#: What a path says of a word: its mood, and for the clause whether it is aimed.
ASSERTED, NEGATED, REPORTED = range(3)
_NEGATED_MARK, _REPORTED_MARK = 1, 2


class Machine(NamedTuple):
    """A transducer over the six classes: ``arcs`` (state, class) -> (state, marks emitted), others keep the state and emit
    nothing; state 0 starts; ``final`` are the states whose clauses it accepts."""

    arcs: dict[tuple[int, int], tuple[int, int]]
    final: frozenset[int]

    def size(self) -> int:
        return 1 + max(s for (a, _), (b, _) in self.arcs.items() for s in (a, b))


_REACH = 3
INSULT = Machine({(0, I): (1, 0)}, frozenset({1}))
THREAT = Machine({(0, H): (1, 0)}, frozenset({1}))
TARGET = Machine({(0, T): (1, 0)}, frozenset({1}))
NEGATION = Machine(
    {(s, N): (_REACH, 0) for s in range(_REACH + 1)} | {(s, c): (s - 1, _NEGATED_MARK if c in (I, H) else 0) for s in range(1, _REACH + 1) for c in (I, H, T, R, O)},
    frozenset(range(_REACH + 1)),
)
REPORT = Machine({(0, R): (1, 0)} | {(1, c): (1, _REPORTED_MARK) for c in (I, H)}, frozenset({0, 1}))


class Composed(NamedTuple):
    """All machines at once: tables [state][class] of the next state and of the marks, and for each state whether the
    insult, threat and target machines accept there."""

    step: list[list[int]]
    marks: list[list[int]]
    accepts: list[tuple[bool, ...]]


def compose(*machines: Machine) -> Composed:
    states = list(product(*(range(m.size()) for m in machines)))
    number = {s: n for n, s in enumerate(states)}
    step, marks = [], []
    for s in states:
        moves = [[m.arcs.get((at, c), (at, 0)) for m, at in zip(machines, s, strict=True)] for c in range(6)]
        step.append([number[tuple(to for to, _ in row)] for row in moves])
        marks.append([sum({mark for _, mark in row}) for row in moves])
    return Composed(step, marks, [tuple(at in m.final for m, at in zip(machines, s, strict=True)) for s in states])


GRAMMAR = compose(INSULT, THREAT, TARGET, NEGATION, REPORT)
_CLOSED = {w: c for c, words in ((T, TARGETS), (N, NEGATIONS), (R, REPORTS)) for w in words.split()}

#: The patterns: (class, mood, aimed).  A threat is a match only if it is aimed.
PATTERNS = [(I, mood, aimed) for aimed in (False, True) for mood in (ASSERTED, NEGATED, REPORTED)] + [(H, mood, True) for mood in (ASSERTED, NEGATED, REPORTED)]
#: Arc weights that fitting starts from, in the order of ``PATTERNS``, after the intercept.
ARCS = (-2.5, 2.0, 0.1, 0.3, 2.5, 0.1, 0.3, 2.5, 0.1, 0.3)
_PATTERN = {p: n for n, p in enumerate(PATTERNS)}


def clause_patterns(classes: list[int], machine: Composed = GRAMMAR) -> list[tuple[int, int]]:
    """(place, pattern) of each insult or threat on the path of a clause; none if no path accepts it."""
    state, read = 0, []
    for place, c in enumerate(classes):
        if c in (I, H):
            marks = machine.marks[state][c]
            read.append((place, c, REPORTED if marks & _REPORTED_MARK else NEGATED if marks & _NEGATED_MARK else ASSERTED))
        state = machine.step[state][c]
    insulting, threatening, aimed = machine.accepts[state][:3]
    accepted = {I: insulting, H: threatening and aimed}
    return [(place, _PATTERN[c, mood, aimed]) for place, c, mood in read if accepted[c]]


def _lower(text: str) -> str:
    """``text`` in lower case, place by place: a letter whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Match(NamedTuple):
    """An accepted clause: its places in the text, and (pattern, lexical weight) of its insults and threats."""

    start: int
    end: int
    words: tuple[tuple[int, float], ...]


@dataclass
class Grammar:
    #: stem -> (weight, whole word only)
    stems: dict[str, tuple[float, bool]]
    #: intercept, then the arc weight of each pattern
    arcs: tuple[float, ...] = ARCS
    _spotter: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.stems, self.arcs

    def __setstate__(self, state):
        (self.stems, self.arcs), self._spotter = state, None

    def _spot(self) -> ahocorasick.Automaton:
        if self._spotter is None:
            self._spotter = ahocorasick.Automaton()
            for s, (w, whole) in self.stems.items():
                self._spotter.add_word(s, (len(s), w, whole, I))
            for s in THREATS.split():
                self._spotter.add_word(s, (len(s), 2.0, True, H))
            self._spotter.make_automaton()
        return self._spotter

    def matches(self, text: str) -> list[Match]:
        """The accepted clauses of a text.  Each clause is read once, however long it is."""
        low = _lower(text or "")
        hits: dict[int, tuple[float, int]] = {}
        for end, (n, w, whole, c) in self._spot().iter(low):
            at = end - n + 1
            if (at and low[at - 1].isalpha()) or (whole and end + 1 < len(low) and low[end + 1].isalpha()):
                continue
            if at not in hits or w > hits[at][0]:
                hits[at] = (w, c)
        out, upto = [], 0
        for at in sorted(hits):
            if at < upto:
                continue
            start, stop = max(upto, *(low.rfind(mark, upto, at) + 1 for mark in ".!?;\n")), _CLAUSE_END.search(low, at)
            upto = stop.start() if stop else len(low)
            classes, weights = [], []
            for m in _WORD.finditer(low, start, upto):
                w, c = hits.get(m.start(), (0.0, None))
                classes.append(_CLOSED.get(m[0].replace("’", "'"), O) if c is None else c)
                weights.append(w)
            if found := clause_patterns(classes):
                out.append(Match(start, upto, tuple((pattern, weights[place]) for place, pattern in found)))
        return out

    def features(self, found: list[Match]) -> list[float]:
        """For each pattern log1p of the lexical weight that its matches have together."""
        sums = [0.0] * len(PATTERNS)
        for match in found:
            for pattern, w in match.words:
                sums[pattern] += w
        return [math.log1p(s) for s in sums]

    def probability(self, found: list[Match]) -> float:
        z = self.arcs[0] + sum(a * x for a, x in zip(self.arcs[1:], self.features(found), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str) -> float:
        return self.probability(self.matches(text))


def stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, whole, toxic, clean, contexts) over rows (text, label): in how many texts of each label a stem stands, and
    a 64-bit sketch of the words before it in toxic texts."""

    def run(batches):
        for batch in batches:
            toxic, clean, contexts = Counter(), Counter(), {}
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                words = _WORD.findall((text.as_py() or "").lower())
                found: dict[tuple[str, bool], int] = {}
                for before, word in zip(["", *words], words):
                    bit = 1 << (xxhash.xxh32_intdigest(before) & 63) if label.as_py() else 0
                    found[word, True] = found.get((word, True), 0) | bit
                    for n in _PREFIXES:
                        if len(word) < n:
                            break
                        found[word[:n], False] = found.get((word[:n], False), 0) | bit
                if label.as_py():
                    toxic.update(found.keys())
                    for k, bits in found.items():
                        contexts[k] = contexts.get(k, 0) | bits
                else:
                    clean.update(found.keys())
            keys = list(toxic.keys() | clean.keys())
            signed = np.array([contexts.get(k, 0) for k in keys], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.bool_()),
                    pa.array([toxic[k] for k in keys], pa.int64()),
                    pa.array([clean[k] for k in keys], pa.int64()),
                    pa.array(signed),
                ],
                names=["stem", "whole", "toxic", "clean", "contexts"],
            )

    counted = small_batches(rows).select("text", "label").mapInArrow(run, "stem string, whole boolean, toxic long, clean long, contexts long")
    return counted.groupBy("stem", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("contexts").alias("contexts"))


def choose_stems(found: list[tuple[str, bool, int, float]]) -> dict[str, tuple[float, bool]]:
    """The shortest stems that cover the others of (stem, whole word, toxic texts, odds), each made as long, or a whole
    word, as 95 % of its toxic texts allow, so that a stem takes in no more words than it was learnt from."""
    stems: dict[str, tuple[float, bool]] = {}
    covered: set[str] = set()
    for stem, whole, toxic, odds in sorted(found, key=lambda r: (len(r[0]), r[1], r[0])):
        if any(stem[:n] in covered for n in range(1, len(stem) + 1)):
            continue
        if not whole:
            covered.add(stem)
            alike = [(w, len(s), s, o) for s, w, n, o in found if s.startswith(stem) and n >= 0.95 * toxic]
            whole, _, stem, odds = max(alike)
        stems[stem] = (round(math.log(odds), 3), whole)
    return stems


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Grammar:
    """A grammar learnt from at most ``bound`` labelled rows outside the evaluation fold.  Without labels of both
    kinds it is the grammar of the fixed words."""
    seeds = {s: (2.0, True) for s in SEEDS.split()}
    rows = training_rows(docs, labels, "toxic", bound)
    sizes = {r["label"]: r["n"] for r in rows.groupBy(F.col("label") > 0).agg(F.count("*").alias("n")).withColumnRenamed("(label > 0)", "label").collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Grammar(seeds)
    rows = rows.select("text", (F.col("label") > 0).alias("label"))
    odds = ((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) / ((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))
    least = max(3, round(0.004 * n_toxic))
    kept = stem_counts(rows).withColumn("odds", odds).where((F.col("toxic") >= least) & (F.bit_count("contexts") >= min(12, least)) & (F.col("odds") >= ODDS)).collect()
    grammar = Grammar(seeds | choose_stems([(r["stem"], r["whole"], r["toxic"], r["odds"]) for r in kept]))

    def run(batches):
        for batch in batches:
            found = [grammar.features(grammar.matches(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    # As many short rows as there are training rows, each of them counted once for each like it.
    points = rows.select("text", "label").mapInArrow(run, "x array<double>, label boolean")
    counted = points.groupBy(F.transform("x", lambda v: F.round(v, 2)).alias("x"), "label").agg(F.count("*").alias("n")).collect()
    grammar.arcs = fit(np.array([(1.0, *r["x"]) for r in counted]), np.array([r["label"] for r in counted], float), np.array([r["n"] for r in counted], float))
    return grammar


#: How strongly arc weights are held at those they start from: asserted patterns, and the others.
_HOLD = (0.5, 5.0)


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, start: tuple[float, ...] = ARCS) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps.  Weights are drawn to ``start``, the intercept hardly; none falls
    below zero, so that no match ever speaks for a text."""
    order = np.lexsort(x.T)
    x, y, n, first = x[order], y[order], n[order], np.array(start)
    hold, b = np.array([0.01] + [_HOLD[mood != ASSERTED] for _, mood, _ in PATTERNS]), np.array(start)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        move = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (n * (y - p)) - hold * (b - first))
        b = b + np.clip(move, -1, 1)
        b[1:] = np.maximum(b[1:], 0)
    return tuple(np.round(b, 6).tolist())


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """One row (doc_id, score, clauses array<struct<start,end,words array<struct<pattern,weight>>>>) for each row of
    ``docs``; start and end are places in the text, pattern an index into ``PATTERNS``.  A null text is empty and scores
    as a text without matches; a text of any length is read whole.  Rows are scored each on their own, repeated or
    not; other columns are ignored."""

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.list_(pa.struct([("pattern", pa.int32()), ("weight", pa.float64())])))]))
        for batch in batches:
            found = [grammar.matches(t.as_py() or "") for t in batch.column(1)]
            scores = pa.array([grammar.probability(f) for f in found], pa.float64())
            clauses = [[{"start": m.start, "end": m.end, "words": [{"pattern": p, "weight": w} for p, w in m.words]} for m in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, pa.array(clauses, kind)], names=["doc_id", "score", "clauses"])

    kind = "doc_id long, score double, clauses array<struct<start: long, end: long, words: array<struct<pattern: int, weight: double>>>>"
    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def rejected(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """``docs`` with a column ``_rejected``: whether the text's score reaches ``threshold``."""

    def toxic(texts: pa.Array) -> pa.Array:
        return pa.array([grammar.score(t.as_py() or "") >= threshold for t in texts], pa.bool_())

    toxic = F.arrow_udf(toxic, "boolean").asNondeterministic()  # once a row: no filter copies it

    return small_batches(docs).withColumn("_rejected", toxic(F.col("text")))
