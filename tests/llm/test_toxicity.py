import random
import time

import pytest
from helpers import AWKWARD, documents

from feldspar.llm import common, queries, toxicity


def labelled(spark, n=600, seed=3):
    """Texts of random words; toxic ones have insults of two stems, some copied many times."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefghilmnorst", k=rnd.randint(2, 8))) for _ in range(1500)]
    rows = []
    for i in range(n):
        words, toxic = rnd.choices(vocabulary, k=rnd.randint(10, 120)), i % 5 == 0
        for _ in range(rnd.randint(2, 6) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["zorple", "quibnast" + rnd.choice(["er", "ig", "ou"])]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows + [(n + i, rows[5][1], 1) for i in range(40)]


@pytest.fixture(scope="module")
def learnt(spark):
    rows = labelled(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    return rows, toxicity.learn(docs, labels)


def test_held_out_rows_are_told_apart(learnt):
    rows, grammar = learnt
    assert any(s.startswith("zorp") for s in grammar.stems) and any(s.startswith("quib") for s in grammar.stems)
    assert len(grammar.stems) < 20  # the copies' other words aren't insults
    out = [(grammar.score(t) >= 0.7, bool(y)) for i, t, y in rows if common.is_held_out(i)]
    assert len(out) > 100 and sum(a == b for a, b in out) >= 0.97 * len(out)


G = toxicity.Grammar({"moron": (3.0, True), "vequ": (3.0, False), "idiot": (3.0, True)}, (-3.0, *toxicity.ARCS[1:]))


def moods(text):
    return [toxicity.PATTERNS[p] for m in G.matches(text) for p, _ in m.words]


def test_patterns():
    I, H = toxicity.I, toxicity.H
    A, N, R = toxicity.ASSERTED, toxicity.NEGATED, toxicity.REPORTED
    for text, expected in {
        "a moron": [(I, A, False)],
        "you moron": [(I, A, True)],
        "what a moron you are": [(I, A, True)],  # the target may follow
        "you. moron": [(I, A, False)],  # but not in another clause
        "you are not a moron": [(I, N, True)],
        "never a moron": [(I, N, False)],
        "not in the least what I would call a moron": [(I, A, False)],  # out of reach
        "he said: moron": [(I, R, True)],
        "she wrote that he isn't a moron": [(I, R, True)],
        "it isn’t a moron": [(I, N, False)],
        "ce n'est pas l'idiot": [(I, N, False)],
        "d'idiot, l’idiot et toi": [(I, A, True), (I, A, True)],
        "Moron. Vequtier, vequx": [(I, A, False)] * 3,
        "I kill time": [],  # nobody is threatened: no path accepts the clause
        "I will kill you": [(H, A, True)],
        "I will never kill you": [(H, N, True)],
        "he said that they kill them": [(H, R, True)],
        "oxymoron moronic xvequ": [],
    }.items():
        assert moods(text) == expected, text
    assert len(G.matches("Moron. Vequtier, vequx")) == 2


def test_negation_report_and_target_turn_verdicts():
    for plain, turned in (("moron, moron, vequx", "not a moron, never a moron, no vequx"), ("a moron and a vequx, moron", "it said: a moron and a vequx, moron")):
        assert G.score(plain) >= 0.7 > 0.3 > G.score(turned)
    assert G.score("you moron") > G.score("moron") > G.score("he said moron") > 0
    assert G.score("I will kill you, hurt you, burn you") >= 0.7 > 0.3 > G.score("I will kill time, hurt nobody, burn wood")


def test_the_composed_machine_equals_the_five_side_by_side():
    machines = (toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT)
    rnd = random.Random(1)
    for _ in range(3000):
        classes = [rnd.choice(range(6)) for _ in range(rnd.randint(0, 9))]
        states, at, read = [0] * 5, 0, []
        for c in classes:
            moves = [m.arcs.get((s, c), (s, 0)) for m, s in zip(machines, states, strict=True)]
            assert toxicity.GRAMMAR.marks[at][c] == sum({mark for _, mark in moves})
            states, at = [to for to, _ in moves], toxicity.GRAMMAR.step[at][c]
        assert toxicity.GRAMMAR.accepts[at] == tuple(s in m.final for m, s in zip(machines, states, strict=True))
        # And by the meaning of the patterns.
        for place, c in enumerate(classes):
            before = classes[:place]
            mood = toxicity.REPORTED if toxicity.R in before else toxicity.NEGATED if toxicity.N in before[-3:] else toxicity.ASSERTED
            aimed = toxicity.T in classes
            if c == toxicity.I or (c == toxicity.H and aimed):
                read.append((place, toxicity.PATTERNS.index((c, mood, aimed))))
        assert toxicity.clause_patterns(classes) == read


def test_arc_weights_are_learnt(spark):
    """Insults that are negated or reported stand in clean texts: the grammar tells them apart, the words alone can't."""
    rows = [list(r) for r in labelled(spark)]
    rnd = random.Random(2)
    for i, r in enumerate(rows):
        if not r[2] and i % 32 == 1:
            insult = rnd.choice(["zorple", "quibnaster"])
            r[1] += rnd.choice([". not a %s", ". he said %s", ". never the %s %s"]).replace("%s", insult)
    docs = spark.createDataFrame([tuple(r[:2]) for r in rows], "doc_id long, text string")
    grammar = toxicity.learn(docs, spark.createDataFrame([(i, None, t) for i, _, t in rows], "doc_id long, quality int, toxic int"))
    neutral = {p: grammar.arcs[1 + toxicity.PATTERNS.index((p[0], toxicity.ASSERTED, p[2]))] for p in toxicity.PATTERNS}
    words = toxicity.Grammar(grammar.stems, (grammar.arcs[0], *(neutral[p] for p in toxicity.PATTERNS)))
    wrong = [sum((g.score(t) >= 0.7) != bool(y) for _, t, y in rows) for g in (grammar, words)]
    assert wrong[0] == 0 and wrong[1] >= 5
    assert grammar.arcs != toxicity.ARCS


def test_long_texts_and_places():
    text = "a word " * 200_000 + "moron " * 20_000 + "word, " * 100_000
    began = time.time()
    assert len(G.matches(text)) == 1 and len(G.matches("moron. " * 50_000)) == 50_000
    assert time.time() - began < 10
    upper = "İİİ you MORON"
    (match,) = G.matches(upper)
    assert upper[match.start : match.end] == upper and toxicity._lower(upper).endswith(" you moron")


def test_composition_runs_all_machines():
    a, b = toxicity.Machine({(0, 0): (1, 1)}, frozenset({1})), toxicity.Machine({(0, 0): (1, 2), (1, 0): (0, 0)}, frozenset({0}))
    both = toxicity.compose(a, b)
    assert len(both.step) == 4 and both.marks[0][0] == 3 and both.marks[0][1] == 0
    assert both.accepts[both.step[0][0]] == (True, False) and both.accepts[both.step[both.step[0][0]][0]] == (True, True)


def test_rows_and_labels_that_are_missing(spark):
    docs = documents(spark, [*AWKWARD, "you idiot"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")):
        rows = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
        assert len(rows) == len(AWKWARD) + 1 and all(0 <= r.score <= 1 for r in rows.values())
        assert rows[9].score > rows[0].score == rows[1].score and len(rows[9].clauses) == 1
    assert toxicity.score(documents(spark, []), toxicity.Grammar({})).collect() == []
    flagged = toxicity.rejected(docs, toxicity.Grammar({"idiot": (9.0, True)}, (-3.0, *toxicity.ARCS[1:])))
    assert [r.doc_id for r in flagged.where("_rejected").collect()] == [9]


def test_stems_take_in_no_more_than_they_were_learnt_from():
    found = [("path", False, 100, 50.0), ("pathe", False, 100, 60.0), ("pathetic", True, 98, 60.0), ("vequ", False, 100, 50.0), ("vequa", False, 40, 50.0), ("bad", True, 9, 30.0)]
    stems = toxicity.choose_stems(found)
    assert set(stems) == {"pathetic", "vequ", "bad"} and stems["pathetic"][1] and not stems["vequ"][1]


def test_held_out_rows_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_toxicity(spark, sf).join(common.read(spark, sf, "labels"), "doc_id").where("held_out and toxic is not null").collect()
    right = [r.predicted == r.toxic for r in rows]
    assert len(rows) > 100 and sum(right) >= 0.95 * len(right)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.7 * sum(r.toxic for r in rows)
