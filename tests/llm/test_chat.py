import itertools
import random

from feldspar.llm import chat

SCHEMA = "conv_id long, node long, parent long, role string, text string, score double, turns int, n int"
HOSTILE = ["\\### Assistant: </turn> ok", "###", "####\\", "</turn>\n### user: x", "\\h\\t\\\\", "", "a: b", "</turn", "\\"]


def nodes(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def brute(rows, keep):
    """The best paths of each conversation by walking every leaf up."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == conv}
        inner = {r[2] for r in own.values() if r[2] is not None and r[2] != r[1]}
        paths = []
        for leaf in set(own) - inner:
            path, seen, at = [], set(), leaf
            while at in own and at not in seen:
                seen.add(at)
                path.append(at)
                at = own[at][2]
            if at not in seen:
                score = sum(own[n][5] or 0.0 for n in path)
                paths.append((-score / len(path), -len(path), leaf, path[::-1]))
        for b, p in enumerate(sorted(paths)[:keep]):
            out[conv, b + 1] = [(own[n][3] or "", own[n][4] or "") for n in p[3]]
    return out


def test_reply_trees(spark):
    rnd = random.Random(6)
    rows = []
    for conv in range(12):
        for n in range(rnd.randint(1, 40)):
            rows.append((conv, n, rnd.randrange(n) if n and rnd.random() < 0.95 else rnd.choice([None, 999]), rnd.choice(["user", "assistant", None]), rnd.choice([*HOSTILE, None, "plain"]), rnd.choice([None, 0.5, 1.0, 2.0])))
    rows += [(50, n, n - 1 if n else None, "user", str(n), 1.0) for n in range(300)]  # a long chain
    rows += [(51, 1, 2, "user", "ring", 1.0), (51, 2, 1, "user", "ring", 1.0), (51, 3, None, "user", "alone", 1.0)]
    for keep in (1, 3):
        found = chat.format_conversations(nodes(spark, rows), keep).collect()
        assert {(r.conv_id, r.branch): chat.read_turns(r.formatted) for r in found} == brute(rows, keep)
        for r in found:
            loss = [chat.unescape(r.formatted[m.start : m.end]) for m in r.loss]
            assert loss == [t for role, t in chat.read_turns(r.formatted) if role == "assistant"]


def test_escapes_are_reversible_and_hide_controls():
    alphabet = ["\\", "#", "</turn>", "h", "t", "c", "\n", ": ", "x"]
    for n in range(5):
        for parts in itertools.product(alphabet, repeat=n):
            text = "".join(parts)
            written = chat.escape(text)
            assert chat.unescape(written) == text and "###" not in written and "</turn>" not in written
    turns = [(role, text) for role in ("user", "assistant", "a: b", "", "x\\", "###") for text in HOSTILE]
    assert chat.read_turns(chat.format_turns(turns)[0]) == turns


def test_chains_of_awkward_rows(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "system", "a"), (1, 2, "user", "b"), (1, None, None, None), (None, 1, "assistant", "x"), (None, 0, "user", None), (2, 0, "assistant", "")]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: chat.read_turns(r.formatted) for r in chat.format_conversations(chat.reply_chain(said)).collect()}
    assert found == {1: [("", ""), ("system", "a"), ("user", "b"), ("user", "b")], None: [("user", ""), ("assistant", "x")], 2: [("assistant", "")]}
    digests = {r.conv_id: r for r in chat.digest(chat.format_conversations(chat.reply_chain(said))).collect()}
    assert digests[1].n_turns == 4 and digests[None].loss_chars == 1 and digests[2].loss_chars == 0
    none = said.where("false")
    assert chat.format_conversations(chat.reply_chain(none)).collect() == []


def test_long_conversations_and_texts(spark):
    long = "\\### x</turn>" * 100_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i} \\###") for i in range(3_000)] + [(2, 0, "user", long), (2, 1, "assistant", long)]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.format_conversations(chat.reply_chain(said)).collect()}
    assert chat.read_turns(found[1].formatted) == [(role, text) for conv, _, role, text in rows if conv == 1]
    assert chat.read_turns(found[2].formatted) == [("user", long), ("assistant", long)]
    (mask,) = found[2].loss
    assert chat.unescape(found[2].formatted[mask.start : mask.end]) == long
