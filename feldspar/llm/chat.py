"""Chat formatting of reply trees.

Messages are nodes (conv_id, node, parent, role, text, score).  Self-joins that double their reach each round give
every leaf its root, its depth and the sum of its path's scores, so that a tree of any depth takes a logarithmic
number of rounds.  Branches are ranked by their mean score, then by length, then by leaf; the chosen paths are walked
back by the same doubled links, and each is formatted as one conversation.

The template marks a turn as ``### Role: text</turn>`` and a line end.  Inside a role or text a backslash, ``###`` and
``</turn>`` are written ``\\\\``, ``\\h`` and ``\\t``, so that no text can be taken for a control string, and reading
back is exact.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

_CONTROL = re.compile(r"\\|###|</turn>")
_WRITTEN = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ":": "\\c"}
_ESCAPED = re.compile(r"\\([\\htc])")
_READ = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":"}
#: Stands for a null conv_id within the joins.
NO_ID = -(1 << 63)
_TURN = re.compile(r"### (?P<role>[^:\\]*(?:\\.[^:\\]*)*): (?P<text>.*?)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _WRITTEN[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _READ[m[1]], text)


def _role(role: str) -> str:
    """A role as the template writes it: as a text, and a colon, which would end it, as ``\\c``."""
    return re.sub(r"\\|###|</turn>|:", lambda m: _WRITTEN[m[0]], role)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation of (role, text) turns, and the loss mask: the code point range of each assistant
    text."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {_role(role)}: ", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m["role"]), unescape(m["text"])) for m in _TURN.finditer(formatted)]


def reply_chain(messages: DataFrame) -> DataFrame:
    """(conv_id, node, parent, role, text, score) of rows (conv_id, turn, role, text) in which each turn replies to the
    one before it: by turn, null turns first, then role, then the text's hash.  Null roles and texts count as empty;
    rows without a conv_id are one conversation, whose id is null.  A conversation is ordered in one task."""
    rows = messages.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("_hash", F.xxhash64("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "_hash")
    node = F.row_number().over(w).cast("long")
    return rows.select("conv_id", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chosen_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(conv_id, branch, place, node) for the nodes of the ``keep`` best root-to-leaf paths of each conversation; branch
    counts from 1, place is the distance to the leaf.

    A parent that isn't there makes its child a root.  A node whose parents form a ring has no root and is on no path.
    Only the links are joined, never the texts, and every round is checkpointed.
    """
    links = cut(nodes.select("conv_id", "node", "parent", F.col("score").cast("double").alias("score")))
    known = links.select("conv_id", F.col("node").alias("parent"), F.col("node").alias("to"))
    jump = cut(
        links.join(known, ["conv_id", "parent"], "left").select("conv_id", "node", "to", F.lit(1).cast("long").alias("n"), F.coalesce("score", F.lit(0.0)).alias("sum"))
    )
    parents = links.where("parent is not null and parent <> node").select("conv_id", F.col("parent").alias("node"))
    leaves = links.select("conv_id", "node").join(parents, ["conv_id", "node"], "left_anti")
    # n nodes from ``node`` up to, not with, ``to``; ``to`` is null once the root is reached.
    hops, reach = [jump], jump
    most = links.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while (1 << (len(hops) - 1)) < most and not reach.where("to is not null").isEmpty():
        up = reach.select("conv_id", F.col("node").alias("to"), F.col("to").alias("t2"), F.col("n").alias("n2"), F.col("sum").alias("s2"))
        n, total = F.col("n") + F.coalesce("n2", F.lit(0)), F.col("sum") + F.coalesce("s2", F.lit(0.0))
        onward = reach.where("to is not null").join(up, ["conv_id", "to"]).select("conv_id", "node", F.col("t2").alias("to"), n.alias("n"), total.alias("sum"))
        reach = cut(onward.union(reach.where("to is null").select("conv_id", "node", "to", "n", "sum")))
        hops.append(reach)
    ends = reach.where("to is null").select("conv_id", "node", "n", (F.col("sum") / F.col("n")).alias("mean"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("mean"), F.desc("n"), "node")
    path = leaves.join(ends, ["conv_id", "node"]).withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= keep)
    path = cut(path.select("conv_id", "branch", F.lit(0).cast("long").alias("place"), "node"))
    for hop in reversed(hops):
        up = hop.where("to is not null").select("conv_id", "node", "to", "n")
        more = path.join(up, ["conv_id", "node"]).select("conv_id", "branch", (F.col("place") + F.col("n")).alias("place"), F.col("to").alias("node"))
        path = cut(path.union(more))
    return path


def format_conversations(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(conv_id, branch, formatted string, loss array<struct<start,end>>) for the chosen paths of each conversation.

    ``nodes`` has conv_id, node (unique in its conversation), parent, role, text and score; other columns are ignored.
    Null roles and texts are empty, null scores 0, null conv_ids one conversation.  Texts move once, to their
    conversation, where the chosen nodes meet them.  A conversation is one row of the result, so its texts, of whatever
    length, must fit in a task together.
    """
    nodes = nodes.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)))
    chosen = chosen_paths(nodes, keep).groupBy("conv_id").agg(F.collect_list(F.struct("node", "branch", "place")).alias("chosen"))
    said = nodes.select("conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = said.groupBy("conv_id").agg(F.collect_list(F.struct("node", "role", "text")).alias("turns"))

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            conv, branch, texts, masks = [], [], [], []
            for i in range(batch.num_rows):
                turns = {t["node"].as_py(): t for t in batch.column(1)[i]}
                paths: dict[int, list[tuple[int, int]]] = {}
                for c in batch.column(2)[i].as_py():
                    paths.setdefault(c["branch"], []).append((-c["place"], c["node"]))
                for b in sorted(paths):
                    text, mask = format_turns([(turns[n]["role"].as_py(), turns[n]["text"].as_py()) for _, n in sorted(paths[b])])
                    conv.append(batch.column(0)[i].as_py())
                    branch.append(b)
                    texts.append(text)
                    masks.append([{"start": s, "end": e} for s, e in mask])
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(branch, pa.int64()), pa.array(texts, pa.string()), pa.array(masks, kind)], names=["conv_id", "branch", "formatted", "loss"]
            )

    made = small_batches(whole).join(chosen, "conv_id").select("conv_id", "turns", "chosen")
    made = made.mapInArrow(run, "conv_id long, branch long, formatted string, loss array<struct<start: long, end: long>>")
    return made.withColumn("conv_id", F.nullif("conv_id", F.lit(NO_ID)))


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, read back from the output and its loss mask; one row for each of
    ``formatted``, repeated or not, whose columns are never null."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                turns = read_turns(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask.as_py())
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), _sha(said), len(loss), _sha(loss), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
