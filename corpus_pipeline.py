"""A training-corpus pipeline: toxicity, near copies, repeated passages, benchmark leaks, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.llm import bpe, decontaminate, simhash, suffix, toxicity
from feldspar.llm.common import read

VOCABULARY = "word_bpe_49k.json"
#: Score from which a document is rejected; benchmark items from which it is.
TOXIC, ITEMS = 0.7, 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below ``TOXIC``; a null text scores as an empty one.  The grammar is learnt
    from the labelled documents of ``sf_dir``, not from what a caller passes in."""
    grammar = toxicity.learn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.rejected(docs, grammar, TOXIC).where(~F.col("_rejected")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest doc_id."""
    return simhash.one_of_each(docs).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the 50-byte strings that a smaller doc_id has; a character that a cut divides goes whole.
    A document of which nothing is left goes, one that was empty before stays."""
    return suffix.without_repeats(docs).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item (``ITEMS`` items reject a document)."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), least_items=ITEMS).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document."""
    return bpe.encode(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix", cut_repeats),
    ("decontaminate", drop_leaks),
    ("bpe", tokenize),
]
#: SQL can't express the learnt grammar, the sketches or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
