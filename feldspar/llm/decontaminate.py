"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of ``window`` consecutive words (an item of fewer words is one window).  A document
contains a window only if it contains all of its words, so the prefix that must be joined is one word long; taking the
window's rarest word by document frequency over the whole corpus makes the fewest candidates.  The words of all
documents meet those prefix words in one join; a candidate passes the length and positional bounds (the window
must fit between the document's ends) and is then verified on the words themselves.

The windows are broadcast if their bytes, measured, fit.  Otherwise the documents' words are shuffled to them, each
with the words around it that a window could cover, after those that are no prefix word are left out, by a broadcast
of the prefix words alone where these fit.  Either way the documents are read as often as for a small benchmark.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_if_small, cut, size_bytes

WINDOW = 8
#: Bytes of windows, or of their prefix words, up to which they are broadcast.
LIMIT = BROADCAST_BYTES
#: What is no word: ASCII besides digits and letters.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BREAK), "")


def fold(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window) for each distinct window of an item; window is its folded words, joined by spaces."""
    rows = items.select("item_id", words(fold(F.col("text"))).alias("w")).where(F.size("w") > 0)
    many = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    return rows.select("item_id", F.explode(F.transform(many, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("window")).distinct()


def rarity(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, n): how many rows of ``docs`` have each word of ``wanted`` (column word, lower case)."""
    found = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word")).select(F.lower("word").alias("word"))
    return found.join(broadcast_if_small(wanted, limit=LIMIT), "word").groupBy("word").agg(F.count("*").alias("n"))


def prefixes(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, n_window, word, place): each distinct window with its rarest word.  Windows with a word that no
    document has are left out, as none can contain them."""
    distinct = windows(items, size).select("window").distinct()
    each = cut(distinct.select("window", F.posexplode(F.split("window", " ")).alias("place", "word")).withColumn("word", F.lower("word")))
    counted = rarity(docs, cut(each.select("word").distinct()))
    ranked = each.join(counted, "word", "left").groupBy("window").agg(
        F.count("*").cast("int").alias("n_window"),
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("rarest"),
    )
    return ranked.where("rarest.n > 0").select("window", "n_window", "rarest.word", "rarest.place")


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, start, n_window, window): each place where a window occurs in a document, word ``start`` on."""
    wanted = cut(prefixes(docs, items, size))
    hashed = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    rows = docs.select("doc_id", hashed, words(F.col("text")).alias("w")).select("doc_id", "text_hash", "w", F.posexplode("w").alias("at", "raw"))
    start = F.col("at") - F.col("place")
    fits = (start >= 0) & (start + F.col("n_window") <= F.col("n_words"))
    if size_bytes(wanted) <= LIMIT:
        met = rows.withColumn("n_words", F.size("w")).join(F.broadcast(wanted), F.lower("raw") == F.col("word"))
        first = start + 1
    else:
        only = cut(wanted.select(F.col("word").alias("_word")).distinct())
        rows = rows.join(broadcast_if_small(only, limit=LIMIT), F.lower("raw") == F.col("_word"), "left_semi")
        left = F.least(F.col("at"), F.lit(size - 1))
        around = rows.select("doc_id", "text_hash", "at", F.size("w").alias("n_words"), left.alias("left"), F.lower("raw").alias("key"), F.slice("w", F.col("at") - left + 1, F.lit(2 * size - 1)).alias("w"))
        met = around.join(wanted, F.col("key") == F.col("word"))
        first = F.col("left") - F.col("place") + 1
    met = met.where(fits)
    met = met.where(fold(F.array_join(F.slice("w", first, F.col("n_window")), " ")) == F.col("window"))
    return met.select("doc_id", "text_hash", start.alias("start"), "n_window", "window")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, least_items: int = 2) -> DataFrame:
    """One row (doc_id, n_words, n_hit, n_items, item_ids array<string>, contaminated) for each row of ``docs``.

    A null or empty text has no words.  Rows with equal doc_id and equal text get equal results, rows that share only
    their doc_id are judged apart, a null doc_id is a key like any other.  Items with null or no text have no window;
    items that share an item_id count as one; a null item_id never counts as an item, but its windows hit.  Texts of
    any length are read whole.  Only the columns doc_id, item_id and text are read.
    """
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    hits = cut(occurrences(docs.select("doc_id", "text"), items, size).distinct())
    key = ["doc_id", "text_hash"]
    covered = hits.select(*key, F.explode(F.sequence("start", F.col("start") + F.col("n_window") - 1)).alias("word")).distinct()
    covered = covered.groupBy(*key).agg(F.count("*").alias("n_hit"))
    owners = hits.select(*key, "window").distinct().join(windows(items, size), "window")
    owners = owners.select(*key, "item_id").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    found = cut(_null_safe_join(covered, owners, key, "left").select(*key, "n_hit", "item_ids"))
    rows = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
    )
    n_items = F.coalesce(F.size("item_ids"), F.lit(0)).cast("long")
    return _null_safe_join(rows, broadcast_if_small(found, limit=LIMIT), key, "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        n_items.alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (n_items >= least_items).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, least_items: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns kept, that hold windows of fewer than ``least_items`` items."""
    judged = decontaminate(docs, items, size, least_items)
    bad = cut(judged.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash"))
    return docs.join(broadcast_if_small(bad), same, "left_anti")


def _null_safe_join(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    right = right.withColumnsRenamed({k: f"_{k}" for k in key})
    return left.join(right, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]), how)
