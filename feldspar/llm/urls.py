"""URL filters by a path-template tree.

Per host, the path's segments form a tree of at most ``LEVELS`` levels; what follows them is the last segment, whole.  A
segment that varies (numbers, ids, dates, or one of very many siblings) becomes a wildcard; siblings whose labelled
shares don't differ significantly are merged into one branch; and a template is rejected if its smoothed share of bad
labels is high.  The smoothing goes down the tree: a node's share is pulled towards its parent's, a host's towards
that of all hosts, so a template with few labels follows its branch.

Labels come from a table of judged urls or, without one, from each page itself (``seed_label``): a page is bad if a word
of its url is on a short list or if its text is mostly symbols, so pages of one host and one branch differ, and
the verdict on a page is that of its template, whatever its own label: a page with a bad word in a clean branch is allowed, one
without in a bad branch is blocked.

All counts are aggregations over distinct (host, path) with map-side sums, so a host with a third of all rows costs no
more in one task than its distinct templates do.  A level's round reads only the paths that reach that level.  Rules on
host and path prefix come before the tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut
from .decontaminate import fold

#: Pseudo-labels that a parent's share counts for; share from which a template is rejected; children from which a
#: level's rare segments become wildcards; the z value from which siblings differ.
WEIGHT, REJECT, MANY, APART = 4.0, 0.7, 40, 2.58
#: Levels of the tree, the last of which is all that is left of a path.
LEVELS = 8
#: Share of symbols in a page's text from which the page counts as bad.
SYMBOLS = 0.25

# Words in a host name, path or query that mark a url as bad for the seed labels.
BAD_WORDS = "ads adult bet bets casino escort farm free gambling pills poker porn sex spam track tracker viagra win xxx"
#: A url is labelled bad if it has this many of the words.
BAD_LEAST = 1

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with its own.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): the host is what follows the first ``://``, in lower case (A-Z), up to ``/``, ``?``, ``#`` or the
    end; the path goes on to ``?``, ``#`` or the end.  Both are empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return fold(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; equally long ones count in their order."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def seed_label(host: Column, rest: Column | None = None, html: Column | None = None) -> Column:
    """1 for a page that has a bad word among the words of its host name or of ``rest`` (path and query), or, with ``html``,
    a text of which ``SYMBOLS`` or more is neither letter, digit nor white space; else 0; null for an empty host."""
    words = F.split(host if rest is None else F.concat_ws("/", host, fold(rest)), "[^a-z0-9]+")
    bad = F.size(F.array_intersect(words, F.array(*map(F.lit, BAD_WORDS.split())))) >= BAD_LEAST
    if html is not None:
        text = F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^<>]*>|&[a-zA-Z0-9#]{1,32};", " ")
        symbols = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}\s]+", ""))
        bad = bad | (symbols >= SYMBOLS * F.length(F.regexp_replace(text, r"\s+", "")) + 1)
    return F.when(host != "", bad.cast("int"))


def _variable(segment: Column) -> Column:
    """A segment that is a number, date or id, with its extension kept."""
    shape = F.regexp_replace(segment, r"^[0-9][0-9_.-]*(?=$|\.[a-z]+$)", "*")
    return F.regexp_replace(shape, r"^(?=[a-f-]*[0-9])[0-9a-f-]{8,}(?=$|\.[a-z]+$)", "*")


def _segments(path: Column) -> Column:
    """The segments of a path that aren't empty; from the last level of the tree on they are one."""
    parts = F.array_remove(F.split(path, "/"), "")
    tail = F.array_join(F.slice(parts, LEVELS, F.greatest(F.size(parts), F.lit(1))), "/")
    return F.when(F.size(parts) > LEVELS, F.concat(F.slice(parts, 1, LEVELS - 1), F.array(tail))).otherwise(parts)


def _by_level(rows: DataFrame, segments: str, step) -> DataFrame:
    """``rows`` after ``step(open rows, level)`` for each level of their array ``segments``; a row is open, and moved, only
    as long as it has a segment at the level."""
    done, level = [], 0
    while level < LEVELS:
        done.append(rows.where(F.size(segments) <= level))
        rows = rows.where(F.size(segments) > level)
        if rows.isEmpty():
            break
        rows = cut(step(rows, level))
        level += 1
    return reduce(DataFrame.unionByName, [*done, rows])


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template array<string>) for each distinct host and path of ``urls`` (host, path, n): each segment
    itself or a wildcard.  Level by level: a segment is generalised if it varies by its form, or if it is rare among
    more than ``MANY`` siblings under the template so far."""

    def step(rows: DataFrame, level: int) -> DataFrame:
        rows = rows.withColumn("here", _variable(F.col("segments")[level]))
        siblings = rows.where("here not like '*%'").groupBy("host", "template", "here").agg(F.sum("n").alias("rows"))
        crowd = siblings.groupBy("host", "template").agg(F.count("*").alias("many"), F.sum("rows").alias("all"))
        crowd = cut(crowd.where(F.col("many") > MANY))
        if not crowd.isEmpty():
            rare = siblings.join(broadcast_if_small(crowd), ["host", "template"]).where(F.col("rows") * MANY < F.col("all")).select("host", "template", "here", F.lit(True).alias("rare"))
            rows = rows.join(rare, ["host", "template", "here"], "left").withColumn("here", F.when(F.col("rare"), "*").otherwise(F.col("here"))).drop("rare")
        return rows.withColumn("template", F.concat("template", F.array("here"))).drop("here")

    rows = urls.select("host", "path", "n", _segments(F.col("path")).alias("segments"), F.array().cast("array<string>").alias("template"))
    return _by_level(cut(rows), "segments", step).select("host", "path", "template")


def judge_templates(counted: DataFrame) -> DataFrame:
    """(host, template, merged, purity, rejected) from (host, template, n, labelled, bad).

    From the root down each node's smoothed share of bad labels is (bad + WEIGHT * parent's) / (labelled + WEIGHT).
    Siblings whose share differs from their parent's by less than ``APART`` standard errors are one branch with their
    parent's merged counts; ``merged`` is the template with those segments as wildcards.
    """
    total = counted.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    prior = ((total["bad"] or 0) + 1.0) / ((total["labelled"] or 0) + 2.0)
    hosts = counted.groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    hosts = hosts.select("host", ((F.col("bad") + WEIGHT * prior) / (F.col("labelled") + WEIGHT)).alias("purity"))
    rows = cut(counted.join(hosts, "host").withColumn("merged", F.array().cast("array<string>")))

    def step(rows: DataFrame, level: int) -> DataFrame:
        rows = rows.withColumn("here", F.col("template")[level])
        node = ["host", "merged", "here"]
        each = rows.groupBy(*node).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.first("purity").alias("p"))
        error = F.sqrt(F.col("p") * (1 - F.col("p")) / F.greatest("l", F.lit(1)))
        each = each.withColumn("apart", (F.col("l") > 0) & (F.abs(F.col("b") / F.greatest("l", F.lit(1)) - F.col("p")) > APART * error))
        each = each.withColumn("branch", F.when(F.col("apart"), F.col("here")).otherwise("*"))
        branch = each.groupBy("host", "merged", "branch").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("p").alias("p"))
        branch = branch.select("host", "merged", "branch", ((F.col("b") + WEIGHT * F.col("p")) / (F.col("l") + WEIGHT)).alias("next"))
        moved = each.select(*node, "branch").join(branch, ["host", "merged", "branch"])
        rows = rows.join(moved, node).withColumn("purity", F.col("next"))
        return rows.withColumn("merged", F.concat("merged", F.array("branch"))).drop("here", "branch", "next")

    rows = _by_level(rows, "template", step)
    return rows.select("host", "template", "merged", "purity", (F.col("purity") >= REJECT).alias("rejected"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of ``pages`` (page_id, url, and html if there is
    such a column).

    ``labelled`` has url and bad (0 or 1; null: no label); without it ``seed_label`` labels each page.  A null or
    malformed url has an empty host and path: no rule fits and, having no label, it is allowed.  Equal urls get equal
    verdicts; urls of any length and depth are read whole; other columns are ignored.
    """
    host, path = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if labelled is None:
        html = F.col("html") if "html" in pages.columns else None
        after = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
        seeded = pages.select(host.alias("host"), path.alias("path"), seed_label(host, after, html).alias("seed"))
        marked = distinct = cut(seeded.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("seed").alias("labelled"), F.coalesce(F.sum("seed"), F.lit(0)).alias("bad")))
    else:
        distinct = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n")))
        lh, lp = parse(F.col("url"))
        marks = labelled.where("bad is not null").select(lh.alias("host"), lp.alias("path"), "bad").groupBy("host", "path").agg(F.count("*").alias("labelled"), F.sum("bad").alias("bad"))
        marked = distinct.join(marks, ["host", "path"], "left").fillna(0, ["labelled", "bad"])
    placed = cut(templates(distinct))
    counted = cut(placed.join(marked, ["host", "path"]).groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    judged = placed.join(judge_templates(counted), ["host", "template"]).select("host", "path", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity", "rejected")
    judged = cut(judged)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    method = F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow")
    return rows.join(broadcast_if_small(judged), ["host", "path"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity"
    )
