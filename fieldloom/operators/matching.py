"""Patterns kept as tables of any size: substrings, token sets and topic filters.

Texts and patterns meet by keys, never all with all. Each side comes in once
for each distinct text or pattern; the callers join the result back.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.lookup import is_small, lookup_join
from fieldloom.session import materialise

# Characters of a key; a shorter pattern is its own key.
GRAM = 4


def grams(text: Column, size: int) -> Column:
    """All distinct substrings of a length; the empty one is in every text."""
    if not size:
        return F.array(F.lit(""))
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


def keyed_pairs(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern) for every pattern whose rarest key is a key of the text.

    ``texts`` has text and keys, ``patterns`` has pattern and keys, both distinct. A pattern fits a text only if the text has
    all its keys, so the one that fewest texts have is enough to find it; a pattern with a key that no text has fits nothing.
    """
    wanted = materialise(patterns.select("pattern", F.explode("keys").alias("key")))
    asked = wanted.select("key").distinct()
    offered = texts.select("text", F.explode("keys").alias("key"))
    offered = materialise(offered.join(F.broadcast(asked) if is_small(wanted) else asked, "key", "left_semi"))
    common = offered.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(common, "key", "left").groupBy("pattern").agg(
        F.min_by(F.struct("key", "n"), F.struct(F.coalesce("n", F.lit(0)), "key")).alias("k"))
    chosen = materialise(rarest.where(F.col("k.n").isNotNull()).select("pattern", F.col("k.key").alias("key")))
    return offered.join(F.broadcast(chosen) if is_small(chosen) else chosen, "key").select("text", "pattern")


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern) for every pattern that is a substring of a text. Nulls are left out; an empty pattern is in every text."""
    few = materialise(patterns.select("pattern").dropna().distinct())
    size = F.least(F.length("pattern"), F.lit(GRAM))
    sizes = [r[0] for r in few.select(size.alias("n")).distinct().collect()]
    own = functools.reduce(lambda rest, n: F.when(size == n, grams(F.col("pattern"), n)).otherwise(rest), sizes, F.array().cast("array<string>"))
    every = F.flatten(F.array(*[grams(F.col("text"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    subjects = texts.select("text").dropna().distinct()
    pairs = keyed_pairs(subjects.withColumn("keys", every), few.withColumn("keys", own))
    return pairs.where(F.contains("text", "pattern"))


def holding_tokens(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern) where the text's tokens include all of the pattern's. Both sides have an array ``keys``."""
    pairs = keyed_pairs(texts, patterns)
    rows = pairs.join(texts.withColumnRenamed("keys", "_has"), "text").join(patterns.withColumnRenamed("keys", "_needs"), "pattern")
    return rows.where(F.size(F.array_except("_needs", "_has")) == 0).select("text", "pattern")


def first_contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, found): the payload ``found`` of the pattern of lowest ``rank`` that is a substring of the text.

    ``patterns`` has pattern, rank and found. Texts without a pattern give no row.
    """
    best = patterns.groupBy("pattern").agg(F.min_by(F.struct("rank", "found"), "rank").alias("b"))
    best = materialise(best.select("pattern", "b.*"))
    hits = contained(texts, best).join(best, "pattern").select("text", "rank", "found")
    return hits.groupBy("text").agg(F.min_by("found", "rank").alias("found"))


def topic_filters(topics: DataFrame, filters: DataFrame) -> DataFrame:
    """(topic, pattern): the first filter by ordinal that takes a topic. Topics that none takes give no row.

    The filters become a tree, one row for each node below its parent: ``+`` is a branch that any level takes, ``#`` ends a
    filter and takes whatever follows, nothing included. All topics go down one level at a time by one lookup, each along
    the branch of its own level and along ``+``. Null topics and filters are left out.
    """
    levels = F.split("pattern", "/", -1)
    cut = F.array_position(levels, "#").cast("int")
    parsed = materialise(filters.where("pattern IS NOT NULL").select(
        F.struct("ordinal", "pattern").alias("rank"), (cut > 0).alias("open"), F.when(cut > 0, F.slice(levels, 1, cut - 1)).otherwise(levels).alias("levels")))
    deepest = parsed.agg(F.max(F.size("levels"))).first()[0]
    if deepest is None:
        return topics.select("topic").limit(0).withColumn("pattern", F.lit(None).cast("string"))
    path = lambda n: F.array_join(F.slice("levels", 1, n), "/")
    steps = parsed.select("rank", "open", "levels", F.explode(F.sequence(F.lit(0), F.size("levels"))).alias("depth"))
    ends = F.col("depth") == F.size("levels")
    nodes = materialise(steps.groupBy(
        "depth", path(F.greatest(F.col("depth") - 1, F.lit(0))).alias("node"), F.when(F.col("depth") > 0, F.get("levels", F.col("depth") - 1)).alias("token"), path(F.col("depth")).alias("child")
    ).agg(F.min(F.when(ends & F.col("open"), F.col("rank"))).alias("open"), F.min(F.when(ends & ~F.col("open"), F.col("rank"))).alias("exact")))
    at = materialise(topics.select("topic").dropna().distinct().select("topic", F.split("topic", "/", -1).alias("tokens"), F.lit("").alias("node")))
    root = nodes.where("depth = 0").select("open").collect()  # one row; a filter that is # alone ends there
    found = [at.select("topic", F.struct(F.lit(r["open"]["ordinal"]).cast(parsed.schema["rank"].dataType["ordinal"].dataType).alias("ordinal"), F.lit(r["open"]["pattern"]).alias("pattern")).alias("rank"))
             for r in root if r["open"] is not None]
    for depth in range(1, deepest + 1):
        own = F.array_distinct(F.array(F.get("tokens", F.lit(depth - 1)), F.lit("+")))
        waiting = at.where(F.size("tokens") >= depth).select("topic", "tokens", "node", F.explode(own).alias("token"))
        below = materialise(nodes.where(F.col("depth") == depth).select("node", "token", "child", "open", "exact"))
        met = lookup_join(waiting, below, ["node", "token"]).where("child IS NOT NULL")
        at = materialise(met.select("topic", "tokens", F.col("child").alias("node"), "open", "exact"))
        here = F.when(F.size("tokens") == depth, F.col("exact"))
        found.append(at.select("topic", F.least("open", here).alias("rank")).where("rank IS NOT NULL"))
    every = functools.reduce(DataFrame.unionByName, found)
    return every.groupBy("topic").agg(F.min("rank").alias("r")).select("topic", "r.pattern")
