"""Operator 10: quality rules from line frequency across documents, in DataFrame functions only.

Lines are normalised and hashed, and for each host the distinct documents that
hold a line are counted. A line above the limit is removed, a document that
loses nearly all of its text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import materialise, sized, text_key

# A line may stand in so many distinct documents of a host.
MAX_DOCUMENTS = 100
# A document that keeps less than this share of the characters of its distinct lines is rejected.
MIN_KEPT = 0.2
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

_WORD = "[^\\x20\\x09-\\x0D]"


def let(value: Column, body) -> Column:
    """Evaluate a column once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Words between spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD))


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three words that occurs twice or more."""

    def count(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - 2)
        values = F.transform(starts, lambda i: F.xxhash64(F.element_at(hashes, i), F.element_at(hashes, i + 1), F.element_at(hashes, i + 2)))

        def covered(windows: Column) -> Column:
            ordered = F.sort_array(F.transform(windows, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

            def flagged(pairs: Column) -> Column:
                same = lambda x, j: F.coalesce(F.get(pairs, j)["v"] == x["v"], F.lit(False))
                twice = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
                places = F.sort_array(F.transform(twice, lambda x: x["i"]))
                state = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
                step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"))
                return F.aggregate(places, state, step, lambda s: s["n"])

            return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(let(ordered, flagged))

        return let(values, covered)

    enough = F.size(words) >= 3
    return F.when(enough, let(F.transform(words, lambda w: F.xxhash64(w)), count)).otherwise(F.lit(0).cast("bigint"))


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. A null text has no words."""
    whole = text_of(F.col(text))
    measured = let(words_of(whole), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    lines = let(lines_of(whole), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint"))
    out = docs.select(
        "*", measured.alias("_m"), (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"), lines.alias("n_dup_lines"))
    out = out.select("*", "_m.n_words", "_m.word_chars", "_m.n_repeat_words").drop("_m")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def line_key(line: Column) -> Column:
    """Hash of a line without case, values of digits and outer space."""
    return F.xxhash64(F.btrim(F.regexp_replace(F.lower(line), "[0-9]", "0"), F.lit(" \t\x0b\f\r")))


def line_verdicts(docs: DataFrame, host: str = "source", text: str = "text", max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """The documents that lose lines, one row for each host and distinct text: host, key, removed line hashes, kept share.

    Distinct documents of a host are its distinct texts, so exact copies count
    once. The text of smallest key among those that hold a line keeps it: a line
    never vanishes from the corpus, and of a group of near copies one stays whole.
    Null hosts are one host, the empty name. Lines without a word do not count.
    """
    whole = text_of(F.col(text))
    entries = F.array_distinct(F.transform(lines_of(whole), lambda line: F.struct(line_key(line).alias("h"), F.length(line).alias("n"))))
    rows = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_key(F.col(text)).alias("key"), entries.alias("lines"))
    distinct = materialise(rows.dropDuplicates(["host", "key"]))
    held = distinct.select("host", "key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counted = held.groupBy("host", "h").agg(F.count("*").alias("documents"), F.min("key").alias("keeper"))
    common = sized(materialise(counted.where(F.col("documents") > max_documents).select("host", "h", "keeper")))
    hits = held.join(common, ["host", "h"]).where("key <> keeper")
    lost = hits.groupBy("host", "key").agg(F.array_sort(F.collect_set("h")).alias("removed"))
    share = lambda lines: F.aggregate(lines, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    kept = F.filter("lines", lambda x: ~F.array_contains("removed", x["h"]))
    return distinct.join(sized(materialise(lost)), ["host", "key"]).select("host", "key", "removed", (share(kept) / share(F.col("lines"))).alias("kept_share"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", max_documents: int = MAX_DOCUMENTS, min_kept: float = MIN_KEPT) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with the statistics, ``removed`` (null if no line goes), ``kept_share`` and ``kept``.

    kept is false for a document that fails the base rules or keeps less than
    ``min_kept`` of its lines. An empty or null text has no words, so it fails.
    """
    verdicts = sized(materialise(line_verdicts(docs, host, text, max_documents)))
    verdicts = verdicts.select(F.col("host").alias("_host"), F.col("key").alias("_key"), F.col("removed"), F.col("kept_share"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_h"))
    stated = document_statistics(rows).withColumn("_k", text_key(F.col("text")))
    joined = stated.join(verdicts, (F.col("_h") == F.col("_host")) & (F.col("_k") == F.col("_key")), "left").drop("text", "_h", "_k", "_host", "_key")
    share = F.coalesce(F.col("kept_share"), F.lit(1.0))
    return joined.withColumn("kept_share", share).withColumn("kept", ~F.col("base_failed") & (share >= min_kept))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without its removed lines; lines without a word stay."""
    lines = F.filter(F.split(text, "\n"), lambda line: ~(line.rlike(_WORD) & F.array_contains(removed, line_key(line))))
    return F.when(removed.isNull(), text).otherwise(F.array_join(lines, "\n"))


def clean_documents(docs: DataFrame, host: str = "source", text: str = "text", length: str = "n_chars", **limits: object) -> DataFrame:
    """The kept documents without lines above the limit; same columns, with the column ``length`` brought up to date."""
    kept = judge(docs, host, text, **limits).where("kept")
    out = kept.select("row", without_lines(F.col(f"row.`{text}`"), F.col("removed")).alias("new"))
    fresh = {text: F.col("new")} | ({length: F.length("new").cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return out.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
