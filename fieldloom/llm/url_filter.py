"""Operator 2: URL filters from dated lists, as an as-of join.

List entries say on which date a pattern was put on a list or taken off it. They
become intervals of validity, and each capture is judged by the entries valid at
its fetch time. Patterns are a domain (which covers its subdomains) or the
beginning of a URL (host and whole path segments).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.common import materialise

# Intervals are joined by periods of so many seconds, so that a capture meets only entries of its own time.
PERIOD = 30 * 86_400


def host_of(url: Column) -> Column:
    """The lower-cased host of an http or https URL, without user, port and a leading ``www.``; empty if there is none."""
    raw = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(raw, r"^www\.", "")


def path_of(url: Column) -> Column:
    """The path without query, fragment and outer slashes."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z]+://[^/?#]*/*([^?#]*?)/*(?:[?#].*)?$", 1)


def keys_of(host: Column, path: Column) -> Column:
    """The patterns that can cover a URL: (kind, pattern, length). A capture has one for each label but the last and each path segment."""
    labels, segments = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    # a top-level domain alone is no pattern
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(segments)), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")).alias("pattern")))
    return F.when(host == "", F.array().cast("array<struct<kind:string,pattern:string>>")).otherwise(F.concat(domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (list, kind, pattern, since, until) from entries (list, kind, pattern, action, at).

    ``action`` is "add" or "remove", ``at`` whole seconds. An interval is closed on the left and open on the right; until is
    null while the pattern stays on the list. Of entries of the same second a removal counts. A second "add" changes
    nothing, nor does a removal of what is not listed. Entries with a null in any of the five columns, or another
    action, are not used. Repeated rows count once.
    """
    known = entries.select("list", "kind", "pattern", "action", F.col("at").cast("bigint").alias("at")).dropna().where(F.col("action").isin("add", "remove"))
    # one row for each second of a pattern: a window never holds more than its distinct times
    steps = known.groupBy("list", "kind", "pattern", "at").agg(F.max("action").alias("action"))
    order = W.partitionBy("list", "kind", "pattern").orderBy("at")
    changes = steps.withColumn("before", F.lag("action").over(order)).where("action <> coalesce(before, 'remove')")
    ends = changes.withColumn("until", F.lead("at").over(order))
    return ends.where("action = 'add'").select("list", "kind", "pattern", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at", allow: str = "allow") -> DataFrame:
    """Every capture with host, n_active, list, pattern and blocked; all columns of ``captures`` stay in the struct ``row``.

    n_active counts the entries valid at the fetch time that cover the URL. The longest pattern decides, of equal ones the
    ``allow`` list, then the list first in the alphabet. blocked is true if the deciding list is not ``allow``. Without a
    covering entry, a host, or a fetch time, a capture is not blocked and list and pattern are null. Repeated captures
    are judged each.
    """
    slim = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(fetched_at).cast("bigint").alias("t"))
    rows = materialise(slim.withColumn("id", F.monotonically_increasing_id()))
    # as far as any capture reaches; one row
    span = rows.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    valid = intervals(entries)
    period = lambda c: F.floor(c / PERIOD).cast("bigint")
    low, high = (span.low, span.high) if span.low is not None else (0, -1)
    reach = valid.where((F.col("since") <= high) & (F.col("until").isNull() | (F.col("until") > low)))
    first, last = period(F.greatest("since", F.lit(low))), period(F.least(F.coalesce("until", F.lit(high)), F.lit(high)))
    dated = reach.withColumn("period", F.explode(F.sequence(first, F.greatest(first, last))))
    keyed = rows.where("t IS NOT NULL").select("id", "t", period(F.col("t")).alias("period"), F.explode(keys_of(F.col("host"), F.col("path"))).alias("k")).select("id", "t", "period", "k.kind", "k.pattern")
    covered = keyed.join(dated, ["kind", "pattern", "period"]).where((F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))))
    rank = F.struct((-F.length("pattern")).alias("a"), (F.col("list") != allow).alias("b"), F.col("list").alias("list"), F.col("kind").alias("kind"), F.col("pattern").alias("pattern"))
    verdicts = covered.groupBy("id").agg(F.count("*").alias("n"), F.min(rank).alias("best"))
    return rows.join(verdicts, "id", "left").select(
        "row", "host", F.coalesce("n", F.lit(0)).alias("n_active"), F.col("best.list").alias("list"), F.col("best.pattern").alias("pattern"), F.coalesce(F.col("best.b"), F.lit(False)).alias("blocked"))
