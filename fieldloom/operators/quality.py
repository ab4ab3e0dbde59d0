"""Input-quality gates.

A gate adds verdict columns. ``split`` turns a verdict into a clean table and a
quarantine; no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import catalog
from fieldloom.functions import document as D
from fieldloom.functions import infer, text as T
from fieldloom.functions.rows import built_once, let


def split(df: DataFrame, verdict: str) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col(verdict), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def clean_text(df: DataFrame, columns: list[str], max_length: int = 10_000, normalize: bool = True) -> DataFrame:
    """G1"""
    return df.withColumns({c: T.clean_text(F.col(c), max_length, normalize) for c in columns})


def clean_identifiers(df: DataFrame, column: str, out: str = "clean_id") -> DataFrame:
    """NULL is a reject."""
    return df.withColumn(out, T.clean_identifier(F.col(column)))


def clean_topics(df: DataFrame, column: str, out: str = "clean_topic") -> DataFrame:
    """G3"""
    return df.withColumn(out, T.clean_topic(F.col(column)))


def topic_validity(df: DataFrame, column: str, out: str = "valid_topic") -> DataFrame:
    """G4"""
    return df.withColumn(out, T.is_valid_topic(F.col(column)))


def _without_escapes(json: Column) -> Column:
    """Every escape as one plain letter, so that a quote is always the end of a string."""
    pairs = F.regexp_replace(json, r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", "x")
    return F.regexp_replace(pairs, r"\\u[0-9a-fA-F]{4}|\\.", "x")


def _outside_strings(json: Column) -> Column:
    """The text without its strings, so that only structure is left."""
    return F.regexp_replace(_without_escapes(json), r'"[^"]*+"', '""')


@built_once
def nesting_depth(json: str) -> Column:
    """How deep objects and arrays are nested below the root; 0 for a flat document.

    One pass over the brackets of the text: +1 for an opening one, -1 for a closing one.
    """
    marks = F.regexp_extract_all(_outside_strings(F.col(json)), F.lit(r"([\[{}\]])"), F.lit(1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.greatest(F.aggregate(marks, start, step)["top"] - 1, F.lit(0))


def depth_gate(df: DataFrame, json: str, max_depth: int = 20) -> DataFrame:
    """G5"""
    depth = nesting_depth(json)
    return df.withColumn("depth", depth).withColumn("depth_ok", F.col("depth") <= max_depth)


def size_gate(df: DataFrame, json: str, max_keys: int = 1000, max_string: int = 100_000) -> DataFrame:
    """Keys of all objects together, and the longest string value.

    A key is a string with a colon behind it; all other strings are values.
    """
    strings = F.regexp_extract_all(_without_escapes(F.col(json)), F.lit(r'("[^"]*+"\s*+:?)'), F.lit(1))

    def measure(found: Column) -> Column:
        keys = F.filter(found, lambda s: s.endswith(":"))
        values = F.filter(found, lambda s: ~s.endswith(":"))
        lengths = F.transform(values, lambda s: F.length(F.rtrim(s, F.lit(" \t\r\n"))) - 2)
        return F.struct(
            F.size(keys).alias("key_count"), F.coalesce(F.array_max(lengths), F.lit(0)).alias("longest_string")
        )

    return (
        df.withColumn("_m", let(strings, measure))
        .select(*df.columns, "_m.*")
        .withColumn("size_ok", (F.col("key_count") <= max_keys) & (F.col("longest_string") <= max_string))
    )


def clean_keys(fields: DataFrame, out: str = "clean_key") -> DataFrame:
    """Every segment of a dotted key; NULL if a segment has nothing left."""
    parts = F.transform(F.split("key", r"\."), lambda part: T.clean_identifier(part))
    whole = ~F.exists(parts, lambda p: p.isNull())
    return fields.withColumn(out, F.when(whole, F.array_join(parts, ".")))


def numeric_gate(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """``number``, ``is_whole`` and ``reason`` (NULL if the value passes)."""
    kind = dict(df.dtypes)[column]
    value = F.col(column)
    if kind == "boolean":
        number = F.lit(None).cast("double")
    elif kind == "string":
        number = infer.text_to_double(value)
    else:
        number = value.cast("double")
    infinite = F.abs(number) == float("inf")
    reason = F.when(number.isNull(), "not a number").when(F.isnan(number), "nan").when(infinite, "infinity")
    if low is not None:
        reason = reason.when(number < low, "below minimum")
    if high is not None:
        reason = reason.when(number > high, "above maximum")
    return (
        df.withColumn("number", number)
        .withColumn("reason", reason)
        .withColumn("is_whole", F.col("reason").isNull() & (F.col("number") == F.floor(F.when(F.col("reason").isNull(), F.col("number")))))
    )


def payload_size_gate(df: DataFrame, column: str = "payload", limit: int = 10 * 1024 * 1024) -> DataFrame:
    """G9"""
    return df.withColumn("payload_bytes", F.octet_length(column)).withColumn(
        "size_ok", F.col("payload_bytes") <= limit
    )


def threat_scan(df: DataFrame, column: str, out: str = "threat") -> DataFrame:
    """Over the whole text."""
    return df.withColumn(out, T.threat_of(F.col(column)))


def threat_report(scanned: DataFrame, column: str = "threat") -> DataFrame:
    return scanned.groupBy(F.coalesce(column, F.lit("clean")).alias("threat")).agg(F.count(F.lit(1)).alias("rows"))


def membership_gate(df: DataFrame) -> DataFrame:
    """Known value type, known protocol, confidence within 0 to 1. Checks the columns that are there."""
    checks = {
        "value_type": ("type_ok", lambda c: F.lower(c).isin(catalog.VALID_FIELD_TYPES)),
        "protocol": ("protocol_ok", lambda c: c.isin(catalog.PROTOCOLS)),
        "confidence": ("confidence_ok", lambda c: c.between(0, 1) & ~F.isnan(c)),
    }
    added = {
        name: F.coalesce(check(F.col(c)), F.lit(False)) for c, (name, check) in checks.items() if c in df.columns
    }
    return df.withColumns(added)


def payload_verdict(
    df: DataFrame, column: str = "payload", limit: int = 10 * 1024 * 1024, max_depth: int = 50
) -> DataFrame:
    """``valid`` and ``message``: size first, then JSON, then depth."""
    size = F.octet_length(column)
    text = F.col(column).cast("string")
    message = (
        F.when(size > limit, F.concat(F.lit("Payload size ("), size, F.lit(f") exceeds maximum ({limit})")))
        .when(~D.is_whole_value(text), "Invalid JSON")
        .when(nesting_depth("_text") > max_depth, F.lit(f"JSON depth exceeded: maximum is {max_depth}"))
    )
    return (
        df.withColumn("_text", text).withColumn("message", message).drop("_text")
        .withColumn("valid", F.col("message").isNull())
    )
