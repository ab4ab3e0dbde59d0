"""Types, flags, units and hints of a field, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom import catalog
from fieldloom.functions.rows import Getter, first_match, let, one_of

# What a Python float() call accepts: underscores between digits, spaces around, nan and infinity.
_DIGITS = r"\d+(?:_\d+)*"
NUMERIC_TEXT = (
    rf"^\s*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
)

# ISO dates and times that carry a moment: date, or date and time with an optional zone.
MOMENT_TEXT = (
    r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?)(Z|[+-]\d{2}:?\d{2})?)?$"
)


def any_of(subject: Column, patterns: list[str]) -> Column:
    return subject.rlike("|".join(f"(?:{p})" for p in patterns))


def is_iso_text(text: Column) -> Column:
    return any_of(text, catalog.ISO_PATTERNS)


def is_numeric_text(text: Column) -> Column:
    return text.rlike(NUMERIC_TEXT)


def text_to_double(text: Column) -> Column:
    """float() of a text, NULL where that fails."""
    plain = F.replace(F.trim(text), F.lit("_"), F.lit(""))
    return F.when(is_numeric_text(text), plain.try_cast("double"))


def unit_of_key(key: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return first_match(F.lower(key), rules or catalog.UNIT_PATTERNS, anchored=True)


def hint_of_key(key: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return first_match(F.lower(key), rules or catalog.HINT_PATTERNS)


def any_word(words: list[str], test: Callable[[str], Column]) -> Column:
    """Plain word tests: on short names they cost a fraction of a pattern."""
    out = test(words[0])
    for word in words[1:]:
        out = out | test(word)
    return out


def timestamp_name(key: Column) -> Column:
    return let(F.lower(key), lambda k: any_word(catalog.TIMESTAMP_WORDS, k.contains))


def identifier_name(key: Column) -> Column:
    return let(
        F.lower(key), lambda k: any_word(catalog.IDENTIFIER_WORDS, lambda w: k.startswith(w) | k.endswith(w))
    )


def typed_values(get: Getter) -> dict[str, Column]:
    """Stage: ``kind`` and ``value`` to num_value, bool_value and str_value."""
    value, kind = get("value"), get("kind")
    return {
        "num_value": F.when(one_of(kind, "integer", "float"), F.try_variant_get(value, "$", "double")),
        "bool_value": F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean")),
        "str_value": F.when(kind == "string", F.try_variant_get(value, "$", "string")),
    }


def value_types(get: Getter) -> dict[str, Column]:
    """Stage B4: the value type; ISO-like text comes before numeric text."""
    kind, text = get("kind"), get("str_value")
    return {
        "value_type": F.when(kind == "objects", "array")
        .when(kind != "string", kind)
        .when(is_iso_text(text), "datetime")
        .when(is_numeric_text(text), "numeric_string")
        .otherwise("string")
    }


def flags(get: Getter) -> dict[str, Column]:
    """Stage B7 and B8: fields that carry a time or an identity."""
    key, number, text = get("key"), get("num_value"), get("str_value")
    seconds = (number > 1e9) & (number < 1e10)
    millis = (number > 1e12) & (number < 1e13)
    no = F.lit(False)
    return {
        "is_timestamp": timestamp_name(key)
        | F.coalesce(is_iso_text(text), no)
        | F.coalesce(seconds | millis, no),
        "is_identifier": identifier_name(key)
        | F.coalesce(F.lower(text).rlike(catalog.UUID_PATTERN), no),
    }


def as_double(get: Getter) -> Column:
    """The value as a number: numbers, booleans and numeric text; NULL otherwise."""
    return F.coalesce(
        get("num_value"), get("bool_value").cast("int").cast("double"), text_to_double(get("str_value"))
    )


def as_boolean(get: Getter) -> Column:
    text = let(F.lower(get("str_value")), lambda t: one_of(t, "true", "1", "yes", "on"))
    return F.coalesce(get("bool_value"), get("num_value") != 0, text)


def as_moment(get: Getter) -> Column:
    """ISO text, epoch seconds or epoch milliseconds as a timestamp; NULL where that fails."""
    text, number = get("str_value"), get("num_value")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    # years 1 to 9999, the range a timestamp can show
    in_range = seconds.between(-62135596800.0, 253402300799.0)
    iso = F.when(text.rlike(MOMENT_TEXT), text).try_cast("timestamp")
    return F.coalesce(iso, F.when(in_range, F.timestamp_micros((F.when(in_range, seconds) * 1000000).cast("bigint"))))
