"""JSON documents to flat lists of typed fields, inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.catalog import MAX_DEPTH
from fieldloom.functions.rows import keep_last, let, one_of

STRICT = {"allowSingleQuotes": "false"}
_NESTED = ("object", "objects")


def _parse(text: Column) -> Column:
    return F.from_json(text, "map<string,variant>", STRICT)


def checked_parse(text: Column) -> Column:
    """``[document, {"#": hash}]``: the second element proves that the text was one whole value.

    The JSON reader ignores anything after the first value, so a bare parse
    would accept ``{"a":1} rest`` and ``1,2``.
    """
    seal = F.xxhash64(text).cast("string")
    whole = F.concat(F.lit("["), text, F.lit(',{"#":'), seal, F.lit("}]"))
    return F.from_json(whole, "array<map<string,variant>>", STRICT)


def is_whole_value(text: Column) -> Column:
    """Any JSON value: object, array, string, number, true, false, null."""
    seal = F.xxhash64(text).cast("string")
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit(","), seal, F.lit("]")), "array<string>", STRICT)
    ok = (F.size(parsed) == 2) & (F.get(parsed, F.lit(1)) == seal)
    return F.coalesce(ok, F.lit(False))


def read_document(text: Column, raw: Column) -> Column:
    """struct<document, root>: the JSON text of an object and its parsed entries.

    A value that is not an object becomes ``{"value": ...}``, broken text ``{"_raw": hex}``.
    """

    def pair(document: Column, root: Column) -> Column:
        return F.struct(document.alias("document"), root.alias("root"))

    def wrapped() -> Column:
        as_value = F.concat(F.lit('{"value":'), text, F.lit("}"))
        as_raw = F.concat(F.lit('{"_raw":"'), raw, F.lit('"}'))
        document = F.when(is_whole_value(text), as_value).otherwise(as_raw)
        return let(document, lambda d: pair(d, _parse(d)))

    def choose(parsed: Column) -> Column:
        seal = F.try_variant_get(F.get(parsed, F.lit(1))["#"], "$", "bigint")
        first = F.get(parsed, F.lit(0))
        whole = (F.size(parsed) == 2) & first.isNotNull() & (seal == F.xxhash64(text))
        return F.when(whole, pair(text, first)).otherwise(wrapped())

    return let(checked_parse(text), choose)


def _kind(value: Column) -> Column:
    def name(schema: Column) -> Column:
        first = F.schema_of_variant(F.try_variant_get(value, "$[0]", "variant"))
        # whole numbers beyond 64 bits are decimals too: DECIMAL(19,0) to DECIMAL(38,0)
        long_whole = schema.endswith(",0)") & (F.length(schema) == 13) & (schema >= "DECIMAL(19,0)")
        return (
            F.when(schema == "STRING", "string")
            .when(schema == "BIGINT", "integer")
            .when(schema == "DOUBLE", "float")
            .when(schema == "BOOLEAN", "boolean")
            .when(schema == "VOID", "null")
            .when(schema.startswith("OBJECT"), "object")
            .when(schema.startswith("ARRAY") & F.coalesce(first.startswith("OBJECT"), F.lit(False)), "objects")
            .when(schema.startswith("ARRAY"), "array")
            .when(long_whole, "integer")
            .otherwise("float")
        )

    return let(F.schema_of_variant(value), name)


def _has_nested(entries: Column) -> Column:
    return F.exists(entries, lambda e: one_of(e["kind"], *_NESTED))


def _level(parsed: Column, text: Column, prefix: Column | None = None) -> Column:
    """Entries of one object. The raw text is kept for nested values, for their key order."""

    def typed(e: Column) -> Column:
        key = e["key"] if prefix is None else F.concat(prefix, e["key"])
        return F.struct(
            key.alias("key"), e["value"].alias("value"), _kind(e["value"]).alias("kind"), F.lit(None).cast("string").alias("raw")
        )

    def with_raw(entries: Column) -> Column:
        texts = keep_last(F.map_entries(F.from_json(text, "map<string,string>", STRICT)), "key")
        filled = let(
            texts,
            lambda t: F.transform(
                entries,
                lambda e, i: F.struct(
                    e["key"].alias("key"),
                    e["value"].alias("value"),
                    e["kind"].alias("kind"),
                    F.when(one_of(e["kind"], *_NESTED), F.get(t, i)["value"]).alias("raw"),
                ),
            ),
        )
        return F.when(_has_nested(entries), filled).otherwise(entries)

    return let(F.transform(keep_last(F.map_entries(parsed), "key"), typed), with_raw)


def _entry(key: Column, value: Column, kind: str) -> Column:
    return F.struct(
        key.alias("key"),
        value.cast("variant").alias("value"),
        F.lit(kind).alias("kind"),
        F.lit(None).cast("string").alias("raw"),
    )


def _first_raw(entry: Column) -> Column:
    return F.get(F.from_json(entry["raw"], "array<string>", STRICT), F.lit(0))


def _count(entry: Column) -> Column:
    size = F.size(F.try_variant_get(entry["value"], "$", "array<variant>"))
    return _entry(F.concat(entry["key"], F.lit("._count")), size.cast("bigint"), "integer")


def _expand(entries: Column) -> Column:
    """Open every nested entry by one level. ``entries`` has to be a bound name."""

    def one(e: Column) -> Column:
        inner = _level(_parse(e["raw"]), e["raw"], F.concat(e["key"], F.lit(".")))
        first = _first_raw(e)
        items = let(first, lambda t: _level(_parse(t), t, F.concat(e["key"], F.lit("[0]."))))
        return (
            F.when(e["kind"] == "object", inner)
            .when(e["kind"] == "objects", F.concat(items, F.array(_count(e))))
            .otherwise(F.array(e))
        )

    return F.when(_has_nested(entries), F.flatten(F.transform(entries, one))).otherwise(entries)


def _close(entries: Column) -> Column:
    """At the depth limit objects stay whole; of object arrays the first item stays whole.

    ``entries`` has to be a bound name, because it is used more than once.
    """

    def one(e: Column) -> Column:
        kept = F.struct(
            F.concat(e["key"], F.lit("[0]")).alias("key"),
            F.try_variant_get(e["value"], "$[0]", "variant").alias("value"),
            F.lit("object").alias("kind"),
            F.lit(None).cast("string").alias("raw"),
        )
        return F.when(e["kind"] == "objects", F.array(kept, _count(e))).otherwise(F.array(e))

    nested = F.exists(entries, lambda e: e["kind"] == "objects")
    return F.when(nested, F.flatten(F.transform(entries, one))).otherwise(entries)


def flatten_document(root: Column, text: Column, max_depth: int = MAX_DEPTH) -> Column:
    """array<struct<key, value, kind, raw>> in document order, with dotted keys."""

    def open_all(entries: Column) -> Column:
        opened = entries
        if max_depth > 1:
            opened = F.aggregate(
                F.sequence(F.lit(1), F.lit(max_depth - 1)), entries, lambda acc, _: _expand(acc)
            )
        closed = keep_last(let(opened, _close), "key")
        return F.when(_has_nested(entries), closed).otherwise(entries)

    return let(_level(root, text), open_all)
