"""Fields, types, flags and signatures.

``extract`` keeps the fields of a message in one array, so that signatures and
all later steps need no shuffle to bring a message together. ``explode_fields``
gives the long table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.catalog import MAX_DEPTH
from fieldloom.functions import infer
from fieldloom.functions.document import flatten_document
from fieldloom.functions.rows import Getter, built_once, chain, widen_table

FIELD = [
    "pos", "key", "value", "value_type", "num_value", "bool_value", "str_value",
    "is_timestamp", "is_identifier",
]


def drop_null_fields(entries: Column) -> Column:
    """B3"""
    return F.filter(entries, lambda e: e["kind"] != "null")


@built_once
def field_array(decoded: str, max_depth: int, preserve_nulls: bool) -> Column:
    """The typed and flagged fields of the decoded document in column ``decoded``."""
    entries = flatten_document(F.col(f"{decoded}.root"), F.col(f"{decoded}.document"), max_depth)
    if not preserve_nulls:
        entries = drop_null_fields(entries)

    def field(e: Column, i: Column) -> Column:
        def finish(get: Getter) -> Column:
            new = {"pos": i, **infer.value_types(get), **infer.flags(get)}
            return F.struct(*[(new[n] if n in new else get(n)).alias(n) for n in FIELD])

        return chain(lambda n: e[n], [infer.typed_values], finish)

    return F.transform(entries, field)


def signature_of(fields: Column) -> Column:
    """Hash of the sorted ``key:type`` of all fields that are neither time nor identity."""
    stable = F.filter(fields, lambda f: ~f["is_timestamp"] & ~f["is_identifier"])
    parts = F.transform(stable, lambda f: F.concat_ws(":", f["key"], f["value_type"]))
    return F.substring(F.sha2(F.array_join(F.array_sort(parts), "|"), 256), 1, 16)


def extract(decoded: DataFrame, max_depth: int = MAX_DEPTH, preserve_nulls: bool = False) -> DataFrame:
    """B1 to B9 for decoded messages: adds ``fields`` and ``schema_signature``."""
    return (
        decoded.withColumn("fields", field_array("decoded", max_depth, preserve_nulls))
        .drop("decoded")
        .withColumn("schema_signature", signature_of(F.col("fields")))
    )


def explode_array(df: DataFrame, column: str) -> DataFrame:
    """One row for each item.

    The outer form and the filter behind it keep the optimiser from copying
    the array expression into an extra size check below the explode.
    """
    kept = [c for c in df.columns if c != column]
    return (
        df.select(*kept, F.explode_outer(column).alias("_item"))
        .filter(F.col("_item").isNotNull())
        .select(*kept, "_item.*")
    )


def explode_fields(extracted: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """B1, B2: the long table, one row for each message and field."""
    kept = keep or ["message_id", "schema_signature"]
    return explode_array(extracted.select(*kept, "fields"), "fields")


def infer_types(fields: DataFrame) -> DataFrame:
    """B4 over a table with ``kind`` and ``value``."""
    return widen_table(fields, [infer.typed_values, infer.value_types])


def infer_units(fields: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """B5"""
    return fields.withColumn("inferred_unit", infer.unit_of_key(F.col("key"), rules))


def infer_semantics(fields: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """B6"""
    return fields.withColumn("inferred_semantic", infer.hint_of_key(F.col("key"), rules))


def schema_fields(extracted: DataFrame) -> DataFrame:
    """The distinct fields of each signature, with unit and hint.

    Whole messages are reduced to their distinct shapes before the explode, and
    the patterns run on what is left. The result grows with the number of
    schemas, not of messages.
    """
    shape = F.transform(
        "fields", lambda f: F.struct(f["key"].alias("key"), (f["is_timestamp"] | f["is_identifier"]).alias("flagged"))
    )
    shapes = extracted.select("schema_signature", shape.alias("shape")).distinct()
    distinct = explode_array(shapes, "shape").distinct()
    return infer_semantics(infer_units(distinct))


def field_summary(extracted: DataFrame) -> DataFrame:
    """One line for each field, in document order."""

    def line(f: Column) -> Column:
        unit, hint = infer.unit_of_key(f["key"]), infer.hint_of_key(f["key"])
        return F.concat(
            F.lit("  - "), f["key"], F.lit(": "), f["value_type"],
            F.coalesce(F.concat(F.lit(" ("), unit, F.lit(")")), F.lit("")),
            F.coalesce(F.concat(F.lit(" -> "), hint), F.lit("")),
        )

    head = F.concat(F.lit("Schema ("), F.col("schema_signature"), F.lit("):\n"))
    return extracted.select(
        "message_id", F.concat(head, F.array_join(F.transform("fields", line), "\n")).alias("summary")
    )


def extraction_stats(extracted: DataFrame) -> DataFrame:
    """Counts over all messages; units and hints are taken by schema, not by message."""
    catalogue = infer_semantics(infer_units(
        explode_fields(extracted, ["schema_signature"]).groupBy("schema_signature", "key").agg(F.count(F.lit(1)).alias("n"))
    ))
    by_field = catalogue.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("fields_extracted"),
        F.coalesce(F.sum(F.when(F.col("inferred_unit").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("fields_with_unit"),
        F.coalesce(F.sum(F.when(F.col("inferred_semantic").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("fields_with_hint"),
    )
    by_schema = extracted.groupBy("schema_signature").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("messages"),
        F.count(F.lit(1)).alias("schemas"),
    )
    return by_schema.join(F.broadcast(by_field), F.lit(True))
