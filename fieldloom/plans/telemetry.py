"""The whole way from raw messages to clean ones, in one reusable plan.

The messages are decoded once and written with their fields. Two passes over
that table: the first collects the distinct schemas, which are translated once;
the second maps, converts and checks every message. There is no shuffle by
message, only the small ones of the catalogue.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame

from fieldloom.operators.fields import extract, schema_fields
from fieldloom.operators.normalize import assemble_messages, compile_mappings, normalize
from fieldloom.operators.devices import enrich_metadata
from fieldloom.operators.translate import translate
from fieldloom.session import materialise
from fieldloom.sources.decode import decode_json


@dataclass
class Translation:
    """The catalogue of one run: fields, mappings and signatures of every schema."""

    fields: DataFrame
    mappings: DataFrame
    signatures: DataFrame
    compiled: DataFrame


def extract_messages(messages: DataFrame, **options: Any) -> DataFrame:
    """Messages with JSON text to messages with ``fields`` and ``schema_signature``."""
    return extract(decode_json(messages), **options).drop("payload")


def translate_messages(
    extracted: DataFrame,
    registry: DataFrame | None = None,
    replies: DataFrame | None = None,
    concepts: DataFrame | None = None,
    constraints: DataFrame | None = None,
    as_of: datetime | Column | None = None,
    rule_mode: str = "compat",
    precision: list[tuple[str, int]] | None = None,
) -> Translation:
    """Translate the distinct schemas. They are written once, as all steps read them."""
    fields = materialise(schema_fields(extracted))
    mappings, signatures = translate(fields, registry, replies, concepts, as_of, rule_mode)
    # only these two bring explicit formulas
    with_formulas = registry is not None or replies is not None
    return Translation(fields, mappings, signatures, compile_mappings(mappings, constraints, precision=precision, with_formulas=with_formulas))


def normalize_messages(
    messages: DataFrame,
    registry: DataFrame | None = None,
    replies: DataFrame | None = None,
    concepts: DataFrame | None = None,
    constraints: DataFrame | None = None,
    as_of: datetime | Column | None = None,
    rule_mode: str = "compat",
    **options: Any,
) -> DataFrame:
    """Raw messages to normalised ones with their ``entries``."""
    # decoding is most of the work of a message and the two passes would each do it
    extracted = materialise(extract_messages(messages, preserve_nulls=options.pop("preserve_nulls", False)))
    precision = options.get("precision")
    found = translate_messages(extracted, registry, replies, concepts, constraints, as_of, rule_mode, precision)
    options.setdefault("with_formulas", registry is not None or replies is not None)
    return normalize(extracted, found.compiled, found.signatures, as_of, **options)


def dry_run(messages: DataFrame, devices: DataFrame | None = None, **options: Any) -> tuple[DataFrame, DataFrame]:
    """(finished messages, quarantine) and no sink.

    Messages whose time field holds an array or object cannot be finished.
    """
    normalized = normalize_messages(messages, **options)
    done = assemble_messages(enrich_metadata(normalized.filter("NOT broken_time"), devices)).drop("broken_time")
    return done, normalized.filter("broken_time").drop("entries", "mapping")
