"""The schema registry as a table.

Registry: schema_signature, mappings array<struct>, confidence, source, created_at, hit_count.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.catalog import REGISTRY_TTL_DAYS

MAPPING_STRUCT = [
    "source_field", "target_concept", "target_field", "source_unit", "target_unit",
    "conversion_formula", "confidence", "resolution_method", "reasoning",
]


def _moment(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def registry_lookup(
    signatures: DataFrame, registry: DataFrame, as_of: datetime | Column, ttl_days: int = REGISTRY_TTL_DAYS
) -> DataFrame:
    """Left join; ``hit`` only for entries younger than the limit, of several the newest."""
    live = registry.filter(_moment(as_of) - F.col("created_at") < F.make_dt_interval(F.lit(ttl_days)))
    kept = [c for c in registry.columns if c != "schema_signature"]
    fresh = live.groupBy("schema_signature").agg(F.max_by(F.struct(*kept), "created_at").alias("_r")).select("schema_signature", "_r.*")
    joined = signatures.join(fresh.withColumn("hit", F.lit(True)), "schema_signature", "left")
    return joined.withColumn("hit", F.coalesce("hit", F.lit(False)))


def registry_entries(mappings: DataFrame, signatures: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Mappings of a translation as registry rows: source ``llm`` for replies, else ``learned``."""
    packed = mappings.groupBy("schema_signature").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("ordinal", F.lit(0)).alias("ordinal"), *MAPPING_STRUCT))).alias("_m"),
        F.bool_or(
            (F.col("resolution_method") == "llm") & ~F.coalesce(F.col("reasoning").startswith("rule-based"), F.lit(False))
        ).alias("_llm"),
    )
    rows = packed.join(signatures.select("schema_signature", F.col("confidence").alias("_c")), "schema_signature", "left")
    return rows.select(
        "schema_signature",
        F.transform("_m", lambda m: F.struct(*[m[n].alias(n) for n in MAPPING_STRUCT])).alias("mappings"),
        F.coalesce("_c", F.lit(1.0)).alias("confidence"),
        F.when(F.col("_llm"), "llm").otherwise("learned").alias("source"),
        _moment(as_of).cast("timestamp").alias("created_at"),
        F.lit(0).cast("bigint").alias("hit_count"),
    )


def registry_upsert(registry: DataFrame, learned: DataFrame) -> DataFrame:
    """The newest entry of each signature; at equal times the learned one.

    ``max_by`` reduces before the shuffle, so a signature that was learned very
    often is no burden for one task.
    """
    both = registry.withColumn("_new", F.lit(0)).unionByName(learned.withColumn("_new", F.lit(1)))
    kept = [c for c in registry.columns if c != "schema_signature"]
    return (
        both.groupBy("schema_signature")
        .agg(F.max_by(F.struct(*kept), F.struct("created_at", "_new")).alias("_r"))
        .select("schema_signature", "_r.*")
        .select(*registry.columns)
    )


def registry_hits(extracted: DataFrame, registry: DataFrame, as_of: datetime | Column,
                  ttl_days: int = REGISTRY_TTL_DAYS) -> DataFrame:
    """Messages for each live registry entry, counted before the join."""
    counts = extracted.groupBy("schema_signature").agg(F.count(F.lit(1)).alias("hits"))
    return registry_lookup(counts, registry, as_of, ttl_days).filter("hit").select("schema_signature", "hits")


def schema_inventory(extracted: DataFrame, registry: DataFrame, as_of: datetime | Column,
                     ttl_days: int = REGISTRY_TTL_DAYS) -> DataFrame:
    """Live registry entries with their hits among the messages."""
    counts = extracted.groupBy("schema_signature").agg(F.count(F.lit(1)).alias("hits"))
    live = registry.filter(_moment(as_of) - F.col("created_at") < F.make_dt_interval(F.lit(ttl_days)))
    return live.join(counts, "schema_signature", "left").select(
        "schema_signature",
        F.size("mappings").cast("bigint").alias("field_count"),
        "confidence",
        "source",
        "created_at",
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
    )
