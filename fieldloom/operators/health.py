"""H1 to H8: counts about the run, taken from the tables it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import catalog


def message_counts(outcomes: DataFrame, by: list[str] = ("protocol", "device_type", "error_type")) -> DataFrame:
    """H1: ``outcomes`` has ``failed`` and the grouping columns."""
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(~F.col("failed")).alias("processed"),
        F.count_if(F.col("failed")).alias("failed"),
    )


def latency_histogram(df: DataFrame, column: str, by: list[str], bounds: list[float] | None = None) -> DataFrame:
    """H2: cumulative counts by upper bound, the last one without limit.

    One aggregate column for each bound; the long form comes after, from the few
    groups. No row meets another.
    """
    bounds = catalog.LATENCY_BOUNDS if bounds is None else bounds
    value = F.col(column)
    counts = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    sums = df.groupBy(*by).agg(*counts, F.count(value).alias("all"), F.sum(value).alias("total"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("count")))
    return sums.select(*by, "total", F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*", "total")


def cache_hit_ratio(lookups: DataFrame) -> DataFrame:
    """H3: ``lookups`` has hit and n (messages)."""
    return lookups.agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).cast("bigint").alias("hits"),
        F.coalesce(F.sum(F.when(~F.col("hit"), F.col("n"))), F.lit(0)).cast("bigint").alias("misses"),
    ).withColumn("ratio", F.try_divide("hits", F.col("hits") + F.col("misses")))


def unique_devices(messages: DataFrame) -> DataFrame:
    """H4: distinct pairs first, so a hot protocol is spread over its devices."""
    pairs = messages.select("protocol", "device_id").distinct()
    return pairs.groupBy("protocol").agg(F.count(F.lit(1)).alias("devices"))


def device_message_rate(messages: DataFrame, ts: str = "ts") -> DataFrame:
    """H5: messages by device and minute."""
    return messages.groupBy("device_id", F.date_trunc("minute", ts).alias("minute")).agg(
        F.count(F.lit(1)).alias("messages")
    )


def output_volume(deliveries: DataFrame, payload: Column | str = "value") -> DataFrame:
    """H6: deliveries and bytes by output and status."""
    size = F.octet_length(payload)
    return deliveries.groupBy("output", F.when(F.col("ok"), "success").otherwise("failure").alias("status")).agg(
        F.count(F.lit(1)).alias("messages"), F.sum(size).cast("bigint").alias("bytes")
    )


def llm_usage(replies: DataFrame) -> DataFrame:
    """H7: requests and tokens by model and status."""
    return replies.groupBy("model", "status").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens").cast("bigint").alias("tokens")
    )


def health_snapshot(outcomes: DataFrame, registry: DataFrame) -> DataFrame:
    """H8: one row."""
    counts = outcomes.agg(
        F.count(F.lit(1)).alias("messages_received"),
        F.count_if(~F.col("failed")).alias("messages_processed"),
        F.count_if(F.col("failed")).alias("messages_failed"),
    )
    size = registry.agg(F.count(F.lit(1)).alias("cache_schemas"))
    return counts.join(F.broadcast(size), F.lit(True))
