"""The metric table over time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BUCKET = ["bucket", "device_id", "metric"]


def partial_rollup(metrics: DataFrame) -> DataFrame:
    """Hourly sums that can be added up later: exact ones to twelve decimals, plain ones for values beyond that."""
    exact = F.expr("try_cast(value AS decimal(38, 12))")
    return metrics.groupBy(F.date_trunc("hour", "time").alias("bucket"), "device_id", "metric").agg(
        F.try_sum(exact).alias("exact_sum"),
        F.count(exact).alias("exact_count"),
        F.sum("value").alias("plain_sum"),
        F.count("value").alias("value_count"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def add_partials(partials: DataFrame) -> DataFrame:
    """Partial sums added up: one row for each bucket, which can be added up again."""
    return partials.groupBy(*BUCKET).agg(
        F.try_sum("exact_sum").cast("decimal(38, 12)").alias("exact_sum"), F.sum("exact_count").alias("exact_count"), F.sum("plain_sum").alias("plain_sum"),
        F.sum("value_count").alias("value_count"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.sum("sample_count").alias("sample_count"))


def merge_rollup(partials: DataFrame) -> DataFrame:
    """One row for each bucket from its partial sums."""
    return finished(add_partials(partials))


def finished(sums: DataFrame) -> DataFrame:
    # the order of the rows does not show in an exact sum
    exact = (F.col("exact_count") == F.col("value_count")) & F.col("exact_sum").isNotNull()
    mean = F.when(exact, F.col("exact_sum").cast("double")).otherwise(F.col("plain_sum")) / F.nullif("value_count", F.lit(0))
    return sums.select(*BUCKET, mean.alias("avg_value"), "min_value", "max_value", "sample_count")


def hourly_rollup(metrics: DataFrame) -> DataFrame:
    """partial sums are made before the shuffle, so a busy device costs no more than a quiet one."""
    return finished(partial_rollup(metrics))


def refresh_rollup(
    rollup: DataFrame, metrics: DataFrame, as_of: datetime, start_hours: int = 3, end_hours: int = 1
) -> DataFrame:
    """recompute the buckets that lie within [as_of - 3 h, as_of - 1 h]; all others stay.

    The window decides which buckets are replaced, so no anti-join is needed.
    """
    start = as_of - timedelta(hours=start_hours)
    end = as_of - timedelta(hours=end_hours)
    first = start.replace(minute=0, second=0, microsecond=0)
    if first < start:
        first += timedelta(hours=1)
    last = end.replace(minute=0, second=0, microsecond=0)
    inside = (F.col("time") >= F.lit(first)) & (F.col("time") < F.lit(last))
    bucket = (F.col("bucket") >= F.lit(first)) & (F.col("bucket") < F.lit(last))
    return rollup.filter(~bucket).unionByName(hourly_rollup(metrics.filter(inside)))


def apply_retention(metrics: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """keep the rows of the last ``days``. On a table by day the old partitions are not read."""
    limit = as_of - timedelta(days=days)
    kept = metrics.filter(F.col("time") >= F.lit(limit))
    if "date" in metrics.columns:
        kept = kept.filter(F.col("date") >= F.lit(limit.date()))
    return kept


def series_slice(
    metrics: DataFrame,
    device_id: str | None = None,
    metric: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """rows of a device, a metric or both, newest first."""
    out = metrics
    if device_id is not None:
        out = out.filter(F.col("device_id") == device_id)
    if metric is not None:
        out = out.filter(F.col("metric") == metric)
    if start is not None:
        out = out.filter(F.col("time") >= F.lit(start))
        if "date" in metrics.columns:
            out = out.filter(F.col("date") >= F.lit(start.date()))
    if end is not None:
        out = out.filter(F.col("time") < F.lit(end))
        if "date" in metrics.columns:
            out = out.filter(F.col("date") <= F.lit(end.date()))
    tie = [c for c in ("device_id", "metric", "message_id") if c in metrics.columns]
    out = out.orderBy(F.desc("time"), *tie)
    return out.limit(limit) if limit is not None else out
