"""A1 to A5: message feeds, topics and device ids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import catalog
from fieldloom.functions.rows import first_match
from fieldloom.operators.matching import topic_filters
from fieldloom.plans.lookup import lookup_join, size_in_bytes
from fieldloom.session import materialise

# the message contract; payload may be text or bytes
CONTRACT = {
    "message_id": "string",
    "device_id": "string",
    "protocol": "string",
    "topic": "string",
    "payload": "binary",
    "payload_encoding": "string",
    "ts": "timestamp",
    "qos": "int",
    "retained": "boolean",
    "metadata": "map<string,string>",
}
SCHEMA = ", ".join(f"{n} {t}" for n, t in CONTRACT.items())


def derive_device_id(topic: Column) -> Column:
    """A5: first matching topic pattern, else the last segment, else ``unknown``."""
    found = [
        F.nullif(F.regexp_extract(topic, f"(?i){p}", 1), F.lit("")) for p in catalog.DEVICE_ID_PATTERNS
    ]
    segments = F.filter(F.split(topic, "/"), lambda s: s != "")
    return F.coalesce(*found, F.try_element_at(segments, F.lit(-1)), F.lit("unknown"))


def subscription_regex(pattern: str) -> str:
    """``+`` is one level, ``#`` is any number of further levels, none included; within a longer level they are plain signs."""
    levels = pattern.split("/")
    whole = "#" not in levels
    if not whole:
        levels = levels[:levels.index("#")]
    body = "/".join("[^/]*" if level == "+" else re.escape(level) for level in levels)
    if whole:
        return f"^{body}$"
    return f"^{body}(?:/.*)?$" if levels else "^.*$"


def match_subscriptions(messages: DataFrame, patterns: list[str] | DataFrame | None = None) -> DataFrame:
    """A4: first subscription that takes the topic, NULL if none does.

    A list is the caller's setting and sits in the expression. A table (ordinal, pattern) may have any size: it is joined
    level by level, for the distinct topics only.
    """
    if isinstance(patterns, DataFrame):
        rows = messages.drop("subscription")
        taken = topic_filters(rows.select("topic"), patterns).withColumnRenamed("pattern", "subscription")
        return lookup_join(rows, materialise(taken), ["topic"])
    rules = [(subscription_regex(p), p) for p in (patterns or catalog.SUBSCRIPTIONS)]
    return messages.withColumn("subscription", first_match(F.col("topic"), rules))


# Bytes of a table's files that one task decodes, about; tasks for each core where the size is not known, and at most.
PIECE_BYTES = 4 << 20
UNKNOWN_SHARE, MOST_SHARE = 4, 100


def spread(scan: DataFrame) -> DataFrame:
    """Share a scan among tasks of bounded size, at least one for each core.

    Decoding is work for the processor: a few MB of a compressed table are minutes of it, and a split without the
    middle of a row group has no rows at all, so splits alone do not balance it. Inputs of many files, with as many
    splits as tasks are wanted, are left as they are: no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = size_in_bytes(scan)
    # a batch of a stream has no size that the planner knows
    wanted = -(-size // PIECE_BYTES) if size < 1 << 60 else UNKNOWN_SHARE * cores
    pieces = min(max(cores, wanted), MOST_SHARE * cores)
    return scan.repartition(pieces) if scan.rdd.getNumPartitions() < pieces else scan


def to_contract(df: DataFrame, protocol: str | None = None) -> DataFrame:
    """Add what is missing of the contract and put the columns in order."""
    have = set(df.columns)
    topic = F.col("topic") if "topic" in have else F.lit("")
    defaults = {
        "device_id": derive_device_id(topic),
        "topic": topic,
        "protocol": F.lit(protocol),
        "ts": F.current_timestamp(),
    }
    picked = []
    for name, kind in CONTRACT.items():
        column = F.col(name) if name in have else defaults.get(name, F.lit(None))
        picked.append(column.cast(kind).alias(name))
    return df.select(*picked)


def read_messages(
    spark: SparkSession, path: str, fmt: str = "parquet", protocol: str | None = None, topic: str | None = None
) -> DataFrame:
    """A1: messages from tables, or one message for each line or file.

    Line and file feeds have no id of their own. The id is built from the path
    and the position, so a task that runs again gives the same ids.
    """
    if fmt in ("parquet", "orc", "json"):
        reader = spark.read.format(fmt)
        if fmt == "json":
            reader = reader.schema(SCHEMA.replace("payload binary", "payload string"))
        return to_contract(reader.load(path), protocol)
    if fmt == "text":
        lines = spark.read.text(path).select(
            F.concat_ws("-", F.md5("_metadata.file_path"), F.monotonically_increasing_id()).alias("message_id"),
            F.lit(topic or "").alias("topic"),
            F.col("value").alias("payload"),
            F.col("_metadata.file_modification_time").alias("ts"),
        )
        return to_contract(lines, protocol)
    if fmt == "binaryFile":
        files = spark.read.format("binaryFile").load(path).select(
            F.md5("path").alias("message_id"),
            (F.lit(topic) if topic else F.col("path")).alias("topic"),
            F.col("content").alias("payload"),
            F.col("modificationTime").alias("ts"),
        )
        return to_contract(files, protocol)
    raise ValueError(f"unknown message format {fmt!r}")


def stream_messages(spark: SparkSession, source: str, protocol: str | None = None, **options) -> DataFrame:
    """A2: the same contract from a stream of files (``path``) or of Kafka records."""
    if source == "kafka":
        records = spark.readStream.format("kafka").options(**options).load()
        shaped = records.select(
            F.concat_ws("-", "topic", "partition", "offset").alias("message_id"),
            F.col("topic"),
            F.col("value").alias("payload"),
            F.col("timestamp").alias("ts"),
        )
        return to_contract(shaped, protocol)
    path = options.pop("path")
    schema = options.pop("schema", SCHEMA)
    return to_contract(spark.readStream.format(source).schema(schema).options(**options).load(path), protocol)


def merge_protocols(feeds: dict[str, DataFrame]) -> DataFrame:
    """A3: one feed from several, each tagged with its protocol."""
    merged = None
    for protocol, df in feeds.items():
        tagged = df.withColumn("protocol", F.lit(protocol))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return merged
