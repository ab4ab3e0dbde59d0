"""The batch functions over streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.operators.devices import enrich_metadata
from fieldloom.operators.normalize import assemble_messages, compile_mappings, normalize
from fieldloom.operators.outputs import to_metrics
from fieldloom.operators.registry import registry_entries
from fieldloom.operators.rollup import add_partials, merge_rollup, partial_rollup
from fieldloom.operators.translate import translate
from fieldloom.operators.fields import schema_fields
from fieldloom.plans.telemetry import extract_messages, normalize_messages
from fieldloom.session import materialise, scratch_scope
from fieldloom.sources.messages import spread
from fieldloom.streaming.folders import merge_batches, read_batches, write_batch

REGISTRY_SCHEMA = (
    "schema_signature string, mappings array<struct<source_field:string,target_concept:string,target_field:string,"
    "source_unit:string,target_unit:string,conversion_formula:string,confidence:double,resolution_method:string,"
    "reasoning:string>>, confidence double, source string, created_at timestamp, hit_count bigint"
)
LOG_SCHEMA = REGISTRY_SCHEMA + ", batch_number bigint"
PARTIAL_SCHEMA = (
    "bucket timestamp, device_id string, metric string, exact_sum decimal(38,12), exact_count bigint, plain_sum double, "
    "value_count bigint, min_value double, max_value double, sample_count bigint"
)
# Batches whose folders are merged into one.
MERGE_EVERY = 64


def start(writer, checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """A trigger each second, or with ``every=None`` all there is and stop."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_stream(
    messages: DataFrame,
    out: str,
    checkpoint: str,
    every: str | None = "1 second",
    devices: DataFrame | None = None,
    as_of: datetime | Column | None = None,
) -> StreamingQuery:
    """Each batch goes through the same plan as a table.

    A batch writes to folders that carry its number and replaces them, so a
    batch that runs again after a lost executor leaves no doubles. Messages
    that cannot be finished go to ``quarantine``; they do not stop the stream.
    """

    def batch(rows: DataFrame, number: int) -> None:
        with scratch_scope(rows.sparkSession):
            normalized = materialise(normalize_messages(spread(rows), as_of=as_of))
            good = normalized.filter("NOT broken_time")
            done = assemble_messages(enrich_metadata(good, devices)).drop("broken_time")
            for name, table in [
                ("metrics", to_metrics(good)),
                ("messages", done.withColumns({c: F.to_json(c) for c in ("data", "metadata")})),
                ("quarantine", normalized.filter("broken_time").drop("entries", "mapping")),
            ]:
                table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return start(messages.writeStream.foreachBatch(batch), checkpoint, every)


def stream_rollup(metrics: DataFrame, out: str, checkpoint: str, every: str | None = "1 second", merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Partial rollups, one folder for each batch; ``read_rollup`` adds them up.

    No row is too late: it adds to its bucket whenever it comes, and the newest, still open buckets are there as well. A
    batch that runs again replaces its folder. Every ``merge_every`` batches those before are added up into one folder, so
    that a reader never has more than about that many, however long the stream runs.
    """

    def batch(rows: DataFrame, number: int) -> None:
        write_batch(partial_rollup(rows), out, number)
        if number % merge_every == merge_every - 1:
            # without the own batch: it may have to run again
            merge_batches(rows.sparkSession, out, PARTIAL_SCHEMA, number - 1, add_partials)

    return start(metrics.writeStream.foreachBatch(batch), checkpoint, every)


def read_rollup(spark, out: str) -> DataFrame:
    """The rollup of all that has come so far."""
    return merge_rollup(read_batches(spark, out, PARTIAL_SCHEMA))


def newest_entries(log: DataFrame) -> DataFrame:
    """One entry for each signature: the newest, at equal times that of the later batch."""
    kept = [c for c in log.columns if c != "schema_signature"]
    newest = log.groupBy("schema_signature").agg(F.max_by(F.struct(*kept), F.struct("created_at", "batch_number")).alias("_r"))
    return newest.select("schema_signature", "_r.*").select(*log.columns)


def latest_registry(spark, path: str, before: int | None = None) -> DataFrame:
    """The registry that ``stream_registry`` keeps, as it stood before a batch or as it is now."""
    return newest_entries(read_batches(spark, path, LOG_SCHEMA, before)).drop("batch_number")


def stream_registry(
    messages: DataFrame,
    registry_path: str,
    out: str,
    checkpoint: str,
    every: str | None = "1 second",
    as_of: datetime | Column | None = None,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """S3: schemas seen for the first time are translated, later ones come from the registry.

    Batch n reads the registry as it stood before it and adds what it learned to a log, a folder for each batch; nothing
    known is written again. Every ``merge_every`` batches the log before is reduced to the newest entry of each signature.
    The registry is a table and not stream state, so it may be read by others (``latest_registry``).
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        with scratch_scope(spark):
            known = materialise(latest_registry(spark, registry_path, number))
            extracted = materialise(extract_messages(spread(rows)))
            now = as_of if as_of is not None else F.current_timestamp()
            mappings, signatures = translate(materialise(schema_fields(extracted)), known, as_of=now)
            mappings, signatures = materialise(mappings), materialise(signatures)
            fresh = signatures.filter("NOT cached")
            learned = registry_entries(
                mappings.join(fresh.select("schema_signature"), "schema_signature", "left_semi"), fresh, now
            )
            log = learned.withColumn("batch_number", F.lit(number).cast("bigint"))
            write_batch(log, registry_path, number)
            normalized = normalize(extracted, compile_mappings(mappings), signatures, now)
            to_metrics(normalized).write.mode("overwrite").parquet(f"{out}/batch={number}")
            if number % merge_every == merge_every - 1:
                merge_batches(spark, registry_path, LOG_SCHEMA, number - 1, newest_entries)

    return start(messages.writeStream.foreachBatch(batch), checkpoint, every)
