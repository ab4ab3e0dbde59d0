"""Device dimension and message metadata.

Device: device_id, type, name, location, tags array<string>, updated_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.lookup import lookup_join
from fieldloom.session import materialise

ATTRIBUTES = ["type", "name", "location", "tags"]


def enrich_metadata(messages: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Add ``metadata`` map<string,variant>.

    A registered device gives all four attributes, NULL ones included.
    """
    def entry(name: str, value, when=None):
        item = F.struct(F.lit(name).alias("key"), value.cast("variant").alias("value"))
        return item if when is None else F.when(when, item)

    items = [
        entry("source_protocol", F.col("protocol")),
        entry("source_topic", F.col("topic")),
        entry("translation_confidence", F.col("confidence")),
        entry("schema_signature", F.col("schema_signature")),
    ]
    joined = messages
    if devices is not None:
        # a device registered twice counts as its newest row
        changed = F.col("updated_at") if "updated_at" in devices.columns else F.lit(None).cast("timestamp")
        newest = F.max_by(F.struct(*ATTRIBUTES), F.coalesce(changed, F.timestamp_seconds(F.lit(0))))
        known = materialise(devices.groupBy("device_id").agg(newest.alias("_device")))
        joined = lookup_join(messages, known, ["device_id"])
        registered = F.col("_device").isNotNull()
        for name, attribute in [("device_type", "type"), ("device_name", "name"), ("location", "location")]:
            items.append(entry(name, F.col(f"_device.{attribute}"), registered))
        items.append(entry("tags", F.coalesce("_device.tags", F.array().cast("array<string>")), registered))
    items.append(entry("inferred_context", F.col("context"), F.coalesce(F.col("context") != "", F.lit(False))))
    items.append(entry("llm_assisted", F.lit(True), F.col("llm_generated")))
    metadata = F.map_from_entries(F.filter(F.array(*items), lambda e: e.isNotNull()))
    return joined.withColumn("metadata", metadata).select(*messages.columns, "metadata")


def device_upsert(devices: DataFrame, changes: DataFrame) -> DataFrame:
    """``op`` is ``register`` (replaces all attributes) or ``update`` (only given ones, known devices only).

    ``changes`` has device_id, op, changed_at and the attributes. For each device
    the state after all its changes in time order comes out. An update before
    the first register of an unknown device does nothing.

    The changes of one device reduce with ``max_by``: no list of them is ever held.
    """
    base = devices.select(
        "device_id", F.lit("register").alias("op"), F.lit(None).cast("timestamp").alias("changed_at"), *ATTRIBUTES,
        "updated_at",
    )
    moves = changes.select("device_id", "op", "changed_at", *ATTRIBUTES, F.col("changed_at").alias("updated_at"))
    every = base.unionByName(moves)
    # an old row sorts before all changes
    order = F.coalesce("changed_at", F.timestamp_seconds(F.lit(-62135596800)))
    is_register = F.col("op") == "register"
    last_register = every.filter(is_register).groupBy("device_id").agg(
        F.max_by(F.struct(*ATTRIBUTES), order).alias("r"), F.max(order).alias("since"),
        F.max_by("updated_at", order).alias("r_at"),
    )
    # both sides are reduced to one row for each device before they meet
    given = [F.max_by(a, F.when(F.col(a).isNotNull(), order)).alias(f"u_{a}") for a in ATTRIBUTES]
    when = [F.max(F.when(F.col(a).isNotNull(), order)).alias(f"t_{a}") for a in ATTRIBUTES]
    updates = every.filter(~is_register).groupBy("device_id").agg(*given, *when, F.max(order).alias("u_at"))
    joined = last_register.join(updates, "device_id", "left")
    return joined.select(
        "device_id",
        *[
            F.when(F.col(f"t_{a}") > F.col("since"), F.col(f"u_{a}")).otherwise(F.col(f"r.{a}")).alias(a)
            for a in ATTRIBUTES
        ],
        F.when(F.col("u_at") > F.col("since"), F.col("u_at")).otherwise(F.col("r_at")).alias("updated_at"),
    )
