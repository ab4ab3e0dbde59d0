"""Routes, formats, metrics, deliveries and table sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.rows import first_of
from fieldloom.operators.matching import first_contained
from fieldloom.operators.normalize import final_entries
from fieldloom.plans.lookup import lookup_join
from fieldloom.session import materialise

# Fixed values of the linked-data format.
JSONLD_CONTEXT = [
    ("@vocab", "https://schema.org/"),
    ("iot", "https://www.w3.org/2019/wot/td#"),
    ("sosa", "http://www.w3.org/ns/sosa/"),
]
KAFKA_PREFIX = "iot.normalized"
MQTT_PREFIX = "normalized"
WEBSOCKET_PREFIX = "devices"
SQL_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


class Rule:
    """A routing rule: ``kind`` is ``device`` (substring of the device id) or ``context`` (equal)."""

    def __init__(self, kind: str, pattern: str, kafka_topic: str | None = None, mqtt_topic: str | None = None):
        self.kind, self.pattern, self.kafka_topic, self.mqtt_topic = kind, pattern, kafka_topic, mqtt_topic


def _by_device(messages: DataFrame, rules: list[Rule] | DataFrame | None, topic: str) -> tuple[DataFrame, Column]:
    """The messages, and the topic of the first device rule that has one. Of two rules for one pattern the later one counts, at the place of the first."""
    if isinstance(rules, DataFrame):
        own = rules.where("kind = 'device' AND pattern IS NOT NULL").groupBy("pattern").agg(F.min("ordinal").alias("rank"), F.max_by(topic, "ordinal").alias("found"))
        ids = messages.select(F.col("device_id").alias("text"))
        found = first_contained(ids, own.where("found <> ''")).select(F.col("text").alias("device_id"), F.col("found").alias("_by_device"))
        return lookup_join(messages, materialise(found), ["device_id"]), F.col("_by_device")
    kept = {r.pattern: r for r in rules or [] if r.kind == "device"}
    branches = [(F.col("device_id").contains(r.pattern), F.lit(getattr(r, topic))) for r in kept.values() if getattr(r, topic)]
    return messages, first_of(branches, F.lit(None).cast("string"))


def _by_context(messages: DataFrame, rules: list[Rule] | DataFrame | None) -> tuple[DataFrame, Column]:
    """The messages, and the topic of the last rule for their context."""
    if isinstance(rules, DataFrame):
        own = rules.where("kind = 'context' AND pattern <> ''").groupBy(F.col("pattern").alias("context")).agg(F.max_by("kafka_topic", "ordinal").alias("_by_context"))
        return lookup_join(messages, materialise(own), ["context"]), F.col("_by_context")
    contexts = {r.pattern: r.kafka_topic for r in rules or [] if r.kind == "context"}
    found = first_of([(F.col("context") == c, F.lit(t).cast("string")) for c, t in contexts.items()], F.lit(None).cast("string"))
    return messages, F.when(F.col("context") != "", found)


def route_kafka(messages: DataFrame, rules: list[Rule] | DataFrame | None = None, prefix: str = KAFKA_PREFIX) -> DataFrame:
    """Device rule, context rule, else ``prefix.<context>`` or ``prefix.general``.

    A list of rules is the caller's setting and sits in the expression. A table (ordinal, kind, pattern, kafka_topic,
    mqtt_topic) may have any size: device ids meet the patterns by substrings of four characters, contexts by equality.
    """
    rows, by_device = _by_device(messages, rules, "kafka_topic")
    rows, by_context = _by_context(rows, rules)
    named = F.when(F.col("context") != "", F.lower(F.replace("context", F.lit(" "), F.lit("_"))))
    default = F.concat(F.lit(prefix + "."), F.coalesce(named, F.lit("general")))
    columns = [c for c in messages.columns if c != "kafka_topic"]
    return rows.select(*columns, F.coalesce(by_device, F.nullif(by_context, F.lit("")), default).alias("kafka_topic"))


def route_mqtt(messages: DataFrame, rules: list[Rule] | DataFrame | None = None, prefix: str = MQTT_PREFIX) -> DataFrame:
    """Device rule, else ``prefix/device``; rules as for E1."""
    rows, by_device = _by_device(messages, rules, "mqtt_topic")
    default = F.concat(F.lit(prefix + "/"), F.col("device_id"))
    columns = [c for c in messages.columns if c != "mqtt_topic"]
    return rows.select(*columns, F.coalesce(by_device, default).alias("mqtt_topic"))


def fan_out(
    routed: DataFrame, endpoints: list[str] = (), outputs: tuple[str, ...] = ("kafka", "mqtt", "http", "websocket", "timescale")
) -> DataFrame:
    """One delivery row for each enabled output, and for each HTTP endpoint."""
    wanted = []
    for output in outputs:
        if output == "http":
            wanted += [("http", F.lit(endpoint)) for endpoint in endpoints]
        else:
            target = {
                "kafka": lambda: F.col("kafka_topic"),
                "mqtt": lambda: F.col("mqtt_topic"),
                "websocket": lambda: F.concat(F.lit(WEBSOCKET_PREFIX + "/"), F.col("device_id")),
                "timescale": lambda: F.lit("iot_metrics"),
            }[output]()
            wanted.append((output, target))
    rows = F.array(*[F.struct(F.lit(o).alias("output"), t.alias("target")) for o, t in wanted])
    return routed.select(*routed.columns, F.explode(rows).alias("_d")).select(*routed.columns, "_d.*")


def iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def format_json(messages: DataFrame) -> DataFrame:
    """The whole message as JSON in ``value``; times are text."""
    parts = [
        (iso(F.col(f.name)) if f.dataType.typeName() == "timestamp" else F.col(f.name)).alias(f.name)
        for f in messages.schema.fields
    ]
    return messages.withColumn("value", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def format_jsonld(messages: DataFrame, urn: str = "fieldloom") -> DataFrame:
    """E5: a SOSA observation in ``value``. Needs ``data`` and ``metadata``."""
    def lit(text: str, name: str) -> Column:
        return F.lit(text).alias(name)

    # a map, as its entries may be left out one by one
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    described = F.array(entry("description", F.col("context")))
    feature = F.map_from_entries(F.concat(
        F.array(
            entry("@type", F.lit("iot:Thing")),
            entry("@id", F.concat(F.lit(f"urn:{urn}:device:"), F.col("device_id"))),
            entry("name", F.col("device_id")),
        ),
        F.when(F.col("context") != "", described).otherwise(F.slice(described, 1, 0)),
    ))
    typed = F.create_map(F.lit("@type"), F.lit("sosa:Result").cast("variant"))
    # a field of the device may itself be named @type; it wins, as the later key
    own = F.map_filter("data", lambda k, _: k == "@type")
    rest = F.map_filter("data", lambda k, _: k != "@type")
    result = F.map_concat(F.when(F.size(own) > 0, own).otherwise(typed), rest)
    properties = F.transform(
        F.map_entries("metadata"),
        lambda e: F.struct(lit("PropertyValue", "@type"), e["key"].alias("name"), e["value"].alias("value")),
    )
    doc = F.struct(
        F.struct(*[lit(v, k) for k, v in JSONLD_CONTEXT]).alias("@context"),
        lit("sosa:Observation", "@type"),
        F.concat(F.lit(f"urn:{urn}:message:"), F.col("message_id")).alias("@id"),
        feature.alias("sosa:hasFeatureOfInterest"),
        iso(F.col("event_time")).alias("sosa:resultTime"),
        result.alias("sosa:hasResult"),
        F.struct(lit("nosec", "scheme")).alias("iot:hasSecurityScheme"),
        F.when(F.size("metadata") > 0, properties).alias("additionalProperty"),
    )
    text = F.to_json(doc, {"ignoreNullFields": "false"})
    # a value of NULL stays; only the empty list of properties, which stands last, is left out
    bare = F.regexp_replace(text, ',"additionalProperty":null}$', "}")
    return messages.withColumn("value", F.when(F.size("metadata") > 0, text).otherwise(bare))


def to_metrics(normalized: DataFrame) -> DataFrame:
    """One row for each number; booleans count, names with a leading underscore do not."""
    numbers = F.filter(
        final_entries(F.col("entries")),
        lambda e: e["metric_value"].isNotNull() & ~e["out_key"].startswith("_"),
    )
    rows = normalized.select("event_time", "device_id", "message_id", F.explode_outer(numbers).alias("_m"))
    return rows.filter(F.col("_m").isNotNull()).select(
        F.col("event_time").alias("time"),
        "device_id",
        F.col("_m.out_key").alias("metric"),
        F.col("_m.metric_value").alias("value"),
        "message_id",
    )


def check_sql_name(name: str) -> str:
    if not name or len(name) > 128 or not SQL_NAME.fullmatch(name):
        raise ValueError(f"not a plain SQL name: {name!r}")
    return name


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    """Files by day. Rows of one day go to several tasks, so a large day is no bottleneck."""
    dated = metrics.withColumn("date", F.to_date("time"))
    dated.write.mode(mode).partitionBy("date").parquet(path)


def write_metrics_jdbc(metrics: DataFrame, url: str, table: str = "iot_metrics", **options) -> None:
    """E7 for a database. Not tested here: no database is at hand."""
    rows = metrics.select("time", "device_id", "metric", "value")
    rows.write.format("jdbc").options(url=url, dbtable=check_sql_name(table), **options).mode("append").save()


def write_kafka(formatted: DataFrame, servers: str, **options) -> None:
    """To the topic of each row. Needs the Kafka connector on the class path."""
    settings = {"kafka.acks": "all", "kafka.compression.type": "gzip", **options}
    (
        formatted.select(F.col("kafka_topic").alias("topic"), F.col("device_id").alias("key"), "value")
        .write.format("kafka").option("kafka.bootstrap.servers", servers).options(**settings).save()
    )


def delivery_report(messages: DataFrame, log: DataFrame) -> DataFrame:
    """All sent, and any sent, for each message. A message without outputs is a success.

    ``log`` has message_id, output, ok, attempts.
    """
    sums = log.groupBy("message_id").agg(
        F.bool_and("ok").alias("a"), F.bool_or("ok").alias("b"),
        F.count(F.lit(1)).alias("outputs"), F.sum("attempts").cast("bigint").alias("attempts"),
    )
    return messages.select("message_id").join(sums, "message_id", "left").select(
        "message_id",
        F.coalesce("a", F.lit(True)).alias("success"),
        F.coalesce("b", F.lit(False)).alias("partial_success"),
        F.coalesce("outputs", F.lit(0)).cast("bigint").alias("outputs"),
        F.coalesce("attempts", F.lit(0)).cast("bigint").alias("attempts"),
    )
