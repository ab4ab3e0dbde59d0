"""Message table derived from the events table, one message for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.rows import first_of

# (event type, protocol, payload template over value, k, user and event id)
SHAPES = [
    ("click", "MQTT", """concat('{"temp_c":', value, ',"humidity_pct":', k, ',"device_id":"user-', user_id, '"}')"""),
    ("view", "HTTP", """concat('{"temperature_f":', value, ',"rh":', k, ',"pressure_hpa":1013.25,"station_id":"user-', user_id, '"}')"""),
    ("purchase", "CoAP", """concat('{"readings":{"temperature":{"value":', value, ',"unit":"K"},"co2_ppm":', k, '},"serial":"IND-', user_id, '","ts":', 1704067200 + event_id, '}')"""),
    ("signup", "OPC-UA", """concat('{"voltage":', value, ',"power_w":', k, ',"ts":', 1704067200000 + event_id, '}')"""),
    ("error", "WebSocket", """concat('{"lat":', value, ',"lng":-', k, ',"speed_kmh":', value, ',"timestamp":"2024-01-15T10:30:00Z"}')"""),
]


def messages_from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    none = F.lit(None).cast("string")
    protocol = first_of([(F.col("event_type") == e, F.lit(p)) for e, p, _ in SHAPES], none)
    payload = first_of([(F.col("event_type") == e, F.expr(t)) for e, _, t in SHAPES], none)
    device = F.concat(F.lit("user-"), F.col("user_id"))
    return events.withColumn("k", k).select(
        F.concat(F.lit("evt-"), F.col("event_id")).alias("message_id"),
        device.alias("device_id"),
        protocol.alias("protocol"),
        F.concat(F.lit("devices/"), device, F.lit("/"), F.col("event_type")).alias("topic"),
        F.col("ts").cast("timestamp").alias("ts"),
        payload.alias("payload"),
    )
