"""Flattening, types, flags, units, hints and signatures: exact values."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import infer
from fieldloom.operators import fields as B
from fieldloom.plans.telemetry import extract_messages


def messages(spark, payloads):
    rows = [(str(i), "d", "MQTT", "t", p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "message_id string, device_id string, protocol string, topic string, payload string")


def flat(spark, payload, **options):
    rows = B.explode_fields(extract_messages(messages(spark, [payload]), **options)).orderBy("pos").select(
        "key", F.to_json("value").alias("value"), "value_type", "is_timestamp", "is_identifier").collect()
    return [tuple(r) for r in rows]


def test_nested_keys_keep_document_order(spark):
    rows = flat(spark, '{"z":{"y":1,"x":{"b":2,"a":"s"}},"k":true}')
    assert [(r[0], r[1]) for r in rows] == [("z.y", "1"), ("z.x.b", "2"), ("z.x.a", '"s"'), ("k", "true")]


def test_arrays(spark):
    rows = flat(spark, '{"s":[{"id":1,"v":10},{"id":2}],"n":[1,2],"e":[],"o":{}}')
    assert [(r[0], r[1], r[2]) for r in rows] == [
        ("s[0].id", "1", "integer"), ("s[0].v", "10", "integer"), ("s._count", "2", "integer"),
        ("n", "[1,2]", "array"), ("e", "[]", "array")]


def test_depth_limit(spark):
    assert flat(spark, '{"a":{"b":{"c":{"d":1}}}}', max_depth=2)[0][:3] == ("a.b", '{"c":{"d":1}}', "object")
    assert [r[0] for r in flat(spark, '{"a":{"l":[{"q":1},{"q":2}]}}', max_depth=2)] == ["a.l[0]", "a.l._count"]


def test_repeated_keys_last_value_first_place(spark):
    assert [(r[0], r[1]) for r in flat(spark, '{"a":1,"b":2,"a":3,"g":{"x":1},"g":{"y":4}}')] == [
        ("a", "3"), ("b", "2"), ("g.y", "4")]
    assert [(r[0], r[1]) for r in flat(spark, '{"a.b":1,"a":{"b":2}}')] == [("a.b", "2")]


@pytest.mark.parametrize("payload, key", [
    ("[1,2]", "value"), ('[{"temp":23.5,"id":1},{"temp":24.0}]', "value[0].temp"), ("5", "value"),
    ("{invalid json}", "_raw"), ('{"a":1} x', "_raw"), ("1,2", "_raw"), ("1],[2", "_raw"), ("{'a':1}", "_raw"), ("", "_raw")])
def test_roots(spark, payload, key):
    rows = flat(spark, payload)
    assert rows[0][0] == key
    if key == "_raw":
        assert json.loads(rows[0][1]) == payload.encode().hex()


def test_types(spark):
    rows = flat(spark, json.dumps({
        "a": 42, "b": 3.5, "c": 1.0, "d": True, "e": "hello", "f": "2024-01-15T10:30:00Z", "g": "2024-01-15 10:30:00",
        "h": "123.45", "i": "-42", "j": "1_0", "l": " inf ", "m": "2024/01/15", "n": "", "o": 12345678901234567890, "p": None}))
    assert [r[2] for r in rows] == [
        "integer", "float", "float", "boolean", "string", "datetime", "datetime", "numeric_string", "numeric_string",
        "numeric_string", "numeric_string", "datetime", "string", "integer"]


def test_nulls_only_when_asked(spark):
    assert flat(spark, '{"a":null}') == []
    assert flat(spark, '{"a":null}', preserve_nulls=True)[0][2] == "null"


UNITS = {
    "temperature_c": "celsius", "temp_celsius": "celsius", "tmp": "celsius", "temperature_f": "fahrenheit", "humidity": "percent",
    "rh_percent": "percent", "pressure_pa": "pascal", "pressure_bar": "bar", "pressure_hpa": "hectopascal", "voltage": "volt",
    "battery_pct": "percent", "random_field": None, "sensor.temp_c": None, "temperature": None, "bat_v": None}
HINTS = {
    "temperature": "temperature", "rh": "humidity", "latitude": "latitude", "lng": "longitude", "battery_level": "battery_level",
    "datetime": "timestamp", "timestamp": "current", "device_id": "identifier", "uuid": "identifier", "xyz": None}
TIMES = {"timestamp": True, "created_at": True, "volts": True, "units": True, "value": False, "name": False}
IDS = {"device_id": True, "serial": True, "machine_temp": True, "humid": True, "temperature": False}


def test_units_hints_and_flags_by_name(spark):
    keys = sorted({*UNITS, *HINTS, *TIMES, *IDS})
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    rows = {r.key: r for r in df.select(
        "key", infer.unit_of_key(F.col("key")).alias("unit"), infer.hint_of_key(F.col("key")).alias("hint"),
        infer.timestamp_name(F.col("key")).alias("ts"), infer.identifier_name(F.col("key")).alias("id")).collect()}
    assert {k: rows[k].unit for k in UNITS} == UNITS
    assert {k: rows[k].hint for k in HINTS} == HINTS
    assert {k: rows[k].ts for k in TIMES} == TIMES
    assert {k: rows[k].id for k in IDS} == IDS


def test_flags_by_value(spark):
    rows = {r[0]: r[3:] for r in flat(spark, json.dumps({
        "a": 1705312200, "b": 1705312200000, "c": 1e9, "d": "2024-01-15T10:30:00Z", "e": "123E4567-e89b-12d3-a456-426614174000"}))}
    assert rows == {"a": (True, False), "b": (True, False), "c": (False, False), "d": (True, False), "e": (False, True)}


def test_signature_ignores_order_values_times_and_ids(spark):
    same = ['{"temperature":1.5,"humidity":60}', '{"humidity":61,"temperature":2.5,"ts":1705312200,"device_id":"x"}']
    got = [r.schema_signature for r in extract_messages(messages(spark, [*same, "{}"])).orderBy("message_id").collect()]
    assert got[0] == got[1] == "e0d3125da7939732"
    assert got[2] == hashlib.sha256(b"").hexdigest()[:16]
