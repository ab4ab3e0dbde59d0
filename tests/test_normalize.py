"""Conversion, types, ranges, outputs: exact values."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldloom import catalog
from fieldloom.functions.formula import formula_program, formula_programs, run_program
from fieldloom.operators import devices as DV
from fieldloom.operators import normalize as N
from fieldloom.operators import outputs as E
from fieldloom.operators import translate as T
from fieldloom.plans.telemetry import dry_run, extract_messages
from tests.test_fields import messages

NOW = datetime(2024, 2, 1)
COLUMNS = "source_field string, target_concept string, target_field string, source_unit string, target_unit string, conversion_formula string"


def run(spark, payload, mappings, constraints=None, **options):
    x = extract_messages(messages(spark, [payload]), preserve_nulls=options.pop("preserve_nulls", False))
    rows = spark.createDataFrame(mappings, COLUMNS)
    table = T.as_mappings(rows, schema_signature=F.lit(x.first().schema_signature), confidence=F.lit(0.9), resolution_method=F.lit("llm"))
    done = N.assemble_messages(N.normalize(x, N.compile_mappings(table, constraints), None, NOW, **options))
    row = done.withColumn("data", F.to_json("data")).first()
    return json.loads(row.data), row


def test_conversions_types_ranges(spark):
    data, row = run(
        spark, '{"t":74.3,"h":150,"q":"abc","p":1013.25,"u":1,"s":"12.5","w":23.5}',
        [("t", "temperature_celsius", "temperature_celsius", "fahrenheit", "celsius", None),
         ("h", "humidity_percent", "humidity_percent", "percent", "percent", None),
         ("q", "voltage_volt", "voltage_volt", None, None, None),
         ("p", "other", "pressure_bar", "hectopascal", "bar", None),
         ("s", "current_ampere", "current_ampere", None, None, None),
         ("w", "x", "warm", None, "fahrenheit", "(value * 9/5) + 32")])
    assert data == {"temperature_celsius": 23.5, "_invalid.humidity_percent": 150.0, "_error.voltage_volt": "abc", "pressure_bar": 1.01325,
                    "_unmapped.u": 1, "current_ampere": 12.5, "warm": 74.3}
    assert [(v.field, v.error, v.details) for v in row.validation_errors] == [("h", "out_of_range", None), ("q", "type_mismatch", 'Cannot convert str to float: "abc"')]
    assert [(c.field, c.from_unit, c.converted_value) for c in row.conversions] == [("t", "fahrenheit", 23.5), ("p", "hectopascal", 1.01325), ("w", "unknown", 74.3)]
    assert row.event_time == NOW


def test_later_field_wins_and_keeps_its_place(spark):
    data, _ = run(spark, '{"a":1.5,"b":2.5,"c":3.5}', [("a", "x", "t", None, None, None), ("b", "x", "u", None, None, None), ("c", "x", "t", None, None, None)])
    assert list(data.items()) == [("t", 3.5), ("u", 2.5)]


def test_other_types(spark):
    limits = spark.createDataFrame(
        [("i", "integer", None, 5.0), ("b", "boolean", None, None), ("s", "string", None, None), ("d", "datetime", None, None)],
        "concept_id string, datatype string, min_value double, max_value double")
    maps = [(k, k, k, None, None, None) for k in "ibsd"]
    assert run(spark, '{"i":"-3.9","b":"Yes","s":7,"d":1705312200}', maps, limits)[0] == {
        "i": -3, "b": True, "s": "7", "d": "2024-01-15T09:50:00.000000Z"}
    assert run(spark, '{"i":"9.9","b":0,"s":true,"d":"2024/01/15"}', maps, limits)[0] == {
        "_invalid.i": 9, "b": False, "s": "True", "_error.d": "2024/01/15"}


@pytest.mark.parametrize("strategy, want", [("preserve", {"t": None, "f": None}), ("omit", {}), ("default", {"t": 0.0, "f": None})])
def test_null_strategies(spark, strategy, want):
    maps = [("t", "temperature_celsius", "t", None, None, None), ("f", "free", "f", None, None, None)]
    data, _ = run(spark, '{"t":null,"f":null}', maps, preserve_nulls=True, null_strategy=strategy)
    assert {k: data.get(k) for k in want} == want and (strategy != "omit" or data == {})


def test_excluding_unmapped_and_invalid(spark):
    maps = [("h", "humidity_percent", "h", None, None, None)]
    data, row = run(spark, '{"h":150,"k":1}', maps, include_unmapped=False, include_invalid=False)
    assert data == {} and len(row.validation_errors) == 1


def test_formulas(spark):
    good = {"(value * 9/5) + 32": 50.0, "-value / (2 + 3)": -2.0, "value/-4": -2.5, "((value))": 10.0, ".5 * value": 5.0, "--value": 10.0, "- +-value - 1": 9.0, "1e2+value*2.": 120.0,
            "2 - 3 - 4 * value / 8": -6.0, "-(value + 1) * -(2)": 22.0, "7": 7.0, "value / 3": 3.333333, "00 + value": 10.0}
    bad = ["value ** 2", "value // 2", "eval(value)", "value(3)", "value value", "5 value", "__import__", "value; 1", "(value", "value)", "v", "1value", "valuevalue", "", " ", " value", "()", "value +", "* value",
           "01", "1e", "value.", "2(3)", "(2)3", "value\t+ 1", "1_0", "a" * 5000, "(" * 3000]
    fails = ["value / 0", "value / (value - 10)", "1 / (value / 0)", "0 * (1 / (value - value))"]
    rows = [(f,) for f in [*good, *bad, *fails, None]]
    table = formula_programs(spark.createDataFrame(rows * 3, "conversion_formula string"))
    got = {r.conversion_formula: (r.program is None, r.x) for r in table.select("*", run_program(F.col("program"), F.lit(10.0)).alias("x")).collect()}
    assert got == {f: (False, v) for f, v in good.items()} | {f: (True, None) for f in bad if f} | {f: (False, None) for f in fails}
    assert table.select(run_program(F.col("program"), F.lit(None).cast("double")).alias("x")).where("x <> 7").count() == 0


def test_details_of_failed_formulas(spark):
    maps = [("a", "x", "a", None, None, "value / (value - 2)"), ("b", "x", "b", None, None, "value ** 2"), ("c", "x", "c", None, None, "value * 2")]
    data, row = run(spark, '{"a":2,"b":3,"c":4}', maps)
    assert [(v.field, v.error, v.details) for v in row.validation_errors] == [
        ("a", "conversion_failed", "Formula gives no number: value / (value - 2) for 2"), ("b", "conversion_failed", "Not a formula: value ** 2")]
    assert data["c"] == 8.0


def test_formula_programs_match_python():
    rng = random.Random(4)

    def grow(depth):
        kind = rng.randrange(6 if depth else 2)
        if kind < 2:
            return rng.choice(["value", "value", "3", "0.25", "1e1", ".5"])
        if kind == 2:
            return rng.choice("+-") + rng.choice(["", " "]) + grow(depth - 1)
        if kind == 3:
            return f"({grow(depth - 1)})"
        return grow(depth - 1) + rng.choice([" + ", "-", "*", " /", "- "]) + grow(depth - 1)

    for _ in range(3000):
        formula = grow(4).lstrip()
        stack = []
        try:
            for op, number in formula_program(formula):
                if op in "nv":
                    stack.append(7.0 if op == "v" else number)
                elif op == "~":
                    stack.append(-stack.pop())
                else:
                    b, a = stack.pop(), stack.pop()
                    stack.append(a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b)
            got = stack.pop()
            assert not stack
        except ZeroDivisionError:
            got = None
        try:
            want = float(eval(formula, {"value": 7.0}))
        except ZeroDivisionError:
            want = None
        assert got == want, formula


def test_conversion_paths_round_trip(spark):
    paths = {(r.from_unit, r.to_unit): r.steps for r in N.conversion_paths(catalog.unit_conversions(spark)).collect()}
    assert len(paths[("hectopascal", "bar")]) == 2 and ("celsius", "celsius") not in paths
    df = spark.createDataFrame([(12.5,)], "v double")
    table = N.conversion_paths(catalog.unit_conversions(spark))
    there = df.crossJoin(table.select(F.col("from_unit").alias("a"), F.col("to_unit").alias("b"), F.col("steps").alias("s1")))
    back = there.join(table.select(F.col("from_unit").alias("b"), F.col("to_unit").alias("a"), F.col("steps").alias("s2")), ["a", "b"])
    for r in back.select("a", "b", N.apply_steps(F.col("v"), F.col("s1")).alias("x"), N.apply_steps(N.apply_steps(F.col("v"), F.col("s1")), F.col("s2")).alias("y")).collect():
        if abs(r.x) > 1:
            assert abs(r.y - 12.5) / 12.5 < 1e-4, r


def test_event_time_rules(spark):
    payloads = ['{"ts":"not a time","timestamp":"2024-01-15T10:30:00+02:00"}', '{"ts":1705312200}', '{"time":1705312200000}', '{"ts":[1]}', '{"a":1}', '{"date":"2024/01/15"}']
    rows = extract_messages(messages(spark, payloads)).select("message_id", N.event_time("fields").alias("t")).orderBy("message_id").collect()
    got = [(r.t.moment.isoformat() if r.t and r.t.moment else None, r.t.broken if r.t else None) for r in rows]
    assert got == [("2024-01-15T08:30:00", False), ("2024-01-15T09:50:00", False), ("2024-01-15T09:50:00", False), (None, True), (None, None), (None, None)]


def test_broken_time_goes_to_quarantine(spark):
    done, bad = dry_run(messages(spark, ['{"ts":[1],"temp":1.5}', '{"temp":2.5}']), as_of=NOW)
    assert [r.message_id for r in done.collect()] == ["1"] and [r.message_id for r in bad.collect()] == ["0"]


def test_metadata_of_registered_devices(spark):
    done, _ = dry_run(messages(spark, ['{"temp":2.5}']), spark.createDataFrame(
        [("d", "env", None, "Hall", ["a"])], "device_id string, type string, name string, location string, tags array<string>"), as_of=NOW)
    meta = json.loads(done.select(F.to_json("metadata")).first()[0])
    assert meta["device_type"] == "env" and meta["device_name"] is None and meta["tags"] == ["a"] and meta["llm_assisted"] is True


def test_a_device_registered_twice_counts_once(spark):
    rows = [("d", "old", "n", "Hall", ["a"], datetime(2024, 1, 1)), ("d", "new", None, None, None, datetime(2024, 1, 2)), ("e", "x", None, None, None, None)]
    devices = spark.createDataFrame(rows, "device_id string, type string, name string, location string, tags array<string>, updated_at timestamp")
    done, _ = dry_run(messages(spark, ['{"temp":2.5}']), devices, as_of=NOW)
    [row] = E.format_jsonld(done).withColumn("m", F.to_json("metadata")).collect()
    assert json.loads(row.m)["device_type"] == "new"
    properties = {p["name"]: p["value"] for p in json.loads(row.value)["additionalProperty"]}
    assert properties["location"] is None and properties["device_type"] == "new"


def test_json_outputs(spark):
    done, _ = dry_run(messages(spark, ['{"temp":2.5}']), as_of=NOW)
    doc = json.loads(E.format_jsonld(done, urn="x").first().value)
    assert doc["@id"] == "urn:x:message:0" and doc["sosa:hasResult"]["temperature_celsius"] == 2.5 and doc["sosa:resultTime"] == "2024-02-01T00:00:00.000000Z"
    plain = json.loads(E.format_json(done).first().value)
    assert plain["data"]["temperature_celsius"] == 2.5 and plain["validation_errors"] == []


def test_metrics_take_booleans_and_leave_private_names(spark):
    x = extract_messages(messages(spark, ['{"online":true,"zzq":5}']))
    table = T.as_mappings(spark.createDataFrame([("online", "free", "online", None, None, None)], COLUMNS), schema_signature=F.lit(x.first().schema_signature))
    rows = E.to_metrics(N.normalize(x, N.compile_mappings(table), None, NOW)).collect()
    assert [(r.metric, r.value) for r in rows] == [("online", 1.0)]


def test_device_upsert(spark):
    shape = "device_id string, type string, name string, location string, tags array<string>, updated_at timestamp"
    base = spark.createDataFrame([("a", "t", "n", "l", ["x"], NOW)], shape)
    moves = spark.createDataFrame(
        [("a", "update", datetime(2024, 2, 2), None, "n2", None, None), ("b", "update", datetime(2024, 2, 2), "t", None, None, None),
         ("c", "update", datetime(2024, 2, 2), "lost", None, None, None), ("c", "register", datetime(2024, 2, 3), "t3", None, None, None),
         ("c", "update", datetime(2024, 2, 4), None, None, "here", None)],
        "device_id string, op string, changed_at timestamp, type string, name string, location string, tags array<string>")
    rows = {r.device_id: (r.type, r.name, r.location, r.updated_at.day) for r in DV.device_upsert(base, moves).collect()}
    assert rows == {"a": ("t", "n2", "l", 2), "c": ("t3", None, "here", 4)}


def test_sql_names():
    assert E.check_sql_name("iot_metrics") == "iot_metrics"
    for bad in ["", "a b", "1a", "x;drop", "a" * 129]:
        with pytest.raises(ValueError):
            E.check_sql_name(bad)
