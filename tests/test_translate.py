"""Mapping cascade, registry, replies."""

from datetime import datetime

from pyspark.sql import functions as F

from fieldloom import catalog
from fieldloom.operators import fields as B
from fieldloom.operators import prompts as P
from fieldloom.operators import registry as R
from fieldloom.operators import translate as T
from fieldloom.operators.normalize import compile_mappings, normalize
from fieldloom.plans.telemetry import extract_messages, translate_messages
from tests.test_fields import messages

NOW = datetime(2024, 2, 1)


def names(spark, keys):
    df = spark.createDataFrame([("s", k, False) for k in keys], "schema_signature string, key string, flagged boolean")
    return T.distinct_names(B.infer_semantics(B.infer_units(df)))


# (accepted by similarity, concept): what the fixed rules give without a model
COMPAT = {
    "temp": (False, "temperature_celsius"), "temperature_f": (False, "temperature_celsius"), "humidity": (False, "temperature_celsius"),
    "rh": (False, "temperature_celsius"), "pressure_hpa": (False, "pressure_pascal"), "co2_ppm": (True, "co2_ppm"),
    "lat": (True, "latitude_degrees"), "lng": (False, "temperature_celsius"), "rssi": (True, "signal_rssi"),
    "power_w": (False, "power_watt"), "energy_kwh": (False, "power_watt"), "speed_kmh": (False, "speed_mps"),
    "value": (False, "voltage_volt"), "k": (False, None)}


def test_compat_table(spark):
    rows = {r.key: r for r in T.resolve_names(names(spark, COMPAT)).collect()}
    assert {k: (r.method == "embedding", r.concept_id) for k, r in rows.items()} == COMPAT


def test_similarities(spark):
    want = {"temp": 0.635, "rh": 0.799, "co2_ppm": 0.870, "lat": 0.957, "rssi": 0.959, "lng": 0.776, "speed_kmh": 0.503}
    rows = {r.key: round(r.similarity, 3) for r in T.best_concepts(names(spark, want)).collect()}
    assert rows == {k: rows[k] for k in want}
    assert all(abs(rows[k] - v) < 0.0011 for k, v in want.items())


def test_token_mode(spark):
    rows = {r.key: r.concept_id for r in T.match_by_rules(names(spark, ["humidity", "lng", "voltage", "value"]), mode="token").collect()}
    assert rows == {"humidity": "humidity_percent", "lng": "longitude_degrees", "voltage": "voltage_volt"}


def test_mapping_validation_and_confidence(spark):
    rows = spark.createDataFrame(
        [("s", "a", "c", "t", 0.8, "llm"), ("s", "b", "c", "t", 1.0, "embedding"), ("s", "x", "", "t", 0.5, "llm"), ("s", "y", "c", "t", 1.5, "llm"),
         ("p", "z", "_id", "z", 1.0, "passthrough")],
        "schema_signature string, source_field string, target_concept string, target_field string, confidence double, resolution_method string")
    checked = T.validate_mappings(T.as_mappings(rows))
    assert {r.source_field: (r.target_field, r.confidence) for r in checked.collect()}["y"] == ("_unmapped.y", 0.0)
    scores = {r.schema_signature: round(r.confidence, 6) for r in T.mapping_confidence(checked).collect()}
    assert scores == {"s": round((0.8 * 0.9 + 1.0) / 1.9, 6), "p": 1.0}


def test_registry_short_circuit_and_expiry(spark):
    x = extract_messages(messages(spark, ['{"temp":20.5,"id":"a"}']))
    found = translate_messages(x)
    fresh = R.registry_entries(found.mappings, found.signatures, datetime(2024, 1, 20))
    hit = translate_messages(x, registry=fresh, as_of=NOW)
    assert [(r.cached, r.llm_generated) for r in hit.signatures.collect()] == [(True, False)]
    assert hit.mappings.count() == 2
    old = fresh.withColumn("created_at", F.lit(datetime(2024, 1, 1)))
    assert [r.cached for r in translate_messages(x, registry=old, as_of=NOW).signatures.collect()] == [False]


def test_upsert_keeps_the_newest(spark):
    x = extract_messages(messages(spark, ['{"temp":20.5}']))
    found = translate_messages(x)
    a, b = (R.registry_entries(found.mappings, found.signatures, datetime(2024, 1, d)) for d in (1, 2))
    assert [r.created_at.day for r in R.registry_upsert(a, b).collect()] == [2]
    assert [r.created_at.day for r in R.registry_upsert(b, a).collect()] == [2]


def test_replies_take_over_what_is_unresolved(spark):
    x = extract_messages(messages(spark, ['{"humidity":55.5,"lat":3.5,"ts":1705312200}']))
    signature = x.first().schema_signature
    reply = spark.createDataFrame([(signature, """Here: {"mappings":[
        {"source_field":"humidity","target_concept":"humidity_percent","target_field":"rel","source_unit":"percent","target_unit":"ratio",
         "conversion_formula":"value / 100","confidence":1.7}], "device_context":"Weather Station"} done""")], "schema_signature string, reply string")
    found = translate_messages(x, replies=P.load_llm_replies(reply))
    done = normalize(x, found.compiled, found.signatures, F.lit(NOW)).first()
    assert done.context == "Weather Station" and done.llm_generated
    # 0.555 of humidity is in range for the concept; the explicit formula came first
    assert {e.out_key: e.metric_value for e in done.entries if e.metric_value is not None}["rel"] == 0.555


def test_bad_replies_are_dropped(spark):
    texts = ["no json", '{"mappings":[]}}', '{"mappings":[{"source_field":"a","target_concept":"nope","target_field":"t"}]}',
             '{"mappings":[{"source_field":"a","target_concept":"_own","target_field":"t"}]}']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "schema_signature string, reply string")
    assert [(r.schema_signature, r.confidence) for r in P.load_llm_replies(df).collect()] == [("3", 0.8)]


def test_prompt_cells(spark):
    df = spark.createDataFrame([("a|b`{c}\x00  d​e" + "x" * 80,)], "t string")
    got = df.select(P.clean_cell(F.col("t"), 20)).first()[0]
    assert got == "abc dexxxxxxxxxxx..." and len(got) == 20


def test_vocabulary_size():
    assert len(catalog.vocabulary()) == 62 and len(catalog.CONVERSIONS) == 40 and len(catalog.UNIT_PATTERNS) == 24


def test_last_mapping_wins(spark):
    rows = spark.createDataFrame([("s", "a", "c1", "t1", 0.8, "llm", 0), ("s", "a", "c2", "t2", 0.8, "llm", 1)],
                                 "schema_signature string, source_field string, target_concept string, target_field string, confidence double, resolution_method string, ordinal int")
    assert [r.m.target_field for r in compile_mappings(T.as_mappings(rows)).collect()] == ["t2"]


def test_lookup_takes_the_newest_live_entry(spark):
    rows = [("s", 0.1, datetime(2024, 1, 1)), ("s", 0.2, datetime(2024, 1, 3)), ("s", 0.3, datetime(2023, 1, 1)), ("t", 0.4, datetime(2023, 1, 1))]
    registry = spark.createDataFrame(rows, "schema_signature string, confidence double, created_at timestamp")
    found = R.registry_lookup(spark.createDataFrame([("s",), ("t",)], "schema_signature string"), registry, datetime(2024, 1, 5)).collect()
    assert {(r.schema_signature, r.hit, r.confidence) for r in found} == {("s", True, 0.2), ("t", False, None)}


def test_new_concepts_have_ordinals_of_their_own(spark):
    rows = [(f"c{i}", "d", "u", "float", ["a"], f"s{i % 50:02}", i) for i in range(3000)]
    suggested = spark.createDataFrame(rows, "concept_id string, description string, unit string, datatype string, aliases array<string>, schema_signature string, ordinal int")
    table, _ = T.learn_concepts(catalog.concepts(spark), suggested)
    found = table.filter("concept_id LIKE 'c%' AND description = 'd'").collect()
    assert len({r.ordinal for r in table.collect()}) == table.count()
    arrival = {f"c{i}": (f"s{i % 50:02}", i) for i in range(3000)}
    assert sorted(arrival, key=arrival.get) == [r.concept_id for r in sorted(found, key=lambda r: r.ordinal)]
