"""Topic filters, rules, concepts and formulas as tables: brute force on small ones, 20,000 rows of each kind, odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldloom import catalog
from fieldloom.functions.formula import formula_program, formula_programs, run_program
from fieldloom.operators import matching as X
from fieldloom.operators import outputs as E
from fieldloom.operators import prompts as P
from fieldloom.operators import translate as T
from fieldloom.plans import lookup
from fieldloom.sources import messages as M

MANY = 20_000
CONCEPT = "ordinal int, concept_id string, description string, unit string, datatype string, aliases array<string>"
NAME = "key string, inferred_semantic string, inferred_unit string"


@pytest.fixture(params=["small", "large"])
def sides(request, monkeypatch):
    """Both ways of a join: by broadcast, and as if no table were small enough for one."""
    if request.param == "large":
        monkeypatch.setattr(lookup, "is_small", lambda df, size=0: False)
        monkeypatch.setattr(X, "is_small", lambda df, size=0: False)
    return request.param


def takes(pattern: str, topic: str) -> bool:
    levels, parts = pattern.split("/"), topic.split("/")
    for i, level in enumerate(levels):
        if level == "#":
            return True
        if i >= len(parts) or level not in ("+", parts[i]):
            return False
    return len(levels) == len(parts)


def test_topic_filters_match_brute_force(spark, sides):
    rng = random.Random(4)
    word = lambda extra: rng.choice(["a", "b", "", "+", "x#", *extra])
    filters = [(i * 3 % 101, "/".join(word(["+", "#"]) for _ in range(rng.randrange(1, 5)))) for i in range(90)] + [(200, "#"), (None, None)]
    topics = ["/".join(word([]) for _ in range(rng.randrange(1, 6))) for _ in range(200)] + ["", "a", None, "a"]
    for chosen in (filters, []) if sides == "small" else (filters[:-2],):
        table = spark.createDataFrame(chosen, "ordinal int, pattern string")
        rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(topics)], "message_id int, topic string, ordinal int")
        want = {i: min(((o, p) for o, p in chosen if p is not None and takes(p, t)), default=(0, None))[1] if t is not None else None for i, t in enumerate(topics)}
        got = M.match_subscriptions(rows, table).collect()
        assert {r.message_id: r.subscription for r in got} == want and len(got) == len(topics)


def test_lists_of_filters_read_the_same_signs(spark):
    filters = ["a/+/c", "x#/b", "a/#", "+", "/+", "#"]
    topics = ["a/b/c", "a", "a/", "x#/b", "q", "/q", "", "p/q/r"]
    rows = spark.createDataFrame([(t,) for t in topics], "topic string")
    want = {t: next((p for p in filters if takes(p, t)), None) for t in topics}
    assert {r.topic: r.subscription for r in M.match_subscriptions(rows, filters).collect()} == want
    table = spark.createDataFrame(list(enumerate(filters)), "ordinal int, pattern string")
    assert {r.topic: r.subscription for r in M.match_subscriptions(rows, table).collect()} == want


def test_many_topic_filters(spark):
    table = spark.range(MANY).select((MANY - F.col("id")).alias("ordinal"), F.expr("concat('site/', id, if(id % 2 = 0, '/#', '/+/state'))").alias("pattern"))
    rows = spark.range(2 * MANY).select(F.expr("concat('site/', id, if(id % 3 = 0, '/pump/state', '/pump'))").alias("topic"))
    got = M.match_subscriptions(rows, table).groupBy().agg(F.count("subscription"), F.count(F.lit(1))).first()
    assert tuple(got) == (sum(i % 2 == 0 or i % 3 == 0 for i in range(MANY)), 2 * MANY)


def test_substrings_match_brute_force(spark, sides):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abé") for _ in range(rng.randrange(n)))
    texts, patterns = [make(25) for _ in range(150)] + [None], [make(9) for _ in range(120)] + [None, ""]
    got = X.contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()
    want = {(t, p) for t in texts for p in patterns if t is not None and p is not None and p in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def routes(rules, device, context, column):
    kept = {}
    for _, kind, pattern, kafka, mqtt in sorted(r for r in rules):
        kept[kind, pattern] = kafka if column == "kafka" else mqtt
    for (kind, pattern), topic in kept.items():
        if kind == "device" and device is not None and pattern in device and topic:
            return topic
    if column == "kafka":
        return kept.get(("context", context)) or f"iot.normalized.{context.replace(' ', '_').lower() if context else 'general'}" if context else "iot.normalized.general"
    return None if device is None else f"normalized/{device}"


@pytest.mark.parametrize("empty", [False, True])
def test_routes_match_brute_force(spark, sides, empty):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("ab-") for _ in range(rng.randrange(1, n)))
    rules = [(i, rng.choice(["device", "device", "context"]), make(7), rng.choice([f"k{i}", ""]), rng.choice([f"m{i}", ""])) for i in range(80)]
    if empty:
        rules = [(0, "device", "", "", "m-all"), *[(o + 1, *r) for o, *r in rules]]
    rows = [(i, rng.choice([None, make(9), make(4)]), rng.choice([None, "", "Cold Room", make(5)]), "x") for i in range(200)]
    messages = spark.createDataFrame(rows, "message_id int, device_id string, context string, pattern string")
    for table in (spark.createDataFrame(rules, "ordinal int, kind string, pattern string, kafka_topic string, mqtt_topic string"), [E.Rule(*r[1:]) for r in rules]):
        got = {r.message_id: (r.kafka_topic, r.mqtt_topic) for r in E.route_mqtt(E.route_kafka(messages, table), table).collect()}
        assert got == {i: (routes(rules, d, c, "kafka"), routes(rules, d, c, "mqtt")) for i, d, c, _ in rows}


def test_many_rules(spark):
    rules = spark.range(MANY).select("id", F.when(F.col("id") % 4 == 0, "context").otherwise("device").alias("kind"), F.concat(F.lit("dev-"), F.col("id"), F.lit("-")).alias("pattern"),
                                     F.concat(F.lit("k"), "id").alias("kafka_topic"), F.concat(F.lit("m"), "id").alias("mqtt_topic")).withColumnRenamed("id", "ordinal")
    rows = spark.range(2 * MANY).select(F.concat(F.lit("a-dev-"), "id", F.lit("-z")).alias("device_id"), F.concat(F.lit("dev-"), "id", F.lit("-")).alias("context"))
    kafka = E.route_kafka(rows, rules).where("NOT startswith(kafka_topic, 'iot.')").count()
    mqtt = E.route_mqtt(rows, rules).where("startswith(mqtt_topic, 'm')").count()
    assert (kafka, mqtt) == (MANY, MANY * 3 // 4)


def concept_rows(rng, n, letters):
    make = lambda: "_".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3)))
    return [(i, f"c{i}", f"about {i}", rng.choice(["u", None]), "float", [make() for _ in range(rng.randrange(4))]) for i in range(n)]


def first_alias(hint, key, concepts, mode):
    split = lambda s: {x for x in re.split(r"[\s_\-./]+", s.lower())}
    aliases = [(a, c[1], c[3]) for c in concepts for a in c[5]]
    low = key.lower().replace(".", "_")
    fits = (lambda s, a: a in s) if mode == "compat" else (lambda s, a: set(a.split("_")) <= split(s))
    for a, c, u in aliases:
        if hint and (fits(hint.lower(), a) or (mode == "compat" and hint.lower() in a)):
            return c, u
    return next(((c, u) for a, c, u in aliases if fits(low, a)), None)


@pytest.mark.parametrize("mode", ["compat", "token"])
def test_concepts_match_brute_force(spark, sides, mode):
    rng = random.Random(8)
    concepts = concept_rows(rng, 40, "abc")
    word = lambda: "".join(rng.choice("abcdE") for _ in range(rng.randrange(1, 6)))
    names = [(f"{word()}.{word()}_{i}", rng.choice([None, word(), f"{word()}_{word()}"]), None) for i in range(120)]
    for chosen in (concepts, []) if sides == "small" else (concepts,):
        got = T.match_by_rules(spark.createDataFrame(names, NAME), spark.createDataFrame(chosen, CONCEPT), mode).collect()
        want = {k: found for k, h, _ in names if (found := first_alias(h, k, chosen, mode))}
        assert {r.key: (r.concept_id, r.unit) for r in got} == want and len(got) == len(want)


def test_own_catalogue_as_table_gives_the_same(spark):
    names = [("room.temp", "temperature", "c"), ("hum_1", "humidity", None), ("zz", None, None), ("pressure.x", None, None), ("co2", "air_quality", None), ("Speed", "t", None)]
    frame = spark.createDataFrame(names, NAME)
    fields = spark.createDataFrame([(s, i, h) for s in ("s1", "s2", "s3") for i, (_, h, _) in enumerate(names) if s != "s3" or h is None], "schema_signature string, pos int, inferred_semantic string")
    own = catalog.concepts(spark)
    for mode in ("compat", "token"):
        assert sorted(T.match_by_rules(frame, own, mode).collect()) == sorted(T.match_by_rules(frame, mode=mode).collect())
        assert sorted(map(str, T.resolve_names(frame, own, mode).collect())) == sorted(map(str, T.resolve_names(frame, rule_mode=mode).collect()))
    assert sorted(P.relevant_concepts(fields, own).collect()) == sorted(P.relevant_concepts(fields).collect())


def test_many_concepts(spark):
    concepts = spark.range(MANY).select(F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("c"), "id").alias("concept_id"), F.lit("d").alias("description"), F.lit("u").alias("unit"),
                                        F.lit("float").alias("datatype"), F.array(F.concat(F.lit("alias"), "id", F.lit("z")), F.concat(F.lit("shared"), F.col("id") % 3)).alias("aliases"))
    names = spark.createDataFrame([(f"k.alias{i}z", None, None) for i in range(0, MANY, 1000)] + [("other", "my_alias77z_hint", None), ("none", "q", None)], NAME)
    got = {r.key: r.concept_id for r in T.match_by_rules(names, concepts).collect()}
    assert got == {f"k.alias{i}z": f"c{i}" for i in range(0, MANY, 1000)} | {"other": "c77"}
    fields = spark.createDataFrame([("a", 0, "alias19999z"), ("a", 1, "Shared2 x"), ("b", 0, None)], "schema_signature string, pos int, inferred_semantic string")
    shown = {r.schema_signature: r.concept_ids for r in P.relevant_concepts(fields, concepts).collect()}
    assert shown["a"] == ["c19999", *[f"c{i}" for i in range(2, 200, 3)][:49]] and shown["b"] == [f"c{i}" for i in range(20)]
    reply = '{"mappings":[{"source_field":"a","target_concept":"c19998","target_field":"x"},{"source_field":"b","target_concept":"c20000","target_field":"x"},{"source_field":"c","target_concept":"power_watt","target_field":"x"}]}'
    rows = spark.createDataFrame([("s", reply)], "schema_signature string, reply string")
    assert sorted(r.target_concept for r in P.load_llm_replies(rows, concepts).collect()) == ["c19998", "power_watt"]


def test_many_formulas(spark):
    rows = spark.range(3 * MANY).select(F.concat(F.lit("(value - "), F.col("id") % MANY, F.lit(") / "), F.col("id") % MANY % 10).alias("conversion_formula"))
    table = formula_programs(rows)
    got = table.select("conversion_formula", run_program(F.col("program"), F.lit(5.0)).alias("x")).collect()
    assert len(got) == MANY and sum(r.x is None for r in got) == MANY // 10
    assert all(r.x is None or r.x == round(eval(r.conversion_formula, {"value": 5.0}), 6) for r in got)
    assert formula_program("+" * 40 + "value") == [("v", None)]
