"""Work is shared in pieces and no message is decoded twice, as seen in the plans."""

import json
import re
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom import catalog
from fieldloom.functions.rows import one_of
from fieldloom.operators import neighbours as K
from fieldloom.operators import prompts as P
from fieldloom.operators import translate as T
from fieldloom.plans import queries as Q
from fieldloom.plans.telemetry import dry_run
from fieldloom.session import materialise, prepare
from fieldloom.sources import messages as M


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of each kind and vectors, in files of their own."""
    path = str(tmp_path_factory.mktemp("scale"))
    kinds = ["click", "view", "purchase", "signup", "error"]
    rows = [(i, datetime(2024, 1, 1, 0, i % 60), i % 7, kinds[i % 5], i * 1.5, f'{{"k": {i}}}') for i in range(200)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/events.parquet")
    vectors = [(i, [1.0, i / 100.0]) for i in range(101)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_spread_makes_pieces_of_bounded_size(spark, folder, monkeypatch):
    scan = spark.read.parquet(f"{folder}/events.parquet")
    monkeypatch.setattr(M, "PIECE_BYTES", 100)
    pieces = M.spread(scan)
    assert pieces.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert sorted(pieces.collect()) == sorted(scan.collect())


def test_spread_without_a_known_size(spark):
    rows = spark.createDataFrame(spark.range(10).rdd)
    assert M.spread(rows).rdd.getNumPartitions() <= M.MOST_SHARE * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["d17_assemble_messages", "e5_format_jsonld", "e10_dry_run", "e6_to_metrics", "d10_route_invalid", "d7_apply_formulas"])
def test_messages_are_decoded_once(spark, folder, name):
    build = {"e10_dry_run": lambda s, f: dry_run(Q.messages(s, f), as_of=F.col("ts"))[0]}.get(name, Q.QUERIES[name])
    assert "xxhash64(payload" not in plan(build(spark, folder))


def test_a_filter_by_time_stays_above_the_join(spark, folder):
    done, _ = dry_run(Q.messages(spark, folder), as_of=F.col("ts"))
    lines = plan(done).splitlines()
    join = next(i for i, line in enumerate(lines) if "Join " in line)
    assert not any("lambda" in line and "Filter" in line for line in lines[join:])


def test_membership_inside_lambdas_is_no_in(spark, folder):
    rows = spark.sql("SELECT explode(array('a', 'b', 'c', NULL)) AS x")
    got = rows.select("x", one_of(F.col("x"), "a", "b").alias("y"), F.col("x").isin("a", "b").alias("z")).collect()
    assert [r.y for r in got] == [r.z for r in got]
    assert " IN (" not in plan(Q.normalized(spark, folder))


def test_every_vector_is_a_query(spark, folder):
    rows = Q.QUERIES["c5_knn_join"](spark, folder).collect()
    assert {r.query_id for r in rows} == set(range(101))
    assert [r.corpus_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 50][0] == 50


def test_suggestions_are_parsed_once_and_aggregated_once(spark, monkeypatch):
    body = '{"suggested_new_concepts":[{"concept_id":"x","description":"d%d","unit":"u","datatype":"float"}]}'
    rows = [(f"s{i}", body % i) for i in range(3)]
    replies = spark.createDataFrame(rows, "schema_signature string, reply string")
    shown = plan(P.suggested_concepts(replies))
    assert shown.count("from_json(StructField(suggested_new_concepts") == 1 and "regexp" not in shown
    known = catalog.concepts(spark)
    concepts, rejected = T.learn_concepts(known, materialise(P.suggested_concepts(replies)))
    assert [r.description for r in concepts.where("concept_id = 'x'").collect()] == ["d0"]
    assert "Aggregate" not in plan(rejected) and sorted(r.description for r in rejected.collect()) == ["d1", "d2"]


def test_span_of_a_reply(spark):
    """The text from the first to the last bracket, where the reply is no JSON as a whole."""
    body = '{"suggested_new_concepts":[{"concept_id":"x","description":"d","unit":"u","datatype":"float"}, null]}'
    replies = [body, f"a {body} b", f"é{body}ü}}"[:-1], f"{body}}}", f"}}{body}", f"}} {body} {{", "}{", "{}", "}", "{", "", None, f"[{body}]", f"[{body}] x", f"{body} {body}", body[:-1]]
    df = spark.createDataFrame(list(enumerate(replies)), "schema_signature int, reply string")
    got = [r.schema_signature for r in P.suggested_concepts(df).collect()]

    def whole(text):
        try:
            return json.loads(text)
        except ValueError:
            return None

    want = []
    for i, reply in enumerate(replies):
        found = re.search(r"\{[\s\S]*\}", reply or "")
        value = whole(reply or "")
        value = value if value is not None else whole(found.group() if found else "")
        want += [i] * len([c for c in value["suggested_new_concepts"] if c] if isinstance(value, dict) and value else [])
    assert sorted(got) == want


def test_neighbours_meet_in_blocks_that_are_not_broadcast(spark, monkeypatch):
    """Near copies, copies, repeated and missing ids, another length and no numbers, over several blocks."""
    random = np.random.default_rng(5)
    groups = random.normal(size=(6, 12))
    vectors = [*(groups[i % 6] + random.normal(size=12) * (1e-6 if i % 3 else 0.3) for i in range(300)), np.zeros(12), *groups, *groups]
    rows = [(i // 2 if i < 20 else i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(None, rows[0][1]), (900, None), (901, [1.0, None, *[0.0] * 10]), (902, [1.0] * 5), (903, [2.0] * 5)]
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df)

    monkeypatch.setattr(K, "materialise", written)
    monkeypatch.setattr(K, "BLOCK_ROWS", 40)
    monkeypatch.setattr(K, "PART_BYTES", 40 * 12 * 8)
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = K.knn_join(df, df, "id", "v", "id", "v", 4, 0.5).collect()
    assert any("CartesianProduct" in p for p in plans) and not any("Broadcast" in p for p in plans)

    good = [(i, np.array(v, dtype=float)) for i, v in rows if v and None not in v and any(v)]
    want = []
    for i, v in good:
        scores = [(round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, w in good if len(v) == len(w)]
        near = sorted((x for x in scores if x[0] >= 0.5), key=lambda x: (-x[0], 1e9 if x[1] is None else x[1]))[:4]
        want += [(i, j, s) for s, j in near]
    shown = lambda x: (str(x[0]), str(x[1]), round(x[2], 6))
    assert sorted(shown((r.query_id, r.corpus_id, r.similarity)) for r in got) == sorted(map(shown, want))


def test_similarities_round_as_in_spark(spark):
    x = [0.5, 0.1234567885, 0.9999999995, 0.70710678118, 1.0000000000000002, -0.3000000005, 0.0, 2.5e-9]
    x += [float(v) for v in np.random.default_rng(1).integers(0, 10**9, 500) / 1e9 + 5e-10]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(F.round("x", K.DIGITS).alias("y")).collect()]
    assert K._rounded(np.array(x)).tolist() == want


def test_batches_for_python_are_bounded_by_bytes(spark):
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    blocks = prepare(spark).range(0, 20, 1, 1).select(F.repeat(F.lit("x"), 3 << 20).alias("block"))
    assert max(r.n for r in blocks.mapInArrow(rows, "n bigint").collect()) <= 4
