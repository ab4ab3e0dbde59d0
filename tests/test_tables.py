"""Decoders, gates, joins, neighbours, streams and a sample of the registered queries."""

import json
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.rounding import exact_round
from fieldloom.operators import normalize as N
from fieldloom.operators import prompts as P
from fieldloom.operators import quality as G
from fieldloom.operators import rollup as RU
from fieldloom.operators.neighbours import knn_join
from fieldloom.plans import lookup
from fieldloom.plans.oracles import ORACLES
from fieldloom.plans.queries import QUERIES
from fieldloom.session import materialise
from fieldloom.sources import decode as A
from fieldloom.sources import messages as M
from fieldloom.streaming import stream as S
from tools.check import rows_of

FOLDER = "/root/testdata/sf0.001"


def payloads(spark, items):
    return spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(items)], "id int, payload binary")


def test_encodings(spark):
    items = [b"", b'{"a":1}', b"<r><k>v</k></r>", b"a,b\n1,2", b"a;b\n1;2\n", b"\x08\x96\xff", b"\xff\xff", b"hello", b"<r>", b"a,b\n1"]
    rows = A.classify_encoding(payloads(spark, items)).orderBy("id").collect()
    assert [r.payload_encoding for r in rows] == ["binary", "json", "xml", "csv", "csv", "protobuf", "binary", "binary", "binary", "binary"]


def test_xml_and_csv_documents(spark):
    xml = [b"<root><key>value</key></root>", b'<r a="1"><v>1</v><v>2</v><e/>t</r>', b"<r> 5 </r>", b"<r>"]
    got = [r.document and json.loads(r.document) for r in A.decode_xml(payloads(spark, xml)).orderBy("id").collect()]
    assert got == [{"key": "value"}, {"@attributes": {"a": "1"}, "v": ["1", "2"], "e": {}}, {"_value": "5"}, None]
    csv = [b"a,b\r\n1,2\r\n", b'a,b\n"x, ""y""",2\n\n3\n', b"a,b\n", b'a,b\n"l1\nl2",2\n']
    got = [json.loads(r.document) for r in A.decode_csv(payloads(spark, csv)).orderBy("id").collect()]
    assert got == [{"a": "1", "b": "2"}, {"rows": [{"a": 'x, "y"', "b": "2"}, {"a": "3", "b": None}], "_count": 2}, {"rows": [], "_count": 0}, {"a": "l1\nl2", "b": "2"}]


def test_registers(spark):
    got = [json.loads(r.document) for r in A.decode_registers(payloads(spark, [b"\x00\x64\x01\x02", b"\x01\x00\x05", b""])).orderBy("id").collect()]
    assert got == [{"registers": [100, 258], "_count": 2}, {"registers": [256, 5], "_count": 2}, {"registers": [], "_count": 0}]


def test_subscriptions(spark):
    cases = {("sensors/#", "sensors"): True, ("sensors/#", "sensors/a/b"): True, ("sensors/#", "sensor"): False, ("devices/+/telemetry", "devices/x/telemetry"): True,
             ("devices/+/telemetry", "devices/x/y/telemetry"): False, ("#", "a"): True, ("+", "a"): True, ("+", "a/b"): False}
    for (pattern, topic), want in cases.items():
        df = spark.createDataFrame([(topic,)], "topic string")
        assert (M.match_subscriptions(df, [pattern]).first().subscription == pattern) is want, (pattern, topic)


def test_device_ids(spark):
    cases = {"devices/x/telemetry": "x", "Sensor/abc": "abc", "plant/a/data": "a", "a/b/": "b", "": "unknown", "///": "unknown"}
    df = spark.createDataFrame([(t,) for t in cases], "topic string").withColumn("d", M.derive_device_id(F.col("topic")))
    assert {r.topic: r.d for r in df.collect()} == cases


def test_text_gates(spark):
    df = spark.createDataFrame([("  <b>\x00ﬁ & 'x'\x1f　",)], "t string")
    assert G.clean_text(df, ["t"]).first().t == "&lt;b&gt;fi &amp; &#x27;x&#x27;"
    threats = {"x OR 1=1": "SQL", "UNION ALL SELECT": "SQL", "<SCRIPT>": "Script", "../etc": "Path", "fine text": None, "a -- ": "SQL", "onclick = 1": "Script"}
    rows = G.threat_scan(spark.createDataFrame([(t,) for t in threats], "t string"), "t").collect()
    assert {r.t: r.threat and r.threat.split()[0] for r in rows} == threats


def test_depth_and_size(spark):
    docs = {'{"a":1}': (0, 1, 0), '{"a":{"b":[{"c":"]}{"}]}}': (3, 3, 3), '[1,[2]]': (1, 0, 0), '{"k\\"{":"\\u00e9\\\\ab"}': (0, 1, 4)}
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    rows = G.size_gate(G.depth_gate(df, "j"), "j").collect()
    assert {r.j: (r.depth, r.key_count, r.longest_string) for r in rows} == docs


def test_lookup_join_gives_the_same_rows_both_ways(spark):
    big = spark.range(20000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700))
    small = materialise(spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    want = sorted((r.id, r.k, r.v) for r in lookup.lookup_join(big, small, ["k"]).collect())
    got = sorted((r.id, r.k, r.v) for r in lookup.lookup_join(big, small, ["k"], size=10).select("id", "k", "v").collect())
    assert [tuple(map(str, r)) for r in sorted(got, key=str)] == [tuple(map(str, r)) for r in sorted(want, key=str)] and len(got) == 20000


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 8))
    vectors = np.vstack([base, base[:1].repeat(30, axis=0), base[:20] + 0.05 * rng.normal(size=(20, 8)), np.zeros((1, 8))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<double>")
    norms = np.linalg.norm(vectors, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        sims = np.round(vectors @ vectors.T / np.outer(norms, norms), 9)
    for threshold in (0.3, 0.85):
        got = {(r.query_id, r["rank"]): (r.corpus_id, round(r.similarity, 6)) for r in knn_join(df, df, "id", "v", "id", "v", 5, threshold, cells=6).collect()}
        want = {}
        for q in range(len(vectors)):
            order = sorted((c for c in range(len(vectors)) if sims[q, c] >= threshold), key=lambda c: (-sims[q, c], c))[:5]
            want.update({(q, i + 1): (c, round(float(sims[q, c]), 6)) for i, c in enumerate(order)})
        assert got == want


def test_budget_by_window(spark):
    rows = [(i, datetime(2024, 1, 1, 0, i // 30, (i % 30) // 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    got = sorted(r.id for r in P.cap_per_window(df, "ts", "id", 15).filter("within_budget").collect())
    assert got == [*range(15), *range(30, 45)]


@pytest.mark.parametrize("name", ["b9_schema_signature", "c15_translate", "d18_normalize", "f1_hourly_rollup", "d16_device_upsert", "e9_delivery_report",
                                  "g10_threat_scan", "h2_latency_histogram", "s1_run_stream", "s2_stream_rollup"])
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("events", "customer", "nation", "documents", "pages", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = db.execute(ORACLES[name])
    df = QUERIES[name](spark, FOLDER)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_every_query_has_sql_or_a_reason():
    # encodings need an XML parser, request texts are long prose: both are tested above
    assert set(QUERIES) - set(ORACLES) == {"a6_encoding_profile", "c8_build_prompt_requests"}


def test_lookup_join_with_hot_and_missing_keys(spark):
    small = materialise(spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    for share in ("id % 10 < 9", "id % 10 < 0"):
        big = spark.range(5000).withColumn("k", F.when(F.expr(share), F.lit(7)).when(F.col("id") % 10 == 9, F.col("id") % 700))
        rows = lookup.lookup_join(big, small, ["k"], size=10).collect()
        assert sorted(r.id for r in rows) == list(range(5000))
        assert all(r.v == (None if r.k is None or r.k >= 600 else 2 * r.k) for r in rows)


def test_exact_rounding_of_ties(spark):
    values = [2.675, 23.125, 0.285, -2.675, 0.5, 1.5, 2.5, 1e-7, 5e-7, 1.0000005, 0.0, 1e300] + [k / 1000 for k in range(5, 4000, 10)] + [(2 * k + 1) / 16 for k in range(200)]
    for digits in (0, 1, 2, 3, 6):
        got = spark.createDataFrame([(v,) for v in values], "x double").select("x", exact_round(F.col("x"), digits).alias("y")).collect()
        assert [r.y for r in got] == [round(v, digits) for v in values]


def test_json_with_a_byte_order_mark(spark):
    rows = A.decode_json(payloads(spark, [b'\xef\xbb\xbf{"a":1}', b'{"a":1}'])).select("decoded.document").collect()
    assert [json.loads(r.document) for r in rows] == [{"a": 1}, {"a": 1}]


def test_streamed_rollup_takes_late_rows_and_open_hours(spark, tmp_path):
    rows = [(datetime(2024, 1, 1 + i % 3, i % 24, 10), f"d{i % 2}", "m", i / 10) for i in range(200)] + [(datetime(2023, 12, 1), "d0", "m", 1e300), (datetime(2023, 12, 1), "d0", "m", None)]
    metrics = spark.createDataFrame(rows, "time timestamp, device_id string, metric string, value double")
    metrics.repartition(5).write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(metrics.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    S.stream_rollup(feed, f"{tmp_path}/out", f"{tmp_path}/state", None).awaitTermination()
    got = sorted(S.read_rollup(spark, f"{tmp_path}/out").collect(), key=str)
    assert got == sorted(RU.hourly_rollup(metrics).collect(), key=str) and sum(r.sample_count for r in got) == 202


def test_table_of_part_files_streams_like_one_file(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["s2_stream_rollup"](spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, QUERIES["s2_stream_rollup"](spark, FOLDER).collect())) and sum(r.sample_count for r in got) == events.count()
