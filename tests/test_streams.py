"""Streams over many batches: merged folders, batches that run again, the registry's log, scratch tables that go."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import rollup as RU
from fieldloom.session import materialise, scratch_dir, scratch_scope
from fieldloom.streaming import folders
from fieldloom.streaming import stream as S

SCHEMA = "k string, n bigint"


def add(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def kept(spark, base):
    return {r.k: r.n for r in add(folders.read_batches(spark, base, SCHEMA)).collect()}


def test_merged_batches_count_once(spark, tmp_path):
    base = f"{tmp_path}/t"
    rows = lambda b: spark.createDataFrame([("a", 1), (f"k{b % 3}", 10)], SCHEMA)
    want = {"a": 0, "k0": 0, "k1": 0, "k2": 0}
    assert kept(spark, base) == {}
    for b in range(13):
        folders.write_batch(rows(b), base, b)
        folders.write_batch(rows(b), base, b)  # ran again
        want["a"] += 1
        want[f"k{b % 3}"] += 10
        if b % 4 == 3:
            folders.merge_batches(spark, base, SCHEMA, b - 1, add)
            folders.write_batch(rows(b), base, b)  # ran again after the merge
            folders.write_batch(rows(b - 1), base, b - 1)  # an old folder that comes back is in the merged one already
        assert kept(spark, base) == {k: n for k, n in want.items() if n}
        # what was merged goes with the next merge
        assert sum(n.startswith("batch=") for n in os.listdir(base)) <= 9
        merged = f"{base}/merged"
        assert not os.path.exists(merged) or len(os.listdir(merged)) <= 2
    assert {r.k: r.n for r in add(folders.read_batches(spark, base, SCHEMA, 12)).collect()} == {"a": 12, "k0": 40, "k1": 40, "k2": 40}


def test_reader_of_the_old_state_finds_its_files(spark, tmp_path):
    base = f"{tmp_path}/t"
    for b in range(4):
        folders.write_batch(spark.createDataFrame([("a", b)], SCHEMA), base, b)
    before = folders.read_batches(spark, base, SCHEMA)
    folders.merge_batches(spark, base, SCHEMA, 2, add)
    assert before.agg(F.sum("n")).first()[0] == 6 == folders.read_batches(spark, base, SCHEMA).agg(F.sum("n")).first()[0]


def test_a_merge_that_fails_changes_nothing(spark, tmp_path):
    base = f"{tmp_path}/t"
    folders.write_batch(spark.createDataFrame([("a", 5)], SCHEMA), base, 0)

    def broken(rows):
        raise ValueError("lost")

    with pytest.raises(ValueError):
        folders.merge_batches(spark, base, SCHEMA, 0, broken)
    assert kept(spark, base) == {"a": 5}


def test_rollup_of_many_batches(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, i % 5, 10), f"d{i % 2}", "m", i / 10) for i in range(120)] + [(datetime(2023, 12, 1), "d0", "m", 1e300), (datetime(2023, 12, 1), "d0", "m", None)]
    metrics = spark.createDataFrame(rows, "time timestamp, device_id string, metric string, value double")
    metrics.repartition(11).write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(metrics.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    S.stream_rollup(feed, f"{tmp_path}/out", f"{tmp_path}/state", None, merge_every=3).awaitTermination()
    assert os.path.isdir(f"{tmp_path}/out/_manifests")
    got = sorted(S.read_rollup(spark, f"{tmp_path}/out").collect(), key=str)
    assert got == sorted(RU.hourly_rollup(metrics).collect(), key=str)


def messages(spark, path, files):
    schema = "message_id string, device_id string, protocol string, topic string, ts timestamp, payload string"
    for i in range(files):
        # three shapes that come back, and one new shape in every fourth file
        shape = f'{{"temp_c":{i}}}' if i % 3 else f'{{"humidity_pct":{i},"temp_c":1}}'
        extra = [] if i % 4 else [(f"x{i}", "d9", "MQTT", "t", datetime(2024, 1, 1, 1), f'{{"field_{i}_c":{i},"temp_c":2}}')]
        rows = [(f"m{i}", f"d{i % 2}", "MQTT", "t", datetime(2024, 1, 1, 1), shape), *extra]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_registry_log_is_merged_and_reads_alike(spark, tmp_path):
    feed = messages(spark, f"{tmp_path}/in", 6)
    found = {}
    for every in (2, 1000):
        out = f"{tmp_path}/{every}"
        S.stream_registry(feed, f"{out}/registry", f"{out}/data", f"{out}/state", None, datetime(2024, 1, 2), merge_every=every).awaitTermination()
        registry = S.latest_registry(spark, f"{out}/registry")
        found[every] = (sorted(map(str, registry.collect())), sorted(map(str, spark.read.parquet(f"{out}/data").drop("batch").collect())))
        log = folders.read_batches(spark, f"{out}/registry", S.LOG_SCHEMA)
        # a schema is written once, by the batch that saw it first
        assert log.count() == log.select("schema_signature").distinct().count() == registry.count()
        assert S.latest_registry(spark, f"{out}/registry", 0).count() == (0 if every == 1000 else S.latest_registry(spark, f"{out}/registry", 5).count())
    assert found[2] == found[1000] and len(found[2][0]) == 4


def tables(spark):
    folder = f"{scratch_dir(spark)}/fieldloom"
    return len(os.listdir(folder)) if os.path.isdir(folder) else 0


def test_scope_drops_its_tables(spark):
    before = tables(spark)
    with pytest.raises(ValueError), scratch_scope(spark):
        one = materialise(spark.range(3))
        with scratch_scope(spark):
            materialise(spark.range(4))
            assert tables(spark) == before + 2
        assert tables(spark) == before + 1 and one.count() == 3
        raise ValueError
    assert tables(spark) == before
    materialise(spark.range(2))
    assert tables(spark) == before + 1


def test_stream_leaves_no_scratch_tables(spark, tmp_path):
    feed = messages(spark, f"{tmp_path}/in", 20)
    before = tables(spark)
    S.run_stream(feed, f"{tmp_path}/out", f"{tmp_path}/state", None, as_of=F.col("ts")).awaitTermination()
    assert tables(spark) == before
    assert spark.read.parquet(f"{tmp_path}/out/messages").count() == 25 and len(os.listdir(f"{tmp_path}/out/messages")) == 20
