"""The pipeline as a whole, against a brute-force version of its stages, and the registered queries on small tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import DOCS, VOCABULARY, classes_by_force, prose, shingles

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def lines(rng: random.Random, n: int) -> str:
    return "\n".join(prose(rng, 12).capitalize() + "." for _ in range(n))


def corpus(rng: random.Random) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Documents, labels and benchmark with every kind of row that a stage has to remove."""
    items = [prose(rng, 30) for _ in range(6)]
    texts, good = [], []
    for i in range(120):
        kind = i % 6
        if kind == 0:  # symbols: bad
            texts.append("\n".join(" ".join(w + "***" for w in prose(rng, 12).upper().split()) for _ in range(6)))
        elif kind == 1:  # too short
            texts.append(prose(rng, 20))
        elif kind == 2:  # repeats itself
            texts.append((prose(rng, 10) + " ") * 9)
        elif kind == 3 and i % 4 == 1:  # holds an item
            texts.append(lines(rng, 8) + "\n" + rng.choice(items))
        else:
            texts.append(lines(rng, rng.randint(6, 40)))
        good.append(kind > 0)
    for i in range(4, 60, 6):  # near copies, and exact ones
        w = texts[i].split(" ")
        w[3] = rng.choice(VOCABULARY)
        texts += [" ".join(w), texts[i]]
        good += [True, True]
    docs = [(i, t, "en", rng.choice("ab"), len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None), (500, "", "en", "a", 0)]
    return docs, [(i, int(g), 0) for i, g in enumerate(good) if i % 4 < 3], [(i, t) for i, t in enumerate(items)]


def test_pipeline_matches_brute_force(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    docs, labels, items = corpus(random.Random(21))
    folder = str(tmp_path)
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")

    texts = {i: t for i, t, *_ in docs if t}
    ruled = {}
    for i, t in texts.items():  # no line stands in a hundred documents of a source, so none is removed
        w = t.split()
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w):
            ruled[i] = t
    clean = {i: t for i, t in ruled.items() if "***" not in t}
    order = sorted(clean)
    found = classes_by_force([clean[i] for i in order])
    single = {order[c]: clean[order[c]] for c in set(found.values())}
    sets = [shingles(t) for _, t in items]
    kept = {i: t for i, t in single.items() if not any(len(s & shingles(t)) >= 0.8 * len(s) for s in sets)}
    assert len(texts) > len(ruled) > len(clean) > len(single) > len(kept) > 20

    stages, current = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, folder)
        assert current.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        stages[name] = {r.doc_id: r.text for r in current.collect()}
    assert stages == {"quality_rules": ruled, "quality_classifier": clean, "near_dedup": single, "decontamination": kept}

    from tokenizers import Tokenizer

    packed = corpus_pipeline.run(spark, folder).collect()
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids: dict[int, bytes] = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    assert {i: np.frombuffer(x, "<u4").tolist() for i, x in ids.items()} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in kept.items()}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    for name, schema in (("documents", DOCS), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_each_operator_has_a_query():
    names = queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert {n for n in oracle_sql() if n.startswith("op")} == {"op2_url_filter", "op3_chat_format", "op9_license_scan", "op10_quality_rules", "op11_period_runs", "op12_prefix_trie"}


def test_held_out_accuracy(spark):
    """Quality and language on the given documents that were not learned from."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    quality = [r for r in queries()["op1_quality_classifier"](spark, FOLDER).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in quality)
    tested = [r for r in quality if r.held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in tested) >= 0.9 * len(tested)
    language = [r for r in queries()["op7_language_id"](spark, FOLDER).collect() if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in language) >= 0.95 * len(language)
