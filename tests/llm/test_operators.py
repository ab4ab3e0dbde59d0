"""The text operators against brute force, round trips and odd input."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import chat_format, decontaminate, language_id, license_scan, near_dedup, packing, quality_classifier, quality_rules, suffix_tree, url_filter
from fieldloom.llm.words import LOWER_ALNUM, flat, windows, words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NULLS = [(None, None, None, None, None), (7, None, "en", "a", 0), (8, "", None, None, 0), (9, " \n\t ", "en", "a", 4), (None, "one two", "en", "a", 7), (9, " \n\t ", "en", "a", 4)]
VOCABULARY = [f"{a}{b}{c}" for a in ("to", "re", "mi", "fa", "so") for b in ("la", "ti", "do") for c in ("n", "s", "r", "th")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def frame(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en", source, len(t)) for i, t in enumerate(texts)], DOCS)


def shingles(text: str) -> set:
    w = re.findall(r"[a-z0-9\x80-\U0010FFFF]+", text.lower())
    return ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}) if w else set()


def varied(rng: random.Random) -> list[str]:
    texts = [prose(rng, rng.randint(20, 120)) for _ in range(30)]
    for t in texts[:12]:
        for _ in range(rng.randint(1, 6)):
            w = t.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    return texts + texts[:5] + ["one two", "one two three", "One two", ""]


# words

def test_words_do_not_cross_texts():
    import pyarrow as pa

    data, offsets = flat(pa.array(["ab cd", None, "", "ef", "ab"]))
    w = words(data, offsets, LOWER_ALNUM)
    assert [bytes(data[s:e]).decode() for s, e in zip(w.start, w.end, strict=True)] == ["ab", "cd", "ef", "ab"]
    assert w.text.tolist() == [0, 0, 3, 4] and w.hash[0] == w.hash[3] and len(set(w.hash.tolist())) == 3
    assert windows(w, 2)[1].tolist() == [0] and windows(w, 2, short=True)[1].tolist() == [0, 3, 4]


# 8

def classes_by_force(texts: list[str]) -> dict[int, int]:
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        union = len(sets[i] | sets[j])
        if texts[i] == texts[j] or (union and len(sets[i] & sets[j]) / union >= 0.8):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_near_duplicates_match_brute_force(spark, weighting):
    texts = varied(random.Random(3))
    found = near_dedup.near_duplicate_classes(frame(spark, texts), weighting=weighting).collect()
    assert {r.doc_id: r.class_id for r in found} == classes_by_force(texts)
    assert sum(r.representative for r in found) == len({r.class_id for r in found})


def test_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(4)
    base = prose(rng, 200).split()
    texts = []
    for _ in range(150):
        w = list(base)
        w[rng.randrange(200)] = "changed" + str(rng.randrange(1000))
        texts.append(" ".join(w))
    assert near_dedup.near_duplicate_classes(frame(spark, texts + [prose(rng, 50)])).select("class_id").distinct().count() == 2


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    element = rng.integers(1, 1 << 62, 60, dtype=np.uint64)
    a, b = rng.integers(0, 5, 60), rng.integers(0, 5, 60)
    text = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    signature = near_dedup.dart_signatures(2, text, np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]).astype(float), 2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signature[0] == signature[1]).mean() - want) < 0.05


def test_representatives_keep_columns(spark):
    docs = spark.createDataFrame(NULLS, DOCS).withColumn("_key", F.lit(1)).withColumn("key", F.lit("x")).withColumn("class_id", F.lit(0))
    kept = near_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns and kept.count() == 3 and kept.where("_key = 1 and key = 'x'").count() == 3
    assert near_dedup.keep_representatives(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    roots = {r.node: r.root for r in near_dedup.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, 101: 100}


# 10

def test_line_rules_match_brute_force(spark):
    rng = random.Random(5)
    common, rows = [prose(rng, 8) for _ in range(4)], []
    for i in range(80):
        lines = [prose(rng, 12) for _ in range(rng.randint(1, 5))] + rng.sample(common, rng.randint(0, 4))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", rng.choice("ab"), 0))
    rows += [(100 + i, common[0] + "\n" + common[1] + f"\n{i}", "en", "a", 0) for i in range(12)] + rows[:10]
    got = quality_rules.judge(spark.createDataFrame(rows, DOCS), max_documents=10, min_kept=0.3).collect()
    held: dict = {}
    norm = lambda line: re.sub("[0-9]", "0", line.lower()).strip()
    for host, text in {(r[3], r[1]) for r in rows}:
        for h in {norm(x) for x in text.split("\n")}:
            held.setdefault((host, h), set()).add(hashlib.md5(text.encode()).digest())
    over = {k: min(v) for k, v in held.items() if len(v) > 10}
    assert over and any(r.removed for r in got)
    for r in got:
        text, host = r.row.text, r.row.source
        distinct = {(norm(x), len(x)) for x in text.split("\n")}
        gone = sum(n for h, n in distinct if (host, h) in over and over[host, h] != hashlib.md5(text.encode()).digest())
        share = 1 - gone / sum(n for _, n in distinct)
        assert abs(share - r.kept_share) < 1e-9
        assert r.kept == (share >= 0.3 and not r.base_failed)


def test_statistics_match_brute_force(spark):
    rng = random.Random(6)
    texts = ["a b c a b c", "a a a a", "x", "", "é#*\x0b$ %\n\n x\nx \nx", "a b c d a b c\rz"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    for r in quality_rules.document_statistics(frame(spark, texts)).collect():
        w = [x for x in re.split("[\x20\x09-\x0d]+", r.text) if x]
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in r.text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines))), r.text
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text))


def test_cleaning_keeps_columns_and_odd_rows(spark):
    docs = spark.createDataFrame([*NULLS, (1, "word " * 3 + " ".join(VOCABULARY), "en", None, 0)], DOCS).withColumn("kept", F.lit(5)).withColumn("removed", F.lit("x")).withColumn("n_words", F.lit(1))
    out = quality_rules.clean_documents(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]
    assert quality_rules.clean_documents(docs.limit(0)).count() == 0


def test_lines_above_the_limit_are_removed(spark):
    rng = random.Random(7)
    texts = [prose(rng, 60) + "\nshared line here\n\n" + prose(rng, 10) for _ in range(6)]
    out = {r.doc_id: r for r in quality_rules.clean_documents(frame(spark, texts), max_documents=3).collect()}
    assert len(out) == 6 and sum("shared" in r.text for r in out.values()) == 1
    assert all(r.n_chars == len(r.text) for r in out.values())


# 1

def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    evidence, transitions, text = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([0, 0, 0, 1, 1])
    forward, backward = quality_classifier.messages(evidence, text, transitions)
    got = quality_classifier.probability(forward + backward)
    for at in (range(0, 3), range(3, 5)):
        total, good = 0.0, np.zeros(len(at))
        for labels in itertools.product((0, 1), repeat=len(at)):
            p = math.exp(sum(evidence[i] * y for i, y in zip(at, labels, strict=True)) + sum(transitions[a, b] for a, b in itertools.pairwise(labels)))
            total += p
            good += p * np.array(labels)
        assert np.allclose(good / total, got[list(at)])


def noisy(rng: random.Random, bad: bool) -> str:
    return "\n".join(("** " + prose(rng, 8).replace(" ", "### ").upper() if bad else prose(rng, 8).capitalize() + ".") for _ in range(rng.randint(1, 6)))


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(8)
    rows = [(i, noisy(rng, i % 4 == 0), "en", "a", 0) for i in range(300)]
    docs = spark.createDataFrame([*rows, *NULLS], DOCS).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    scored = quality_classifier.score_lines(docs, quality_classifier.train(docs, labels, limit=120)).collect()
    assert len(scored) == 306 and all(0 <= r.score <= 1 for r in scored)
    assert all(r.score == 0 and r.n_lines == 0 for r in scored if not (r.row.text or "").strip())
    assert all((r.score >= 0.5) == (r.row.doc_id % 4 > 0) for r in scored if r.row.doc_id is not None and zlib.crc32(str(r.row.doc_id).encode()) % 3 == 1 and (r.row.text or "").strip())
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality_classifier.keep_good(docs.limit(0), labels).count() == 0


def test_classifier_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    docs = frame(spark, ["a line\nanother"])
    assert quality_classifier.score_lines(docs, quality_classifier.train(docs, labels)).first().score == pytest.approx(0.5)


# 4

def test_containment_matches_brute_force(spark):
    rng = random.Random(9)
    items = [prose(rng, rng.randint(3, 60)) for _ in range(25)] + ["", "one"]
    texts = [prose(rng, rng.randint(5, 400)) for _ in range(40)]
    for i in range(20):
        w, item = texts[i].split(), rng.choice(items[:25]).split()
        if rng.random() < 0.5 and len(item) > 12:
            item = item[:-rng.randint(1, 4)]
        at = rng.randrange(len(w))
        texts[i] = " ".join(w[:at] + item + w[at:]).upper()
    texts.append(" ".join(items))
    benchmark = spark.createDataFrame([*enumerate(items), (None, None)], "item_id bigint, text string")
    docs = frame(spark, texts)
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contaminated(docs, benchmark).collect()}
    sets = [shingles(x) if len(x.split()) >= 5 else set() for x in items]
    want = {(d, i): len(s & shingles(t)) / len(s) for d, t in enumerate(texts) for i, s in enumerate(sets) if s and len(s & shingles(t)) / len(s) >= 0.8}
    assert want and got == pytest.approx(want)
    clean = decontaminate.keep_clean(docs.withColumn("_contaminated", F.lit(1)), benchmark)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_items_in_a_document_of_many_pieces(spark):
    rng = random.Random(10)
    items = [prose(rng, 40) for _ in range(120)]
    docs = frame(spark, [" ".join(items), prose(rng, 30)])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert decontaminate.contaminated(docs, benchmark).where("doc_id = 0").count() == 120


def test_large_items_are_found(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**9)}"
    items = [[word() for _ in range(n + 4)] for n in (9000, 9000, 5000, 1500, 1025, 1024, 700)]
    docs, want = [], set()
    for i, item in enumerate(items):
        for share in (0.85, 0.7):
            n = len(item) - 4
            at = rng.randrange(max(1, int(n * (1 - share))))
            docs.append(" ".join([*(word() for _ in range(300)), *item[at:at + math.ceil(share * n) + 4], *(word() for _ in range(300)), *(items[-1][:200] if i < 6 else [])]))
            if share > 0.8:
                want.add((len(docs) - 1, i))
    docs.append(" ".join(x for item in items for x in item))
    want |= {(len(docs) - 1, i) for i in range(len(items))}
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id int, text string")
    got = decontaminate.contaminated(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.item_size == len(items[r.item_id]) - 4 for r in got)


def test_containment_of_nothing(spark):
    docs, benchmark = spark.createDataFrame(NULLS, DOCS), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, benchmark).count() == 0
    assert decontaminate.keep_clean(docs, benchmark).count() == len(NULLS)
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")).count() == 0


# 6

@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_packing_round_trip(spark, vocabulary):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    texts = [prose(rng, rng.choice([1, 5, 40, 300, 3000])) for _ in range(40)] + ["a  b", " a", "a ", "x\n y", "x \n\n y  z", "it's  <|endoftext|> don't", "　 é ü x", "a\0b c"]
    docs = spark.createDataFrame([*((i, t, "en", "a", 0) for i, t in enumerate(texts)), *NULLS, NULLS[-1]], DOCS)
    packed = packing.pack(packing.tokenised(docs, vocabulary, end_id=1)).collect()
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    for i, t in enumerate(texts):
        if i in (7, 8, 9):
            continue
        own = sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own])
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and all(r.doc_tokens == len(ids) for r in own)
    places: dict = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(packed) - sum(r.doc_id in range(len(texts)) for r in packed) == 2
    assert packing.pack(packing.tokenised(docs.limit(0), vocabulary, end_id=1)).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(2)
    demand = np.bincount(rng.integers(1, 64, 5000), minlength=65)[1:]
    demand[63] = 0
    made = packing.plan(demand, 64)
    assert made.sequences <= 1.01 * math.ceil((demand * np.arange(1, 65)).sum() / 64) + 1
    value, counts = packing.knapsack(np.array([1.0, 2.5, 3.0]), 7)
    assert value == pytest.approx(8.5) and (counts * [1, 2, 3]).sum() <= 7


# 3

def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\n", "\\", "\\.", "<\\.|end|>", "", None, "<<|end|>", "[[INST]", "\\n"]
    rows = [(c, i, role, text) for c, order in enumerate(itertools.product(range(len(hard)), repeat=2)) for i, (role, text) in enumerate([("user", hard[order[0]]), ("assistant", hard[order[1]])])]
    rows += [(1000, 0, None, "x"), (1000, 1, "to\nol\\n", "y"), (None, None, "user", "z"), (None, 1, "assistant", "q"), (None, 1, "assistant", "q")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("state", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, role or "", text or "") for cc, t, role, text in rows if cc == c))
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()), own
    assert got[0].valid and not got[1000].valid and not got[None].valid
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_chat_machine(spark):
    orders = {0: "sua", 1: "ua", 2: "uaua", 3: "u", 4: "au", 5: "suu", 6: "s", 7: "uas"}
    names = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(c, i, names[x], "t") for c, o in orders.items() for i, x in enumerate(o)]
    got = chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    assert {r.conv_id for r in got if r.valid} == {0, 1, 2}


# 9

def test_license_scan(spark):
    texts = [
        "x MIT License y\nReleased under the MIT License.", "Licensed under the Apache License Version 2", "Mit\nlicense", "rights reserved all", "all rights kept",
        "This program is free software; you can redistribute it and/or modify it\nunder the terms of the GNU General Public License as published by\nthe Free Software Foundation", "CC BY-NC 4.0 licensed under.", "", "licensed under the",
    ]
    docs = spark.createDataFrame([*((i, t, "en", "a", 0) for i, t in enumerate(texts)), *NULLS], DOCS).withColumn("labels", F.lit(1)).withColumn("n_words", F.lit(1))
    got = {r.row.doc_id: r for r in license_scan.scan(docs).collect() if r.row.doc_id not in (7, 8, 9, None)}
    assert [(got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels) for i in range(7)] == [
        (2, 1, 7, "mit", "mit"), (1, 3, 3, "apache", "apache"), (1, 0, 0, "mit", "mit"), (0, None, None, "", "reserved"), (0, None, None, "", ""),
        (1, 19, 19, "gpl", "gpl"), (0, None, None, "", "cc-by-nc")]
    assert got[0].score == 1 and got[2].score == license_scan.NAMED and got[4].score == 0
    assert license_scan.scan(docs).count() == len(texts) + len(NULLS)


def test_license_blocks_match_brute_force(spark):
    rng = random.Random(12)
    entries = [(f"l{i}", f"t{i}", "line", prose(rng, rng.randint(1, 20))) for i in range(16)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(entries)[3].split() + prose(rng, rng.randint(0, 6)).split()
            rng.shuffle(w)
            lines.append(" ".join(w[rng.randint(0, 3):]))
        texts.append("\n".join(lines))
    got = license_scan.scan(frame(spark, texts), entries=entries).collect()
    for r in got:
        want = sorted((x.name, b) for x in license_scan.templates(entries) for b, line in enumerate(r.row.text.split("\n")) if len(set(x.tokens) & set(line.split())) >= (len(x.tokens) if len(x.tokens) < 10 else 0.8 * len(x.tokens) - 1e-9))
        assert sorted(m.name for m in r.matches) == [n for n, _ in want]


# 7

def test_language_words_first_then_shorter_grams():
    from collections import Counter

    model = language_id.build({"aa": Counter({"river": 5, "house": 2}), "bb": Counter({"fluss": 5, "haus": 2})})
    assert model.word("river").argmax() == 0 and model.word("fluss").argmax() == 1
    assert model.word("rivet").argmax() == 0 and model.word("hausen").argmax() == 1
    assert not model.word("qqqq").any()


def test_language_of_odd_texts(spark):
    rows = [(i, "the river runs to the sea" if i % 2 else "der fluss zieht in das meer", "en" if i % 2 else "de", "a", 0) for i in range(40)]
    docs = spark.createDataFrame([*rows, *NULLS, (50, "123 !? 4", "en", "a", 0), (51, "RIVER SEA", None, None, 0)], DOCS).withColumn("score", F.lit("x"))
    got = language_id.identify(docs, language_id.train(docs, limit=10)).collect()
    assert len(got) == 48 and all(r.lang_pred == r.row.lang for r in got if r.row.doc_id is not None and r.row.doc_id < 40 and (r.row.text or "").strip())
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if not re.search("[a-z]", (r.row.text or "").lower()))
    assert next(r for r in got if r.row.doc_id == 51).lang_pred == "en"
    nothing = language_id.identify(docs, language_id.train(docs.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


# 2

def test_intervals_and_verdicts_match_brute_force(spark):
    rng = random.Random(13)
    day, patterns = 86_400, [("domain", "a.example"), ("domain", "x.a.example"), ("prefix", "a.example/p"), ("prefix", "x.a.example/"), ("prefix", "a.example/p/q")]
    entries = [(rng.choice(["block", "allow", "adult"]), *rng.choice(patterns), rng.choice(["add", "add", "remove"]), rng.randrange(120) * day) for _ in range(120)]
    entries += entries[:10] + [(None, "domain", "a.example", "add", 0), ("block", "domain", "a.example", "keep", 0), ("block", "domain", None, "add", 0)]
    urls = ["http://a.example/p/q?x=1", "https://x.a.example/p", "http://www.a.example", "https://b.example/p", "nonsense", None, "HTTP://A.example/p/"]
    captures = [(i, rng.choice(urls), rng.choice([None, *range(0, 130 * day, day // 2)])) for i in range(200)]
    got = url_filter.evaluate(spark.createDataFrame(captures, "page_id bigint, url string, fetched_at bigint").withColumn("host", F.lit(1)), spark.createDataFrame(entries, "list string, kind string, pattern string, action string, at bigint")).collect()
    assert len(got) == 200
    good = [e for e in set(entries) if None not in e and e[3] in ("add", "remove")]
    for r in got:
        url, t = r.row.url or "", r.row.fetched_at
        m = re.match(r"https?://(?:www\.)?([^/?#]+)/?([^?#]*)", url, re.IGNORECASE)
        active = []
        if m and t is not None:
            host, path = m[1].lower(), m[2].strip("/")
            for key in {e[:3] for e in good}:
                said = max(((e[4], e[3]) for e in good if e[:3] == key and e[4] <= t), default=(0, ""))[1]
                covers = host == key[2] or host.endswith("." + key[2]) if key[1] == "domain" else (host + "/" + path + "/").startswith(key[2].rstrip("/") + "/")
                if said == "add" and covers:
                    active.append((-len(key[2]), key[0] != "allow", key[0], key[1], key[2]))
        best = min(active, default=None)
        assert (r.n_active, r.list, r.pattern, r.blocked) == (len(active), best and best[2], best and best[4], bool(best and best[1])), (r, active)


def test_urls_without_entries(spark):
    captures = spark.createDataFrame([(1, "http://a.example", 5), (2, None, None)], "page_id bigint, url string, fetched_at bigint")
    entries = spark.createDataFrame([], "list string, kind string, pattern string, action string, at bigint")
    assert [r.blocked for r in url_filter.evaluate(captures, entries).collect()] == [False, False]
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0


# 5

def tree_by_force(texts: list[str], learn: list[bool]) -> list[tuple[int, float, float]]:
    from collections import Counter, defaultdict

    cut = lambda t: [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x] + ["</end>"]
    count: Counter = Counter()
    one, two = defaultdict(Counter), defaultdict(Counter)
    for t, use in zip(texts, learn, strict=True):
        if use:
            w = cut(t)
            count.update(w)
            for i in range(1, len(w)):
                one[w[i - 1]][w[i]] += 1
                two[w[i - 2] if i > 1 else None, w[i - 1]][w[i]] += 1
    total, distinct = sum(count.values()), len(count)

    def apart(nexts, shorter) -> bool:
        n, m = sum(nexts.values()), sum(shorter.values())
        return n >= suffix_tree.MIN_COUNT and sum(k * math.log(k / n / (shorter[x] / m)) for x, k in nexts.items()) >= suffix_tree.DIVERGENCE * n - 1e-9

    kept2 = {g for g, nexts in two.items() if apart(nexts, one[g[1]])}
    # a context stays if a longer one below it does
    kept1 = {s for s, nexts in one.items() if apart(nexts, count)} | {g[1] for g in kept2}
    out = []
    for t in texts:
        w, score, base = cut(t), 0.0, 0.0
        for i, x in enumerate(w):
            p = (count[x] + 0.1) / (total + 0.1 * (distinct + 1))
            base += math.log10(p)
            if i and w[i - 1] in kept1:
                p = (one[w[i - 1]][x] + suffix_tree.WEIGHT * p) / (sum(one[w[i - 1]].values()) + suffix_tree.WEIGHT)
                g = (w[i - 2] if i > 1 else None, w[i - 1])
                if g in kept2:
                    p = (two[g][x] + suffix_tree.WEIGHT * p) / (sum(two[g].values()) + suffix_tree.WEIGHT)
            score += math.log10(p)
        out.append((len(w), base, score))
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_suffix_tree_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", block)
    rng = random.Random(14)
    chorus = ["Sing the low song", "walk the long road home", "sing the high song"]
    texts = [" ".join(rng.choice([*chorus, prose(rng, 2)]) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    learn = [i % 5 > 0 for i in range(80)]
    docs = spark.createDataFrame(list(zip(range(80), texts, learn, strict=True)), "doc_id bigint, text string, learn boolean").repartition(3)
    got = {r.doc_id: r for r in suffix_tree.score_texts(docs.withColumn("block", F.lit(1))).collect()}
    want = tree_by_force(texts, learn)
    assert sum(r.n_states for r in got.values()) > 100 and any(abs(w[1] - w[2]) > 1 for w in want)
    for i, (n, base, score) in enumerate(want):
        assert (got[i].n_tokens, got[i].base_score, got[i].score) == (n, pytest.approx(base), pytest.approx(score)), texts[i]


def test_suffix_tree_of_odd_rows(spark):
    rows = [(None, None, None), (1, None, True), (1, None, True), (2, "", False), (3, "a b", None)]
    got = suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string, learn boolean")).collect()
    assert len(got) == 5 and {r.train_tokens for r in got} == {2}
    assert suffix_tree.score_texts(spark.createDataFrame([(3, "a b", False)], "doc_id bigint, text string, learn boolean")).first().train_tokens == 0
    assert suffix_tree.score_texts(spark.createDataFrame([], "doc_id bigint, text string, learn boolean")).count() == 0
