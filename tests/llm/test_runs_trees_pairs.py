"""Runs of repeated words, the prefix tree and byte pairs against brute force, the tokenizer library and odd input."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldloom.llm import bpe, period_runs, prefix_trie

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


# 11

def runs_by_force(w: list) -> list[tuple[int, int, int]]:
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                found.setdefault((i, j - i + q), q)
            i = j if j > i else i + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed_by_force(w: list[str]) -> str:
    gone = {i for start, length, q in runs_by_force(w) for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng: random.Random) -> list[int]:
    letters = rng.choice([1, 2, 3, 9, 30])
    kind = rng.randrange(7)
    base = [rng.randrange(letters) for _ in range(rng.choice([0, 11, 12, 60, 200]))]
    if kind == 0:
        return base
    if kind == 1:
        return base[:20] + ([rng.randrange(letters) for _ in range(rng.randrange(1, 40))] * 30)[:rng.randrange(12, 300)] + base[20:40]
    if kind == 2:  # breaks inside stretches of a small period
        w = ([rng.randrange(max(2, letters)) for _ in range(rng.randrange(1, 5))] * 300)[:rng.randrange(50, 200)]
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(w))
            w[i:i + rng.randrange(2)] = [w[i]] * rng.randrange(3)
        return w * rng.randrange(1, 4)
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < 250:
            a, b = b, b + a
        return b
    if kind == 4:
        return [i.bit_count() % 2 for i in range(256)]
    if kind == 5:
        return ([0] * rng.randrange(1, 100) + [1]) * 3
    return [0, 1] * rng.randrange(20, 60) + [1, 0] * rng.randrange(20, 60) + base


def found_runs(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    first = np.append(0, np.cumsum([len(w) for w in texts])).astype(np.int64)
    runs = period_runs.find_runs(np.array([x for w in texts for x in w], np.int64), first)
    out = [[] for _ in texts]
    for t, start, end, q in zip(runs.text, runs.start, runs.end, runs.period, strict=True):
        out[t].append((int(start), int(end - start), int(q)))
    return out


def test_runs_match_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        texts = [repetitive(rng) for _ in range(8)]
        assert found_runs(texts) == [runs_by_force(w) for w in texts]


def test_breaks_in_a_small_period_make_many_runs():
    w = [0, 1] * 80 + [1, 0] * 80
    runs = runs_by_force(w)
    assert len({q for _, _, q in runs}) > 50 and found_runs([w]) == [runs]


def test_runs_do_not_cross_texts():
    assert found_runs([[1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6], [], [7] * 12, [7] * 11]) == [[], [], [], [(0, 12, 1)], []]


def test_a_long_text_of_one_word_and_one_of_distinct_words():
    assert found_runs([[3] * 200_000, list(range(200_000))]) == [[(0, 200_000, 1)], []]
    w = list(range(5000)) * 2
    assert found_runs([w + [-1]]) == [[(0, 10_000, 5000)]]


def test_collapse_of_documents(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{x}" for x in repetitive(rng)) for _ in range(30)]
    rows = [*enumerate(texts), (None, None), (None, "a\x0bb  c\n" * 9), (7, ""), (7, " \t\n"), (8, "x\xa0y " * 12), (8, "x\xa0y " * 12)]
    docs = spark.createDataFrame([(i, t, i, "z", t) for i, t in rows], "doc_id bigint, text string, n_words bigint, runs string, row string")
    got = period_runs.collapse_runs(docs).collect()
    want = []
    for i, t in rows:
        w = [x for x in re.split(r"[ \x09-\x0d]+", t or "") if x]
        want.append((i, len(w), runs_by_force(w), collapsed_by_force(w)))
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted(((r.row.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    assert {r.row.n_words for r in got} == {i for i, _ in rows} and all(r.row.runs == "z" for r in got)
    assert period_runs.collapse_runs(docs.limit(0)).collect() == []


# 12

def tree_by_force(rows: list[tuple], ids: list[int] = ()) -> list[tuple]:
    talks: dict = {c: [] for c in ids}
    for c, turn, role, text in rows:
        talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: tuple((role, text) for _, _, role, text in sorted(t)) for c, t in talks.items()}
    nodes: dict = {}
    for c, t in talks.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    least = lambda members: min((c for c in members if c is not None), default=None)
    out = []
    for p, members in nodes.items():
        below = [n for n in nodes if n[:len(p)] == p]
        kids = lambda n: sum(len(m) == len(n) + 1 and m[:-1] == n for m in nodes)
        ends = sorted((c for c, t in talks.items() if t == p), key=lambda c: (c is not None, c or 0))
        out.append((len(p), least(members), least(nodes[p[:-1]]) if p else None, len(members), kids(p), sum(kids(n) == 0 for n in below),
                    sum((len(nodes[n]) - 1) * len(n[-1][1].split()) for n in below if n),
                    hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()))
    return out


def in_order(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def tree(spark, rows, ids=None, columns="conv_id bigint, turn bigint, role string, text string"):
    frame = spark.createDataFrame(rows, columns)
    nodes = prefix_trie.prefix_trie(frame, None if ids is None else spark.createDataFrame([(i,) for i in ids], "conv_id bigint"))
    return in_order(nodes.select("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def talk(rng: random.Random, c: int, words: int, most: int) -> list[tuple]:
    return [(c, i, rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randrange(words)))) for i in range(rng.randrange(1, most))]


@pytest.mark.parametrize(("narrow", "block"), [(10_000, 64), (0, 64), (10_000, 3), (0, 3), (25, 4)])
def test_tree_matches_brute_force(spark, monkeypatch, narrow, block):
    monkeypatch.setattr(prefix_trie, "NARROW_ROWS", narrow)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(narrow + block)
    rows = [r for c in range(25) for r in talk(rng, c, 2, 9)]
    rows += [(c, i, "user", f"copy {i}") for c in (600, 31, 1200, -5) for i in range(7)] + [(32, i, "user", f"copy {i}") for i in range(8)]
    assert tree(spark, rows, [3, 900, 901]) == in_order(tree_by_force(rows, [3, 900, 901]))


def test_tree_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (2, None, "", ""), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "user", "x"), (None, None, None, None), (3, 5, "us", "er x"), (3, 5, "user", " x")]
    assert tree(spark, rows) == in_order(tree_by_force(rows))
    assert tree(spark, [(None, None, None, None)]) == in_order(tree_by_force([(None, None, None, None)]))
    wide = [(*r, "k", 7, "p") for r in rows]
    assert tree(spark, wide, columns="conv_id bigint, turn bigint, role string, text string, path string, depth int, known string") == in_order(tree_by_force(rows))
    assert tree(spark, []) == []
    assert tree(spark, [], [4, 4]) == in_order(tree_by_force([], [4]))


def test_tree_of_long_conversations_and_texts(spark):
    long = [(c, i, "user", f"t{i}" if i < 140 else f"t{i} of {c}") for c in (1, 2, 3) for i in range(130 + 7 * c)]
    rows = [*long, (9, 0, "user", "word " * 200_000), (10, 0, "user", "word " * 200_000)]
    got = tree(spark, rows)
    assert got == in_order(tree_by_force(rows))


def test_ends_of_many_copies(spark):
    rows = [(c, 0, "user", "hello there") for c in range(-700, 3000, 2)]
    assert tree(spark, rows) == in_order(tree_by_force(rows))


# 13

@pytest.fixture(scope="module")
def words():
    return bpe.load(WORD_FILE), Tokenizer.from_file(WORD_FILE)


def agrees(words, texts: list[str]) -> list[str]:
    """The texts that the library encodes or decodes otherwise."""
    ours, library = words
    bad = []
    for text, raw in zip(texts, ours.encode(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        if np.frombuffer(raw, "<u4").tolist() != ids or ours.decode(raw) != library.decode(ids, skip_special_tokens=False):
            bad.append(text)
    return bad


def test_pairs_match_the_library(words):
    rng = random.Random(13)
    pool = [*"abcdefghijABC'' \t\n\x0b\x1c\x85\xa0.,!?0123éÉΣσİßǅ漢字한🙂́̀ﬁ", "<|endoftext|>", "<|startoftext|>", "<|end", "'s", "'LL", "the", "ing"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(4000)]
    assert agrees(words, texts) == []


def test_pairs_of_all_characters(words):
    assert agrees(words, [f"a{chr(c)}b" for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in (0x1C89, 0xA7CB, 0xA7DA, 0x10D50, 0x1F600, 0x2FA1D, 0xE0001, 0x10FFFF)]) == []


def test_scan_and_heap_agree(words):
    rng = random.Random(7)
    vocabulary = words[0]
    texts = ["".join(rng.choice("abcdeinrsté") for _ in range(rng.randrange(1, 90))) for _ in range(500)]
    together = vocabulary.merges.of_words(texts, vocabulary.inner, vocabulary.last)
    for text in texts:
        parts = bpe.first_parts([text], vocabulary.inner, vocabulary.last)
        assert np.frombuffer(together[text], "<u4").tolist() == vocabulary.merges.long(parts[0].tolist())


def test_long_words(words):
    rng = random.Random(2)
    assert agrees(words, ["a" * 20_000, "".join(rng.choice("abcdet") for _ in range(20_000)), "é漢" * 4000, "!" * 777, "x" * 64, "x" * 65, "word " * 60_000]) == []


def test_pairs_of_documents(spark, words, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    texts = [None, "", " \n", "Hello  wörld's <|endoftext|>x", "same same", "same same", "it's 12 o'clock"]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "i", i, "r") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, n_tokens int, row string")
    ids = bpe.encoded(docs, WORD_FILE)
    got = bpe.decoded(ids, WORD_FILE).collect()
    library = words[1]
    for r in got:
        want = library.encode(r.row.row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.row.ids, "<u4").tolist() == want and r.row.n_tokens == len(want) and r.row.row.ids == "i"
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert len(got) == len(texts) and bpe.decoded(bpe.encoded(docs.limit(0), WORD_FILE), WORD_FILE).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="not a vocabulary"):
        bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
