"""Cases that a cut of the work would lose: spread contexts, contexts below plain words, large groups near the threshold."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldloom.llm import near_dedup, suffix_tree


# 5

def scores_by_words(texts: list[str]) -> tuple[list[tuple[float, int]], set, set]:
    """Score and number of states of each text, and the retained contexts: every context is tested on its next words."""
    lists = [[*t.split(), "</end>"] for t in texts]
    count, one, two = Counter(x for w in lists for x in w), defaultdict(Counter), defaultdict(Counter)
    for w in lists:
        for i in range(1, len(w)):
            one[w[i - 1]][w[i]] += 1
            two[w[i - 2] if i > 1 else None, w[i - 1]][w[i]] += 1
    total = sum(count.values())

    def divergence(nexts, shorter):
        n, m = sum(nexts.values()), sum(shorter.values())
        return sum(k / n * math.log(k / n / (shorter[x] / m)) for x, k in nexts.items()) if n >= suffix_tree.MIN_COUNT else 0.0

    two_kept = {g for g, nexts in two.items() if divergence(nexts, one[g[1]]) >= suffix_tree.DIVERGENCE}
    plain = {s for s, nexts in one.items() if divergence(nexts, count) >= suffix_tree.DIVERGENCE}
    one_kept = plain | {g[1] for g in two_kept}
    out = []
    for w in lists:
        score, states = 0.0, 0
        for i, x in enumerate(w):
            p = (count[x] + 0.1) / (total + 0.1 * (len(count) + 1))
            if i and w[i - 1] in one_kept:
                states += 1
                p = (one[w[i - 1]][x] + suffix_tree.WEIGHT * p) / (count[w[i - 1]] + suffix_tree.WEIGHT)
                g = (w[i - 2] if i > 1 else None, w[i - 1])
                if g in two_kept:
                    p = (two[g][x] + suffix_tree.WEIGHT * p) / (sum(two[g].values()) + suffix_tree.WEIGHT)
            score += math.log10(p)
        out.append((score, states))
    return out, plain, two_kept


@pytest.mark.parametrize("block", [1 << 20, 900])
def test_contexts_are_tested_on_words(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", block)
    rng = random.Random(21)
    many = [f"w{i}" for i in range(240)]
    texts = []
    for _ in range(150):
        w = []
        for _ in range(12):
            k = rng.randrange(6)
            w += [f"head{k}", rng.choice(many[40 * k:40 * k + 40])] if rng.random() < 0.6 else ["the", rng.choice(many)]
            if rng.random() < 0.2:
                w += ["of", "the", "sea"]
        texts.append(" ".join(w))
    want, plain, two_kept = scores_by_words(texts)
    # followers in 40 words of 240, so in all of 16 hash classes; and a pair below a word that is not retained by itself
    assert {f"head{k}" for k in range(6)} <= plain and "the" not in plain and ("of", "the") in two_kept
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id bigint, text string, learn boolean").repartition(3)
    got = {r.doc_id: r for r in suffix_tree.score_texts(docs).collect()}
    for i, (score, states) in enumerate(want):
        assert (got[i].score, got[i].n_states) == (pytest.approx(score), states)


# 8

def test_large_group_around_the_threshold(spark):
    rng, texts_, width = np.random.default_rng(5), 2000, 300
    texts, table = [], np.ones((texts_, width - 4), np.float32)
    for i in range(texts_):
        w = [f"t{j}" for j in range(width)]
        # each own word breaks five shingles of the template; two texts are similar if both break at most 32
        for at in rng.choice(width, rng.integers(3, 9), replace=False):
            w[at] = f"u{i}x{at}"
            table[i, max(0, at - 4):at + 1] = 0
        texts.append(" ".join(w))
    shared = np.rint(table @ table.T).astype(int)
    parent = list(range(texts_))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [(int(a), int(b)) for a, b in np.argwhere(1000 * shared >= 800 * (2 * (width - 4) - shared)) if a < b]
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(texts_)}
    assert len(links) > 100 and len(set(want.values())) > 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()} == want


def test_suffix_tree_by_ranges_of_hashes(spark, monkeypatch):
    """Blocks, ranges and packed sums give the scores of one block, and no table holds a row for each pair of words."""
    rng = random.Random(5)
    lines = ["sing the low song now", "walk the long road home", "sing the high song now"]
    texts = [" ".join(rng.choice([*lines, f"only{i} twice{i % 40} said"]) for _ in range(rng.randint(0, 14))) for i in range(120)]
    docs = spark.createDataFrame([(i, t, i % 4 > 0) for i, t in enumerate(texts)], "doc_id bigint, text string, learn boolean").repartition(3)
    want = {r.doc_id: r for r in suffix_tree.score_texts(docs).collect()}
    written = []
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 400)
    monkeypatch.setattr(suffix_tree, "RANGE_KEYS", 50)
    keep = suffix_tree.materialise
    monkeypatch.setattr(suffix_tree, "materialise", lambda df: written.append(keep(df)) or written[-1])
    got = {r.doc_id: r for r in suffix_tree.score_texts(docs).collect()}
    assert sum(r.n_states for r in got.values()) > 100
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.n_states) == (want[i].n_tokens, want[i].n_known, want[i].train_tokens, want[i].n_states)
        assert (r.base_score, r.score) == (pytest.approx(want[i].base_score), pytest.approx(want[i].score))
    assert not any({"pair", "triple"} & {c for c, t in df.dtypes if t == "bigint"} for df in written)
