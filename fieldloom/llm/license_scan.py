"""Operator 9: license notices by an exact set-similarity join with prefix, length and positional filters.

Templates are sets of words. Their words are ordered by how many documents of the
corpus hold them, rarest first. A block that holds at least a given share of a
template's words must hold one of the first few (the prefix), must have enough
words (length), and must have enough template words left from the first match on
(position). Blocks that pass are compared exactly, so every block that meets the
threshold is found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import per_portion
from fieldloom.llm.words import LOWER_ALNUM, flat, hash_of, words

CONTAINMENT = 0.8
# A template of fewer words must be held whole: one word tells short notices apart.
SHORT = 10
# What a document scores that names a license but holds no notice.
NAMED = 0.5

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices by label, name and block. A line is text between line feeds, a section text between blank lines.
TEMPLATES = [
    ("mit", "mit-short", "line", "Released under the MIT License."),
    ("mit", "mit-licensed", "line", "Licensed under the MIT License."),
    ("mit", "mit-grant", "section", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "apache-short", "line", "Licensed under the Apache License, Version 2.0."),
    ("apache", "apache-notice", "section", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "gpl-short", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "gpl-notice", "section", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "bsd-notice", "section", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "cc-by-nc-short", "line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "cc-by-sa-short", "line", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "cc-by-notice", "line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl", "mpl-notice", "section", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "reserved-short", "line", "All rights reserved."),
]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Template:
    label: str
    name: str
    block: str
    tokens: tuple[str, ...]


def templates(entries: list[tuple[str, str, str, str]] | None = None) -> list[Template]:
    """Templates from (label, name, block, text) entries; a text's tokens are its distinct words."""
    import re

    cut = lambda text: tuple(sorted(set(re.findall(r"[a-z0-9\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))))
    return [Template(label, name, block, cut(text)) for label, name, block, text in (TEMPLATES if entries is None else entries)]


def needed(template: Template, containment: float = CONTAINMENT) -> int:
    """How many of a template's words a block must hold."""
    size = len(template.tokens)
    return size if size < SHORT else math.ceil(containment * size - 1e-9)


class _Vocabulary:
    """Positions of some hashes, with a small bit table in front."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where values are known, and the position of each in the given hashes."""
        at = np.flatnonzero(self.bits[(values & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.sorted, values[at]), max(0, len(self.sorted) - 1))
        same = self.sorted[place] == values[at] if len(self.sorted) else np.zeros(0, bool)
        return at[same], self.order[place[same]] if len(self.sorted) else place[:0]


def _words(column: pa.Array):
    data, offsets = flat(column)
    data = _LOWER[data]
    return data, words(data, offsets, LOWER_ALNUM)


def document_frequency(docs: DataFrame, tokens: list[str], text: str = "text") -> dict[str, int]:
    """In how many rows of ``docs`` each token stands. The driver gets one row for each token."""
    known = _Vocabulary(hash_of(tokens)) if tokens else None

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, w = _words(batch.column("text"))
        at, token = known.find(w.hash)
        pairs = np.unique(w.text[at] * len(tokens) + token)
        n = np.bincount(pairs % len(tokens), minlength=len(tokens))
        seen = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["token", "n"])

    if not tokens:
        return {}
    rows = docs.select(F.col(text).alias("text")).mapInArrow(per_portion(count), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {t: 0 for t in tokens} | {tokens[r.token]: r.n for r in rows}


def scan(docs: DataFrame, text: str = "text", entries: list[tuple[str, str, str, str]] | None = None, phrases: dict[str, str] | None = None, containment: float = CONTAINMENT,
         carry: list[str] | None = None) -> DataFrame:
    """Rows (row, n_words, n_base, first_word, last_word, base_labels, labels, score, matches).

    ``row`` is the whole input row, or its columns to carry. Words are runs of letters, digits and characters beyond ASCII, capitals A-Z lowered.
    n_base counts the places where a phrase begins, first_word and last_word are the smallest and largest (words counted
    from 0). ``matches`` has, for each block and template it meets, name, label, first_word, last_word and containment.
    A template of fewer than SHORT words has to be held whole. score is the largest containment found, NAMED for a document with a phrase only, else 0. A null text is an empty one.
    """
    chosen = templates(entries)
    named = PHRASES if phrases is None else phrases
    tokens = sorted({t for x in chosen for t in x.tokens})
    frequency = document_frequency(docs, tokens, text)
    tokens.sort(key=lambda t: (frequency[t], t))  # global order, rarest first
    rank = {t: i for i, t in enumerate(tokens)}
    ordered = [sorted(rank[t] for t in x.tokens) for x in chosen]
    need = [needed(x, containment) for x in chosen]
    prefixes = sorted({r for x, n in zip(ordered, need, strict=True) for r in x[:len(x) - n + 1]})
    token_hash = hash_of(tokens) if tokens else np.zeros(0, np.uint64)
    all_known, first_known = _Vocabulary(token_hash), _Vocabulary(token_hash[prefixes] if prefixes else token_hash[:0])
    phrase_hash = [(hash_of(p.split(" ")), label) for p, label in named.items()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def matched(data: np.ndarray, w, kind: str) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, last word, containment) of the blocks of a kind."""
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 0x0A, out=breaks[1:])
        gap = breaks[w.start[1:]] - breaks[w.end[:-1]]
        block = np.append(0, np.cumsum((gap >= (1 if kind == "line" else 2)) | (w.text[1:] != w.text[:-1])))
        rare, _ = first_known.find(w.hash)
        held = np.unique(block[rare])  # blocks with a word of some prefix
        if not len(held):
            return []
        inside = np.zeros(block[-1] + 1, bool)
        inside[held] = True
        at = np.flatnonzero(inside[block])
        own, value = block[at], w.hash[at]
        size_order = np.lexsort((value, own))
        fresh = np.append(True, (value[size_order][1:] != value[size_order][:-1]) | (own[size_order][1:] != own[size_order][:-1]))
        distinct = np.bincount(own[size_order][fresh], minlength=block[-1] + 1)
        found, token = all_known.find(value)
        pairs = np.unique(own[found] * len(tokens) + token)
        pair_block, pair_token = pairs // len(tokens), pairs % len(tokens)
        begin, stop = np.searchsorted(block, np.arange(block[-1] + 1)), np.searchsorted(block, np.arange(block[-1] + 1), side="right")
        out = []
        for k, x in enumerate(chosen):
            if x.block != kind:
                continue
            position = np.full(len(tokens), -1)
            position[ordered[k]] = np.arange(len(ordered[k]))
            mine = position[pair_token] >= 0
            blocks, places = pair_block[mine], position[pair_token[mine]]
            if not len(blocks):
                continue
            heads = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
            for h, e in zip(heads, np.append(heads[1:], len(blocks)), strict=True):
                b, first = blocks[h], places[h]  # pairs are in global order, so the first match comes first
                if first > len(ordered[k]) - need[k] or distinct[b] < need[k] or e - h < need[k]:
                    continue  # prefix, length, position
                out.append((int(w.text[begin[b]]), k, int(begin[b]), int(stop[b]) - 1, (e - h) / len(ordered[k])))
        return out

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, w = _words(batch.column("text"))
        n = batch.num_rows
        base = [(p, label) for hashes, label in phrase_hash for p in _places(w, hashes)]
        results = [{"n_base": 0, "first": None, "last": None, "base": set(), "labels": set(), "score": 0.0, "matches": []} for _ in range(n)]
        for place, label in base:
            r, at = results[w.text[place]], int(place - w.first[w.text[place]])
            r["n_base"] += 1
            r["first"] = at if r["first"] is None else min(at, r["first"])
            r["last"] = at if r["last"] is None else max(at, r["last"])
            r["base"].add(label)
            r["score"] = NAMED
        if len(w.hash) and tokens:
            for kind in sorted({x.block for x in chosen}):
                for t, k, begin, stop, share in matched(data, w, kind):
                    r, head = results[t], int(w.first[t])
                    r["labels"].add(chosen[k].label)
                    r["score"] = max(r["score"], share)
                    r["matches"].append({"name": chosen[k].name, "label": chosen[k].label, "first_word": begin - head, "last_word": stop - head, "containment": share})
        return pa.RecordBatch.from_arrays([
            batch.column("row"), pa.array(np.diff(w.first).astype(np.int64)), pa.array([r["n_base"] for r in results], pa.int64()), pa.array([r["first"] for r in results], pa.int64()),
            pa.array([r["last"] for r in results], pa.int64()), pa.array([",".join(sorted(r["base"])) for r in results], pa.string()),
            pa.array([",".join(sorted(r["base"] | r["labels"])) for r in results], pa.string()), pa.array([r["score"] for r in results], pa.float64()),
            pa.array([r["matches"] for r in results], match)], ["row", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    fields = [("name", T.StringType(), pa.string()), ("label", T.StringType(), pa.string()), ("first_word", T.LongType(), pa.int64()), ("last_word", T.LongType(), pa.int64()), ("containment", T.DoubleType(), pa.float64())]
    match = pa.list_(pa.struct([(n, a) for n, _, a in fields]))
    schema = T.StructType([rows.schema["row"]])
    for name, kind in [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]:
        schema = schema.add(name, kind)
    schema = schema.add("matches", T.ArrayType(T.StructType([T.StructField(n, t) for n, t, _ in fields])))
    return rows.mapInArrow(per_portion(work), schema)


def _places(w, phrase: np.ndarray) -> np.ndarray:
    """First words of all runs of words that equal the phrase, within one text."""
    n = len(w.hash) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(w.hash[:n] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[(w.hash[at + j] == phrase[j]) & (w.text[at + j] == w.text[at])]
    return at
