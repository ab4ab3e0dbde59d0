"""Operator 7: language identification, words first, then shorter and shorter character n-grams.

A word seen in training counts with the log of its frequency in each language.
Any other word counts with its character n-grams of the longest length of which
at least one was seen. A document's language is the one with the largest sum.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import held_out, materialise, per_portion
from fieldloom.llm.words import LOWER_ALNUM, flat, words

# Documents that the model is fitted on, at most; the first by hash of the id.
TRAINING_DOCUMENTS = 4000
LONGEST = 4
SMOOTHING = 0.5
# Scored words that a task remembers.
REMEMBERED = 150_000
UNDETERMINED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def _marked(word: str, n: int) -> str:
    """The word with its ends marked; single characters are counted without."""
    return f"^{word}$" if n > 1 else word


@dataclass
class Model:
    """Languages, and tables of words and of n-grams: the place of each, and its log frequency per language there."""

    languages: list[str]
    words: tuple[dict[str, int], np.ndarray]
    grams: list[tuple[dict[str, int], np.ndarray]]  # by length, from 1

    def word(self, run: str) -> np.ndarray:
        place, logs = self.words
        if run in place:
            return logs[place[run]]
        for n in range(len(self.grams), 0, -1):
            (place, logs), marked = self.grams[n - 1], _marked(run, n)
            found = [p for i in range(len(marked) - n + 1) if (p := place.get(marked[i:i + n])) is not None]
            if found:
                return logs[found].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)


def _logs(counts: dict[str, Counter], languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    everything = sorted(set().union(*counts.values())) if counts else []
    totals = [sum(counts[x].values()) + SMOOTHING * (len(everything) + 1) for x in languages]
    logs = [[math.log((counts[x][k] + SMOOTHING) / t) for x, t in zip(languages, totals, strict=True)] for k in everything]
    return {k: i for i, k in enumerate(everything)}, np.array(logs, np.float32).reshape(len(everything), len(languages))


def build(counts: dict[str, Counter]) -> Model:
    """A model from word counts per language. n-grams are counted once for each distinct word."""
    languages = sorted(counts)
    grams = []
    for n in range(1, LONGEST + 1):
        own = {x: Counter(m[i:i + n] for w in counts[x] for m in [_marked(w, n)] for i in range(len(m) - n + 1)) for x in languages}
        grams.append(_logs(own, languages))
    return Model(languages, _logs(counts, languages), grams)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = TRAINING_DOCUMENTS) -> Model:
    """Fit on at most ``limit`` documents that have a language and are not held out (crc32 of the id mod 5 is 0)."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id, 5, 0))
    keys = materialise(usable.select(F.col(doc_id).alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    chosen = usable.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(keys), "doc_id", "left_semi")

    def count(batches):
        for batch in batches:
            tally: Counter = Counter()
            for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                tally.update((x, w) for w in _LETTERS.findall(t))
            rows = list(tally)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string()), pa.array([tally[r] for r in rows], pa.int64())], ["lang", "word", "n"])

    table = chosen.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    counts: dict[str, Counter] = {}
    for x, w, n in zip(table["lang"], table["word"], table["n"], strict=True):
        counts.setdefault(x, Counter())[w] = n
    return build(counts)


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows (row, lang_pred, score): the row's columns, or those to carry, as a struct, its language and that language's share of the likelihood.

    A text that is null or holds no letter is ``und`` with score 0, as is every text if no language was learned. Of equal
    sums the language first in the alphabet is taken.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    known: dict[int, bytes] = {}  # by hash of the word; NaN without a letter

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        width, n = len(own.languages), batch.num_rows
        data, offsets = flat(batch.column("text"))
        w = words(data, offsets, LOWER_ALNUM)
        distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(known) > REMEMBERED:
            known.clear()
        raw, nothing, order = data.tobytes(), np.full(width, np.nan, np.float32).tobytes(), distinct.tolist()
        for h, at in zip(order, first.tolist(), strict=True):
            if h not in known:
                runs = _LETTERS.findall(raw[w.start[at]:w.end[at]].decode("utf-8", "ignore"))
                known[h] = np.sum([own.word(r) for r in runs], axis=0, dtype=np.float32).tobytes() if runs else nothing
        values = np.frombuffer(b"".join(known[h] for h in order), np.float32).astype(float).reshape(len(order), width)
        letters = ~np.isnan(values).any(axis=1)
        values = np.where(letters[:, None], values, 0.0)
        sums = np.column_stack([np.bincount(w.text, values[inverse, j], n) for j in range(width)]) if width else np.zeros((n, 1))
        some = (np.bincount(w.text, letters[inverse], n) > 0) & (width > 0)
        best = sums.argmax(axis=1)
        share = 1 / np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -700)).sum(axis=1)
        names = [own.languages[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(np.where(some, share, 0.0))], ["row", "lang_pred", "score"])

    return rows.mapInArrow(per_portion(work), T.StructType([rows.schema["row"]]).add("lang_pred", "string").add("score", "double"))
