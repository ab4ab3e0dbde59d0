"""Operator 1: document quality from a linear-chain conditional random field over lines.

Every line that holds a word is labelled good or bad. The score of a line comes
from its own features and those of the lines before and after it, and a
transition weight joins neighbours. Forward-backward gives each line's
probability of being good; their mean, weighted by line length, is the quality
of the document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import held_out, materialise, per_portion
from fieldloom.llm.words import NOT_SPACE, flat, windows, words

# Labelled documents that the field is fitted on, at most; the first by hash of the id.
TRAINING_DOCUMENTS = 6000
STEPS = 200
PENALTY = 1e-3

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "high": range(0x80, 0x100),
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "sign": b"#*$%&<>",
    "other": b"\"'()[]{}/\\-_+=~^@`",
}
FEATURES = ["bias", "log_length", "log_words", "word_length", *_CLASSES, "distinct", "adjacent", "repeated_run", "repeated_line", "ends_stop", "begins_upper", "first", "last"]


@dataclass
class Lines:
    """Lines with a word of several texts: number of the text, length in bytes, features."""

    text: np.ndarray
    length: np.ndarray
    features: np.ndarray


def line_features(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Features of all lines with a word. No feature looks beyond the own text."""
    w = words(data, offsets, NOT_SPACE)
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0x0A, out=breaks[1:])
    line_of_word = breaks[w.start]
    if not len(w.start):
        return Lines(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(FEATURES))))
    head = np.flatnonzero(np.append(True, (line_of_word[1:] != line_of_word[:-1]) | (w.text[1:] != w.text[:-1])))
    count = np.diff(np.append(head, len(w.start)))
    text, begin, end = w.text[head], w.start[head], w.end[np.append(head[1:], len(w.start)) - 1]
    length = end - begin
    line = np.repeat(np.arange(len(head)), count)
    size = (w.end - w.start).astype(float)
    inside = np.add.reduceat(size, head)
    columns = [np.ones(len(head)), np.log1p(length), np.log1p(count), np.minimum(inside / count, 30)]
    kind = np.zeros(256, np.int64)
    for i, values in enumerate(_CLASSES.values(), 1):
        kind[list(values)] = i
    classes = kind[data]
    for i in range(1, len(_CLASSES) + 1):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(classes == i, out=sums[1:])
        columns.append((sums[end] - sums[begin]) / inside)
    order = np.lexsort((w.hash, line))
    own, value = line[order], w.hash[order]
    fresh = np.append(True, (value[1:] != value[:-1]) | (own[1:] != own[:-1]))
    columns.append(np.bincount(own[fresh], minlength=len(head)) / count)
    same = np.append(False, (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1]))
    columns.append(np.bincount(line[same], minlength=len(head)) / count)
    run, run_text, at = windows(w, 3)
    order = np.lexsort((run, run_text))
    equal = (run[order][1:] == run[order][:-1]) & (run_text[order][1:] == run_text[order][:-1])
    twice = np.zeros(len(run), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(len(w.start), bool)
    for j in range(3):
        covered[at[twice] + j] = True
    columns.append(np.bincount(line[covered], minlength=len(head)) / count)
    whole = np.add.reduceat(w.hash * (np.arange(len(w.hash)) - np.repeat(head, count) + 1).astype(np.uint64), head)
    order = np.lexsort((whole, text))
    equal = (whole[order][1:] == whole[order][:-1]) & (text[order][1:] == text[order][:-1])
    again = np.zeros(len(head), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    columns.append(again)
    last = data[end - 1]
    columns.append(np.isin(last, np.frombuffer(b".!?:;", np.uint8)))
    columns.append((data[begin] >= 0x41) & (data[begin] < 0x5B))
    columns.append(np.append(True, text[1:] != text[:-1]))
    columns.append(np.append(text[1:] != text[:-1], True))
    return Lines(text, length, np.column_stack([np.asarray(c, float) for c in columns]))


def with_neighbours(features: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The features of each line beside those of the line before and after; zeros beyond the text."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    if len(text) > 1:
        same = (text[1:] == text[:-1])[:, None]
        before[1:] = features[:-1] * same
        after[:-1] = features[1:] * same
    return np.hstack([features, before, after])


@dataclass
class Field:
    """Weights of a line's log odds of good, transition weights [from, to] (0 bad, 1 good), centre and scale of the features."""

    weights: np.ndarray
    transitions: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def evidence(self, lines: Lines) -> np.ndarray:
        scaled = (lines.features - self.centre) / self.scale
        scaled[:, 0] = 1.0
        return with_neighbours(scaled, lines.text) @ self.weights


def messages(evidence: np.ndarray, text: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds from the lines up to each line, and from those behind it."""
    forward, backward = evidence.copy(), np.zeros_like(evidence)
    if len(text):
        head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        count = np.diff(np.append(head, len(text)))
        order = np.argsort(-count, kind="stable")
        head, count = head[order], count[order]
        (bb, bg), (gb, gg) = transitions
        step = lambda odds, a, b, c, d: np.logaddexp(odds + a, b) - np.logaddexp(odds + c, d)
        active = np.searchsorted(-count, -np.arange(count[0]) - 1, side="right")
        for t in range(1, count[0]):
            at = head[:active[t]] + t
            forward[at] += step(forward[at - 1], gg, bg, gb, bb)
        for t in range(count[0] - 1, 0, -1):
            at = head[:active[t]] + t
            backward[at - 1] = step(backward[at] + evidence[at], gg, gb, bg, bb)
    return forward, backward


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(lines: Lines, good: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Maximise the conditional likelihood of the line labels, each line with its document's label; full-batch Adam.

    ``good`` is 0 or 1 for each line. Without lines the field gives every line a probability of a half.
    """
    width = len(FEATURES)
    if not len(good):
        return Field(np.zeros(3 * width), np.zeros((2, 2)), np.zeros(width), np.ones(width))
    centre, scale = lines.features.mean(axis=0), lines.features.std(axis=0) + 1e-6
    centre[0], scale[0] = 0.0, 1.0
    x = with_neighbours(np.hstack([np.ones((len(good), 1)), ((lines.features - centre) / scale)[:, 1:]]), lines.text)
    pair = lines.text[1:] == lines.text[:-1]
    y = good.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][pair], y[1:][pair]), 1)
    # a document counts once, however many lines it has
    weight = 1.0 / np.bincount(lines.text)[lines.text]
    theta, first, second = np.zeros(3 * width + 4), np.zeros(3 * width + 4), np.zeros(3 * width + 4)
    for step in range(1, steps + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        evidence = x @ w
        forward, backward = messages(evidence, lines.text, t)
        slope = x.T @ (weight * (y - probability(forward + backward)))
        a, b = forward[:-1][pair], (evidence + backward)[1:][pair]
        joint = np.stack([np.zeros_like(a) + t[0, 0], b + t[0, 1], a + t[1, 0], a + b + t[1, 1]])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        share = weight[1:][pair]
        observed = np.zeros((2, 2))
        np.add.at(observed, (y[:-1][pair], y[1:][pair]), share)
        slope = np.append(slope, (observed - (joint * share).sum(axis=1).reshape(2, 2)).ravel())
        slope = slope / max(1, lines.text[-1] + 1) - penalty * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2), centre, scale)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", limit: int = TRAINING_DOCUMENTS) -> Field:
    """Fit on at most ``limit`` labelled documents that are not held out (crc32 of the id mod 3 is 1).

    Which labelled ids are used is decided by a hash of the id, so it does not depend on the cluster. Null ids and
    null labels are not used; an id labelled twice counts as its lower label.
    """
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).dropna().where(~held_out("doc_id", 3, 1))
    chosen = usable.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = materialise(chosen)
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = line_features(*flat(batch.column("text")))
        take = pa.array(lines.text)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(lines.text) + 1, dtype=np.int32) * len(FEATURES)), pa.array(lines.features.ravel(), pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()).take(take), batch.column("label").cast(pa.int64()).take(take), pa.array(lines.text), values],
                                          ["doc_id", "label", "n", "features"])

    rows = sample.mapInArrow(per_portion(measure), "doc_id string, label bigint, n bigint, features array<double>").toPandas()
    if not len(rows):
        return fit(Lines(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(FEATURES)))), np.zeros(0))
    # consecutive rows of one portion and text are one document
    change = (rows["doc_id"].to_numpy()[1:] != rows["doc_id"].to_numpy()[:-1]) | (rows["n"].to_numpy()[1:] != rows["n"].to_numpy()[:-1])
    number = np.append(0, np.cumsum(change))
    features = np.stack(rows["features"].to_numpy())
    return fit(Lines(number, np.zeros(len(rows), np.int64), features), rows["label"].to_numpy())


def score_lines(docs: DataFrame, field: Field, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows (row, score, n_lines, line_good): the row's columns, or those to carry, as a struct, its quality, and each line's probability of being good.

    Lines without a word are not labelled. A null text is an empty one; a text without a word scores 0.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = line_features(*flat(batch.column("text")))
        forward, backward = messages(field.evidence(lines), lines.text, field.transitions)
        good, n = probability(forward + backward), batch.num_rows
        whole = np.bincount(lines.text, lines.length, n)
        score = np.bincount(lines.text, lines.length * good, n) / np.maximum(whole, 1)
        count = np.bincount(lines.text, minlength=n)
        ends = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.clip(score, 0, 1)), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(good.astype(np.float32)))],
                                          ["row", "score", "n_lines", "line_good"])

    schema = T.StructType([rows.schema["row"]]).add("score", "double").add("n_lines", "long").add("line_good", T.ArrayType(T.FloatType()))
    return rows.mapInArrow(per_portion(work), schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose quality reaches the threshold; same columns."""
    scored = score_lines(docs, train(docs, labels)).where(F.col("score") >= threshold)
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
