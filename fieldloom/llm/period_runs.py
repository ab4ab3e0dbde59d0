"""Operator 11: runs of repeated words, found with string synchronising sets.

A run is a stretch of words with smallest period q, at least 2 q long, that no
neighbouring word extends. The texts of a portion are one sequence of word
numbers, with a number of its own after each text, so no run crosses a text.

For each width w = 1, 2, 4, ... the windows of w words get random values. A place
is selected if the least value among the windows of the next w + 1 places stands
at the first or the last of them. That depends on 2 w words only, so equal
stretches have equal selections, and of any w neighbouring places one is selected,
unless all windows there have a period of at most w / 3. Such windows lie in runs of
small periods, which narrower widths have found, and have no value.

Two selected places with equal contexts of 2 w words at distance q propose the
period q, for 3 w - 1 <= q < 6 w - 1; w = 1 also proposes 1 and 2 (3 w - 1 is 2). A proposal is
extended to both sides word by word and is a run if it holds at least 2 q words.
A run of period q whose places are all unselected begins and ends in two
neighbouring runs of one small period; those pairs of runs give its period
(``_across``). So all runs of each text are found, each with its smallest period.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import per_portion
from fieldloom.llm.words import mix

# The shortest run that is reported.
LEAST_LENGTH = 12
# Cells compared at once when proposals are extended.
CELLS = 1 << 20
_LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class Runs:
    """Runs of several texts: number of the text, first word, end, smallest period; in order of text, start and period."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def _agreement(words: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, width: int) -> np.ndarray:
    """How many words after a and b (before them, if ``step`` is -1) agree pairwise; a is before b.

    ``words`` ends, and for a step back begins, with a number that is nowhere else.
    """
    n = len(words)
    found = np.zeros(len(a), np.int64)
    for first in range(0, len(a), max(1, CELLS // width)):
        rows = np.arange(first, min(len(a), first + max(1, CELLS // width)))
        reach = np.arange(width) if step > 0 else -1 - np.arange(width)
        while len(rows):
            x = a[rows] + step * found[rows]
            y = b[rows] + step * found[rows]
            left, right = x[:, None] + reach, y[:, None] + reach
            same = (left >= 0) & (right < n)
            same &= words[np.clip(left, 0, n - 1)] == words[np.clip(right, 0, n - 1)]
            whole = same.all(axis=1)
            found[rows] += np.where(whole, width, same.argmin(axis=1))
            rows = rows[whole]
    return found


def _selected(value: np.ndarray, width: int) -> np.ndarray:
    """Places where the least of this and the next ``width`` values stands first or last. The largest value is none."""
    least, span = value.copy(), 1
    while span < width:
        least[:-span] = np.minimum(least[:-span], least[span:])
        span *= 2
    last = np.append(value[width:], np.full(min(width, len(value)), _LARGEST))
    least = np.minimum(least, last)
    return np.flatnonzero((least != _LARGEST) & ((least == value) | (least == last)))


def _proposals(place: np.ndarray, context: np.ndarray, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of selected places with equal contexts: the first place, and the distance."""
    firsts, distances = [], []
    for skip in range(1, len(place)):
        distance = place[skip:] - place[:-skip]
        near = distance <= longest
        if not near.any():
            break
        at = np.flatnonzero(near & (distance >= shortest) & (context[skip:] == context[:-skip]))
        firsts.append(place[at])
        distances.append(distance[at])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *firsts]), np.concatenate([none, *distances])


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with the least of its periods, in order of start and end."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
    return start[fresh], end[fresh], period[fresh]


def _across(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of larger periods around the break between two neighbouring runs of one period.

    If the two runs repeat the same words, shifted by d, every period q that leaves d when divided by theirs holds from the
    first run into the second, as far as both last. Periods under 8 of theirs are left to the selected places.
    """
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    out = [np.zeros((3, 0), np.int64)]
    long = end - start >= 9 * period - 1
    for i in np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1]) & long[1:] & long[:-1]):
        p, s1, e1, s2, e2 = (int(x) for x in (period[i], start[i], end[i], start[i + 1], end[i + 1]))
        root, size = words[e1 - p:e1].tobytes(), words.itemsize
        ahead = words[s2:s2 + 2 * p].tobytes()
        at = ahead.find(root)
        while at % size and at >= 0:
            at = ahead.find(root, at + 1)
        if at < 0:
            continue
        shift = (s2 + at // size - (e1 - p)) % p
        q = np.arange(shift + (8 * p - shift + p - 1) // p * p, min(e1 - s1, e2 - s2) + 1, p)
        first, final = np.maximum(s1, s2 - q), np.minimum(e1, e2 - q)
        real = final - first >= q
        out.append(np.stack([first, final, q])[:, real])
    first, final, q = np.concatenate(out, axis=1)
    # where both runs begin or end there, the words beyond may agree, too
    return first - _agreement(words, first, first + q, -1, 8), final + _agreement(words, final, final + q, 1, 8) + q, q


def find_runs(words: np.ndarray, first: np.ndarray) -> Runs:
    """All runs of at least 12 words in several texts.

    ``words`` numbers the words of all texts, equal words by equal numbers; text t has those from first[t] to first[t + 1].
    """
    count = np.diff(first)
    texts = np.flatnonzero(count >= LEAST_LENGTH)
    count = count[texts]
    # each text is followed by a number of its own; the whole begins with one, too
    begin = 1 + np.append(0, np.cumsum(count + 1))[:-1].astype(np.int64)
    line = np.arange(-1, -2 - int((count + 1).sum()), -1, dtype=np.int64)
    line[_ranges(begin, count)] = words[_ranges(first[texts], count)]
    name = mix(line.view(np.uint64) * np.uint64(2) + np.uint64(1))
    runs = [np.zeros(0, np.int64) for _ in range(3)]
    whole_line, whole_begin = line, begin
    # place in the whole line of each word that is left
    place_of = np.arange(len(line))
    width = 1
    while len(count) and 6 * width - 2 <= count.max():
        keep = np.append(True, np.repeat(count >= 6 * width - 2, count + 1))
        if not keep.all():
            line, name, place_of = line[keep], name[keep], place_of[keep]
            count = count[count >= 6 * width - 2]
        context = np.append(mix(name[:-width] * np.uint64(3) + mix(name[width:])), mix(name[-width:] + np.uint64(width)))
        value = mix(name ^ np.uint64(0x5851F42D4C957F2D))
        short = 3 * runs[2] <= width
        start, end = (np.searchsorted(place_of, x[short]) for x in runs[:2])
        inside = (end - start >= width) & (start < len(place_of)) & (place_of[np.minimum(start, len(place_of) - 1)] == runs[0][short])
        mark = np.zeros(len(line) + 1, np.int64)
        np.add.at(mark, start[inside], 1)
        np.add.at(mark, end[inside] - width + 1, -1)
        value[np.cumsum(mark[:-1]) > 0] = _LARGEST
        at = _selected(value, width)
        shortest, longest = (1 if width == 1 else 3 * width - 1), 6 * width - 2
        a, q = _proposals(at, context[at], shortest, longest)
        # overlapping proposals of one distance agree as one stretch
        order = np.lexsort((a, q))
        a, q = a[order], q[order]
        head = np.append(True, (q[1:] != q[:-1]) | (a[1:] > a[:-1] + 2 * width)) if len(a) else np.zeros(0, bool)
        tail = np.append(head[1:], True) if len(a) else head
        low, high, q = a[head], a[tail] + 2 * width, q[head]
        low = low - _agreement(line, low, low + q, -1, width)
        high = high + _agreement(line, high, high + q, 1, width)
        real = high - low >= q
        low, high, q = place_of[low[real]], place_of[high[real] - 1] + 1 + q[real], q[real]
        runs = list(_smallest(*(np.concatenate(x) for x in zip(runs, (low, high, q), strict=True))))
        now = (runs[2] >= shortest) & (runs[2] <= longest)
        wide = _across(whole_line, *(x[now] for x in runs))
        runs = list(_smallest(*(np.concatenate(x) for x in zip(runs, wide, strict=True))))
        name, width = context, 2 * width
    start, end, period = runs
    enough = end - start >= np.maximum(LEAST_LENGTH, 2 * period)
    start, end, period = start[enough], end[enough], period[enough]
    text = np.searchsorted(whole_begin, start, side="right") - 1
    base = whole_begin[text]
    order = np.lexsort((period, start - base, text))
    return Runs(texts[text][order], (start - base)[order], (end - base)[order], period[order])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start, so many as its count, one after the other."""
    total = int(count.sum())
    return np.repeat(start - np.append(0, np.cumsum(count))[:-1], count) + np.arange(total)


def numbered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts one after the other, their numbers (equal for equal words), and where each text's words begin."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)
    ends = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    # the offsets of a slice do not begin at 0
    first = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
    flat = flat.filter(real)
    return flat, flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), first


def collapse_runs(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows (row, n_words, runs, collapsed): the row's columns, or those to carry, as a struct, the number of words, the runs
    as structs of start, length and period in order of start and period, and the text without repetitions.

    Words are what stands between spaces and the controls from tab to carriage return. A run has at least 12 words. A word is
    left out if some run holds it after that run's first period; the words kept are joined by one space. A null text is an
    empty one. Each row stands for itself, so repeated rows and null ids come out as they are. Texts are taken in portions;
    a long text is one portion and is not cut.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    run = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = T.StructType([rows.schema["row"]]).add("n_words", "long").add("runs", T.ArrayType(run)).add("collapsed", "string")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, number, first = numbered_words(batch.column("text"))
        runs = find_runs(number, first)
        change = np.zeros(len(number) + 1, np.int64)
        np.add.at(change, first[runs.text] + runs.start + runs.period, 1)
        np.add.at(change, first[runs.text] + runs.end, -1)
        kept = np.cumsum(change[:-1]) == 0
        ends = np.append(0, np.cumsum(kept))[first]
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept))), " ")
        ends = np.append(0, np.cumsum(np.bincount(runs.text, minlength=batch.num_rows)))
        values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (runs.start, runs.end - runs.start, runs.period)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), collapsed],
                                          ["row", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(per_portion(work), schema)
