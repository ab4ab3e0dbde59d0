"""Operator 6: packing by cutting-stock column generation.

Documents become token ids and are cut into full sequences and one remainder.
The remainders' lengths, rounded up to whole units, form a histogram of bounded
size. A linear program covers it by patterns (how many remainders of each length
share a sequence); a knapsack dynamic program prices new patterns. Rounded
pattern counts become slots, and remainders take the slots of their length by
rank.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm.bpe import Merges, byte_characters
from fieldloom.llm.common import materialise, per_portion, sized, text_key

CAPACITY = 2048
# Lengths are rounded up to so many tokens in the linear program, which so has 256 rows.
UNIT = 8
# Ranks are counted within so many remainders of a length, then shifted.
RANK_ROWS = 4_000
# Texts are encoded in portions of so many bytes: larger ones look up fewer parts again but take more memory.
PORTION_BYTES = 2 << 20
# Encoded parts that a Python worker remembers, from task to task.
REMEMBERED = 400_000
# A word of letters up to Latin Extended-A, with the space before it, and signs behind; no apostrophe, which may begin a token.
_PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]{1,48})([!-&(-/:-@\\[-`{-~]{0,48})")


class Encoder:
    """Parts of texts to ids with a byte-level vocabulary of the tokenizers library.

    Most parts are a word and signs behind it, which such a vocabulary takes apart at once; those are merged many
    together, see ``bpe``. All other parts go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        ids, cut = spec["model"]["vocab"], spec["pre_tokenizer"] or {}
        # a vocabulary with other rules is left to the library altogether
        self.plain = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not any(
            spec["model"].get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges"))
        if self.plain:
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
            self.merges = Merges([(ids[a], ids[b]) for a, b in pairs], [ids[a + b] for a, b in pairs])
            self.bytes = np.array([ids[c] for c in byte_characters()], np.int32)
        self.known: dict[str, bytes] = {}

    def encode(self, parts: list[str]) -> list[bytes]:
        """The ids of each part. Up to REMEMBERED words and parts are kept for later portions and tasks of the worker."""
        known = self.known
        found = list(map(known.get, parts))
        fresh = {p for p, ids in zip(parts, found, strict=True) if ids is None}
        if not fresh:
            return found
        words = {p: m for p in fresh if (m := _PLAIN.fullmatch(p))} if self.plain else {}
        own = {m[i] for m in words.values() for i in (1, 2)}.difference(known, [""])
        new = self.merges.of_words(list(own), self.bytes) if own else {}
        ids_of = lambda w: new[w] if w in new else known[w] if w else b""
        new.update([(p, ids_of(m[1]) + ids_of(m[2])) for p, m in words.items()])
        rest = [p for p in fresh if p not in words]
        for i in range(0, len(rest), 20_000):
            some = rest[i:i + 20_000]
            new.update(zip(some, (array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        if len(known) < REMEMBERED:
            # long parts are whole texts that did not split
            known.update((p, ids) for p, ids in new.items() if len(p) < 64)
        return [new[p] if ids is None else ids for p, ids in zip(parts, found, strict=True)]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    return Encoder(path)


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, key (of the text), start, length, doc_tokens, ids (little-endian unsigned 32-bit).

    A document is cut every ``capacity`` ids. A null text is an empty one and has only the end id. Ids of documents must be
    integers or their text; other text is refused by the cast.

    A single space between two characters that are not white space always begins a
    new token of a byte-level vocabulary. Texts are therefore split there, and each
    distinct part is encoded once by the tokenizer.
    """
    spaced = F.col(text).rlike(r"(?U)( \s|\s )")
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), text_key(F.col(text)).alias("key"),
                         F.coalesce(spaced, F.lit(False)).alias("whole"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, n, whole = encoder(vocabulary).encode, batch.num_rows, batch.column("whole")
        split = pc.split_pattern(pc.if_else(whole, "", batch.column("text")), " ")
        flat, heads = split.flatten(), split.offsets.to_numpy()
        # the first part of a text has no space before it; a text that does not split is its own first part
        begin = pc.if_else(whole, batch.column("text"), flat.take(pa.array(heads[:-1]))).to_pylist()
        seen = flat.dictionary_encode()
        parts = encode([f" {p}" for p in seen.dictionary.to_pylist()])
        table = [*parts, *encode(begin), np.asarray([end_id], "<u4").tobytes()]
        which = seen.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        which[heads[:-1]] = len(parts) + np.arange(n)
        which = np.insert(which, heads[1:], len(table) - 1)
        # the ids of all texts, one after the other
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        place = np.append(0, np.cumsum(size))[:-1]
        many = size[which]
        ends = np.cumsum(many)
        ids = np.frombuffer(b"".join(table), "<u4")[np.repeat(place[which] - (ends - many), many) + np.arange(int(many.sum()))]
        total = np.diff(np.append(0, ends[heads[1:] + np.arange(n)]))
        pieces = -(-total // capacity)
        of = np.repeat(np.arange(n), pieces)
        start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        length = np.minimum(capacity, total[of] - start)
        bounds = 4 * np.append(0, np.cumsum(length))
        cut = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
        take = pa.array(of)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(start), pa.array(length), pa.array(total[of]), cut.cast(pa.binary())],
            ["doc_id", "key", "start", "length", "doc_tokens", "ids"])

    return source.mapInArrow(per_portion(work, size=PORTION_BYTES), "doc_id bigint, key binary, start bigint, length bigint, doc_tokens bigint, ids binary")


@dataclass
class Plan:
    """Patterns as rows (units of length, first rank, ranks, slots per sequence, first sequence, slots before), ordered by units and rank."""

    units: np.ndarray
    first_rank: np.ndarray
    per_sequence: np.ndarray
    first_sequence: np.ndarray
    sequences: int


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of lengths 1..n of these values within the capacity, with repeats, and how many of each."""
    n = len(values)
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        m = min(c, n)
        offers = best[c - m:c][::-1] + values[:m]  # offers[i]: a piece of length i + 1 on top
        i = int(offers.argmax())
        best[c], choice[c] = (offers[i], i + 1) if offers[i] > best[c - 1] else (best[c - 1], 0)
    counts, c = np.zeros(n, np.int64), capacity
    while c > 0:
        counts[choice[c] - 1] += choice[c] > 0
        c -= max(1, choice[c])
    return float(best[capacity]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination, without the threads of a linear algebra library, which may wait for each other in a driver."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, n:].copy()


def patterns(demand: np.ndarray, capacity: int, tolerance: float = 1e-3, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the cutting-stock linear program for the demand of lengths 1..n, and how often each is used (fractions)."""
    kinds = np.flatnonzero(demand > 0)
    m = len(kinds)
    lengths = kinds + 1
    need = demand[kinds].astype(float)
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1.0 / (capacity // lengths))
    times = lambda matrix, vector: np.einsum("ij,j->i", matrix, vector)  # noqa: E731  small; threads would only wait for each other
    use = times(inverse, need)
    for step in range(rounds):
        dual = inverse.sum(axis=0)  # every pattern costs one sequence
        values = np.zeros(len(demand))
        values[kinds] = dual
        value, counts = knapsack(values, capacity)
        if value <= 1 + tolerance:
            break
        column = counts[kinds].astype(float)
        change = times(inverse, column)
        able = change > 1e-9
        if not able.any():
            break
        ratio = np.full(m, np.inf)
        ratio[able] = np.maximum(use[able], 0) / change[able]
        out = int(ratio.argmin())
        use = use - change * ratio[out]
        use[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / change[out]
        inverse = inverse - np.outer(change, row)
        inverse[out] = row
        if step % 200 == 199:
            inverse = inverted(basis)
            use = times(inverse, need)
    full = np.zeros((m, len(demand)), np.int64)
    full[:, kinds] = np.rint(basis.T).astype(np.int64)
    return full, np.maximum(use, 0)


def plan(demand: np.ndarray, capacity: int) -> Plan:
    """Whole patterns for the demand (pieces of 1..n units): rounded down, then the rest by best fit, longest first."""
    left = demand.astype(np.int64).copy()
    chosen: list[tuple[np.ndarray, int]] = []
    if left.any():
        columns, use = patterns(demand, capacity)
        for column, x in sorted(zip(columns, use, strict=True), key=lambda p: -p[1]):
            some = column > 0
            times = min(int(x + 1e-6), int((left[some] // column[some]).min())) if some.any() else 0
            if times:
                chosen.append((column, times))
                left -= times * column
    while left.any():
        column, room = np.zeros(len(left), np.int64), capacity
        for i in range(len(left) - 1, -1, -1):
            n = min(int(left[i]) - int(column[i]), room // (i + 1))
            if n > 0:
                column[i] += n
                room -= n * (i + 1)
        some = column > 0
        times = int((left[some] // column[some]).min())
        chosen.append((column, times))
        left -= times * column
    rows: list[tuple[int, int, int, int]] = []
    rank, sequence = np.zeros(len(demand), np.int64), 0
    for column, times in chosen:
        for i in np.flatnonzero(column):
            rows.append((i + 1, int(rank[i]), int(column[i]), sequence))
            rank[i] += times * column[i]
        sequence += times
    rows.sort()
    units, first, per, base = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    return Plan(units, first, per, base, sequence)


def pack(pieces: DataFrame, carry: dict[str, Column] | None = None, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Give every piece a sequence_id and an offset: doc_id, start, length, doc_tokens, the carried columns, sequence_id, offset.

    ``pieces`` as from ``tokenised``; ``carry`` names columns made from its own, by default the ids. A full piece is a
    sequence of its own. Pieces of a sequence stand without gaps, longest first. Repeated rows are packed as often as
    they occur. An empty table gives an empty one.

    To the driver come only the histogram (capacity / unit counts) and the number of rank groups.
    """
    carried = carry if carry is not None else {"ids": F.col("ids")}
    # only lengths go through the ranking; the carried columns are joined to their places at the end
    units_of = F.least(F.ceil(F.col("length") / unit), F.lit(capacity // unit)).cast("bigint")
    written = materialise(pieces.select("doc_id", "key", "start", "length", "doc_tokens", *[c.alias(n) for n, c in carried.items()]).withColumn("piece", F.monotonically_increasing_id()))
    slim = written.select("piece", "key", "length", units_of.alias("units"))
    # a group of ranks holds a bounded share of a length, dealt by hash; a piece's rank is its place in its group after the groups before
    groups = max(1, -(-written.count() // RANK_ROWS))
    grouped = slim.withColumn("g", F.pmod(F.xxhash64("key", "piece"), F.lit(groups)))
    counts = materialise(grouped.groupBy("units", "g").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(W.partitionBy("units").orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    histogram = np.zeros(capacity // unit, np.int64)
    for row in counts.groupBy("units").agg(F.sum("n").alias("n")).collect():
        histogram[row.units - 1] = row.n
    full = capacity // unit
    ranked = grouped.join(counts.select("units", "g", before.alias("before")), ["units", "g"])
    place = F.row_number().over(W.partitionBy("units", "g").orderBy("key", "piece")) - 1
    ranked = ranked.withColumn("rank", F.col("before") + place)
    demand = histogram.copy()
    demand[full - 1] = 0
    made = plan(demand, full)

    def assign(batches):
        bounds = np.searchsorted(made.units, np.arange(full + 2))
        for batch in batches:
            units, rank = batch.column("units").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = rank + made.sequences, np.zeros(len(rank), np.int64)
            for u in np.unique(units):
                if u == full:
                    continue
                low, high = bounds[u], bounds[u + 1]
                own = units == u
                at = low + np.searchsorted(made.first_rank[low:high], rank[own], side="right") - 1
                over = rank[own] - made.first_rank[at]
                sequence[own] = made.first_sequence[at] + over // made.per_sequence[at]
                slot[own] = over % made.per_sequence[at]
            rest = [c for c in batch.schema.names if c not in ("rank",)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sequence), pa.array(slot)], [*rest, "sequence_id", "slot"])

    assigned = ranked.select("piece", "length", "units", "rank").mapInArrow(assign, "piece bigint, length bigint, units bigint, sequence_id bigint, slot bigint")
    so_far = W.partitionBy("sequence_id").orderBy(F.desc("units"), "slot").rowsBetween(W.unboundedPreceding, -1)
    placed = materialise(assigned.select("piece", "sequence_id", F.coalesce(F.sum("length").over(so_far), F.lit(0)).alias("offset")))
    return written.join(sized(placed), "piece").select("doc_id", "start", "length", "doc_tokens", *carried, "sequence_id", "offset")
