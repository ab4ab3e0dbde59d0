"""Operator 5: language-model scores from a probabilistic suffix tree over words.

The tree's states are contexts of no, one or two words. A context is retained if
it occurs often enough and its next-symbol distribution diverges enough from that
of the context without its oldest word, or if a longer context is retained below
it. Each symbol is scored in the longest retained context before it; distributions are smoothed towards the shorter
context, down to the word frequencies.

Texts are kept as blocks of local word numbers. A block sends the hashes of its
words, pairs and triples of words in sorted packed pieces, one for each range of
hashes; each range adds up its counts and sends them back to the block in the
same order. So the tree may grow with the corpus: it is never broadcast or
collected. Of what stands in one block alone, the block knows all and sends nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import materialise, portions
from fieldloom.llm.words import NOT_SPACE, flat, mix, words

# A block holds the words of about so many bytes of text.
BLOCK_BYTES = 8 << 20
# A range of hashes has about so many, those of all blocks together.
RANGE_KEYS = 1 << 20
# Marks of what was added up: it has its first block here; no other block has it.
FIRST, ALONE = 1, 2
# Share of an unseen word: added to every count.
ADDED = 0.1
# A context must be followed by a word so often.
MIN_COUNT = 8
# Least divergence (nats) of a retained context from the next shorter one.
DIVERGENCE = 1.0
# Occurrences that the shorter context is worth in a longer one.
WEIGHT = 1.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_END = np.uint64(0x5851F42D4C957F2D)
_BEGIN = np.uint64(1)
_CODEC = pa.Codec("zstd", compression_level=3)


def _pack(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + values.dtype.itemsize.to_bytes(1, "little") + _CODEC.compress(np.ascontiguousarray(values).tobytes(), asbytes=True)


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), data[8]
    return np.frombuffer(_CODEC.decompress(data[9:], n * size), np.dtype(dtype)) if n else np.zeros(0, np.dtype(dtype))


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks (doc_id, learn, lengths, tokens, vocabulary, counts) from (doc_id, learn, text); all arrays, tokens packed.

    A text's tokens are its words with A-Z lowered, then one end. Tokens are numbers of the block's vocabulary, the most
    frequent first; counts are those in texts to learn from.
    """
    kind = docs.schema["doc_id"].dataType

    def close(ids: list, learn: list, lengths: list, hashes: list) -> pa.RecordBatch:
        learn_, length = np.concatenate(learn), np.concatenate(lengths)
        value, inverse, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        tokens = number[inverse]
        counts = np.bincount(tokens[np.repeat(learn_, length)], minlength=len(value))
        one = lambda x, t: pa.array([x], pa.list_(t))
        ids_ = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids_)], pa.int32()), ids_), one(learn_, pa.bool_()), one(length, pa.int64()), pa.array([_pack(tokens)], pa.binary()),
             one(value[order].astype(np.int64), pa.int64()), one(counts.astype(np.int64), pa.int64())], ["doc_id", "learn", "lengths", "tokens", "vocabulary", "counts"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            for part in portions(batch):
                data, offsets = flat(part.column("text"))
                w = words(_LOWER[data], offsets, NOT_SPACE)
                held[0].append(part.column("doc_id"))
                held[1].append(part.column("learn").to_numpy(zero_copy_only=False).astype(bool))
                held[2].append(np.diff(w.first) + 1)
                held[3].append(np.insert(w.hash, w.first[1:], _END))
                size += len(data) + part.num_rows
                if size >= BLOCK_BYTES:
                    yield close(*held)
                    held, size = ([], [], [], []), 0
        if held[0]:
            yield close(*held)

    schema = T.StructType([T.StructField("doc_id", T.ArrayType(kind)), T.StructField("learn", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.LongType())),
                           T.StructField("tokens", T.BinaryType()), T.StructField("vocabulary", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    return materialise(docs.mapInArrow(cut, schema).withColumn("block", F.monotonically_increasing_id()))


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as steps, byte by byte: the leading bytes of the steps are zero."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return _pack(steps.view(np.uint8).reshape(-1, 8).T.ravel())


def _unpack_keys(data: bytes) -> np.ndarray:
    planes = _unpack(data, "u1")
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _pieces(block: int, keys: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (block, part, keys, n) of a block: its sorted hashes with their counts, cut by their first ``bits`` bits."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    part = ((keys >> np.uint64(1)) >> np.uint64(63 - bits)).astype(np.int64)
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(heads, len(part))[1:]
    cuts = list(zip(heads, ends, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), block), pa.int64()), pa.array(part[heads]), pa.array([_pack_keys(keys[i:j]) for i, j in cuts], pa.binary()),
                                       pa.array([_pack(n[i:j]) for i, j in cuts], pa.binary())], ["block", "part", "keys", "n"])


_PIECE = "block bigint, part bigint, keys binary, n binary"


def added_up(pieces: DataFrame, name: str, kind: str = "<i8") -> DataFrame:
    """Per block, in the order of its sorted hashes: each one's sum of n over all blocks and its mark, as ``name`` and ``name``_mark."""

    def add(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("block")
        keys = [_unpack_keys(x.as_py()) for x in table.column("keys")]
        n = np.concatenate([_unpack(x.as_py(), kind) for x in table.column("n")])
        value, head, inverse, blocks = np.unique(np.concatenate(keys), return_index=True, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, n, len(value)).astype(kind)[inverse]  # whole numbers are exact up to 2^53
        mark = np.zeros(len(n), np.uint8)
        mark[head] = np.where(blocks == 1, ALONE, FIRST)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "total": pa.array([_pack(x) for x in np.split(total, ends)], pa.binary()),
                         "mark": pa.array([_pack(x) for x in np.split(mark, ends)], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("part")
        whole = lambda c, t: _pack(np.concatenate([_unpack(x.as_py(), t) for x in table.column(c)]))
        return pa.table({"block": table.column("block")[:1], name: pa.array([whole("total", kind)], pa.binary()), f"{name}_mark": pa.array([whole("mark", "u1")], pa.binary())})

    added = pieces.groupBy("part").applyInArrow(add, "block bigint, part bigint, total binary, mark binary")
    return materialise(added.groupBy("block").applyInArrow(gather, f"block bigint, {name} binary, {name}_mark binary"))


def sent_back(rows: DataFrame) -> DataFrame:
    """Per block its values of ``i``, packed: from rows (block, i) to (block, i)."""

    def gather(table: pa.Table) -> pa.Table:
        return pa.table({"block": table.column("block")[:1], "i": pa.array([_pack(np.sort(table.column("i").to_numpy()).astype(np.int64))], pa.binary())})

    return materialise(rows.select("block", "i").groupBy("block").applyInArrow(gather, "block bigint, i binary"))


def _answered(keys: np.ndarray, asked: np.ndarray, n: np.ndarray, row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all blocks and mark of each hash, from what came back for those that were asked for; of all others the block's own n is the sum."""
    total, mark = n.copy(), np.full(len(n), ALONE, np.uint8)
    if row[name] is not None:
        where = np.flatnonzero(asked)
        where = where[np.argsort(keys[where], kind="stable")]
        total[where], mark[where] = _unpack(row[name], n.dtype.str), _unpack(row[f"{name}_mark"], "u1")
    return total, mark


class _Block:
    """The tokens of a block with what was sent back for its words."""

    def __init__(self, row: dict) -> None:
        self.row, self.block = row, row["block"]
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.learn = np.asarray(row["learn"], bool)
        self.tokens = _unpack(row["tokens"], "<u4").astype(np.int64)
        self.text = np.repeat(np.arange(len(self.lengths)), self.lengths)
        words_ = np.asarray(row["vocabulary"]).view(np.uint64)
        self.count, mark = _answered(words_, np.ones(len(words_), bool), np.zeros(len(words_), np.int64), row, "word")
        self.vocabulary, self.alone = np.append(words_, _BEGIN), np.append(mark == ALONE, False)
        self.begin = np.append(0, np.cumsum(self.lengths))[:-1]

    def number_of(self, at: np.ndarray, number: np.ndarray, numbers: int) -> np.ndarray:
        """How often each number stands in texts to learn from."""
        return np.bincount(number[self.learn[self.text[at]]], minlength=numbers).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places after a frequent word or at a text's beginning, each one's number of (word, next), and the words of the numbers."""
        before, size = np.empty_like(self.tokens), len(self.count) + 1
        before[1:] = self.tokens[:-1]
        before[self.begin] = size - 1  # the beginning of a text is a symbol too
        at = np.flatnonzero(np.append(self.count >= MIN_COUNT, True)[before])
        value, number = np.unique(before[at] * size + self.tokens[at], return_inverse=True)
        return at, number, value // size, value % size

    def triples(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places after a frequent pair of symbols, each one's pair (word, next) and number of (oldest, word, next), and the numbers' (oldest, word) and first places."""
        at, number, _, _ = self.pairs()
        pair, size = np.full(len(self.tokens), -1), len(self.count) + 1
        pair[at] = number
        often = np.append(total >= MIN_COUNT, False)
        inner = np.append(False, often[pair[:-1]])
        inner[self.begin] = False
        at = np.flatnonzero(inner)
        value, head, number = np.unique(pair[at - 1] * size + self.tokens[at], return_index=True, return_inverse=True)
        return at, pair, number, value // size, at[head]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: (c[k].values.to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) and n != "doc_id" else c[k].as_py()) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


class _Pairs:
    """The pairs (word, next) of a block: their hashes and counts here, which of them are asked for, and their sums once those came back.

    Not asked for are pairs with a symbol that only this block has, whose counts here are all, and with a next word without a count.
    """

    def __init__(self, b: _Block) -> None:
        self.at, self.number, self.word, self.next = b.pairs()
        self.n = b.number_of(self.at, self.number, len(self.word))
        self.keys = mix(mix(b.vocabulary[self.word]) + b.vocabulary[self.next])
        self.asked = ~b.alone[self.word] & ~b.alone[self.next] & (b.count[self.next] > 0)
        self.total, self.mark = _answered(self.keys, self.asked, self.n, b.row, "pair") if "pair" in b.row else (self.n, None)


class _Triples:
    """The triples (oldest, word, next) of a block whose (oldest, word) is frequent, as in ``_Pairs``; outer is the number of (oldest, word), inner that of (word, next)."""

    def __init__(self, b: _Block, p: _Pairs) -> None:
        self.at, pair, self.number, self.outer, head = b.triples(p.total)
        self.inner = pair[head]
        self.n = b.number_of(self.at, self.number, len(head))
        self.keys = mix(mix(p.keys[self.outer]) + b.vocabulary[b.tokens[head]])
        self.asked = (p.mark[self.outer] != ALONE) & (p.mark[self.inner] != ALONE) & (p.total[self.inner] > 0)
        self.total, self.mark = _answered(self.keys, self.asked, self.n, b.row, "triple") if "triple" in b.row else (self.n, None)


def _sums(number: np.ndarray, x: np.ndarray, numbers: int, mark: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of x by number, over what has its first block here and a count."""
    own = (mark > 0) & (n > 0)
    return np.bincount(number[own], x[own], numbers)


class _Contexts:
    """The contexts (oldest, word) of a block by number of their pair: their divergence here, which are asked for, and which are kept once all came back.

    Each occurrence of one has a next word, so that the sum of its pair is also that of its triples.
    """

    def __init__(self, b: _Block, p: _Pairs, t: _Triples) -> None:
        share = p.total[t.inner] / np.maximum(b.count, 1)[p.word[t.inner]]
        gain = t.total * (np.log(np.maximum(t.total, 1)) - np.log(np.where(t.total > 0, share, 1)))
        self.gain = _sums(t.outer, gain, len(p.word), t.mark, t.total).astype(np.float64)
        present = np.bincount(t.outer, minlength=len(p.word)) > 0
        self.asked = present & (p.mark != ALONE)
        if "gain" in b.row:
            total, _ = _answered(p.keys, self.asked, self.gain, b.row, "gain")
            self.kept = present & (p.total >= MIN_COUNT) & (total - p.total * np.log(np.maximum(p.total, 1)) >= DIVERGENCE * p.total)


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", learn: str = "learn") -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score, n_states) for all texts; the model is that of those with ``learn``.

    base_score is the log10 probability by word frequencies alone, score by the tree; n_states counts the tokens scored in a
    context of at least one word. A null text is an empty one: its only token is the end. A null ``learn`` is false.
    Repeated rows count as often as they occur. With nothing to learn from, all words are equally unknown.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(learn), F.lit(False)).alias("learn"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = blocks_of(source)

    sizes = blocks.select(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n"), F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("tokens"))
    size = sizes.agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).first()
    total, bits = size.n or 0, max(0, ((size.tokens or 0) // RANGE_KEYS).bit_length())

    def each(rows: DataFrame, cut: Callable[[dict], pa.RecordBatch], schema: str) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                yield cut(row)

        return rows.mapInArrow(run, schema)

    # counts of words
    def word_pieces(row: dict) -> pa.RecordBatch:
        return _pieces(row["block"], np.asarray(row["vocabulary"]).view(np.uint64), np.asarray(row["counts"], np.int64), bits)

    counts = added_up(each(blocks.select("block", "vocabulary", "counts"), word_pieces, _PIECE), "word")

    def known(row: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([int(((_unpack(row["word"], "<i8") > 0) & (_unpack(row["word_mark"], "u1") > 0)).sum())], pa.int64())], ["v"])

    distinct = each(counts, known, "v bigint").agg(F.sum("v").alias("v")).first().v or 0

    # one-word contexts: the divergence of their next words from all words
    def pair_pieces(row: dict) -> pa.RecordBatch:
        b = _Block(row)
        p = _Pairs(b)
        return _pieces(b.block, p.keys[p.asked], p.n[p.asked], bits)

    def word_contexts(row: dict) -> pa.RecordBatch:
        b = _Block(row)
        p, numbers = _Pairs(b), len(b.count)
        gain = p.total * (np.log(np.maximum(p.total, 1)) - np.log(np.maximum(b.count, 1))[p.next] + np.log(max(total, 1)))
        n = _sums(p.word, p.total, numbers + 1, p.mark, p.total)[:numbers]
        i = np.flatnonzero(np.bincount(p.word, minlength=numbers + 1)[:numbers])
        gain = _sums(p.word, gain, numbers + 1, p.mark, p.total)[i]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), b.block), pa.int64()), pa.array(i), pa.array(b.vocabulary[i].view(np.int64)), pa.array(n[i].astype(np.int64)), pa.array(gain.astype(np.float64))],
                                          ["block", "i", "word", "n", "gain"])

    base = blocks.select("block", "lengths", "learn", "tokens", "vocabulary").join(counts, "block")
    deeper = base.join(added_up(each(base, pair_pieces, _PIECE), "pair"), "block", "left")
    apart = (F.col("n") >= MIN_COUNT) & (F.col("gain") - F.col("n") * F.log("n") >= DIVERGENCE * F.col("n"))
    ones = materialise(each(deeper, word_contexts, "block bigint, i bigint, word bigint, n bigint, gain double"))
    retained = ones.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain")).where(apart).select("word")

    # two-word contexts: the divergence of their next words from those of the newer word alone
    def triple_pieces(row: dict) -> pa.RecordBatch:
        b = _Block(row)
        t = _Triples(b, _Pairs(b))
        return _pieces(b.block, t.keys[t.asked], t.n[t.asked], bits)

    def gain_pieces(row: dict) -> pa.RecordBatch:
        b = _Block(row)
        p = _Pairs(b)
        c = _Contexts(b, p, _Triples(b, p))
        return _pieces(b.block, p.keys[c.asked], c.gain[c.asked], bits)

    def kept_words(row: dict) -> pa.RecordBatch:
        b = _Block(row)
        p = _Pairs(b)
        word = np.unique(b.vocabulary[p.next[_Contexts(b, p, _Triples(b, p)).kept]])
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64))], ["word"])

    known_triples = deeper.join(added_up(each(deeper, triple_pieces, _PIECE), "triple"), "block", "left")
    whole = known_triples.join(added_up(each(known_triples, gain_pieces, _PIECE), "gain", "<f8"), "block", "left")

    # a context is also retained below which a longer one is
    retained = materialise(retained.union(each(whole, kept_words, "word bigint")).distinct())
    flags = sent_back(ones.select("block", "i", "word").join(retained, "word")).withColumnRenamed("i", "retained")

    kind = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)])
    for name, t in [("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("n_states", "long")]:
        schema = schema.add(name, t)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b, texts = _Block(row), len(row["lengths"])
            c = b.count[b.tokens]
            p = (c + ADDED) / (total + ADDED * (distinct + 1))
            add = lambda x, b=b, texts=texts: np.bincount(b.text, x, texts)
            base_score, n_known, states = add(np.log10(p)), add(c > 0), np.zeros(texts)
            if row["retained"] is not None:
                keep, pairs = np.zeros(len(b.count) + 1, bool), _Pairs(b)
                keep[_unpack(row["retained"], "<i8")] = True
                use = keep[pairs.word[pairs.number]]
                at, number = pairs.at[use], pairs.number[use]
                p[at] = (pairs.total[number] + WEIGHT * p[at]) / (b.count[pairs.word[number]] + WEIGHT)
                states = np.bincount(b.text[at], minlength=texts)
                t = _Triples(b, pairs)
                use = _Contexts(b, pairs, t).kept[t.outer[t.number]]
                at, number = t.at[use], t.number[use]
                p[at] = (t.total[number] + WEIGHT * p[at]) / (pairs.total[t.outer[number]] + WEIGHT)
            ids = pa.array(row["doc_id"], type=batch_type)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(b.lengths), pa.array(n_known.astype(np.int64)), pa.array(np.full(texts, total), pa.int64()), pa.array(base_score), pa.array(add(np.log10(p))), pa.array(states.astype(np.int64))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_states"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(kind)
    last = whole.join(blocks.select("block", "doc_id"), "block").join(flags, "block", "left")
    return last.mapInArrow(score, schema)
