"""Operator 13: byte pair encoding of whole texts, and decoding.

A text is cut at white space, each piece into words, and each word into parts
that are single characters first. A word is a row of its parts, which stand for
their boundaries, and a second row of the ranks of every two adjacent parts. The
lowest rank is sought, the boundary inside that pair deleted, and the ranks on
both sides are looked up again, until no pair has a rank. All new words of a
portion with about one length do each round together, as the rows of two arrays. Words
of more than ``LONG_WORD`` characters keep their pairs in a heap, since seeking
the lowest anew for each merge takes the square of the length; both ways give
the same parts.

The vocabulary is a file of the ``tokenizers`` library whose words are lower
case, cut by a pattern, written byte by byte, and marked at their end. The
library itself is asked only to normalise pieces that are not ASCII.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from fieldloom.llm.common import SPACES, per_portion

# Words of more characters are merged with a heap, and are not remembered.
LONG_WORD = 64
# Pieces and words a task remembers between portions; beyond it the memory starts anew.
REMEMBERED = 1 << 18
NO_RANK = 1 << 30


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints one, else the next free one from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


def first_parts(words: list[str], inner: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """A row for each word: the ids of its bytes, the last one from ``last``, filled up with -1."""
    raw = [w.encode() for w in words]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8)
    out = np.full((len(raw), int(length.max())), -1, np.int32)
    out[np.arange(out.shape[1]) < length[:, None]] = inner[flat]
    if last is not None:
        out[np.arange(len(raw)), length - 1] = last[flat[np.cumsum(length) - 1]]
    return out


class Merges:
    """Ranks of pairs of parts, and the part each makes."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        both = np.array(pairs, np.int64).reshape(-1, 2)
        key = both[:, 0] << 32 | both[:, 1]
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), np.array(made, np.int32)
        self.of_pair = {pair: i for i, pair in reversed(list(enumerate(pairs)))}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where it has none."""
        if not len(self.key):
            return np.full(left.shape, NO_RANK, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NO_RANK).astype(np.int32)

    def rows(self, parts: np.ndarray) -> list[bytes]:
        """The parts of several words after all merges, as little-endian unsigned 32-bit integers.

        The lowest rank comes first, of equal ranks the leftmost. Shorter words are filled up with -1, which joins nothing.
        """
        done = [b""] * len(parts)
        which = np.arange(len(parts))
        joint = self.ranks(parts[:, :-1], parts[:, 1:])
        while True:
            at = joint.argmin(axis=1) if joint.shape[1] else np.zeros(len(which), np.int64)
            low = joint[np.arange(len(which)), at] if joint.shape[1] else np.full(len(which), NO_RANK, np.int32)
            ended = low == NO_RANK
            if ended.any():
                width = 4 * parts.shape[1]
                sizes = 4 * (parts[ended] >= 0).sum(axis=1)
                ids = parts[ended].astype("<u4").tobytes()
                for k, (w, n) in enumerate(zip(which[ended].tolist(), sizes.tolist(), strict=True)):
                    done[w] = ids[width * k:width * k + n]
                going = ~ended
                which, parts, joint, at, low = which[going], parts[going], joint[going], at[going], low[going]
            n = len(which)
            if not n:
                break
            row = np.arange(n)
            parts[row, at] = self.made[low]
            kept = np.ones(parts.shape, bool)
            kept[row, at + 1] = False
            parts = parts[kept].reshape(n, -1)
            kept = np.ones(joint.shape, bool)
            kept[row, at] = False
            joint = joint[kept].reshape(n, -1)
            for side in (at - 1, at):
                inside = np.flatnonzero((side >= 0) & (side < joint.shape[1]))
                joint[inside, side[inside]] = self.ranks(parts[inside, side[inside]], parts[inside, side[inside] + 1])
        return done

    def of_words(self, words: list[str], inner: np.ndarray, last: np.ndarray | None = None) -> dict[str, bytes]:
        """The ids of words. Those of up to 8, 16, 32 characters, and so on, are merged together."""
        by_size = defaultdict(list)
        for w in words:
            by_size[(len(w) - 1).bit_length()].append(w)
        out = {}
        for group in by_size.values():
            # a round's arrays stay small
            for i in range(0, len(group), 1 << 14):
                some = group[i:i + (1 << 14)]
                out.update(zip(some, self.rows(first_parts(some, inner, last)), strict=True))
        return out

    def long(self, parts: list[int]) -> list[int]:
        """The same for one long word, with a heap of pairs."""
        n, parts = len(parts), list(parts)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))

        def joint(i: int) -> int:
            return self.of_pair.get((parts[i], parts[following[i]]), NO_RANK) if following[i] < n else NO_RANK

        queue = [(r, i) for i in range(n) if (r := joint(i)) < NO_RANK]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            # stale once the left part is gone or a side of the pair has changed
            if parts[i] < 0 or joint(i) != r:
                continue
            j = following[i]
            parts[i], parts[j], following[i] = int(self.made[r]), -1, following[j]
            if following[j] < n:
                previous[following[j]] = i
            for k in (previous[i], i):
                if k >= 0 and (r := joint(k)) < NO_RANK:
                    heapq.heappush(queue, (r, k))
        return [p for p in parts if p >= 0]


@dataclass
class Vocabulary:
    """Ids of the parts, the merges, the cut into words, and strings that have an id of their own."""

    ids: dict[str, int]
    merges: Merges
    pattern: regex.Pattern
    ending: str
    special: dict[str, int]
    normalise: Callable[[str], str]
    cut: Callable[[str], list[tuple[str, tuple[int, int]]]]

    def __post_init__(self):
        characters = byte_characters()
        self.inner = np.array([self.ids[c] for c in characters], np.int32)
        self.last = np.array([self.ids[c + self.ending] for c in characters], np.int32)
        self.parts = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        # of two special strings that begin at one place, the longer
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Find the ids of words, as little-endian unsigned 32-bit integers."""
        plain = []
        for w in words:
            if len(w) > LONG_WORD:
                self.words[w] = np.array(self.merges.long(first_parts([w], self.inner, self.last)[0].tolist()), "<u4").tobytes()
            else:
                plain.append(w)
        self.words.update(self.merges.of_words(plain, self.inner, self.last))

    def words_of(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if text.isascii():
            return self.pattern.findall(text.lower())
        text = self.normalise(text)
        if any([unicodedata.category(c) == "Cn" for c in text]):
            # too new for this Python: the library knows its own letters and digits
            return [text[a:b] for _, (a, b) in self.cut(text)]
        return self.pattern.findall(text)

    def split(self, piece: bytes) -> list[str | int]:
        """The words of a piece between white space, and the ids of special strings in it."""
        text = piece.decode()
        if self.apart is None or not self.apart.search(text):
            return self.words_of(text)
        return [x for i, s in enumerate(self.apart.split(text)) for x in ([self.special[s]] if i % 2 else self.words_of(s))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Neither words, special strings nor composed characters reach across white space."""
        cut = [t.encode().split() for t in texts]
        new = {p: self.split(p) for p in set().union(*cut).difference(self.pieces)}
        self.learn({w for words in new.values() for w in words if isinstance(w, str) and w not in self.words})
        for p, words in new.items():
            self.pieces[p] = b"".join([self.words[w] if isinstance(w, str) else np.array([w], "<u4").tobytes() for w in words])
        ids = [b"".join([self.pieces[p] for p in pieces]) for pieces in cut]
        for known in (self.pieces, self.words):
            if len(known) > REMEMBERED:
                known.clear()
        for p, words in new.items():
            if len(p) > LONG_WORD:
                self.pieces.pop(p, None)
                for w in words:
                    self.words.pop(w, None)
        return ids

    def decode(self, ids: bytes) -> str:
        """The parts that the ids stand for, with a space between."""
        return " ".join([self.parts[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.cache
def load(path: str) -> Vocabulary:
    """The vocabulary of a file; read once in each process.

    Refused, since their rules differ: files with other normalisers or cuts, with a decoder, with unknown or fused parts, or
    with special strings that hold or take white space.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, added = spec["model"], spec["added_tokens"]
    steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    other = [model.get(k) for k in ("unk_token", "continuing_subword_prefix", "dropout", "byte_fallback", "fuse_unk", "ignore_merges")]
    odd = [t for t in added if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or any(c in t["content"] for c in SPACES)]
    if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or spec["decoder"] or any(other) or odd:
        raise ValueError(f"{path}: not a vocabulary of lower-case words with marked ends")
    # in the file, white space is the Unicode property
    pattern = regex.compile(cuts[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids, library = model["vocab"], Tokenizer.from_file(path)
    merges = Merges([(ids[a], ids[b]) for a, b in pairs], [ids[a + b] for a, b in pairs])
    return Vocabulary(ids, merges, pattern, model["end_of_word_suffix"] or "", {t["content"]: t["id"] for t in added}, library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str)


def encoded(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows (row, ids, n_tokens): the row's columns, or those to carry, as a struct, and the ids of its whole text as
    little-endian unsigned 32-bit integers.

    ``path`` is the vocabulary's file, the same on every machine. A null text is an empty one, which has no ids. Every row
    comes out once, repeated ones too; texts are taken a portion at a time and none is cut.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = load(path).encode(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())], ["row", "ids", "n_tokens"])

    return rows.mapInArrow(per_portion(work), T.StructType([rows.schema["row"]]).add("ids", "binary").add("n_tokens", "long"))


def decoded(ids: DataFrame, path: str, column: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Rows (row, decoded): the row's columns, or those to carry, as a struct, and the text that its ids stand for.

    Null ids are no ids and make the empty text. An id that the vocabulary lacks is an error.
    """
    rows = ids.select(F.struct(*[F.col(f"`{c}`") for c in (ids.columns if carry is None else carry)]).alias("row"), F.coalesce(F.col(column), F.lit(b"")).alias("ids"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = load(path).decode
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array([decode(i) for i in batch.column("ids").to_pylist()], pa.string())], ["row", "decoded"])

    return rows.mapInArrow(per_portion(work, "ids"), T.StructType([rows.schema["row"]]).add("decoded", "string"))
