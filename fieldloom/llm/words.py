"""Words and word shingles of many texts at once, as 64-bit hashes in NumPy arrays.

A word's hash is a polynomial of its bytes, taken from prefix sums, then mixed.
Equal words have equal hashes in every process, so hashes can be joined on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

# Letters, digits and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
# The same without capitals: the text has been lower-cased before.
LOWER_ALNUM = ALNUM.copy()
LOWER_ALNUM[0x41:0x5B] = False
# Everything but space and the controls from tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Values in (0, 1] from scrambled 64-bit values."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < size:
        steps = [np.full(size, f, np.uint64) for f in (_FACTOR, _INVERSE)]
        for s in steps:
            s[0] = 1
        _powers = tuple(np.multiply.accumulate(s) for s in steps)
    return _powers


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the offsets of the texts (one more than texts). Null is empty."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of several texts: byte range, hash, number of the text, and where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray  # one more than texts


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """All maximal runs of bytes of a kind; no word crosses the end of its text."""
    inside = kind[data]
    begin, final = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    final[:-1] &= ~inside[1:]
    edge = offsets[1:-1][offsets[1:-1] < len(data)]
    edge = edge[edge > 0]
    begin[edge] = inside[edge]
    final[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(final) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:len(data)], out=sums[1:])
    value = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, offsets)
    return Words(start, end, value, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def hash_of(words_: list[str]) -> np.ndarray:
    """The hashes that ``words`` gives these words."""
    data = np.frombuffer(" ".join(words_).encode(), np.uint8)
    return words(data, np.array([0, len(data)]), NOT_SPACE).hash


def windows(w: Words, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of each run of ``size`` words.

    With ``short`` a text of fewer words, but at least one, has one shingle of all its words.
    """
    n = len(w.hash) - size + 1
    if n > 0:
        at = np.flatnonzero(w.text[:n] == w.text[size - 1:])
        value = np.zeros(len(at), np.uint64)
        for j in range(size):
            value = value * _FACTOR + w.hash[at + j]
        value = mix(value)
    else:
        at, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = w.text[at] if len(at) else np.zeros(0, np.int64)
    if short:
        count = np.diff(w.first)
        for t in np.flatnonzero((count > 0) & (count < size)):
            run = np.uint64(count[t])
            for x in w.hash[w.first[t]:w.first[t + 1]]:
                run = mix(np.array([run ^ x]))[0]
            value, text, at = np.append(value, run), np.append(text, t), np.append(at, w.first[t])
        order = np.argsort(text, kind="stable")
        value, text, at = value[order], text[order], at[order]
    return value, text, at
