"""Hashes of words and of windows of words, for many texts at once.

Words are read eight bytes at a time, all words of some megabytes of text together; a word's hash, like a window's, is
put together from those of its parts by a mix in which every bit of the first part is spread before the second joins,
so that nothing cancels out, as it can in polynomials modulo a power of two. Two lanes give 128 bits. What is held of a
long text is 16 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are found at once, at least; a longer word is not cut.
SEGMENT = 4 << 20
#: Bytes of the longest word that is read along with the others; a longer one is digested by itself.
LONGEST = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240501).integers(0, 1 << 64, 2, dtype=np.uint64)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of two parts, one after the other."""
    return scramble(scramble(first + _ODD) * _ODD + second)


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end; no word spans one of the edges (places of the data or its end)."""
    inside = ~_SPACE[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    first, last = edges[edges < len(data)], edges[edges > 0] - 1
    begin[first], finish[last] = inside[first], inside[last]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int) -> list[np.ndarray]:
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    length = end - start
    out = [scramble(length.astype(np.uint64) + _SEEDS[lane]) for lane in range(lanes)]
    some = np.flatnonzero(length <= LONGEST)
    for a in range(0, LONGEST, 8):
        some = some[length[some] > a]
        if not len(some):
            break
        part = eight[start[some] + a] & _MASKS[np.minimum(length[some] - a, 8)]
        for lane in range(lanes):
            out[lane][some] = joined(out[lane][some], part)
    for i in np.flatnonzero(length > LONGEST).tolist():
        digest = np.frombuffer(blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest(), "<u8")
        for lane in range(lanes):
            out[lane][i] = digest[lane]
    return out


def _segments(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of texts and of bytes: all texts together where they are small, else each by itself and a long one in
    pieces that end at white space."""
    if ends[-1] - ends[0] <= SEGMENT:
        yield 0, len(ends) - 1, int(ends[0]), int(ends[-1])
        return
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        while b - a > SEGMENT:
            cut = a + SEGMENT
            while cut < b:  # the next white space
                gap = np.flatnonzero(_SPACE[data[cut : min(b, cut + SEGMENT)]])
                if len(gap):
                    cut += int(gap[0])
                    break
                cut = min(b, cut + SEGMENT)
            yield i, i + 1, a, cut
            a = cut
        yield i, i + 1, a, b


def hashed(texts: pa.Array, lanes: int = 2, prints: bool = False) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    """The words of texts (an Arrow array of strings), one text after the other: lanes of their hashes, the number of
    words of each text, and digests of the texts' sequences of words if asked for (by both lanes). A null text has no
    words. Words are runs of other than ASCII white space."""
    if not len(texts):
        return [np.zeros(0, np.uint64)] * lanes, np.zeros(0, np.int64), []
    texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, body = texts.buffers()
    ends = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    parts: list[list[np.ndarray]] = [[] for _ in range(lanes)]
    counts = np.zeros(len(texts), np.int64)
    digests = [blake2b(digest_size=16) for _ in range(len(texts) if prints else 0)]
    for i, j, a, b in _segments(data, ends):
        edges = np.clip(ends[i : j + 1], a, b) - a
        start, end = _words(data[a:b], edges)
        found = _hashes(data[a:b], start, end, lanes)
        for column, values in zip(parts, found):
            column.append(values)
        at = np.searchsorted(start, edges)
        counts[i:j] += np.diff(at)
        if prints:
            both = np.stack(found, axis=1)
            for k, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if x < y:
                    digests[i + k].update(both[x:y].data)
    flat = [column[0] if len(column) == 1 else np.concatenate(column) for column in parts]
    return flat, counts, [d.digest() for d in digests]


#: Words whose windows are put together at once.
CHUNK = 1 << 19


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    if n > CHUNK:
        out = np.empty(n, np.uint64)
        for a in range(0, n, CHUNK):
            out[a : a + CHUNK] = windows(hashes[a : a + CHUNK + size - 1], size)
        return out
    level, reach, at, out, left = hashes, 1, 0, None, size
    while True:
        if left & 1:
            part = level[at : at + n]
            out = part if out is None else joined(out, part)
            at += reach
        left >>= 1
        if not left:
            return out
        level = joined(level[:-reach], level[reach:])
        reach *= 2


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after the other."""
    total = int(length.sum())
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)


def spans(hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of spans of words: two windows of a power of two that cover a span, and its length."""
    inner = hashes[ranges(start, length)]  # the spans alone: usually few of the words
    start = np.cumsum(length) - length
    out = np.zeros(len(start), np.uint64)
    level, reach = inner, 1
    while len(start):
        here = np.flatnonzero((length >= reach) & (length < 2 * reach))
        if len(here):
            a, n = start[here], length[here]
            out[here] = joined(joined(level[a], level[a + n - reach]), n.astype(np.uint64))
        if 2 * reach > length.max():
            break
        level = joined(level[:-reach], level[reach:])
        reach *= 2
    return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least value of each ``size`` consecutive ones, by windows of doubling length."""
    reach = 1
    while 2 * reach <= size:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (size - reach)], x[size - reach :]) if size > reach else x
