"""The minimiser kernel on arrays: a batch of reads at once, no loop over bases.

The constants below belong to the published definition of the hash: ranks of the five-letter alphabet in alphabetical
order, the first base the most significant digit, forward and reverse complement combined with one seed, the smaller
unsigned value taken. With k of 27 at most the seed's top bit sets the sign of every value, so that signed order is
unsigned order.
"""

from __future__ import annotations

import numpy as np

#: Alphabet in rank order, its complement, and the seed.
LETTERS, COMPLEMENT = b"ACGNT", b"TGCNA"
SEED = 0x8F3F73B5CF1C9ADE
LONGEST_K = 27

_RANK = np.full(256, LETTERS.index(b"N"), np.uint8)
for _i, _c in enumerate(LETTERS):
    _RANK[[_c, ord(chr(_c).lower())]] = _i
_RANK[[ord("U"), ord("u")]] = LETTERS.index(b"T")
_TURNED = np.array([LETTERS.index(c) for c in COMPLEMENT], np.uint8)


#: Places that are hashed at once, so that what is held beside the result fits a cache.
STEP = 1 << 15


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers of a byte array (also across reads; the caller knows which to use)."""
    n = max(0, len(data) - k + 1)
    out = np.empty(n, np.uint64)
    for a in range(0, n, STEP):
        out[a : a + STEP] = _hashes(data[a : a + STEP + k - 1], k)
    return out


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The same of a short array: numbers of 1, 2, 4 ... digits, and k digits from those of the bits of k."""
    rank = _RANK[data]
    forward, backward = rank.astype(np.uint64), _TURNED[rank].astype(np.uint64)
    power = lambda m: np.uint64(5**m)
    held, m = 0, 1
    while m <= k:
        if k & m:
            n = len(forward) - held
            if held:
                f, r = f[:n] * power(m) + forward[held:], r[:n] + backward[held:] * power(held)
            else:
                f, r = forward, backward
            held += m
        if 2 * m <= k:
            forward, backward = forward[:-m] * power(m) + forward[m:], backward[:-m] + backward[m:] * power(m)
        m *= 2
    return np.minimum(f ^ np.uint64(SEED), r ^ np.uint64(SEED))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least value of each ``size`` consecutive ones."""
    reach = 1
    while 2 * reach <= size:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (size - reach)], x[size - reach :]) if size > reach else x


def _distinct(values: np.ndarray, start: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    long = np.flatnonzero(count >= width)
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(long):
        least = sliding_min(values, width)
        n = count[long] - width + 1
        at = np.repeat(start[long] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner, found_ = np.repeat(long, n), least[at]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (found_[1:] != found_[:-1])])
        owners.append(owner[new])
        found.append(found_[new])
    for i in np.flatnonzero((count > 0) & (count < width)):
        owners.append(np.array([i]))
        found.append(values[start[i] : start[i] + count[i]].min(keepdims=True))
    owner, value = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _emitted(values: np.ndarray, start: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All reads step together from one minimum to the next: a smaller value that enters, or, when the minimum leaves
    its window first, the rightmost least value of the window then."""
    owner = np.flatnonzero(count > 0)
    end = start[owner] + count[owner]
    wide = np.minimum(width, count[owner])
    padded = np.concatenate([values, np.full(width, np.iinfo(np.uint64).max, np.uint64)])
    reach = np.arange(width)

    def rightmost(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        window = np.where(reach < size[:, None], padded[at[:, None] + reach], np.iinfo(np.uint64).max)
        return at + width - 1 - window[:, ::-1].argmin(1)

    owners, found = [], []
    at = rightmost(start[owner], wide) if len(owner) else owner
    while len(owner):
        owners.append(owner)
        found.append(values[at])
        ahead = np.where(at[:, None] + 1 + reach < end[:, None], padded[np.minimum(at[:, None] + 1 + reach, len(padded) - 1)], np.iinfo(np.uint64).max)
        smaller = (ahead < values[at][:, None]) & (reach < wide[:, None] - 1)
        drops = smaller.any(1)
        leaves = ~drops & (at + wide < end)
        go = drops | leaves
        following = np.where(drops, at + 1 + smaller.argmax(1), rightmost(np.minimum(at + 1, len(values)), wide))
        owner, end, wide, at = owner[go], end[go], wide[go], following[go]
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner, value = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return owner[order], value[order]


def minimisers(reads: list[bytes], k: int, w: int, emission: str = "exact") -> tuple[np.ndarray, np.ndarray]:
    """Index of the read and value (as signed) of each minimiser, by read.

    ``exact`` keeps the order and multiplicity of emission, ``distinct`` the set of each read, sorted. A read shorter
    than w has one window of what there is; a read shorter than k has none.
    """
    size = np.array([len(r) for r in reads], np.int64)
    start = np.cumsum(size) - size
    values = kmer_hashes(np.frombuffer(b"".join(reads), np.uint8), k)
    owner, value = (_emitted if emission == "exact" else _distinct)(values, start, np.maximum(0, size - k + 1), w - k + 1)
    return owner, value.view(np.int64)
