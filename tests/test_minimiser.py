import random

import pytest

from readsift.functions import kernel

RANK = {c: i for i, c in enumerate("ACGNT")}
TURN = dict(zip("ACGNT", "TGCNA"))


def plain(seq, k, w):
    """The definition, one window after the other: emissions and the set of window minima."""
    seq = "".join(c if c in "ACGT" else "T" if c == "U" else "N" for c in seq.upper())
    hashes = []
    for i in range(len(seq) - k + 1):
        both = []
        for s in (seq[i : i + k], "".join(TURN[c] for c in reversed(seq[i : i + k]))):
            h = 0
            for c in s:
                h = h * 5 + RANK[c]
            both.append(h ^ kernel.SEED)
        hashes.append(min(both))
    if not hashes:
        return [], set()
    width = min(w - k + 1, len(hashes))
    right = lambda a: max(range(a, a + width), key=lambda i: (-hashes[i], i))
    at = right(0)
    out, minima = [hashes[at]], {min(hashes[:width])}
    for a in range(1, len(hashes) - width + 1):
        minima.add(min(hashes[a : a + width]))
        new = a + width - 1
        if at < a:
            at = right(a)
            out.append(hashes[at])
        elif hashes[new] < hashes[at]:
            at = new
            out.append(hashes[at])
    return out, minima


@pytest.mark.parametrize("k,w", [(19, 41), (3, 9), (4, 4), (2, 30), (1, 1), (27, 60)])
def test_as_the_definition(k, w):
    r = random.Random(k)
    reads = ["", "A" * (k - 1), "ACGT" * 40, "a" * 200, "NNNN", "acgu" * 10]
    reads += ["".join(r.choice("ACGTN"[: r.choice([2, 4, 5])]) for _ in range(r.randint(0, 300))) for _ in range(60)]
    for emission in ("exact", "distinct"):
        owner, value = kernel.minimisers([x.encode() for x in reads], k, w, emission)
        for i, read in enumerate(reads):
            got = [int(v) % (1 << 64) for v in value[owner == i]]
            emitted, minima = plain(read, k, w)
            if emission == "exact":
                assert got == emitted, (i, read)
            else:
                assert got == sorted(minima)


def test_reverse_complement_has_the_same_set():
    read = "".join(random.Random(1).choice("ACGT") for _ in range(500))
    other = "".join(TURN[c] for c in reversed(read))
    values = [set(kernel.minimisers([x.encode()], 19, 41)[1].tolist()) for x in (read, other)]
    assert values[0] == values[1]
