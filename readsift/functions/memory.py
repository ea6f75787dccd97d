"""What keeps a Python worker small: values of a column in runs of bounded size, and freed memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(column: pa.Array, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """The values of a string column from the first to the last, null as empty, as (place of the first, values) of about
    ``most`` bytes; a longer value stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:]):
        yield a, [v or b"" for v in column.slice(a, b - a).cast(pa.binary()).to_pylist()]


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and those of one stage stand beside the next's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
