"""Runs of unequal length, end to end in one array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of lists without an empty one: (where each begins, the number of every entry, the different entries)."""
    counts, entries = lists.value_lengths().to_numpy(), lists.flatten().dictionary_encode()
    return np.cumsum(counts) - counts, entries.indices.to_numpy().astype(np.int64), entries.dictionary


def gathered(size: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values, `size` long each, put one after another as `which` says."""
    begin, n = np.cumsum(size) - size, size[which]
    ends = np.cumsum(n)
    return n, values[np.repeat(begin[which] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)]
