"""Postings as packed arrays: one row holds many, as bytes, for one bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """A bucket from 0 to n - 1 for each 64-bit hash."""
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def packed(to: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    """One row for each value of ``to``: it and the values of each column, as bytes."""
    order = np.argsort(to, kind="stable")
    to, cols = to[order], tuple(c[order] for c in cols)
    at = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.empty(0, int)
    ends = np.concatenate((at[1:], [len(to)])) if len(to) else at
    own = [[c[s:e].tobytes() for s, e in zip(at, ends)] for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(to[at], pa.int32()), *(pa.array(x, pa.binary()) for x in own)], names=["to", *"abc"[: len(cols)]])
