"""Array columns of Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows_of(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths, without nulls, as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def list_array(rows: np.ndarray) -> pa.ListArray:
    """A matrix as an array column, a list for each row."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel()))
