"""Vectors packed in blocks, for operators that compare them in bulk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def rows_of(batch: pa.RecordBatch, ids: int = 0, vectors: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of doubles) for each dimension in the batch.

    Rows whose vector is null or holds null or non-finite components, and rows
    with a null id, are left out.
    """
    if not batch.num_rows:
        return
    column = batch.column(vectors)
    size = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()])
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    known = batch.column(ids).is_valid().to_numpy(zero_copy_only=False)
    names = np.array([x if x is not None else 0 for x in batch.column(ids).to_pylist()], np.int64)
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero((size == d) & known)
        m = values[(ends[rows] - d)[:, None] + np.arange(d)]  # a null component is a NaN here
        good = np.isfinite(m).all(1)
        yield names[rows[good]], m[good]
