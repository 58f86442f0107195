"""Columns of vectors as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of all vectors in a row, the n + 1 offsets, and which vectors are usable.

    A vector is usable if it is not null or empty, has no null, infinite or undefined component, and is not zero.
    """
    lists = pc.fill_null(column.cast(pa.large_list(pa.float64())), pa.scalar([], pa.large_list(pa.float64())))
    flat = lists.flatten()
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.r_[0, np.cumsum(lengths)]

    def counted(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags)][offsets])

    return values, offsets, (counted(~np.isfinite(values)) == 0) & (counted(values != 0) > 0)


def matrix(blobs: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, width)
