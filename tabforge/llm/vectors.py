"""Vectors as matrices inside tasks: what the embedding operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) per vector length; null and empty vectors and those with null or non-finite components are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == length)
        rows = flat[starts[at][:, None] + np.arange(length)]
        good = np.isfinite(rows).all(axis=1)
        yield at[good], rows[good]


def integers(rows: np.ndarray, scale: float, limit: int) -> np.ndarray:
    """floor(scale * x), held between -limit and limit (at most 2^53)."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(rows * scale), -limit, limit).astype(np.int64)


def packed(rows: np.ndarray) -> list[bytes]:
    """Little-endian bytes of each row."""
    return [r.tobytes() for r in np.ascontiguousarray(rows)]


def packed_floats(rows: np.ndarray) -> list[bytes]:
    """Bytes of each row of doubles, as single floats where these hold the same numbers."""
    with np.errstate(over="ignore"):
        small = rows.astype(np.float32)
    same = (small == rows).all(axis=1)
    return [(s if fit else r).tobytes() for r, s, fit in zip(rows, small, same)]


def unpacked_floats(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of doubles of ``packed_floats``."""
    cells = column.to_pylist()
    if all(len(c) == 4 * dim for c in cells):
        return np.frombuffer(b"".join(cells), np.float32).reshape(len(cells), dim).astype(np.float64)
    return np.array([np.frombuffer(c, np.float32 if len(c) == 4 * dim else np.float64) for c in cells], dtype=np.float64).reshape(len(cells), dim)
