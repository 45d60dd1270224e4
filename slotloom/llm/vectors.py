"""Vectors of floats as exact whole numbers, read off Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Whole numbers up to these sizes are exact in the two kinds of floats.
SINGLE, DOUBLE = 2**24, 2**53


def complete(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Row numbers of the lists that are not null, have no null or non-finite component and, if given, ``dim`` ones."""
    n = len(column)
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten()
    bad = ~np.isfinite(pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(n), np.maximum(length, 0))
    good = (length >= 0) if dim is None else (length == dim)
    good[owner[bad]] = False
    return np.flatnonzero(good)


def floors(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of every component, as doubles; every list has ``dim`` components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.floor(scale * flat).reshape(len(column), dim)


def largest(x: np.ndarray) -> int:
    """The largest size of a component, or more than any double where scaling has left them."""
    most = float(np.abs(x).max(initial=0))
    return int(most) if np.isfinite(most) else 1 << 1024


def whole(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """The same as Python's whole numbers, for components of any size."""
    rows = [[_floor(v, scale) for v in row] for row in column.to_pylist()]
    return np.array(rows, object).reshape(len(rows), dim)


def _floor(v: float, scale: float) -> int:
    """floor(scale * v) without rounding where the product is no double."""
    product = scale * float(v)
    if np.isfinite(product):
        return int(np.floor(product))
    (a, b), (c, d) = float(v).as_integer_ratio(), float(scale).as_integer_ratio()
    return a * c // (b * d)
