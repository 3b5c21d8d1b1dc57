"""Scalars of :mod:`gridloom.functions.scalars` on numpy arrays, for kernels inside tasks (NaN stands for null)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def clip(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """A missing value stays missing."""
    return np.minimum(np.maximum(x, lo), hi)


def bridge_alpha(q_left: np.ndarray, q_right: np.ndarray, gap: np.ndarray, lo: float, hi: float, gap_scale: float) -> np.ndarray:
    score = clip(0.5 * (q_left + q_right) / 5.0, 0.0, 1.0)
    penalty = 1.0 + np.maximum(gap - 1, 0) / max(gap_scale, 1.0)
    return clip((lo + (hi - lo) * score) / penalty, 0.05, 0.95)


def single_obs_alpha(q: np.ndarray, mismatch: np.ndarray, scale: float, hi: float) -> np.ndarray:
    base = 0.05 + 0.15 * clip(q / 5.0, 0.0, 1.0)
    return clip(base / (1.0 + np.abs(mismatch) / max(scale, 1e-6)), 0.02, hi)


def soft_anchor_alpha(n_obs: np.ndarray | float, mismatch: np.ndarray, ref: float, lo: float, hi: float, scale: float) -> np.ndarray:
    base = clip(n_obs / max(ref, 1.0), lo, hi)
    return clip(base / (1.0 + np.abs(mismatch) / max(scale, 1e-6)), 0.02, 1.0)


def doubles(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Values of a numeric column, NaN where it is null."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def known(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.combine_chunks().is_valid().to_numpy(zero_copy_only=False)
