"""Keys along a Hilbert curve, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of the points ``cells``, ``bits`` bits per axis.

    Bit by bit from the top, an axis whose bit is set mirrors the first axis below that bit,
    and any other swaps its lower bits with the first axis; a Gray code over the axes and the
    interleaved bits then give the position (Skilling 2004). ``bits`` times the axes is at
    most 63, so keys are non-negative longs.
    """
    axes = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for k in range(len(axes)):
            mirrored = (axes[k] >> bit & 1).astype(bool)
            swap = np.where(mirrored, 0, (axes[0] ^ axes[k]) & below)
            axes[0] = np.where(mirrored, axes[0] ^ below, axes[0] ^ swap)
            if k:
                axes[k] = axes[k] ^ swap
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    turned = np.zeros(len(cells), dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where(axes[-1] >> bit & 1, (1 << bit) - 1, 0)
    key = np.zeros(len(cells), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | (axis ^ turned) >> bit & 1
    return key


@dataclass(frozen=True)
class Curve:
    """The axes of a curve for vectors of one width, and where each is cut into cells."""

    axes: np.ndarray
    cuts: np.ndarray
    bits: int

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        at = vectors @ self.axes
        cells = [np.searchsorted(self.cuts[:, k], at[:, k]) for k in range(at.shape[1])]
        return hilbert_keys(np.stack(cells, axis=1), self.bits) if cells else np.zeros(len(vectors), np.int64)


def fit_curve(sample: np.ndarray, axes: int, bits: int) -> Curve:
    """A curve along the directions in which ``sample`` varies most, its cells equally full."""
    count = min(axes, sample.shape[1])
    scale = max(float(np.abs(sample).max(initial=0)), 1.0)
    centred = sample / scale - (sample / scale).mean(axis=0)
    directions = np.linalg.svd(centred, full_matrices=True)[2][:count].T / scale
    shares = np.arange(1, 1 << bits) / (1 << bits)
    cuts = np.quantile(sample @ directions, shares, axis=0) if count else np.zeros((len(shares), 0))
    return Curve(directions, cuts, bits)
