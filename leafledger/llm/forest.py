"""Groups of linked indices within one task."""

from __future__ import annotations

import numpy as np


class Forest:
    """Smallest index of each group of linked indices, kept up by array operations."""

    def __init__(self, size: int) -> None:
        self.label = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            x, y = self.label[a], self.label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (jump := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = jump

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Every index that has a smaller one in its group, and the smallest of the group."""
        linked = np.flatnonzero(self.label != np.arange(self.label.size))
        return linked, self.label[linked]
