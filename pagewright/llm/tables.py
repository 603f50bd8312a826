"""A table from whole numbers to whole numbers that numpy looks up many at once."""

from __future__ import annotations

import numpy as np


class IntTable:
    """Keys that are not negative with their values; a quarter full at most, with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int32), np.zeros(self.mask + 1, np.int32)
        for key, value, at in zip(keys.tolist(), values.tolist(), self._place(keys).tolist(), strict=True):
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, value

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint32) * np.uint32(2654435769)) >> self.shift).astype(np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of ``keys``, -1 where there is none."""
        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            same = found == keys[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (found != -1)]
        return out
