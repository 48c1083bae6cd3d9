"""A small encoder for the encoder hook, with the interface of a sentence model."""

from __future__ import annotations

import hashlib

import numpy as np

from labelweave.operators.vectors import DIMS


class HashedCounts:
    """Counts of hashed blank-separated words."""

    def encode(self, texts: list[str]) -> np.ndarray:
        vectors = np.zeros((len(texts), DIMS), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in text.split():
                vectors[row, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % DIMS] += 1
        return vectors
