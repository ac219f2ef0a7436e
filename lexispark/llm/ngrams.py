"""Hashed character n-gram counts of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def counts(points: np.ndarray, bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    """How often each of 2**bits hashed n-grams of the given sizes occurs."""
    out = np.zeros(1 << bits, np.int64)
    with np.errstate(over="ignore"):
        for n in sizes:
            if len(points) < n:
                continue
            mixed = np.full(len(points) - n + 1, n, np.uint32)
            for k in range(n):
                mixed = (mixed ^ points[k : len(points) - n + 1 + k]) * np.uint32(MULTIPLIERS[k % 4])
                mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            out += np.bincount(mixed >> np.uint32(32 - bits), minlength=1 << bits)
    return out
