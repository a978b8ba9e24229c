"""Vectorised rolling hashes and window minima over many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads polynomial hashes evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``symbols[i:i+width]`` for each i; built by doubling, so it takes log2(width) passes."""
    if len(symbols) < width:
        return np.empty(0, dtype=np.uint64)
    done, level, size, power = None, mix(symbols.astype(np.uint64) + np.uint64(1)), 1, _BASE
    offset, left = 0, width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = level[offset:]
                done = part if done is None else done[: len(part)] * power + part[: len(done)]
                offset += size
            left >>= 1
            if left:
                level = level[:-size] * power + level[size:]
                power = power * power
                size *= 2
        return mix(done[: len(symbols) - width + 1])


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value of each ``values[i:i+width]`` (the last of equal ones), by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    best = np.arange(len(values), dtype=np.int64)
    size = 1
    while size * 2 <= width:
        a, b = best[:-size], best[size:]
        best = np.where(values[a] < values[b], a, b)
        size *= 2
    a, b = best[:n], best[width - size : width - size + n]
    return np.where(values[a] < values[b], a, b)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and the offset at which each text begins (one more at the end)."""
    joined = "".join(texts)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts
