"""64-bit hashes of many substrings of one byte string at once."""

from __future__ import annotations

import numpy as np

_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 17)
        up, down = np.full(size, _P, dtype=np.uint64), np.full(size, pow(_P, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: bytes, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """A hash of ``data[s:e]`` for each pair, from prefix sums of a polynomial; it depends on the bytes alone."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
