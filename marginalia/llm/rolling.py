"""Vectorised rolling hashes over bytes, and the triggers that they set."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_WORD = 1 << 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-byte strings of ``data``, by doubling their length."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    of_length, power, length = {1: data.astype(np.uint64) + np.uint64(1)}, {1: _BASE}, 1
    while 2 * length <= size:
        short = of_length[length]
        of_length[2 * length] = short[:-length] * np.uint64(power[length]) + short[length:]
        power[2 * length] = power[length] ** 2 % _WORD
        length *= 2
    out, done = of_length[length], length
    while done < size:
        length //= 2
        if size - done >= length:
            out = out[: len(data) - done - length + 1] * np.uint64(power[length]) + of_length[length][done:]
            done += length
    return mixed(out[:n])


def sliding(best: Callable, x: np.ndarray, size: int) -> np.ndarray:
    """``best`` (minimum or maximum) over all runs of ``size`` values."""
    length = 1
    while 2 * length <= size:
        x = best(x[:-length], x[length:])
        length *= 2
    rest = size - length
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def triggers(data: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some ``window`` bytes; each such window has one."""
    hashes = gram_hashes(data, gram)
    span = window - gram + 1
    if len(hashes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding(np.minimum, hashes, span)
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), span) == hashes)
    return at, hashes[at]
