"""The Castagnoli checksum, of many lanes at once."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Fixed value: the polynomial, lowest power first.
POLYNOMIAL = 0x82F63B78
#: Lanes into which long content is cut.
LANES = 1024


@cache
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


def _fed(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    table = _table()
    for column in columns:
        state = table[(state ^ column) & 0xFF] ^ (state >> 8)
    return state


@cache
def _zeros(n: int) -> np.ndarray:
    """What each bit of a state becomes after ``n`` bytes of zero, by squaring."""
    if n == 1:
        return _fed((np.uint32(1) << np.arange(32, dtype=np.uint32)), np.zeros((1, 32), np.uint8))
    half = _zeros(n // 2)
    twice = _applied(half, half)
    return _applied(_zeros(1), twice) if n % 2 else twice


def _applied(step: np.ndarray, states: np.ndarray) -> np.ndarray:
    """A linear step, by what it makes of each bit, of several states."""
    bits = (states[:, None] >> np.arange(32, dtype=np.uint32)) & 1
    return np.bitwise_xor.reduce(np.where(bits.astype(bool), step, np.uint32(0)), axis=1)


def crc32c(content: bytes) -> int:
    data = np.frombuffer(content, np.uint8)
    width = len(data) // LANES
    state = np.full(1, 0xFFFFFFFF, np.uint32)
    if width:
        lanes = _fed(np.zeros(LANES, np.uint32), data[: LANES * width].reshape(LANES, width).T)
        for lane in lanes:
            state = _applied(_zeros(width), state) ^ lane
        data = data[LANES * width :]
    return int(_fed(state, data[:, None])[0]) ^ 0xFFFFFFFF
