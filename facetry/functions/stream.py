"""Numbers of a sequential 64-bit generator, from any place of its stream.

A step of the generator is linear over the field of two elements, so many steps at once are a power of one 128 x 128 bit matrix.
Each task starts its blocks at their own place, and all of them together are the one sequential stream.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# The seeding's increment and multipliers, the step's turns and shift, the output's multipliers and turn.
SEED_STEP = 0x9E3779B97F4A7C15
SEED_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
TURN_FIRST, SHIFT, TURN_SECOND = 24, 16, 37
OUT_TIMES, OUT_TURN, OUT_TIMES_AGAIN = 5, 7, 9
_ALL = (1 << 64) - 1


def seeded(seed: int) -> np.ndarray:
    """The two words at the start of a seed's stream."""
    words = []
    for k in (2, 3):
        x = (seed + k * SEED_STEP) & _ALL
        for shift, by in zip((30, 27), SEED_MIX, strict=True):
            x = ((x ^ (x >> shift)) * by) & _ALL
        words.append(x ^ (x >> 31))
    return np.array(words, np.uint64)


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def advance(s: np.ndarray) -> np.ndarray:
    """States (n, 2) one step on."""
    both = s[:, 0] ^ s[:, 1]
    return np.column_stack((_turned(s[:, 0], TURN_FIRST) ^ both ^ (both << np.uint64(SHIFT)), _turned(both, TURN_SECOND)))


def output(s: np.ndarray) -> np.ndarray:
    return _turned(s[:, 0] * np.uint64(OUT_TIMES), OUT_TURN) * np.uint64(OUT_TIMES_AGAIN)


def _mapped(images: np.ndarray, s: np.ndarray) -> np.ndarray:
    """States under a linear map, given by its images of the 128 single bits."""
    out = np.zeros_like(s)
    for bit in range(128):
        on = (s[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        out ^= on[:, None] * images[bit]
    return out


@lru_cache(maxsize=128)
def _power(j: int) -> np.ndarray:
    """The map of 2 ** j steps."""
    if j:
        return _mapped(_power(j - 1), _power(j - 1))
    bits = np.zeros((128, 2), np.uint64)
    for bit in range(128):
        bits[bit, bit // 64] = np.uint64(1) << np.uint64(bit % 64)
    return advance(bits)


def jump(s: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """States (n, 2), each its own number of steps on."""
    s = s.copy()
    for j in range(int(steps.max()).bit_length() if len(steps) else 0):
        on = (steps >> j) & 1 == 1
        s[on] = _mapped(_power(j), s[on])
    return s
