"""SHA-256 of many messages at once, going on from any kept state of the hash.

`hashlib` can copy a state but not store one. Here a state is what it is after whole blocks of 64 bytes: eight words.
The messages are digests as hex text, each just one block, so a state before any of them is such a state.
"""

from __future__ import annotations

import itertools
import math

import numpy as np


def _primes(n: int) -> list[int]:
    return list(itertools.islice((p for p in itertools.count(2) if all(p % q for q in range(2, math.isqrt(p) + 1))), n))


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 2)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**3 <= n else (low, middle)
    return low


# The first 32 bits behind the point of square and cube roots of primes.
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32).reshape(8, 1)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
_digit = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_four = np.arange(1 << 16)
HEX = sum(_digit[_four >> (4 * i) & 15] << np.uint32(8 * i) for i in range(4)).astype(np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block each (16, n or 1)."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        x = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
        y = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
        w.append(w[t - 16] + x + w[t - 7] + y)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[t] + ROUND[t])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([np.broadcast_to(x, state.shape[1:]) for x in (a, b, c, d, e, f, g, h)])


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the blocks (16, n) of their hex text."""
    out = np.empty((16, digests.shape[1]), np.uint32)
    out[0::2] = HEX[digests >> np.uint32(16)]
    out[1::2] = HEX[digests & np.uint32(0xFFFF)]
    return out


def last_block(n: int) -> np.ndarray:
    """What closes a message of n blocks."""
    end = np.zeros((16, 1), np.uint32)
    end[0] = 1 << 31
    end[14:, 0] = (n << 9) >> 32, (n << 9) & 0xFFFFFFFF
    return end


def from_bytes(packed: bytes) -> np.ndarray:
    """Digests or states of 32 bytes each as (8, n)."""
    return np.ascontiguousarray(np.frombuffer(packed, ">u4").reshape(-1, 8).T.astype(np.uint32))


def to_bytes(words: np.ndarray) -> bytes:
    return words.T.astype(">u4").tobytes()
