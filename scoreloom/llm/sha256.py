"""SHA-256 over many messages at once with its chaining state in the open: a state can be kept, copied and resumed.

A digest as hex text has 64 bytes, exactly one block, so the state between two digests of a message is eight 32-bit words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


def _fractions(root: int, count: int) -> np.ndarray:
    """The first 32 fractional bits of the square (2) or cube (3) roots of the first primes: the constants of the standard."""
    out, n = [], 2
    while len(out) < count:
        if all(n % p for p in range(2, int(n**0.5) + 1)):
            whole, low, high = n << 32 * root, 0, 1 << 40
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if middle**root <= whole else (low, middle - 1)
            out.append(low & 0xFFFFFFFF)
        n += 1
    return np.array(out, np.uint32)


START, _K = _fractions(2, 8), _fractions(3, 64)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states (8, n) after one more block each; ``blocks`` is (n, 64) bytes, or (1, 64) for the same block in all."""
    words = list(np.ascontiguousarray(blocks).view(">u4").astype(np.uint32).T)
    for i in range(16, 64):
        x, y = words[i - 15], words[i - 2]
        words.append(
            words[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + words[i - 7]
            + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10)))
        )
    a, b, c, d, e, f, g, h = states
    for k, word in zip(_K, words, strict=True):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + (word + k)
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + states


def closing(n_blocks: int) -> np.ndarray:
    """The padding block of a message of ``n_blocks`` whole blocks, (1, 64)."""
    out = np.zeros((1, BLOCK), np.uint8)
    out[0, 0] = 0x80
    out[0, 56:] = np.frombuffer((n_blocks * BLOCK * 8).to_bytes(8, "big"), np.uint8)
    return out


def starts(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def digests(states: np.ndarray) -> np.ndarray:
    """Raw digests (n, 32) of closed states."""
    return np.ascontiguousarray(states.T).astype(">u4").view(np.uint8).reshape(-1, 32)


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def hex_blocks(raw: np.ndarray) -> np.ndarray:
    """Raw digests (n, 32) as lowercase hex text, (n, 64) bytes."""
    return np.stack([_HEX[raw >> 4], _HEX[raw & 15]], axis=2).reshape(-1, 64)
