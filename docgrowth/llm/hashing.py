"""64-bit hashes of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _byte_values() -> np.ndarray:
    """A random-looking value per byte, the same for A-Z and a-z; 0 for ASCII white space."""
    b = np.arange(256, dtype=np.uint64)
    b[ord("A") : ord("Z") + 1] += np.uint64(32)
    v = mix((b + np.uint64(1)) * _R)
    v[[0x20, *range(0x09, 0x0E)]] = 0
    return v


_VALUES = _byte_values()
#: As above, and ASCII punctuation parts words too.
LETTERS = _VALUES.copy()
LETTERS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 0


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def first(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + 1)
            ones = np.ones(size, np.uint64)
            ones[1:] = _R
            cls.up = np.multiply.accumulate(ones)
            ones[1:] = _R_INVERSE
            cls.down = np.multiply.accumulate(ones)
        return cls.up[:n], cls.down[:n]


def word_hashes(texts: list[str | None], values: np.ndarray = _VALUES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For chunks of the texts, in order: the hashes of their words, and where each text's words begin (and end).

    Words are runs of bytes whose value is not 0: anything but ASCII white space, with A-Z as a-z. A word's hash is
    the difference of two prefix sums, shifted to the front by an inverse power.
    """
    at, n = 0, len(texts)
    while at < n:
        raw, size = [], 0
        while at < n and (not raw or size < CHUNK):
            raw.append((texts[at] or "").encode())
            size += len(raw[-1]) + 1
            at += 1
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        up, down = _Powers.first(len(data))
        value = values[data]
        inside = np.concatenate(([False], value != 0))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * up, dtype=np.uint64)))
        start = np.flatnonzero(inside[1:] & ~inside[:-1])
        end = np.flatnonzero(inside[:-1] & ~inside[1:])
        words = mix((sums[end] - sums[start]) * down[start] ^ (end - start).astype(np.uint64))
        begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
        yield words, np.searchsorted(start, begins)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words that begin at each place; none for the last size - 1 places."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h = (h * _R ^ words[k : n + k]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(h)
