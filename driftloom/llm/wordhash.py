"""64-bit hashes of all words, and of all runs of k words, of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MOD = 1 << 64
BASE = 0x9E3779B97F4A7C15 | 1
STEP = 0xD6E8FEB86659FD93 | 1
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LETTER = np.random.default_rng(20240607).integers(1, MOD - 1, 256, np.uint64)
#: Bytes hashed at a time.
BLOCK = 2 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64((seed * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) % MOD)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """base**i and base**-i modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.n = base, 0
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = n
            for name, b in (("up", self.base), ("down", pow(self.base, -1, MOD))):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))


_LETTERS, _WORDS = Powers(BASE), Powers(STEP)


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of text."""
    a = np.frombuffer(text, np.uint8)
    is_word = np.zeros(len(a) + 2, bool)
    is_word[1:-1] = IS_WORD[a]
    turn = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = turn[::2], turn[1::2]
    _LETTERS.grow(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(LETTER[a] * _LETTERS.up[: len(a)], out=total[1:])
    return start, mix((total[end] - total[start]) * _LETTERS.down[start] + (end - start).astype(np.uint64))


def blocks(texts: list[str | bytes | None], block: int = BLOCK) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(places in texts, offset of each one's first word and the end, word hashes), for some texts at a time."""
    first, size, parts = 0, 0, []

    def made(at: int):
        joined = b"\n".join(parts)
        lengths = np.array([len(p) + 1 for p in parts], np.int64)
        start, words = hashed(joined)
        return range(first, at), np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)])), words

    for i, t in enumerate(texts):
        parts.append(t if isinstance(t, bytes) else (t or "").encode())
        size += len(parts[-1])
        if size >= block:
            yield made(i + 1)
            first, size, parts = i + 1, 0, []
    if parts:
        yield made(len(texts))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _WORDS.grow(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _WORDS.up[: len(words)], out=total[1:])
    return mix((total[k:] - total[:n]) * _WORDS.down[:n], k)
